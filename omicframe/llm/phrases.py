"""Phrase collocations of each language, counted in quotient filters of packed word-id n-grams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, dropped, numbered, tidy
from .quotient import QuotientFilter

#: Tokens of a chunk, the shard that is counted in one filter, and of a range of keys, which one task merges. They
#: bound a task's memory and decide nothing.
CHUNK, RANGE = 1_000_000, 2_000_000
TOP_ROWS = 100_000  # rows of which one task takes the first ones

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Bytes A-Z become small, the cutters become a newline, a tab becomes a space.
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _LOWER + b"\n" * 9 + b" ")


class _Ids(dict):
    """Numbers of words, in the order in which they are met, from 1."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) - 1
        return n


def _fresh() -> _Ids:
    return _Ids({b"": -1, b"\n": 0})


def _tokenized(docs: DataFrame) -> DataFrame:
    """(chunk, lang, tokens, words, counts): shards of the texts. ``tokens`` are the numbers of the words in 4 bytes
    each, 0 between two pieces; ``words`` and ``counts`` list the shard's words by number."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Ids, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (ids, parts) in held.items():
                tokens = np.concatenate(parts)
                counts = np.bincount(tokens, minlength=len(ids) - 1)[1:].astype(np.int64)
                words = pa.array(list(ids)[2:], pa.binary())
                cells = [
                    pa.array([uuid.uuid4().hex]),
                    pa.array([lang]),
                    pa.array([tokens.astype("<i4").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts)),
                ]
                yield pa.RecordBatch.from_arrays(cells, ["chunk", "lang", "tokens", "words", "counts"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids, parts = held.setdefault(lang, (_fresh(), []))
                split = text.as_py().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
                split.append(b"\n")
                tokens = np.fromiter(map(ids.__getitem__, split), np.int32, len(split))
                parts.append(tokens[tokens >= 0])
                size += len(parts[-1])
                if size >= CHUNK:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    read = docs.select("lang", F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(chunks, "chunk string, lang string, tokens binary, words array<binary>, counts array<bigint>")


def _counted(tokens: DataFrame, bits: int) -> DataFrame:
    """(lang, n, part, filter): for each chunk and length of phrase the filter of its n-grams whose words all have a
    number in the table (``known``: local number, number), cut into 2^bits ranges of the permuted keys."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, raw, known in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                own = np.frombuffer(raw.as_py(), "<i4")
                table = np.zeros(int(own.max(initial=0)) + 1, np.uint64)
                pairs = known.values.flatten()
                table[pairs[0].to_numpy()] = pairs[1].to_numpy().astype(np.uint64)
                w = table[own]
                two = w[:-1] << np.uint64(32) | w[1:]
                good = (w[:-1] > 0) & (w[1:] > 0)
                good3 = good[:-1] & good[1:]
                found = [(2, QuotientFilter.counting(two[good])), (3, QuotientFilter.counting(two[:-1][good3], w[2:][good3]))]
                for n, every in found:
                    parts = every.split(bits)
                    cells = [[lang] * len(parts), [n] * len(parts), [k for k, _ in parts], [f.to_bytes(bits) for _, f in parts]]
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, kinds)], ["lang", "n", "part", "filter"])

    return tokens.mapInArrow(count, "lang string, n int, part long, filter binary")


def _merged(filters: DataFrame, min_count: int) -> DataFrame:
    """(lang, w1, w2, w3, a) of the n-grams with a count of ``min_count`` or more; w3 is 0 for pairs. Each range of the
    keys of a language is merged by one task, shard after shard."""

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[QuotientFilter] = []
        for b in batches:
            for raw in b.column("filter"):
                held.append(QuotientFilter.from_bytes(raw.as_py()))
                if len(held) > 1 and sum(map(len, held[1:])) > max(RANGE // 4, len(held[0])):
                    held = [QuotientFilter.merged(held)]
        often = QuotientFilter.merged(held).at_least(min_count)
        pair, third = often.keys()
        n = len(often)
        cells = [
            pa.array([key[0].as_py()] * n, pa.string()),
            pa.array((pair >> np.uint64(32)).astype(np.int64)),
            pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)),
            pa.array(np.zeros(n, np.int64) if third is None else third.astype(np.int64)),
            pa.array(often.counts),
        ]
        yield pa.RecordBatch.from_arrays(cells, ["lang", "w1", "w2", "w3", "a"])

    return filters.groupBy("lang", "n", "part").applyInArrow(merge, "lang string, w1 long, w2 long, w3 long, a long")


def _first(df: DataFrame, within: str, order: list[Column], name: str, k: int, rows: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1. A task takes the first ones of some ``TOP_ROWS`` rows,
    dealt out by a hash of ``name``, and those that stay meet in ever fewer tasks; the last one has 32 times ``k``."""
    parts = -(-rows // TOP_ROWS)
    while parts > 1:
        own = W.partitionBy(within, F.pmod(F.xxhash64(name), F.lit(parts))).orderBy(*order)
        df = df.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= k).drop("_rank")
        parts = parts // 32
    return df.withColumn("rank", F.row_number().over(W.partitionBy(within).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def collocations(
    docs: DataFrame,
    min_count: int = 10,
    first: int = 2000,
    cover_percent: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of two and three words of each language that stand
    together most exclusively.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and the characters 10 to 13, and pieces into words at
    spaces and tabs. ``n`` counts the language's words, ``a`` the phrase's occurrences inside pieces. Candidates have
    ``a`` >= ``min_count``. A cut after k words gives l and r, the counts of both parts, and the score
    floor(10^6 a^2 / (l r)); the lowest one counts, ties to the smallest k. A candidate is dropped when a longer one
    holds it and has at least ``cover_percent`` percent of its occurrences. Order: score and a falling, phrase by bytes.

    Counting: shards of a million words number their own words; words with ``min_count`` occurrences get a number in
    their language's dictionary, and the shards' numbers are replaced through a join, so that no dictionary is
    broadcast. N-grams of such words (all others are too rare) are packed, two words in 64 bits and the third beside
    them, permuted invertibly and counted in a counting quotient filter of the shard; sorted filters are cut into ranges
    of the permuted keys and merged. Nothing is estimated. A language may have 2^32 - 1 words of ``min_count``.

    A null text is empty, a null language is ``und``; repeated rows count as often as they are given; texts without
    words, and tables without candidates, give no rows. Only the two named columns are read.
    """
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = cut(_tokenized(read), "phrase-chunks")
    local = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x"))
    local = local.select("chunk", "lang", (F.col("pos") + 1).alias("local"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    words = cut(local.groupBy("lang", "word").agg(F.sum("c").alias("f")), "phrase-words")
    totals = cut(words.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    often = words.where(F.col("f") >= min_count)
    ids = cut(numbered(often, ["lang"], [F.col("word")], "id").withColumn("id", F.col("id") + 1), "phrase-ids")
    known = local.drop("c").join(ids.drop("f"), ["lang", "word"]).groupBy("chunk", "lang").agg(F.collect_list(F.struct("local", "id")).alias("known"))
    most, tokens = ids.agg(F.max("id"), F.sum("f")).first()
    if (most or 0) >= 1 << 32:
        raise ValueError(f"{most} words of {min_count} occurrences in one language; 32 bits number them")
    tidy(docs.sparkSession)
    bits = max(0, ((tokens or 0) // RANGE).bit_length())
    numbers = chunks.select("chunk", "lang", "tokens").join(known, ["chunk", "lang"]).select("lang", "tokens", "known")
    grams = cut(_merged(_counted(numbers, bits), min_count), "phrase-counts")
    dropped(chunks)
    dropped(words)
    tidy(docs.sparkSession)

    pair = grams.where("w3 = 0")
    left = pair.select("lang", "w1", "w2", F.col("a").alias("a12"))
    right = pair.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("a23"))
    three = grams.where("w3 > 0").join(left, ["lang", "w1", "w2"]).join(right, ["lang", "w2", "w3"])
    holds = [three.select("lang", F.col(x).alias("w1"), F.col(y).alias("w2"), "a") for x, y in (("w1", "w2"), ("w2", "w3"))]
    covers = holds[0].union(holds[1]).groupBy("lang", "w1", "w2").agg(F.max("a").alias("cover"))
    two = pair.join(covers, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("cover") < cover_percent * F.col("a"), F.lit(True)))
    void = F.lit(None).cast("long")
    both = two.select("lang", "w1", "w2", "w3", "a", void.alias("a12"), void.alias("a23"))
    both = both.union(three.select("lang", "w1", "w2", "w3", "a", "a12", "a23"))
    for k in "123":
        own = ids.select("lang", F.col("id").alias(f"w{k}"), F.col("word").cast("string").alias(f"t{k}"), F.col("f").alias(f"f{k}"))
        both = both.join(own, ["lang", f"w{k}"], "left")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "f1", "f2", "f3", "a12", "a23")}

    def score(x: str, y: str) -> Column:
        return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide["a"] * wide["a"], wide[x] * wide[y])

    cuts = F.array(
        F.when(F.col("w3") == 0, F.struct(score("f1", "f2").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f2").alias("r"))),
        F.when(F.col("w3") > 0, F.struct(score("f1", "a23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("a23").alias("r"))),
        F.when(F.col("w3") > 0, F.struct(score("a12", "f3").alias("score"), F.lit(2).alias("k"), F.col("a12").alias("l"), F.col("f3").alias("r"))),
    )
    scored = both.withColumn("cut", F.array_min(cuts)).withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = _first(scored, "lang", order, "phrase", first, grams.count())
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Where recognition sites stand in sequences.

Enzymes are either a list, which enters the plan as an array literal, or a table of any size, which meets the text
through an equi-join on its first letters. Hits are rows, one for each place: no step holds all places of a sequence.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import spread
from ..functions.sequences import IUPAC, IUPAC_BASES, IUPAC_COMPLEMENT, ascii_slice, clean_sequence, iupac_rc, iupac_regex, match_starts

CHUNK = 2048  # letters of text that one row of the scan holds
BLOCK = 1 << 16  # letters whose matches of one probe one row of the chain walk holds
SEED = 6  # letters by which the sites of an enzyme table meet the words of the text
WORD = 8  # letters of a word: four bits each, one for each base, so a long holds a word and the next one
PAD = "-"  # stands for the end of the text and for letters that no code matches


@dataclass(frozen=True)
class Enzyme:
    """Recognition site with the two cut positions, 0-based from the start of the site."""

    name: str
    site: str
    cut5: int
    cut3: int

    @property
    def rc(self) -> str:
        return self.site.upper().translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT))[::-1]

    @property
    def palindromic(self) -> bool:
        return self.site.upper() == self.rc

    @property
    def overhang(self) -> str:
        return "blunt" if self.cut5 == self.cut3 else "5'" if self.cut5 < self.cut3 else "3'"


Enzymes = Sequence[Enzyme] | DataFrame


def site_regex(site: str) -> str:
    return "".join(b if len(b) == 1 else f"[{b}]" for b in (IUPAC_BASES[c] for c in site.upper()))


def _can_overlap(site: str) -> bool:
    """Whether two matches of the site can share bases."""
    bases = [set(IUPAC_BASES[c]) for c in site.upper()]
    n = len(bases)
    return any(all(bases[i + d] & bases[i] for i in range(n - d)) for d in range(1, n))


def _probes(enzymes: Sequence[Enzyme]) -> Column:
    """Array literal with one entry per enzyme and searched strand."""
    rows = []
    for order, e in enumerate(enzymes):
        strands = [(e.site, e.cut5, False)]
        if not e.palindromic:
            strands.append((e.rc, len(e.site) - e.cut3, True))
        for site, shift, reverse in strands:
            rows.append(
                F.struct(
                    F.lit(order).alias("enzyme_no"),
                    F.lit(e.name).alias("enzyme"),
                    F.lit(len(site)).alias("site_len"),
                    F.lit(site_regex(site)).alias("pattern"),
                    F.lit(shift).alias("shift"),
                    F.lit(reverse).alias("is_reverse"),
                    F.lit(_can_overlap(site)).alias("can_overlap"),
                )
            )
    return F.array(*rows)


def usable_enzymes(enzymes: Enzymes, min_length: int = 6) -> Enzymes:
    """Enzymes of at least ``min_length`` letters without N."""
    if isinstance(enzymes, DataFrame):
        return enzymes.where((F.length("site") >= min_length) & ~F.contains(F.upper("site"), F.lit("N")))
    return [e for e in enzymes if len(e.site) >= min_length and "N" not in e.site.upper()]


BITS = {c: sum(1 << "ACGT".index(y) for y in b) for c, b in IUPAC_BASES.items()}


def _seeds(site: str) -> list[int]:
    """The codes of all concrete texts of the first ``SEED`` letters."""
    found = [0]
    for c in site[:SEED].ljust(SEED):
        bits = [1 << i for i in range(4) if BITS[c] >> i & 1] if c in BITS else [0, 1, 2, 4, 8]
        found = [f << 4 | x for f in found for x in bits]
    return found


def _mask(site: Column) -> Column:
    """The code of the bases that each of the first ``WORD`` letters allows, 0 for those past the end."""
    digits = F.translate(site, "".join(BITS), "".join("{:X}".format(b) for b in BITS.values()))
    return F.conv(F.rpad(F.substr(digits, F.lit(1), F.lit(WORD)), WORD, "0"), 16, 10).cast("long")


def table_probes(enzymes: DataFrame) -> DataFrame:
    """(enzyme_no, enzyme, site_len, pattern, mask, shift, is_reverse, can_overlap, seed): every enzyme and searched strand,
    once for each concrete text of its first ``SEED`` letters; past the end of a shorter site any letter, or none, may
    stand. ``mask`` has the bases that its first ``WORD`` letters allow, ``pattern`` is set for longer sites only.

    ``enzymes``: (name, site, cut5, cut3), and enzyme_no to number them by something else than their name. Sites with
    letters that are no code, and empty ones, are left out; names are taken as they are, repeated ones too.
    """
    codes = F.upper("site")
    number = F.col("enzyme_no") if "enzyme_no" in enzymes.columns else F.col("name")
    n = F.length("site")
    forward = F.struct(codes.alias("site"), F.col("cut5").alias("shift"), F.lit(False).alias("is_reverse"))
    backward = F.struct(iupac_rc("site").alias("site"), (n - F.col("cut3")).alias("shift"), F.lit(True).alias("is_reverse"))
    strands = F.when(codes == iupac_rc("site"), F.array(forward)).otherwise(F.array(forward, backward))
    each = enzymes.where(F.rlike("site", F.lit(f"^[{IUPAC}{IUPAC.lower()}]+$"))).select(
        number.alias("enzyme_no"), F.col("name").alias("enzyme"), n.alias("site_len"), F.inline(strands)
    )

    @F.pandas_udf("boolean")
    def overlaps(site: pd.Series) -> pd.Series:
        return site.map(_can_overlap).astype(bool)

    @F.pandas_udf("array<long>")
    def seeds(site: pd.Series) -> pd.Series:
        return pd.Series([_seeds(s) for s in site], dtype=object)

    each = spread(each, "enzyme_no")
    return each.select(
        "enzyme_no",
        "enzyme",
        "site_len",
        F.when(F.col("site_len") > WORD, iupac_regex("site")).alias("pattern"),
        _mask(F.col("site")).alias("mask"),
        "shift",
        "is_reverse",
        overlaps("site").alias("can_overlap"),
        F.explode(seeds("site")).alias("seed"),
    )


def _texts(seqs: DataFrame, key: str, sequence: str, wrap_origin: bool, longest: Column, chunk: int) -> DataFrame:
    """(key, n, _at, _text): overlapping chunks of the cleaned sequences, each with ``longest - 1`` letters more."""
    circular = F.coalesce(F.col("is_circular"), F.lit(False)) if wrap_origin and "is_circular" in seqs.columns else F.lit(False)
    base = (
        seqs.select(key, clean_sequence(sequence, "iupac").alias("_s"), circular.alias("_circ"))
        .where(F.length("_s") > 0)
        .withColumn("n", F.length("_s"))
        .withColumn("_s", F.when(F.col("_circ"), F.concat("_s", F.substr("_s", F.lit(1), longest - 1))).otherwise(F.col("_s")))
    )
    chunks = base.withColumn("_raw", F.encode("_s", "UTF-8")).select(
        key, "n", "_s", "_raw", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk))).alias("_at")
    )
    text = F.when(F.length("_s") <= chunk, F.col("_s")).otherwise(ascii_slice(F.col("_raw"), F.col("_at"), F.lit(chunk) + longest - 1))
    # Trying every probe costs far more per base than moving the text once, so chunks are spread evenly.
    return spread(chunks.select(key, "n", "_at", text.alias("_text")), key, "_at")


HIT = ["enzyme_no", "enzyme", "site_len", "shift", "is_reverse", "can_overlap"]


def _places(seqs: DataFrame, enzymes: DataFrame, key: str, sequence: str, wrap_origin: bool, chunk: int) -> DataFrame:
    """(key, n, start, word, _before, _after, _window): every place of the cleaned sequences with the codes of its word, of
    the ``2 * WORD`` letters about it and of those from it on; the text of the longest site's size where that is over ``WORD``."""
    longest = F.coalesce(enzymes.select(F.max(F.length("site"))).scalar(), F.lit(1))
    circular = F.coalesce(F.col("is_circular"), F.lit(False)) if wrap_origin and "is_circular" in seqs.columns else F.lit(False)
    base = (
        seqs.select(key, clean_sequence(sequence, "iupac").alias("_s"), circular.alias("_circ"))
        .withColumn("n", F.length("_s"))
        .withColumn("_s", F.when(F.col("_circ"), F.concat("_s", F.substr("_s", F.lit(1), longest - 1))).otherwise(F.col("_s")))
        .withColumn("_raw", F.when(longest > WORD, F.encode("_s", "UTF-8")))
        .withColumn("_padded", F.encode(F.concat(F.lit(PAD * WORD), F.col("_s"), F.lit(PAD * 2 * WORD)), "UTF-8"))
    )
    chunks = base.select(key, "n", "_raw", "_padded", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk)))).alias("_at"))
    part = lambda c, size: F.substr(c, F.col("_at") + 1, size)
    texts = spread(chunks.select(key, "n", "_at", longest.alias("_size"), part("_raw", F.lit(chunk) + longest).alias("_raw"), part("_padded", F.lit(chunk + 3 * WORD)).alias("_padded")), key, "_at")
    bits = np.array([BITS.get(chr(c), 0) if chr(c) in "ACGT" else 0 for c in range(256)], np.uint64)

    @F.pandas_udf("array<long>")
    def codes(padded: pd.Series) -> pd.Series:
        out = []
        for letters in padded:
            code, have = bits[np.frombuffer(letters, np.uint8)], 1
            while have < 2 * WORD:
                code, have = code[:-have] << np.uint64(4 * have) | code[have:], 2 * have
            out.append(code.view(np.int64))
        return pd.Series(out, dtype=object)

    own = F.sequence(F.lit(0), F.least(F.lit(chunk), F.col("n") - F.col("_at")) - 1)
    each = texts.withColumn("_codes", codes("_padded")).select(key, "n", "_at", "_raw", "_size", "_codes", F.explode(own).alias("_i"))
    after = F.get("_codes", F.col("_i") + WORD)
    return each.select(
        key,
        "n",
        (F.col("_at") + F.col("_i")).alias("start"),
        F.shiftrightunsigned(after, 4 * WORD).alias("word"),
        F.get("_codes", F.col("_i")).alias("_before"),
        after.alias("_after"),
        F.substr("_raw", F.col("_i") + 1, F.col("_size")).cast("string").alias("_window"),
    )


def _fits(code: Column) -> Column:
    """Whether a word, in the low bits of ``code``, has bases that the probe's first letters allow."""
    return F.bit_count(code.bitwiseAND(F.col("mask"))) == F.least(F.col("site_len"), F.lit(WORD))


def _meet(words: DataFrame, enzymes: DataFrame) -> DataFrame:
    """``words`` (word, and more) with every probe that their letters allow. Spark takes the probes for as small as the
    enzymes, of which each becomes many, so they are never broadcast."""
    seed = F.shiftrightunsigned("word", 4 * (WORD - SEED))
    return words.withColumn("seed", seed).join(table_probes(enzymes).hint("merge"), "seed").where(_fits(F.col("word"))).drop("seed")


def _in_full() -> Column:
    return (F.col("site_len") <= WORD) | F.rlike("_window", F.concat(F.lit("^"), F.col("pattern")))


def _has_neighbour() -> Column:
    """Whether the match may overlap another one of its probe: no match of a short site that this leaves out does."""
    near = F.col("site_len") > WORD
    for d in range(1, WORD):
        sides = _fits(F.shiftrightunsigned("_before", 4 * d)) | _fits(F.shiftrightunsigned("_after", 4 * (WORD - d)))
        near = near | ((F.col("site_len") > d) & sides)
    return F.col("can_overlap") & near


def _table_matches(seqs: DataFrame, enzymes: DataFrame, key: str, sequence: str, wrap_origin: bool, chunk: int) -> DataFrame:
    """(key, n, *HIT, start): every match of a table's probes; ``can_overlap`` holds for those that may overlap another
    match there. Probes meet each distinct word of the texts once, and places take the probes of their word."""
    places = _places(seqs, enzymes, key, sequence, wrap_origin, chunk)
    met = _meet(places.select("word").distinct(), enzymes)
    # Spark takes the places, too, for as small as the stored texts, and would broadcast them
    return places.join(met.hint("merge"), "word").where(_in_full()).withColumn("can_overlap", _has_neighbour()).select(key, "n", *HIT, "start")


def site_totals(
    seqs: DataFrame, enzymes: DataFrame, key: str = "seq_id", sequence: str = "sequence", wrap_origin: bool = False, chunk: int = CHUNK
) -> DataFrame:
    """(enzyme_no, enzyme, is_reverse, cuts, places): number and sum of the starts of all matches, overlapping ones too, of
    each probe of a table that has any. Places are added up by their word before probes meet them, so no row is made for
    a match; with sites over ``WORD`` letters, by the text of the longest site's size."""
    places = _places(seqs, enzymes, key, sequence, wrap_origin, chunk)
    words = places.groupBy("word", "_window").agg(F.count("*").alias("_cuts"), F.sum("start").alias("_places"))
    found = _meet(words, enzymes).where(_in_full())
    return found.groupBy("enzyme_no", "enzyme", "is_reverse").agg(F.sum("_cuts").alias("cuts"), F.sum("_places").alias("places"))


def _every_match(seqs: DataFrame, enzymes: Enzymes, key: str, sequence: str, wrap_origin: bool, chunk: int) -> DataFrame:
    """(key, n, *HIT, start): every match, overlapping ones too. A start belongs to the chunk it begins in; starts past
    the end are copies of the origin."""
    if isinstance(enzymes, DataFrame):
        return _table_matches(seqs, enzymes, key, sequence, wrap_origin, chunk)
    longest = max(len(e.site) for e in enzymes)
    texts = _texts(seqs, key, sequence, wrap_origin, F.lit(longest), chunk)
    tried = texts.select(key, "n", "_at", "_text", F.inline(_probes(enzymes)))
    found = F.transform(match_starts(F.col("_text"), F.col("pattern"), F.col("site_len"), True), lambda s: s + F.col("_at"))
    own = F.filter(found, lambda s: (s < F.col("_at") + chunk) & (s < F.col("n")))
    return tried.select(key, "n", *HIT, F.explode(own).alias("start"))


def _exits(starts: list[int], size: int, begin: int, end: int) -> list[int]:
    """For each number of letters of a block that matches before it may cover, the letters of the next block that are
    covered after the leftmost walk through the block's own ``starts``."""
    out: list[int] = []
    for entry in range(size):
        free = begin + entry
        i = bisect_left(starts, free)
        while i < len(starts):
            free = starts[i] + size
            i = bisect_left(starts, free, i + 1)
        out.append(max(0, free - end))
    return out


def _leftmost(hits: DataFrame, key: str, block: int) -> DataFrame:
    """Of the matches of a probe those that the leftmost walk without overlaps takes.

    A block of ``block`` letters turns the letters that earlier matches cover at its begin into those that its own
    matches cover behind its end; such a map has as many entries as the site has letters. Maps are composed along the
    blocks, which gives every block its begin, and each block walks its own matches from there. So a task holds the
    matches of one block, or one small map for each block of a sequence (2^31 letters at most), never all matches.
    """
    wide = F.greatest(F.lit(block), F.col("site_len"))
    ids = [key, "n", *HIT]
    blocks = (
        hits.withColumn("_block", F.floor(F.col("start") / wide).cast("int"))
        .groupBy(*ids, "_block")
        .agg(F.array_sort(F.collect_list("start")).alias("starts"))
        .withColumn("_begin", (F.col("_block") * wide).cast("long"))
        .withColumn("_end", (F.col("_begin") + wide).cast("long"))
    )

    @F.pandas_udf("array<int>")
    def exits(starts: pd.Series, size: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([_exits(s.tolist(), n, b, e) for s, n, b, e in zip(starts, size, begin, end)], dtype=object)

    @F.pandas_udf("array<struct<_block:int,_entry:int>>")
    def entries(maps: pd.Series) -> pd.Series:
        out = []
        for rows in maps:
            found, last, state = [], None, 0
            for r in rows:
                state = state if last is not None and r["_block"] == last + 1 else 0
                found.append({"_block": r["_block"], "_entry": state})
                last, state = r["_block"], int(r["exits"][state])
            out.append(found)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<int>")
    def walk(starts: pd.Series, size: pd.Series, free: pd.Series) -> pd.Series:
        out = []
        for places, n, at in zip(starts, size, free):
            kept, places = [], places.tolist()
            i = bisect_left(places, at)
            while i < len(places):
                kept.append(places[i])
                i = bisect_left(places, places[i] + n, i + 1)
            out.append(kept)
        return pd.Series(out, dtype=object)

    probe = [key, "enzyme_no", "is_reverse", "enzyme"]
    mapped = blocks.select(*probe, "_block", exits("starts", "site_len", "_begin", "_end").alias("exits"))
    begun = mapped.groupBy(*probe).agg(entries(F.array_sort(F.collect_list(F.struct("_block", "exits")))).alias("e")).select(*probe, F.inline("e"))
    return blocks.join(begun, [*probe, "_block"]).select(*ids, F.explode(walk("starts", "site_len", F.col("_begin") + F.col("_entry"))).alias("start"))


def site_hits(
    seqs: DataFrame,
    enzymes: Enzymes,
    key: str = "seq_id",
    sequence: str = "sequence",
    overlapping: bool = False,
    wrap_origin: bool = False,
    chunk: int = CHUNK,
    block: int = BLOCK,
) -> DataFrame:
    """(key, n, enzyme_no, enzyme, site_len, shift, is_reverse, start): one row for each match of each probe, without
    those that overlap an earlier one of the same probe unless ``overlapping``. Results do not depend on ``chunk`` and
    ``block``."""
    hits = _every_match(seqs, enzymes, key, sequence, wrap_origin, chunk)
    listed = not isinstance(enzymes, DataFrame)
    if not overlapping and not (listed and not any(_can_overlap(s) for e in enzymes for s in (e.site, e.rc))):
        hits = hits.where(~F.col("can_overlap")).unionByName(_leftmost(hits.where("can_overlap"), key, block))
    return hits.drop("can_overlap")

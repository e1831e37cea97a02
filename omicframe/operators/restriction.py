"""Digests, enzyme profiles, cloning sites and clones, from the places of restriction sites (``operators.sites``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import ascii_slice, clean_sequence, reverse_complement_n
from .sites import BLOCK, CHUNK, Enzyme, Enzymes, site_hits, site_regex, usable_enzymes

def filter_enzymes(
    enzymes: Sequence[Enzyme],
    text: str | None = None,
    lengths: Sequence[int] | None = None,
    other_lengths: bool = False,
    overhangs: Sequence[str] | None = None,
    palindromic: bool | None = None,
) -> list[Enzyme]:
    """Enzymes by name/site text, site length (4, 6, 8 and/or others), overhang and symmetry."""

    def keep(e: Enzyme) -> bool:
        n = len(e.site)
        by_length = not lengths and not other_lengths or n in (lengths or ()) or (other_lengths and n not in (4, 6, 8))
        by_text = not text or text.upper() in e.name.upper() or text.upper() in e.site.upper()
        return by_length and by_text and (not overhangs or e.overhang in overhangs) and palindromic in (None, e.palindromic)

    return [e for e in enzymes if keep(e)]


def filter_enzyme_table(df: DataFrame, text=None, length=None, overhang=None, palindromic=None) -> DataFrame:
    """The same filters on an enzyme table (name, site, cut5, cut3)."""
    from ..functions.sequences import is_palindromic, overhang_type

    if text:
        df = df.where(F.contains(F.upper("name"), F.lit(text.upper())) | F.contains(F.upper("site"), F.lit(text.upper())))
    if length:
        df = df.where(F.length("site") == length)
    if overhang:
        df = df.where(overhang_type("cut5", "cut3") == overhang)
    if palindromic is not None:
        df = df.where(is_palindromic("site") == palindromic)
    return df


def filter_cutters(profile: DataFrame, none: bool = True, single: bool = True, multi: bool = True) -> DataFrame:
    """Enzyme profile rows by number of cuts."""
    c = F.col("cut_count")
    return profile.where(((c == 0) & F.lit(none)) | ((c == 1) & F.lit(single)) | ((c > 1) & F.lit(multi)))


def cut_sites(
    seqs: DataFrame,
    enzymes: Enzymes,
    key: str = "seq_id",
    sequence: str = "sequence",
    overlapping: bool = False,
    wrap_origin: bool = False,
    chunk: int = CHUNK,
    block: int = BLOCK,
) -> DataFrame:
    """Every cut: (key, n, enzyme_no, enzyme, recognition_start, position, is_reverse).

    Forward hits cut at start + cut5; a site that is not its own reverse complement is searched on the other
    strand as well, cutting at start + length - cut3. Matches of one probe do not overlap unless ``overlapping``;
    sites across the origin count only with ``wrap_origin`` (needs ``is_circular``). ``enzymes`` is a list or a table
    (name, site, cut5, cut3); a table numbers its enzymes by a column enzyme_no or else by their names.
    """
    hits = site_hits(seqs, enzymes, key, sequence, overlapping, wrap_origin, chunk, block)
    position = F.col("start") + F.col("shift")
    return hits.select(
        key,
        "n",
        "enzyme_no",
        "enzyme",
        "is_reverse",
        F.col("start").alias("recognition_start"),
        F.when(F.lit(wrap_origin), F.pmod(position, F.col("n"))).otherwise(position).alias("position"),
    )


def cut_counts(seqs: DataFrame, enzymes: Enzymes, key: str = "seq_id", sequence: str = "sequence", **options) -> DataFrame:
    """(key, enzyme_no, enzyme, cut_count, first_cut) of the enzymes that cut a sequence, without its positions."""
    cuts = cut_sites(seqs, enzymes, key, sequence, **options)
    return cuts.groupBy(key, "enzyme_no", "enzyme").agg(F.count("*").alias("cut_count"), F.min("position").alias("first_cut"))


def _tried(seqs: DataFrame, enzymes: Enzymes, key: str, sequence: str) -> DataFrame:
    """(key, enzyme_no, enzyme): every enzyme for every sequence that is not empty. A table's enzymes are dealt into
    buckets that each sequence asks for one by one; the pairs are the rows of the profile."""
    some = seqs.where(F.length(clean_sequence(sequence, "iupac")) > 0).select(key)
    if not isinstance(enzymes, DataFrame):
        names = F.array(*[F.struct(F.lit(i).alias("enzyme_no"), F.lit(e.name).alias("enzyme")) for i, e in enumerate(enzymes)])
        return some.select(key, F.inline(names))
    number = F.col("enzyme_no") if "enzyme_no" in enzymes.columns else F.col("name")
    dealt = enzymes.select(number.alias("enzyme_no"), F.col("name").alias("enzyme")).distinct().withColumn("_b", F.pmod(F.xxhash64("enzyme_no"), F.lit(64)))
    return some.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).join(dealt, "_b").drop("_b")


def enzyme_profile(seqs: DataFrame, enzymes: Enzymes, key: str = "seq_id", sequence: str = "sequence", **options) -> DataFrame:
    """Per sequence and enzyme: number of cuts, ascending positions, and their text (``None`` when there is none).

    The report holds all positions of a pair in one row; ``cut_sites`` has them one by one, ``cut_counts`` their number.
    """
    cuts = cut_sites(seqs, enzymes, key, sequence, **options)
    listed = cuts.groupBy(key, "enzyme_no", "enzyme").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    return (
        _tried(seqs, enzymes, key, sequence)
        .join(listed, [key, "enzyme_no", "enzyme"], "left")
        .withColumn("positions", F.coalesce("positions", F.array().cast("array<int>")))
        .withColumn("cut_count", F.size("positions"))
        .withColumn(
            "positions_text",
            F.when(F.col("cut_count") == 0, "None").otherwise(F.array_join(F.transform("positions", lambda p: p.cast("string")), ", ")),
        )
    )


def _neighbours(marks: DataFrame, key: str, block: int) -> DataFrame:
    """(key, position, enzyme, before, after, opening): each cut with the (position, enzyme) of the cuts before and after
    it, null at the ends, and of the sequence's first one. Windows hold the cuts of one block of ``block`` bases; what
    lies across a border comes from a table of the blocks' first and last cuts."""
    at = F.struct("position", "enzyme")
    placed = marks.withColumn("_block", F.floor(F.col("position") / block))
    edges = placed.groupBy(key, "_block").agg(F.min_by(at, "position").alias("_first"), F.max_by(at, "position").alias("_last"))
    w = Window.partitionBy(key).orderBy("_block")
    edges = edges.select(
        key,
        "_block",
        F.lag("_last").over(w).alias("_left"),
        F.lead("_first").over(w).alias("_right"),
        F.first("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("opening"),
    )
    w = Window.partitionBy(key, "_block").orderBy("position")
    inside = placed.withColumn("before", F.lag(at).over(w)).withColumn("after", F.lead(at).over(w))
    return (
        inside.join(edges, [key, "_block"])
        .withColumn("before", F.coalesce("before", "_left"))
        .withColumn("after", F.coalesce("after", "_right"))
        .drop("_block", "_left", "_right")
    )


def fragments(
    cuts: DataFrame, lengths: DataFrame, key: str = "seq_id", circular: bool = False, drop_outside: bool = False, block: int = BLOCK
) -> DataFrame:
    """Fragments between neighbouring distinct cuts: (key, start, end, size, enzyme5, enzyme3).

    ``lengths`` has (key, n) of every sequence; one without cuts stays whole. ``end`` is the last position.
    Linear: a cut past the end still counts as the last cut, so the tail behind the cut before it is not
    reported unless ``drop_outside`` ignores such cuts. Neighbours are found inside blocks of ``block`` bases.
    """
    valid = (F.col("position") >= 0) & ((F.col("position") <= F.col("n")) | F.lit(not circular and not drop_outside))
    marks = cuts.where(valid).groupBy(key, "position").agg(F.min_by("enzyme", "enzyme_no").alias("enzyme"))
    placed = lengths.join(_neighbours(marks, key, block), key, "left")
    pos, n = F.col("position"), F.col("n")
    if circular:
        uncut = pos.isNull()
        follow = F.coalesce("after", "opening")
        nxt = follow["position"]
        return placed.select(
            key,
            F.when(uncut, 0).otherwise(pos).alias("start"),
            F.when(uncut, n - 1).when((nxt == 0) & (pos != 0), n - 1).otherwise(nxt - 1).alias("end"),
            F.when(uncut, n).when(nxt > pos, nxt - pos).otherwise(n - pos + nxt).alias("size"),
            F.col("enzyme").alias("enzyme5"),
            F.when(~uncut, follow["enzyme"]).alias("enzyme3"),
        )
    before = F.struct(
        F.coalesce("before.position", F.lit(0)).alias("start"),
        F.coalesce(pos, n).alias("stop"),
        F.col("before.enzyme").alias("enzyme5"),
        F.col("enzyme").alias("enzyme3"),
    )
    after = F.struct(pos.alias("start"), n.alias("stop"), F.col("enzyme").alias("enzyme5"), F.lit(None).cast("string").alias("enzyme3"))
    parts = F.when(F.col("after").isNull() & pos.isNotNull(), F.array(before, after)).otherwise(F.array(before))
    return (
        placed.select(key, "n", F.inline(parts))
        .where((F.col("stop") > F.col("start")) & (F.col("stop") <= F.col("n")))
        .select(key, "start", (F.col("stop") - 1).alias("end"), (F.col("stop") - F.col("start")).alias("size"), "enzyme5", "enzyme3")
    )


def by_size(found: DataFrame, key: str = "seq_id") -> DataFrame:
    """Fragments with their 1-based ``size_rank`` in their sequence: longest first, of equal ones the earlier."""
    return found.withColumn("size_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), "start", "end")))


def digest(
    seqs: DataFrame,
    enzymes: Enzymes,
    key: str = "seq_id",
    sequence: str = "sequence",
    circular: bool = False,
    with_sequence: bool = False,
    drop_outside: bool = False,
    **options,
) -> DataFrame:
    """Fragments of every sequence under the given enzymes, with their text when ``with_sequence``.

    ``by_size`` ranks them for the report. Without texts only positions are shuffled.
    """
    cleaned = seqs.select(key, clean_sequence(sequence, "iupac").alias("_s")).where(F.length("_s") > 0)
    out = fragments(
        cut_sites(seqs, enzymes, key, sequence, **options), cleaned.select(key, F.length("_s").alias("n")), key, circular, drop_outside
    )
    if not with_sequence:
        return out
    raw = cleaned.select(key, F.encode("_s", "UTF-8").alias("_raw"))
    tail = F.greatest(F.col("start") + F.col("size") - F.length("_raw"), F.lit(0))
    text = F.concat(
        ascii_slice(F.col("_raw"), F.col("start"), F.col("size") - tail), ascii_slice(F.col("_raw"), F.lit(0), tail)
    )
    return out.join(raw, key).withColumn("fragment", text).drop("_raw")


def single_cutters(seqs: DataFrame, enzymes: Enzymes, key: str = "seq_id", sequence: str = "sequence") -> DataFrame:
    """Enzymes of at least six bases without N that cut a sequence exactly once: (key, enzyme_no, enzyme, position, site_len)."""
    hits = site_hits(seqs, usable_enzymes(enzymes), key, sequence)
    position = F.min(F.col("start") + F.col("shift"))
    found = hits.groupBy(key, "enzyme_no", "enzyme").agg(F.count("*").alias("_cuts"), position.alias("position"), F.first("site_len").alias("site_len"))
    return found.where("_cuts = 1").drop("_cuts")


def densest_window(sites: DataFrame, key: str = "seq_id", span: int = 200, min_n: int = 4, block: int = BLOCK) -> DataFrame:
    """Per sequence the first window of at most ``span`` bases with most sites (at least ``min_n``).

    A window starts at a site and takes the following sites in position order up to the first whose end lies
    beyond the span. Windows are opened in blocks of ``block`` bases (``span`` at least), which also get the sites
    of the next ``span`` bases; a site looks at the sites of the following ``span`` bases alone.
    """
    wide = max(block, span)
    home = F.floor(F.col("position") / wide)
    near = F.when(F.pmod("position", F.lit(wide)) <= span, F.array(home, home - 1)).otherwise(F.array(home))
    dealt = sites.withColumn("_home", home).withColumn("_block", F.explode(near))
    order = Window.partitionBy(key, "_block").orderBy("position").rangeBetween(0, span)
    site = F.struct("position", "enzyme_no", "enzyme", (F.col("position") + F.col("site_len")).alias("stop"))
    own = F.struct("position", "enzyme_no")
    opened = dealt.withColumn("_ahead", F.collect_list(site).over(order)).where("_home = _block")
    rest = F.array_sort(F.filter("_ahead", lambda s: F.struct(s["position"].alias("position"), s["enzyme_no"].alias("enzyme_no")) >= own))
    beyond = F.array_position(F.transform("_rest", lambda s: s["stop"] - F.col("position") > span), True)
    taken = F.when(beyond > 0, F.slice("_rest", F.lit(1), (beyond - 1).cast("int"))).otherwise(F.col("_rest"))
    window = F.struct(
        F.size("_in").alias("n_sites"),
        F.col("position").alias("first"),
        F.element_at("_in", -1)["stop"].alias("stop"),
        F.transform("_in", lambda s: s["enzyme"]).alias("enzymes"),
    )
    # most sites first, then the earlier window, then the lower enzyme number
    rank = F.struct((-F.size("_in")).alias("a"), F.col("position").alias("b"), F.col("enzyme_no").alias("c"))
    return (
        opened.withColumn("_rest", rest)
        .withColumn("_in", taken)
        .where(F.size("_in") >= min_n)
        .groupBy(key)
        .agg(F.min_by(window, rank).alias("_best"))
        .select(key, "_best.*")
    )


def detect_mcs(seqs: DataFrame, enzymes: Enzymes, key: str = "seq_id", sequence: str = "sequence") -> DataFrame:
    """Multiple cloning site: the densest window of single cutters, widened by five bases: (key, name, start, end)."""
    dense = densest_window(single_cutters(seqs, enzymes, key, sequence), key)
    n = seqs.select(key, F.length(clean_sequence(sequence, "iupac")).alias("n"))
    return dense.join(n, key).select(
        key,
        F.concat(F.lit("MCS ("), F.array_join(F.slice("enzymes", 1, 6), ", "), F.lit(")")).alias("name"),
        F.greatest(F.lit(0), F.col("first") - 5).alias("start"),
        F.least(F.col("n"), F.col("stop") + 5).alias("end"),
        "n_sites",
    )


def cloning_sites(vectors: DataFrame, inserts: DataFrame, pairs: DataFrame, enzymes: Enzymes, mcs: DataFrame | None = None) -> DataFrame:
    """For each (vector_id, insert_id): enzymes that cut the vector once and the insert never, by position.

    ``in_mcs`` marks positions inside the vector's multiple cloning site (seq_id, start, end).
    """
    usable = usable_enzymes(enzymes)
    single = single_cutters(vectors, usable).withColumnRenamed("seq_id", "vector_id")
    hit = cut_sites(inserts, usable).select(F.col("seq_id").alias("insert_id"), "enzyme").distinct()
    out = pairs.join(single, "vector_id").join(hit, ["insert_id", "enzyme"], "left_anti")
    if mcs is None:
        return out.withColumn("in_mcs", F.lit(False))
    m = mcs.select(F.col("seq_id").alias("vector_id"), F.col("start").alias("_ms"), F.col("end").alias("_me"))
    return (
        out.join(m, "vector_id", "left")
        .withColumn("in_mcs", F.coalesce(F.col("position").between(F.col("_ms"), F.col("_me")), F.lit(False)))
        .drop("_ms", "_me")
    )


def clone_inserts(requests: DataFrame, vectors: DataFrame, inserts: DataFrame, enzymes: Enzymes) -> DataFrame:
    """Splice inserts: ``requests`` has (vector_id, insert_id, enzyme, reverse); vectors not cut exactly once drop out.

    Sequences are used as stored; the insert is reverse-complemented when ``reverse``.
    """
    once = cut_counts(vectors, enzymes).where("cut_count = 1").select(F.col("seq_id").alias("vector_id"), "enzyme", F.col("first_cut").alias("cut"))
    v = vectors.select(F.col("seq_id").alias("vector_id"), F.col("sequence").alias("_v"), "is_circular")
    i = inserts.select(F.col("seq_id").alias("insert_id"), F.col("sequence").alias("_i"))
    piece = F.when(F.col("reverse"), reverse_complement_n("_i")).otherwise(F.col("_i"))
    return (
        requests.join(once, ["vector_id", "enzyme"])
        .join(v, "vector_id")
        .join(i, "insert_id")
        .withColumn("_piece", piece)
        .select(
            "vector_id",
            "insert_id",
            "enzyme",
            "reverse",
            "cut",
            F.length("_piece").alias("insert_len"),
            F.concat(F.substr("_v", F.lit(1), F.col("cut")), "_piece", F.substr("_v", F.col("cut") + 1, F.length("_v"))).alias("sequence"),
            "is_circular",
        )
    )


def clone_features(clones: DataFrame, features: DataFrame, insert_names: DataFrame) -> DataFrame:
    """Features of the clones: vector features at or after the cut move by the insert; the insert is added as a gene."""
    keys = ["vector_id", "insert_id", "enzyme", "reverse"]
    moved = F.when(F.col("start") >= F.col("cut"), F.col("insert_len")).otherwise(0)
    kept = (
        clones.select(*keys, "cut", "insert_len")
        .join(features.withColumnRenamed("seq_id", "vector_id"), "vector_id")
        .select(*keys, "name", "type", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"), "is_reverse")
    )
    added = clones.join(insert_names.select(F.col("seq_id").alias("insert_id"), F.col("name").alias("_n")), "insert_id").select(
        *keys,
        F.concat("_n", F.lit(" insert"), F.when(F.col("reverse"), " (rev)").otherwise("")).alias("name"),
        F.lit("Gene").alias("type"),
        F.col("cut").alias("start"),
        (F.col("cut") + F.col("insert_len")).alias("end"),
        F.col("reverse").alias("is_reverse"),
    )
    return kept.unionByName(added)


def ends_compatible(dir1: Column, overhang1: Column, dir2: Column, overhang2: Column, opposite_direction: bool = True) -> Column:
    """Whether two ends can be joined: both blunt, or overhangs that are each other's reverse complement.

    Sticky ends need different overhang directions (the reference's rule); ``opposite_direction=False`` asks for
    equal ones.
    """
    blunt1 = (dir1 == "none") | (F.coalesce(overhang1, F.lit("")) == "")
    blunt2 = (dir2 == "none") | (F.coalesce(overhang2, F.lit("")) == "")
    direction = (dir1 != dir2) if opposite_direction else (dir1 == dir2)
    partner = F.reverse(F.translate(F.upper(overhang2), "ACGT", "TGCA"))
    fits = (F.upper(overhang1) == partner) & F.rlike(F.upper(overhang1), F.lit("^[ACGT]+$"))
    return F.when(blunt1 & blunt2, True).when(blunt1 | blunt2, False).otherwise(direction & fits)


def compatible_ends(ends: DataFrame, opposite_direction: bool = True) -> DataFrame:
    """Compatible kinds of ends in a table (direction, overhang), with how many ends are of each kind.

    Ends are counted per kind before they meet, and kinds meet on the overhang they need, so the result stays
    as small as the number of different overhangs.
    """
    blunt = (F.col("direction") == "none") | (F.coalesce("overhang", F.lit("")) == "")
    kinds = (
        ends.select(
            F.when(blunt, "none").otherwise(F.col("direction")).alias("direction"),
            F.when(blunt, "").otherwise(F.upper("overhang")).alias("overhang"),
        )
        .groupBy("direction", "overhang")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    left = kinds.select(F.col("direction").alias("direction_1"), F.col("overhang").alias("overhang_1"), F.col("n").alias("n_1"))
    right = kinds.select(
        F.col("direction").alias("direction_2"),
        F.col("overhang").alias("overhang_2"),
        F.col("n").alias("n_2"),
        F.reverse(F.translate("overhang", "ACGT", "TGCA")).alias("overhang_1"),
    )
    once = F.struct("direction_1", "overhang_1") <= F.struct("direction_2", "overhang_2")
    fit = ends_compatible(F.col("direction_1"), F.col("overhang_1"), F.col("direction_2"), F.col("overhang_2"), opposite_direction)
    return left.join(right, "overhang_1").where(once & fit)

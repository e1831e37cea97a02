"""Guide candidates inside coding parts and their frameshift effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import spread
from ..functions.sequences import ascii_slice, gc_percent, match_starts, reverse_complement_n
from .intervals import exon_of, to_cds

# The recognised PAM patterns and the stop codons.
PAM_CLASSES = {"NGG": "[ACGT]GG", "NAG": "[ACGT]AG"}
STOP_CODONS = ("TAA", "TAG", "TGA")


def is_recommended(guide: Column | str) -> Column:
    """Starts with G, ends with A, GC between 40 and 60 percent."""
    g = F.col(guide) if isinstance(guide, str) else guide
    return F.startswith(g, F.lit("G")) & F.endswith(g, F.lit("A")) & gc_percent(g).between(40, 60)


def guide_candidates(
    seqs: DataFrame,
    cds: DataFrame,
    exons: DataFrame,
    pam: str = "NGG",
    length: int = 20,
    overlapping: bool = False,
    key: str = "seq_id",
    sequence: str = "sequence",
) -> DataFrame:
    """Guides of ``length`` bases followed by the PAM on both strands of every coding part.

    Positions are 1-based on the forward strand. Matches on one strand of a part do not overlap unless
    ``overlapping`` (the reference lists the non-overlapping ones).
    """
    size = length + len(pam)
    pattern = F.lit(f"[ACGT]{{{length}}}{PAM_CLASSES[pam]}")
    parts = (
        cds.join(seqs.select(key, F.col(sequence).alias("_s"), F.length(sequence).alias("_n")), key)
        .where((F.col("start") >= 1) & (F.col("start") <= F.col("_n")))
        .withColumn("_at", F.col("start") - 1)
        .withColumn("_len", F.least(F.col("end"), F.col("_n")) - F.col("_at"))
        .select(key, "part", "_at", "_len", ascii_slice(F.encode("_s", "UTF-8"), F.col("_at"), F.col("_len")).alias("_p"))
    )
    strands = spread(parts, key, "part").select(
        key,
        "part",
        "_at",
        "_len",
        F.inline(
            F.array(
                F.struct(F.lit("+").alias("strand"), F.col("_p").alias("_text")),
                F.struct(F.lit("-").alias("strand"), reverse_complement_n("_p").alias("_text")),
            )
        ),
    )
    hits = strands.withColumn("_raw", F.encode("_text", "UTF-8")).select(
        key,
        "part",
        "_at",
        "_len",
        "strand",
        F.inline(
            F.transform(
                match_starts(F.col("_text"), pattern, F.lit(size), overlapping),
                lambda i: F.struct(i.alias("_i"), ascii_slice(F.col("_raw"), i, F.lit(size)).alias("_hit")),
            )
        ),
    )
    position = F.when(F.col("strand") == "+", F.col("_at") + F.col("_i") + 1).otherwise(
        F.col("_at") + F.col("_len") - F.col("_i") - size + 1
    )
    guides = hits.select(
        key,
        "part",
        F.substr("_hit", F.lit(1), F.lit(length)).alias("guide"),
        F.substr("_hit", F.lit(length + 1), F.lit(len(pam))).alias("pam"),
        position.alias("position"),
        "strand",
    ).withColumn("position_end", F.col("position") + size - 1)
    return (
        exon_of(guides, exons, "position", key)
        .withColumn("gc", gc_percent("guide"))
        .withColumn("is_recommended", is_recommended("guide"))
    )


def cds_sequences(seqs: DataFrame, cds: DataFrame, key: str = "seq_id", sequence: str = "sequence") -> DataFrame:
    """Joined coding sequence (parts by start; parts outside the sequence are left out) and protein length."""
    parts = cds.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_parts"))
    raw = F.col("_raw")
    joined = (
        seqs.select(key, F.encode(sequence, "UTF-8").alias("_raw"))
        .join(parts, key)
        .withColumn(
            "cds",
            F.array_join(
                F.transform(
                    F.filter("_parts", lambda p: (p["start"] >= 1) & (p["end"] <= F.length(raw))),
                    lambda p: ascii_slice(raw, p["start"] - 1, p["end"] - p["start"] + 1),
                ),
                "",
            ),
        )
    )
    codons = F.floor(F.length("cds") / 3).cast("int")
    return joined.select(key, "cds", F.when(codons > 0, codons - 1).otherwise(0).alias("protein_length"))


def protein_length_after_insertion(cds: Column, site: Column, bases: int) -> Column:
    """Residues before the first stop when ``bases`` unknown bases are inserted at a 0-based CDS position.

    Translation starts at the codon of the site; a codon with an unknown base counts as a residue. NULL when the
    site lies outside.
    """
    before = F.floor(site / 3).cast("int")
    tail = F.concat(
        F.substr(cds, before * 3 + 1, site - before * 3), F.lit("N" * bases), F.substr(cds, site + 1, F.length(cds))
    )
    codons = F.regexp_extract_all(tail, F.lit("(...)"), 1)
    stop = F.array_position(F.transform(codons, lambda c: c.isin(*STOP_CODONS)), True)
    read = F.when(stop > 0, (stop - 1).cast("int")).otherwise(F.size(codons))
    return F.when((site >= 0) & (site < F.length(cds)), before + read)


def frameshift(guides: DataFrame, seqs: DataFrame, cds: DataFrame, key: str = "seq_id", sequence: str = "sequence") -> DataFrame:
    """Add the cleavage site in the CDS (-1 outside) and the loss in residues and percent after +1 and +2 insertions."""
    cut = F.when(F.col("strand") == "+", F.col("position") + F.length("guide") - 4).otherwise(
        F.col("position") + F.length("pam") + 2
    )
    placed = to_cds(guides.withColumn("_cut", cut), cds, "_cut", key, "cleavage_site")
    out = placed.join(cds_sequences(seqs, cds, key, sequence), key)
    for n in (1, 2):
        out = out.withColumn(
            f"loss_plus{n}", F.col("protein_length") - protein_length_after_insertion(F.col("cds"), F.col("cleavage_site"), n)
        ).withColumn(f"loss_percent_plus{n}", F.try_divide(F.col(f"loss_plus{n}") * 100.0, F.col("protein_length")))
    return out.drop("_cut", "cds")

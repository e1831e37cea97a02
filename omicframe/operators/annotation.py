"""Feature annotation of constructs by similarity to known probes.

Constructs are plasmid-sized rows. One small Arrow function compares a batch of sequences with the probes (built-in
higher-order functions can express it but took fifty times as long); thresholds, placing, the choice of strand and
the exclusion of known features are DataFrame work on the few hits. Sequence text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import spread
from ..functions.sequences import ascii_upper, reverse_complement_n


@dataclass(frozen=True)
class Probe:
    """Named feature with its typical length and one or more marker sequences."""

    name: str
    type: str
    length: int
    variants: tuple[str, ...]

    @property
    def min_similarity(self) -> float:
        return 0.92 if self.length < 30 else 0.83


# Well-known promoters, reporters and tags with their marker sequences.
KNOWN_PROBES: list[Probe] = [
    Probe("CMV promoter", "Promoter", 580, (
        "GACATTGATTATTGACTAGTTATTAATAGTAATCAATTACGGGGTCATTAGTTCATAGCCC",
        "CATTGACGTCAATAATGACGTATGTTCCCATAGTAACGCCAATAGGGACTTTCCATTGACG",
        "CATCAAGTGTATCATATGCCAAGTACGCCCCCTATTGACGTCAATGACGG")),
    Probe("SV40 promoter", "Promoter", 340, (
        "ATCTCTATCACTGATAGGGAGTGGTAAACTCGACTTTAAAAGT",
        "GCCCAGTCTCTCATCTACTTTCATCCACAGTTGGCACC")),
    Probe("T7 promoter", "Promoter", 25, ("TAATACGACTCACTATAGGG",)),
    Probe("T3 promoter", "Promoter", 25, ("AATTAACCCTCACTAAAGGG",)),
    Probe("SP6 promoter", "Promoter", 25, ("ATTTAGGTGACACTATAGAA",)),
    Probe("lac promoter", "Promoter", 80, (
        "TTTACACTTTATGCTTCCGGCTCGTATGTTGTGTGG",
        "AATTGTGAGCGGATAACAATTTCACACAGG")),
    Probe("CAG promoter", "Promoter", 400, ("CTCTAGAGCCTCTGCTAACCATGTTCATGCCTTCTTCTTTTTCCTACAG",)),
    Probe("EF-1α promoter", "Promoter", 250, ("AACTTCTTTGGCTATGCGGGTGATGCTTTTTCCCTGT",)),
    Probe("EGFP", "Reporter", 720, (
        "ATGGTGAGCAAGGGCGAGGAGCTGTTCACCGGGGTGGTGCCCATCCTGGTCGAGCTGGAC",
        "GGCAAGCTGCCCGTGCCCTGGCCCACCCTCGTGACCACCCTGACCTACGGCGTGCAGTGC")),
    Probe("mCherry", "Reporter", 711, ("ATGGTGAGCAAGGGCGAGGAGGATAACATGGCCATCATCAAGGAGTTCATGCGCTTCAAG",)),
    Probe("tdTomato", "Reporter", 1431, ("ATGGTGAGCAAGGGCGAGGAGGTCATCAAAGAGTTCATGCGCTTCAAGGTGCGCATGGAG",)),
    Probe("Firefly luciferase", "Reporter", 1650, (
        "ATGGAAGACGCCAAAAACATAAAGAAAGGCCCGGCGCCATTCTATCCTCTAGAGGATGGAA",
        "GAAGACATTCTTGGACAAATAGCTTACTACATCCTCGATATGCTGTCCCTTCTATGCCCGG")),
    Probe("Renilla luciferase", "Reporter", 936, ("ATGACTTCGAAAGTTTATGATCCAGAACAAAGGAAACGGATGATAACTGGTCCGCAGTGG",)),
    Probe("NanoLuc", "Reporter", 513, ("ATGGTCTTCACACTCGAAGATTTCGTTGGGGACTGGCGACAGACAGCCG",)),
    Probe("lacZ-alpha", "Reporter", 400, ("ATGACCATGATTACGCCAAGCTTGCATGCCTGCAGGTCGACTCTAGAGGATCCC",)),
    Probe("His-tag", "Tag", 24, ("CACCATCACCATCACCAC", "CATCATCATCATCATCAT", "CATCACCATCACCATCAC")),
    Probe("FLAG-tag", "Tag", 30, ("GACTACAAAGACGATGACGATAAA", "GATTACAAGGATGACGACGATAAG")),
    Probe("Myc-tag", "Tag", 36, ("GAACAAAAACTCATCTCAGAAGAGGATCTG", "GAGCAGAAACTCATCTCTGAAGAGGATCTG")),
    Probe("HA-tag", "Tag", 30, ("TACCCATACGATGTTCCAGATTACGCT", "TACCCCTACGACGTGCCCGACTACGCC")),
    Probe("V5-tag", "Tag", 45, ("GGTAAGCCTATCCCTAACCCTCTCCTCGGTCTCGATTCTACG",)),
    Probe("GST", "Tag", 660, ("ATGTCCCCTATACTAGGTTATTGGAAAATTAAGGGCCTTGTGCAACCCACTCGAC",)),
    Probe("MBP", "Tag", 1100, ("ATGAAAATCGAAGAAGGTAAACTGGTAATCTGGATTAACGGCGATAAAGGCTATAACGGT",)),
    Probe("Strep-tag II", "Tag", 27, ("TGGAGCCACCCGCAGTTCGAAAAA",)),
    Probe("SUMO", "Tag", 300, ("ATGTCGGACTCAGAAGTCAATCAAGAAGCTAAGCCAGAGGTCAAGCCAG",)),
]

SEED = 8


_HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("probe_no", T.IntegerType()),
            T.StructField("is_reverse", T.BooleanType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("at", T.IntegerType()),
            T.StructField("size", T.IntegerType()),
        ]
    )
)


def _starts(text: str, marker: str) -> np.ndarray | None:
    """Starts the seeded search looks at: near each hit of the marker's first letters, then in steps behind the last hit.
    None where there is no hit, which leaves the steps alone."""
    last, seed, near, resume = len(text) - len(marker), marker[:SEED], [], 0
    while resume <= last and (hit := text.find(seed, resume)) >= 0:
        near.append(np.arange(max(0, hit - 5), min(last, hit + 5) + 1))
        resume = hit + 1
    if not near:
        return None
    return np.unique(np.concatenate([*near, np.arange(resume, last + 1, max(1, len(marker) // 3))]))


def _best_places(texts: list[str], whole: str, marker: str) -> tuple[np.ndarray, np.ndarray]:
    """Per text the best similarity and its first position among the starts the seeded search looks at (0 and -1 where
    there is none). ``whole`` holds the texts one behind the other."""
    size, step = len(marker), max(1, len(marker) // 3)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.cumsum(n) - n
    count = np.maximum((n - size) // step + 1, 0)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    owner, at = np.repeat(np.arange(len(texts)), count), at * step
    hits = {i: found for i, t in enumerate(texts) if marker[:SEED] in t and (found := _starts(t, marker)) is not None}
    if hits:
        plain = ~np.isin(owner, list(hits))
        owner = np.concatenate([owner[plain], *[np.full(len(f), i) for i, f in hits.items()]])
        at = np.concatenate([at[plain], *hits.values()])
    best, place = np.zeros(len(texts)), np.full(len(texts), -1)
    if not len(at):
        return best, place
    bases = np.frombuffer(whole.encode("ascii", "replace"), dtype=np.uint8)
    same, begin = np.zeros(len(at), dtype=np.int32), first[owner] + at
    for i, code in enumerate(marker.encode()):
        letter = bases[begin + i]
        same += (letter == code) | (letter == ord("N"))
    order = np.lexsort((at, -same, owner))
    owner, lead = np.unique(owner[order], return_index=True)
    best[owner], place[owner] = same[order][lead] / size, at[order][lead]
    return best, place


LETTERS = 1 << 18  # of text that are searched at once


def _search(probes: Sequence[Probe]):
    """Arrow function: sequence text -> best place per probe and strand that reaches the probe's similarity."""
    table = [(i, p.min_similarity, p.variants) for i, p in enumerate(probes)]

    def places(texts: list[str], is_reverse: bool, out: list[list[dict]]) -> None:
        whole = "".join(texts)
        for no, floor, variants in table:
            best, at, size = np.zeros(len(texts)), np.full(len(texts), -1), np.zeros(len(texts), dtype=int)
            for marker in variants:
                similarity, start = _best_places(texts, whole, marker)
                better = similarity > best
                best[better], at[better], size[better] = similarity[better], start[better], len(marker)
            for i in np.flatnonzero((at >= 0) & (best >= floor)):
                out[i].append(
                    {"probe_no": no, "is_reverse": is_reverse, "similarity": float(best[i]), "at": int(at[i]), "size": int(size[i])}
                )

    @F.pandas_udf(_HITS)
    def search(forward: pd.Series, reverse: pd.Series) -> pd.Series:
        found: list[list[dict]] = []
        if not len(forward):
            return pd.Series(found, dtype=object)
        share = forward.str.len().cumsum().to_numpy() // LETTERS
        for rows in np.split(np.arange(len(forward)), np.flatnonzero(np.diff(share)) + 1):
            out: list[list[dict]] = [[] for _ in rows]
            for is_reverse, column in ((False, forward), (True, reverse)):
                places(column.iloc[rows].tolist(), is_reverse, out)
            found += out
        return pd.Series(found)

    return search


def annotate_features(
    constructs: DataFrame,
    probes: Sequence[Probe] = KNOWN_PROBES,
    existing: DataFrame | None = None,
    key: str = "seq_id",
    sequence: str = "sequence",
) -> DataFrame:
    """Best place of every probe on every construct of at least 50 bases: (key, name, type, start, end, is_reverse, similarity).

    Both strands are searched and the better one wins (the forward one on a tie). The feature is centred on the
    marker with the probe's length. A probe is skipped when ``existing`` already names it.
    """
    literal = F.array(
        *[F.struct(F.lit(p.name).alias("name"), F.lit(p.type).alias("type"), F.lit(p.length).alias("length")) for p in probes]
    )
    text = spread(constructs.select(key, ascii_upper(sequence).alias("_f")).where(F.length("_f") >= 50), key)
    found = text.select(key, F.length("_f").alias("n"), _search(probes)("_f", reverse_complement_n("_f")).alias("_hits"))
    hits = found.select(key, "n", F.inline("_hits")).withColumn("_p", literal[F.col("probe_no")])
    centre = F.col("at") + F.floor(F.col("size") / 2)
    half = F.floor(F.col("_p.length") / 2)
    s, e = F.greatest(F.lit(0), centre - half), F.least(F.col("n"), centre + half)
    placed = hits.select(
        key,
        "probe_no",
        F.col("_p.name").alias("name"),
        F.col("_p.type").alias("type"),
        F.when(F.col("is_reverse"), F.col("n") - e).otherwise(s).cast("int").alias("start"),
        F.when(F.col("is_reverse"), F.col("n") - s).otherwise(e).cast("int").alias("end"),
        "is_reverse",
        "similarity",
    )
    winner = placed.groupBy(key, "probe_no").agg(
        F.max(F.struct("similarity", (~F.col("is_reverse")).alias("_fwd"), "name", "type", "start", "end", "is_reverse")).alias("_w")
    )
    out = winner.select(key, "probe_no", *[F.col(f"_w.{c}").alias(c) for c in ("name", "type", "start", "end", "is_reverse", "similarity")])
    if existing is not None:
        named = existing.select(key, F.lower("name").alias("_e")).distinct()
        first_word = F.substring_index(F.lower("name"), " ", 1)
        clash = out.join(named, key).where(
            F.contains("_e", first_word) | F.contains(F.lower("name"), F.col("_e"))
        ).select(key, "probe_no").distinct()
        out = out.join(clash, [key, "probe_no"], "left_anti")
    return out.drop("probe_no")

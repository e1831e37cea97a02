"""Nucleotide text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Name, as_col

# IUPAC codes, their complements, and the bases each code stands for.
IUPAC = "ACGTRYMKSWHDBVN"
IUPAC_COMPLEMENT = "TGCAYRKMSWDHVBN"
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT",
    "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT", "N": "ACGT",
}


def ascii_upper(s: Name) -> Column:
    """Upper-case the letters a-z only (full upper-casing would turn a sharp s into two letters)."""
    return F.translate(as_col(s), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _translate(s: Column, known: str, to: str, unknown: str) -> Column:
    """Map the known letters; everything else becomes ``unknown``."""
    return F.translate(F.regexp_replace(s, f"(?s)[^{known}{unknown}]", unknown), known, to)


def complement(s: Name, kind: str = "dna") -> Column:
    """Base by base; U and T are both understood, N stays, any other character becomes ``?``."""
    target = "TGCANA" if kind == "dna" else "UGCANA"
    source = "ACGTNU" if kind == "dna" else "ACGUNT"
    return _translate(as_col(s), source, target, "?")


def reverse_complement(s: Name, kind: str = "dna") -> Column:
    """Complement of the reversed text; the other nucleic acid's base (U for DNA, T for RNA) becomes ``?``."""
    source, target = ("ACGTN", "TGCAN") if kind == "dna" else ("ACGUN", "UGCAN")
    return F.reverse(_translate(as_col(s), source, target, "?"))


def reverse_complement_n(s: Name) -> Column:
    """DNA reverse complement; anything but A, C, G, T becomes N."""
    return F.reverse(F.translate(F.regexp_replace(as_col(s), "(?s)[^ACGT]", "N"), "ACGT", "TGCA"))


def iupac_rc(s: Name) -> Column:
    """Reverse complement over the fifteen IUPAC codes, upper-cased; other characters stay."""
    return F.reverse(F.translate(F.upper(as_col(s)), IUPAC, IUPAC_COMPLEMENT))


def iupac_regex(s: Name) -> Column:
    """Regular expression of an IUPAC pattern: one character class per degenerate code."""
    out = F.upper(as_col(s))
    # Codes become marks first, so that letters of an inserted class are not replaced again.
    degenerate = [c for c in IUPAC if len(IUPAC_BASES[c]) > 1]
    out = F.translate(out, "".join(degenerate), "".join(chr(0xE000 + i) for i in range(len(degenerate))))
    for i, c in enumerate(degenerate):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(f"[{IUPAC_BASES[c]}]"))
    return out


def clean_sequence(s: Name, alphabet: str = "dna") -> Column:
    """Upper-case and keep only A, C, G, T (``dna``) or the fifteen IUPAC codes (``iupac``)."""
    keep = "ACGT" if alphabet == "dna" else IUPAC
    # Dropping first leaves plain letters, which upper-case cheaply and without surprises.
    return F.upper(F.regexp_replace(as_col(s), f"(?s)[^{keep}{keep.lower()}]+", ""))


def gc_percent(s: Name, digits: int | None = None) -> Column:
    """100 * (G + C) / length, 0 for empty text; with ``digits`` rounded half-to-even."""
    s = as_col(s)
    n = F.length(s)
    gc = F.length(F.regexp_replace(s, "(?s)[^GC]", ""))
    value = F.when(n > 0, 100.0 * gc / n).otherwise(0.0)
    return value if digits is None else F.bround(value, digits)


def overhang_type(cut5: Name, cut3: Name) -> Column:
    c5, c3 = as_col(cut5), as_col(cut3)
    return F.when(c5 == c3, "blunt").when(c5 < c3, "5'").otherwise("3'")


def overhang_seq(site: Name, cut5: Name, cut3: Name) -> Column:
    """Site text between the two cuts; empty for blunt ends and for cuts outside the site."""
    site, c5, c3 = as_col(site), as_col(cut5), as_col(cut3)
    lo, hi = F.least(c5, c3), F.greatest(c5, c3)
    return F.when((c5 != c3) & (lo >= 0) & (hi <= F.length(site)), F.substr(site, lo + 1, hi - lo)).otherwise("")


def is_palindromic(site: Name) -> Column:
    return F.upper(as_col(site)) == iupac_rc(site)


def circular_substring(s: Name, start: Name, end: Name, circular: Name) -> Column:
    """0-based half-open slice; on a circular sequence an end at or before the start runs over the origin."""
    s, start, end, circular = as_col(s), as_col(start), as_col(end), as_col(circular)
    return (
        F.when(end > start, F.substr(s, start + 1, end - start))
        .when(circular, F.concat(F.substr(s, start + 1, F.length(s)), F.substr(s, F.lit(1), end)))
        .otherwise("")
    )


def ascii_slice(raw: Column, start: Column, size: Column) -> Column:
    """Slice of a *binary* column as text, 0-based. Cutting bytes is constant-time; cutting a string counts characters."""
    return F.decode(F.substr(raw, (start + 1).cast("int"), size.cast("int")), "UTF-8")


def match_starts(text: Column, pattern: Column, size: Column, overlapping: bool) -> Column:
    """0-based starts of a fixed-length regex in ``text``, found with one linear split.

    Non-overlapping: leftmost matches, each search going on after the last match. Overlapping: every start.
    """
    if overlapping:
        pieces = F.split(text, F.concat(F.lit("(?="), pattern, F.lit(")")), -1)
        first = F.when(F.rlike(text, F.concat(F.lit("^"), pattern)), F.array(F.lit(0))).otherwise(
            F.array().cast("array<int>")
        )
        step = F.lit(0)
    else:
        pieces = F.split(text, pattern, -1)
        first = F.array().cast("array<int>")
        step = size
    # Every piece but the last ends where a match begins; the entry of the last piece is cut off at the end.
    return F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), first.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p) + step).alias("at"),
            F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out"),
        ),
        lambda acc: F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1),
    )

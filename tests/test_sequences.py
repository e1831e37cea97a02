"""Sequence, primer and gating operators against brute force written from their definitions."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from omicframe.functions import oligos as og
from omicframe.functions import sequences as sq
from omicframe.operators import annotation, gating, guides, intervals, primers, restriction as rs

RNG = random.Random(11)
COMP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(COMP)[::-1]


def dna(n, rng=RNG):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_text_functions(spark):
    s = spark.createDataFrame([("AUGTNX?",)], "s string").select(
        sq.complement("s").alias("d"), sq.complement("s", "rna").alias("r"), sq.reverse_complement("s").alias("rd"),
        sq.reverse_complement("s", "rna").alias("rr"), sq.reverse_complement_n("s").alias("n"), sq.iupac_regex(F.lit("GRNc")).alias("p"),
    ).collect()[0]
    assert (s["d"], s["r"], s["rd"], s["rr"], s["n"]) == ("TACAN??", "UACAN??", "??NAC?T", "??N?CAU", "NNNACNT")
    assert s["p"] == "G[AG][ACGT]C"


def brute_sites(seq, e):
    out = []
    for site, shift, rev in [(e.site, e.cut5, False)] + ([] if e.palindromic else [(e.rc, len(e.site) - e.cut3, True)]):
        out += [(m.start(), m.start() + shift, rev) for m in re.finditer(rs.site_regex(site), seq)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [7, 64, 65_536])
def test_cut_sites_do_not_depend_on_chunks(spark, chunk):
    seqs = [(i, dna(300) + "A" * 40 + "ATATATATA" + dna(50)) for i in range(4)] + [(9, "ACG"), (10, "")]
    enzymes = [rs.Enzyme("aa", "AA", 1, 1), rs.Enzyme("atat", "ATAT", 2, 2), rs.Enzyme("far", "GAAGA", 13, 12), rs.Enzyme("deg", "RGCY", 1, 3), rs.Enzyme("neg", "CNC", -2, 5)]
    df = spark.createDataFrame(seqs, "seq_id int, sequence string")
    got = {}
    for r in rs.cut_sites(df, enzymes, chunk=chunk).collect():
        got.setdefault((r["seq_id"], r["enzyme"]), []).append((r["recognition_start"], r["position"], r["is_reverse"]))
    for i, s in seqs:
        for e in enzymes:
            assert sorted(got.get((i, e.name), [])) == brute_sites(s, e)
    every = rs.cut_sites(df, enzymes[:1], overlapping=True, chunk=chunk).where(~F.col("is_reverse")).groupBy("seq_id").count().collect()
    assert {r["seq_id"]: r["count"] for r in every} == {i: sum(s.startswith("AA", k) for k in range(len(s))) for i, s in seqs if "AA" in s}


def test_wrap_origin(spark):
    df = spark.createDataFrame([(1, "TTCCCCGAA", True), (2, "TTCCCCGAA", False)], "seq_id int, sequence string, is_circular boolean")
    e = [rs.Enzyme("EcoRI", "GAATTC", 1, 5)]
    assert rs.cut_sites(df, e).count() == 0
    hit = rs.cut_sites(df, e, wrap_origin=True).collect()
    assert [(r["seq_id"], r["recognition_start"], r["position"]) for r in hit] == [(1, 6, 7)]


def test_digest_sizes(spark):
    seqs = [(i, dna(400)) for i in range(6)] + [(7, "CCC")]
    df = spark.createDataFrame(seqs, "seq_id int, sequence string")
    e = [rs.Enzyme("x", "AGCT", 2, 2), rs.Enzyme("y", "CC", 1, 1)]
    for circular in (False, True):
        sums = {r["seq_id"]: r["s"] for r in rs.digest(df, e, circular=circular).groupBy("seq_id").agg(F.sum("size").alias("s")).collect()}
        assert sums == {i: len(s) for i, s in seqs}
    text = rs.digest(df, e, circular=True, with_sequence=True).where("seq_id = 3").orderBy("start").collect()
    joined = "".join(r["fragment"] for r in text)
    first = text[0]["start"]
    assert joined == seqs[3][1][first:] + seqs[3][1][:first]
    # A cut past the end hides the tail unless such cuts are ignored.
    tail = spark.createDataFrame([(1, "CCCCCCGAAGACC")], "seq_id int, sequence string")
    far = [rs.Enzyme("far", "GAAGA", 13, 12)]
    assert rs.digest(tail, far).count() == 0 and rs.digest(tail, far, drop_outside=True).collect()[0]["size"] == 13


def test_ends(spark):
    ends = [("five", "AATT"), ("three", "AATT"), ("three", "GATC"), ("none", ""), ("five", None)]
    df = spark.createDataFrame(ends, "direction string, overhang string")
    got = {(r["direction_1"], r["overhang_1"], r["direction_2"], r["n_1"]) for r in rs.compatible_ends(df).collect()}
    assert got == {("five", "AATT", "three", 1), ("none", "", "none", 2)}


def _similarity(seq, at, p):
    return sum(a == b or a == "N" for a, b in zip(seq[at : at + len(p)], p)) / len(p)


def _search(seq, probe):
    best, pos, used = 0.0, -1, ""
    for p in probe.variants:
        tried, start = [], 0
        while start <= len(seq) - len(p):
            hit = seq.find(p[:8], start)
            if hit < 0:
                tried += range(start, len(seq) - len(p) + 1, max(1, len(p) // 3))
                break
            tried += range(max(0, hit - 5), min(len(seq) - len(p), hit + 5) + 1)
            start = hit + 1
        for at in tried:
            if _similarity(seq, at, p) > best:
                best, pos, used = _similarity(seq, at, p), at, p
    if best < probe.min_similarity:
        return None
    centre, half = pos + len(used) // 2, probe.length // 2
    return max(0, centre - half), min(len(seq), centre + half), best


def test_annotation(spark):
    known = annotation.KNOWN_PROBES
    t7, his, egfp = known[2], known[15], known[8]
    bent = list(egfp.variants[1])
    bent[10], bent[30] = "N", "A" if bent[30] != "A" else "C"
    seqs = [
        (1, dna(120) + t7.variants[0] + dna(90) + rc("".join(bent)) + dna(700)),
        (2, dna(30) + his.variants[1] + dna(60)),
        (3, dna(40)),
        (4, dna(200)),
    ]
    df = spark.createDataFrame(seqs, "seq_id int, sequence string")
    got = {(r["seq_id"], r["name"]): (r["start"], r["end"], r["is_reverse"]) for r in annotation.annotate_features(df).collect()}
    want = {}
    for i, s in seqs:
        if len(s) < 50:
            continue
        for p in known:
            f, r = _search(s, p), _search(rc(s), p)
            if f and (not r or f[2] >= r[2]):
                want[(i, p.name)] = (f[0], f[1], False)
            elif r:
                want[(i, p.name)] = (len(s) - r[1], len(s) - r[0], True)
    assert got == want and (1, "T7 promoter") in got and (1, "EGFP") in got and (2, "His-tag") in got
    have = spark.createDataFrame([(1, "T7 prom"), (2, "his-tag 6x")], "seq_id int, name string")
    left = {(r["seq_id"], r["name"]) for r in annotation.annotate_features(df, existing=have).collect()}
    assert (1, "T7 promoter") not in left and (2, "His-tag") not in left and (1, "EGFP") in left


def test_guides_and_frameshift(spark):
    s = dna(400)
    seqs = spark.createDataFrame([(1, s)], "seq_id int, sequence string")
    cds = spark.createDataFrame([(1, 1, 31, 180), (1, 2, 220, 500)], "seq_id int, part int, start int, end int")
    exons = spark.createDataFrame([(1, 1, 1, 190), (1, 2, 300, 400)], "seq_id int, exon int, start int, end int")
    got = guides.frameshift(guides.guide_candidates(seqs, cds, exons), seqs, cds).collect()
    want = []
    for a, b in ((31, 180), (220, 400)):
        p = s[a - 1 : b]
        want += [(a + m.start(), "+", m.group(1)) for m in re.finditer(r"([ACGT]{20})([ACGT]GG)", p)]
        want += [(a - 1 + len(p) - m.start() - 23 + 1, "-", m.group(1)) for m in re.finditer(r"([ACGT]{20})([ACGT]GG)", rc(p))]
    assert sorted((r["position"], r["strand"], r["guide"]) for r in got) == sorted(want)
    coding = s[30:180]  # the second part reaches past the sequence and is left out of the CDS text
    for r in got:
        cut = r["position"] + 16 if r["strand"] == "+" else r["position"] + 5
        site = cut - 31 if 31 <= cut <= 180 else 150 + cut - 220 if cut >= 220 else -1
        assert r["cleavage_site"] == site
        if 0 <= site < len(coding):
            for n in (1, 2):
                m = coding[:site] + "N" * n + coding[site:]
                length = site // 3
                for i in range(site // 3 * 3, len(m) - 2, 3):
                    if m[i : i + 3] in ("TAA", "TAG", "TGA"):
                        break
                    length += 1
                assert r[f"loss_plus{n}"] == len(coding) // 3 - 1 - length
        else:
            assert r["loss_plus1"] is None


def test_band_join_edges(spark):
    a = spark.createDataFrame([("k", i) for i in range(0, 60, 7)] + [("z", 5)], "k string, x int")
    b = spark.createDataFrame([("k", i) for i in range(0, 80, 3)], "k string, y int")
    for lo, hi in ((4, 11), (-5, 5), (0, 0), (-20, -9)):
        got = {(r["x"], r["y"]) for r in intervals.band_join(a, b, "k", "x", "y", lo, hi).collect()}
        assert got == {(x, y) for x in range(0, 60, 7) for y in range(0, 80, 3) if lo <= y - x <= hi}


# ---------------------------------------------------------------- primers


def slow_scores(s):
    n, pairs = len(s), {("A", "T"), ("T", "A"), ("C", "G"), ("G", "C")}
    g = dict(zip(og.NN_PAIRS, og.NN_G))
    r = rc(s)
    self_comp = any_comp = 0
    dimer = 0.0
    for d in range(-(n - 1), n):
        run = total = 0
        energy = 0.0
        for i in range(n):
            j = i - d
            if 0 <= j < n and (s[i], r[j]) in pairs:
                run, total = run + 1, total + 1
                if run >= 2:
                    energy += g[s[i - 1] + s[i]]
                    dimer = min(dimer, energy + 1.96)
                self_comp = max(self_comp, run)
            else:
                run, energy = 0, 0.0
        any_comp = max(any_comp, total)
    hairpin, fold = 0, 0.0
    for a in range(n):
        for b in range(a + 4, n):
            loop, k, energy = b - a - 1, 0, 0.0
            while a - k >= 0 and b + k < n and (s[a - k], s[b + k]) in pairs:
                k += 1
                if k >= 2:
                    energy += g[s[a - k + 1] + s[a - k + 2]]
            if loop <= 8 and 2 <= a <= n - 5:
                hairpin = max(hairpin, k)
            if loop <= 12 and 1 <= a <= n - 6 and b <= n - 2 and k >= 2:
                fold = min(fold, energy + og.LOOP_PENALTY[loop])
    short = n < 4
    return (0 if short else self_comp, 0 if n < 8 else hairpin, 0.0 if short else round(dimer, 2), 0.0 if n < 8 else round(fold, 2), 0 if short else any_comp)


def slow_tm(s, ions=og.Ions()):
    gc = s.count("G") + s.count("C")
    if len(s) < 14:
        return 2.0 * (len(s) - gc) + 4.0 * gc
    h, ds = dict(zip(og.NN_PAIRS, og.NN_H)), dict(zip(og.NN_PAIRS, og.NN_S))
    ends = [og.INIT_GC if c in "GC" else og.INIT_AT for c in (s[0], s[-1])]
    hh = sum(h[s[i : i + 2]] for i in range(len(s) - 1)) + sum(e[0] for e in ends)
    ss = sum(ds[s[i : i + 2]] for i in range(len(s) - 1)) + sum(e[1] for e in ends)
    return round(og.celsius(hh, ss, gc, len(s), ions), 1)


def test_oligo_scores(spark):
    words = [dna(n) for n in (1, 3, 5, 8, 9, 13, 14, 20, 20, 25, 33)] + ["AAAAAAAAAAAAAAAA", "GCGCGCGCGCGCGCGC", "GGGGAAAACCCCTTTT", "ACGTACGTACGTACGTACGT"]
    df = spark.createDataFrame([(w,) for w in words], "sequence string")
    for ions in (og.Ions(), og.Ions(magnesium=0.0), og.Ions(magnesium=0.2), og.Ions(sodium=0.0, magnesium=0.0)):
        tm = {r["sequence"]: r["tm"] for r in df.select("sequence", og.primer_tm("sequence", ions).alias("tm")).collect()}
        for w in words:
            assert tm[w] == pytest.approx(slow_tm(w, ions), abs=0.051), (w, ions)
    m = primers.primer_warnings(primers.primer_metrics(df)).collect()
    for r in m:
        assert (r["self_comp"], r["hairpin"], r["self_dimer_dg"], r["hairpin_dg"], r["any_comp"]) == pytest.approx(slow_scores(r["sequence"]), abs=0.011)
        assert ("run of four equal bases" in r["warnings"]) == bool(re.search(r"(.)\1{3}", r["sequence"]))


def slow_hetero(a, b):
    best = 0
    r = rc(b)
    for d in range(-len(r) + 1, len(a)):
        run = 0
        for i in range(len(a)):
            ok = 0 <= i - d < len(r) and r[i - d] == a[i].translate(COMP)
            run = run + 1 if ok else 0
            best = max(best, run)
    return best


def slow_candidates(t, side, tm_lo=55, tm_hi=65, clamp=True):
    out = []
    for s in range(len(t)):
        for n in range(18, 26):
            if s + n > len(t):
                continue
            w = t[s : s + n] if side == "f" else rc(t[s : s + n])
            gc = round(100 * (w.count("G") + w.count("C")) / n, 1)
            if 30 <= gc <= 70 and (w[-1] in "GC" or not clamp) and tm_lo <= slow_tm(w) <= tm_hi:
                out.append((s, n, w, slow_tm(w), gc))
    return out


@pytest.mark.parametrize("region", [None, (60, 150)])
def test_primer_pairs_match_brute_force(spark, region):
    t = dna(230, random.Random(5))
    df = spark.createDataFrame([(1, t), (2, dna(40))], "template_id int, sequence string")
    opts = primers.PrimerOptions(region=region, refine=20, keep=10)
    got = primers.primer_pairs(primers.primer_candidates(df, opts), opts).orderBy("template_id", "rank").collect()
    pairs = []
    score = {w: slow_scores(w) for side in "fr" for _, _, w, _, _ in slow_candidates(t, side)}
    for fs, fn, fw, ft, fg in slow_candidates(t, "f"):
        for s, n, w, tm, g in slow_candidates(t, "r"):
            prod = s + n - fs
            if region:
                if fs > region[0] or s + n < region[1] or prod < 0:
                    continue
            elif not 100 <= prod <= 1000 or abs(ft - tm) > 3:
                continue
            q = 100 - abs(ft - tm) * 3 - abs(300 - prod) * 0.02
            for x, gg, ww in ((ft, fg, fw), (tm, g, w)):
                q -= abs(60 - x) * 1.5 + abs(50 - gg) * 0.5 + score[ww][1] * 3 + score[ww][0] * 2
            pairs.append((-q, fs, fn, s, n, fw, w))
    pairs.sort(key=lambda p: (round(p[0], 6), *p[1:5]))
    top = []
    for p in pairs[:20]:
        q = -p[0] - 2 * slow_hetero(p[5], p[6])
        for w in p[5:7]:
            d = score[w][2]
            q -= abs(d + 5) * 2 if d < -5 else 0
        top.append((-q, p))
    top.sort(key=lambda x: (round(x[0], 6), round(x[1][0], 6), *x[1][1:5]))
    assert len(pairs) > 20 and {r["template_id"] for r in got} == {1}
    assert [(r["f_start"], r["f_sequence"], r["r_start"], r["r_sequence"]) for r in got] == [(p[1], p[5], p[3], p[6]) for _, p in top[:10]]
    assert [r["score"] for r in got] == pytest.approx([-q for q, _ in top[:10]], abs=1e-6)


def test_tails(spark):
    t = dna(200, random.Random(8))
    opts = primers.PrimerOptions(use_tails=True, forward_site="GAATTC", reverse_site="GGATCC", max_len=30, max_tm=75.0)
    df = spark.createDataFrame([(1, t)], "template_id int, sequence string")
    rows = primers.primer_candidates(df, opts).collect()
    assert rows and {r["length"] for r in rows} <= set(range(10, 23))
    for r in random.Random(1).sample(rows, 25):
        tail = "GC" + ("GAATTC" if r["side"] == "forward" else "GGATCC")
        assert r["tm"] == pytest.approx(slow_tm(tail + r["sequence"]), abs=0.051) and r["tm_gene"] == pytest.approx(slow_tm(r["sequence"]), abs=0.051)
        part = t[r["start"] : r["start"] + r["length"]]
        assert r["sequence"] == (part if r["side"] == "forward" else rc(part))
    pairs = primers.primer_pairs(primers.primer_candidates(df, opts), opts).collect()
    for r in pairs:
        assert r["f_full"].endswith("GAATTC" + r["f_sequence"]) and len(r["f_full"]) == 8 + len(r["f_sequence"])


@pytest.mark.parametrize("side", ["forward", "reverse"])
def test_find_mate(spark, side):
    t = dna(420, random.Random(21))
    primer = t[30:50] if side == "forward" else rc(t[380:400])
    df = spark.createDataFrame([(1, t)], "template_id int, sequence string")
    p = spark.createDataFrame([(1, primer, side), (1, "A" * 30, side)], "template_id int, primer string, side string")
    got = primers.find_mate(p, df, target_product=200, product_tolerance=120).collect()
    best = None
    for s, n, w, tm, gc in slow_candidates(t, "r" if side == "forward" else "f", 57, 63, clamp=False):
        if side == "forward":
            ok, prod, edge = max(50 + 200 - 120, 50 + 50) <= s + n <= 50 + 320, s + n - 30, s + n
        else:
            ok, prod, edge = 380 - 320 <= s <= min(380 - 80, 380 - 50), 400 - s, s
        sc = slow_scores(w)
        q = 100 - abs(tm - 60) * 3 - abs(prod - 200) * 0.1 - sc[0] * 2 - sc[1] * 3
        if ok and (best is None or (round(q, 6), -edge, -n) > (round(best[0], 6), -best[1], -best[2])):
            best = (q, edge, n, w, prod)
    assert len(got) == 1 and (got[0]["mate"], got[0]["product"]) == (best[3], best[4]) and got[0]["score"] == pytest.approx(best[0], abs=1e-6)


def test_mates_are_looked_for_where_they_can_be(spark, monkeypatch):
    rng = random.Random(23)
    t = dna(9000, rng)
    df = spark.createDataFrame([(1, t), (2, t[:300])], "template_id int, sequence string")
    p = spark.createDataFrame([(1, t[4000:4020], "forward"), (1, rc(t[5000:5020]), "reverse"), (2, rc(t[20:40]), "reverse"), (None, "ACGT", "forward")], "template_id int, primer string, side string")
    read, scan = [], primers.primer_candidates

    def counted(templates, opts, key):
        read.append(templates.agg(F.sum(F.length("sequence"))).first()[0])
        return scan(templates, opts, key)

    monkeypatch.setattr(primers, "primer_candidates", counted)
    got = primers.find_mate(p, df).collect()
    assert sorted(r["side"] for r in got) == ["forward", "reverse"] and sum(read) < 1500
    for r in got:
        mate = r["mate"] if r["side"] == "reverse" else rc(r["mate"])
        assert mate in t[4000:4520] or mate in t[4520:5020]
        assert r["place"] == (4000 if r["side"] == "forward" else 5000) and 100 <= r["product"] <= 520


# ---------------------------------------------------------------- gates


def inside(x, y, pts):
    hit = False
    for i in range(len(pts)):
        (xa, ya), (xb, yb) = pts[i], pts[i - 1]
        if (ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa:
            hit = not hit
    return hit


def test_polygons(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    star = [(RNG.uniform(-5, 15), RNG.uniform(-5, 15)) for _ in range(9)]
    many = [(5 + RNG.uniform(3, 8) * c, 5 + RNG.uniform(3, 8) * s) for c, s in [(__import__("math").cos(k / 50), __import__("math").sin(k / 50)) for k in range(310)]]
    pts = [(RNG.uniform(-6, 16), RNG.uniform(-6, 16)) for _ in range(300)] + [(0.0, 0.0), (10.0, 5.0), (5.0, 0.0), (0.0, 5.0), (5.0, 10.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    for poly in (square, star, many):
        got = {(r["x"], r["y"]) for r in df.where(gating.polygon_gate("x", "y", poly)).collect()}
        assert got == {p for p in pts if inside(*p, poly)}
    assert df.where(gating.polygon_gate("x", "y", square[:2])).count() == 0
    assert df.where(gating.polygon_gate("x", "y", square, log_x=True)).count() == sum(inside(*p, square) and p[0] > 0 for p in pts)


def test_gate_tree_rules(spark):
    ev = spark.createDataFrame([("f", i, [float(i), 1.0]) for i in range(10)] + [("g", 0, [5.0])], "file string, event_id long, values array<double>")
    par = spark.createDataFrame([("f", 0, "A", "la"), ("f", 1, "B", "lb"), ("g", 0, "A", "A")], "file string, idx int, name string, label string")
    gates = [gating.Gate("late", "A", lo=0, hi=9, parent="p"), gating.Gate("p", "la", lo=2, hi=6), gating.Gate("kid", "A", lo=4, hi=9, parent="p"), gating.Gate("b", "B", lo=0, hi=2)]
    out = gating.apply_gates(ev, par, gates)
    got = {g: sorted(r["event_id"] for r in out.where(F.col(g) & (F.col("file") == "f")).collect()) for g in ("late", "p", "kid", "b")}
    assert got == {"late": list(range(10)), "p": [2, 3, 4, 5, 6], "kid": [4, 5, 6], "b": list(range(10))}
    g = out.where("file = 'g'").collect()[0]
    assert g["p"] is None and g["kid"] is True and g["b"] is None
    stats = {(r["file"], r["gate"]) for r in gating.gate_stats(ev, par, gates).collect()}
    assert ("g", "p") not in stats and ("g", "kid") in stats


def test_singular_spillover(spark):
    df = spark.createDataFrame([("a", ["A", "B"], [[100.0, 100.0], [100.0, 100.0]]), ("b", ["A", "zz"], [[0.0, 50.0], [100.0, 0.0]])], "file string, channels array<string>, matrix array<array<double>>")
    inv = {r["file"]: r["compensation"] for r in gating.invert_spillover(df).collect()}
    assert inv["a"] is None and inv["b"] == [[0.0, 1.0], [2.0, 0.0]]


def test_pair_summary(spark):
    pairs = [(dna(20), dna(22)) for _ in range(6)] + [("ACGTACGTACGTACGTACGT", "GGGGGGGGGGGGGGGGGGGG")]
    rows = [(f, slow_tm(f), *slow_scores(f)[:2], r, slow_tm(r), *slow_scores(r)[:2]) for f, r in pairs]
    df = spark.createDataFrame(rows, "f_sequence string, f_tm double, f_self_comp int, f_hairpin int, r_sequence string, r_tm double, r_self_comp int, r_hairpin int")
    for s in primers.primer_pair_summary(df).collect():
        hd, diff = slow_hetero(s["f_sequence"], s["r_sequence"]), abs(s["f_tm"] - s["r_tm"])
        score = 100 - 3 * diff - 2 * hd
        for p in ("f", "r"):
            score -= abs(60 - s[f"{p}_tm"]) + 2 * s[f"{p}_self_comp"] + 3 * s[f"{p}_hairpin"]
        assert s["hetero_dimer"] == hd and s["overall"] == pytest.approx(max(0, score))
        assert ("hetero-dimer risk" in s["warnings"]) == (hd >= 4) and ("Tm difference above 5 C" in s["warnings"]) == (diff > 5)


def test_intervals_across_bins(spark, monkeypatch):
    """The same rows whatever the bins: exons, coding positions and fragments that touch several bins."""
    from omicframe.operators import intervals as iv

    points = spark.createDataFrame([(1, p) for p in range(0, 90, 4)] + [(2, 5), (3, None)], "seq_id long, position int")
    parts = spark.createDataFrame([(1, 1, 3, 20), (1, 2, 18, 60), (2, 1, 5, 5)], "seq_id long, exon int, start int, end int")
    marks = spark.createDataFrame([(1, a, a + n) for a in range(0, 80, 7) for n in (1, 9, 30)], "seq_id long, start int, end int")
    pieces = spark.createDataFrame([(1, 0, 40), (1, 40, 50), (2, 0, 9)], "seq_id long, start int, size int")

    def rows():
        cds = parts.where("exon = 1 or start > 20").select("seq_id", "start", "end")
        found = (iv.exon_of(points, parts), iv.to_cds(points, cds), iv.features_in_fragments(marks, pieces))
        return [sorted(map(str, f.collect())) for f in found]

    whole = rows()
    assert len(whole[0]) == 25 and any("exon=2" in r for r in whole[0]) and len(whole[2]) > 10
    for width in (3, 8, 64):
        monkeypatch.setattr(iv, "BIN", width)
        assert rows() == whole


def test_windows_with_other_letters_are_left_out():
    from omicframe.functions import oligos as og

    text = "ACGTTGCANACGGTCATGCC"
    got = og.window_table(text, 5, 7, "", og.Ions())
    want = {(i, k) for k in (5, 6, 7) for i in range(len(text) - k + 1) if "N" not in text[i : i + k]}
    assert set(zip(got["start"], got["length"])) == want


def test_cds_by_transcript_takes_the_first(spark):
    from omicframe.operators.intervals import cds_by_transcript

    mrna = spark.createDataFrame([("s", "t1", 1), ("s", "t2", 2), ("r", "t1", 1)], "seq_id string, transcript_id string, feature_no int")
    cds = spark.createDataFrame(
        [("s", "t1", 9, 50), ("s", "t1", 4, 20), ("r", "t1", 3, 70), ("r", "t9", 1, 1)], "seq_id string, transcript_id string, feature_no int, begin int"
    )
    got = sorted((r.seq_id, r.transcript_id, r.cds_feature_no, r.cds_begin) for r in cds_by_transcript(mrna, cds).collect())
    assert got == [("r", "t1", 3, 70), ("s", "t1", 4, 20), ("s", "t2", None, None)]


def test_primer_candidates_of_many_templates(spark, monkeypatch):
    """Templates that are scanned together give what each gives alone, also where a scan or a chunk ends."""
    rng = random.Random(12)
    texts = [dna(n, rng) for n in (0, 17, 18, 25, 26, 60, 300, 41)] + [dna(50, rng) + "N" + dna(50, rng)]
    df = spark.createDataFrame(list(enumerate(texts)), "template_id int, sequence string").coalesce(1)
    seen = ["template_id", "side", "start", "length", "sequence", "tm", "gc"]
    opts = primers.PrimerOptions(min_tm=40.0)
    monkeypatch.setattr(primers, "CHUNK", 64)
    together = sorted(map(tuple, primers.primer_candidates(df, opts).select(*seen).collect()))
    monkeypatch.setattr(primers, "SCAN", 1)
    alone = sorted(map(tuple, primers.primer_candidates(df, opts).select(*seen).collect()))
    assert together == alone and {r[0] for r in together} >= {5, 6, 8}
    for _, side, start, length, oligo, _, _ in together:
        assert len(oligo) == length and "N" not in oligo
    assert all(texts[i][s : s + n] == o for i, side, s, n, o, _, _ in together if side == "forward")


def test_scores_of_an_empty_oligo(spark):
    df = spark.createDataFrame([("", "ACGT"), ("ACGTT", "")], "a string, b string")
    assert [r[0] for r in df.select(og.hetero_dimer("a", "b")).collect()] == [0, 0]


def test_annotation_of_many_constructs(monkeypatch):
    """Constructs that are searched together give what each gives alone; no constructs give none."""
    rng = random.Random(21)
    markers = [v for p in annotation.KNOWN_PROBES for v in p.variants]
    texts = [""] + [dna(rng.choice([0, 30, 200]), rng) + rng.choice(markers)[rng.choice([0, 0, 2]) :] + dna(rng.choice([0, 3, 150]), rng) for _ in range(60)]
    search = annotation._search(annotation.KNOWN_PROBES).func
    forward, reverse = pd.Series(texts, dtype=object), pd.Series([rc(t) for t in texts], dtype=object)
    together = search(forward, reverse).tolist()
    assert sum(map(len, together)) > 30 and together[0] == []
    monkeypatch.setattr(annotation, "LETTERS", 1)
    assert search(forward, reverse).tolist() == together
    assert len(search(forward[:0], reverse[:0])) == 0

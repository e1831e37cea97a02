"""Line dedup, decontamination and the quality classifier against plain Python."""

import random
import re
import zlib

import numpy as np
import pytest

from omicframe.llm import decontam, linededup, quality

SCHEMA = "doc_id long, text string, d string, th int, words int"


def docs(spark, rows):
    """Extra columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute_lines(rows, min_words):
    split = lambda t: [x for x in (t or "").split("\n") if x.strip(" \t\n\r\v\f")]
    each = [(i, n, [x.strip(" \t\n\r\v\f") for x in split(t)]) for n, (i, t) in enumerate(rows)]
    places = [(i, n, s, s + k, tuple(ls[s : s + k])) for i, n, ls in each for s in range(len(ls)) for k in range(1, len(ls) - s + 1)]
    first = {}
    for i, n, s, _, run in sorted(places):
        first.setdefault(run, (i, n, s))
    gone = {}
    for i, n, s, e, run in places:
        if first[run] < (i, n, s) and sum(len(x.split()) for x in run) >= min_words:
            gone.setdefault(n, set()).update(range(s, e))
    return {n: "\n".join(x for k, x in enumerate(split(t)) if k not in gone[n]) if n in gone else t for n, (_, t) in enumerate(rows)}


@pytest.mark.parametrize("min_words", [1, 3, 7])
def test_line_dedup(spark, min_words):
    rng = random.Random(min_words)
    pool = ["a", "b b", "c c c", " d d", "e e e e", "f"]
    rows = [(i, "\n".join(rng.choice(pool + ["", f"own {i} {j}"]) for j in range(rng.randint(0, 9)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "f " * 20_000), (104, "f " * 20_000)]
    got = linededup.dedup_lines(docs(spark, rows), min_words)
    want = brute_lines(rows, min_words)
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for n, (i, t) in enumerate(rows):
        assert found[i].text == want[n], (i, t)
        assert found[i].d == "x" and found[i].th == 1
        assert (found[i].n_removed > 0) == (want[n] != t or found[i].n_spans > 0)


def test_line_dedup_odd_tables(spark):
    assert linededup.dedup_lines(docs(spark, [(1, "x")]).limit(0)).count() == 0
    run = "one two three\nfour five six\n"
    got = linededup.dedup_lines(docs(spark, [(3, run + "end"), (3, run + "end"), (None, "start\n" + run)]), 5).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed, r.n_spans) for r in got), key=str) == [(3, "end", 2, 1), (3, "end", 2, 1), (None, "start\n" + run, 0, 0)]


def grams(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_contained(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(3, 70))) for i in range(30)] + [(90, None), (91, ""), (None, say(30))]
    rows = []
    for i in range(120):
        t = say(rng.randint(0, 300)).split()
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if item:
                    item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(t))
            t[at:at] = item
        rows.append((i, ", ".join(t).upper()))
    rows += [(500, None), (501, ""), (5, items[0][1]), (None, items[4][1]), (503, items[-1][1]), (502, (items[5][1] + " ") * 3000)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = decontam.contained(docs(spark, rows), bench)
    want = {}
    for i, t in rows:
        for j, b in items:
            g, h = grams(t), grams(b)
            if h and len(g & h) >= 0.8 * len(h) - 1e-9:
                want[i, j] = max(want.get((i, j), (0, 0))[0], len(g & h)), len(h)
    assert len(want) > 20
    assert {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in got.collect()} == want
    assert decontam.contained(docs(spark, rows).limit(0), bench).count() == 0
    assert decontam.contained(docs(spark, rows), bench.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "river", "stone", "quiet", "walks", "home", "green", "over"]) for _ in range(n)).capitalize() + "."
    junk = [lambda n: " ".join(w.upper() + "!!" for w in say(n).split()), lambda n: "buy " * n, lambda n: " | ".join(say(n).split())]
    rows, truth = [], []
    for i in range(600):
        good = rng.random() < 0.8
        rows.append((i, say(rng.randint(5, 60)) if good else rng.choice(junk)(rng.randint(5, 60))))
        truth.append(int(good))
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(600) if i % 2], "doc_id long, quality int, toxic int")
    table = docs(spark, rows + [(900, None), (901, ""), (None, "the river"), (7, "the stone")])
    model = quality.train(table, labels, lambda c: ~quality.held_out(c))
    got = quality.scored(table, model).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5, truth[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert quality.train(table, labels.limit(0), lambda c: ~quality.held_out(c)) is None
    assert {r.score for r in quality.scored(table, None).collect()} == {0.5}
    assert quality.scored(table.limit(0), model).count() == 0


def test_only_fitting_rows_are_learnt_from(spark):
    rows = [(i, f"some text number {i}") for i in range(60)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (quality.train(docs(spark, rows), spark.createDataFrame(x, schema), lambda c: ~quality.held_out(c)) for x in (labels, turned))
    assert np.array_equal(a["w"], b["w"])

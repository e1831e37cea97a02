"""The pipeline's stages on small tables, and near-duplicate classes against brute force."""

import random
import re

import pytest

import corpus_pipeline
from omicframe.llm import common, linededup, simhash, stages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, score int, row int, id int, n_lines int, gone int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4, 5) for i, t in rows], SCHEMA)


def say(rng, n):
    return " ".join("".join(rng.choice(["ka", "ro", "ti", "mel", "an", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def test_near_duplicate_classes(spark):
    rng = random.Random(8)
    rows, i = [], 0
    for _ in range(25):
        base = say(rng, 120).split()
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 1)):
                t[rng.randrange(len(t))] = "changed"
            rows.append((i, " ".join(t)))
            i += 1
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (None, "null id"), (905, "null id"), (906, "w " * 20_000), (0, "another text under an id that is taken")]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] or "") == (rows[b][1] or "") or alike(rows[a][1], rows[b][1]):
                root[find(a)] = find(b)
    key = lambda i: -(2**63) if i is None else i
    keep = {}
    for a, (i, _) in enumerate(rows):
        keep[find(a)] = min(key(i), keep.get(find(a), 2**63))
    want = sorted((key(i), keep[find(a)]) for a, (i, _) in enumerate(rows))
    assert sorted((r.id, r.keep) for r in simhash.similar_texts(docs(spark, rows)).collect()) == want
    left = simhash.without_near_duplicates(docs(spark, rows)).collect()
    assert sorted(key(r.doc_id) for r in left) == sorted(i for i, k in want if i == k) and left[0].th == "x"
    assert simhash.without_near_duplicates(docs(spark, rows).limit(0)).count() == 0


def classes(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a] == texts[b] or alike(texts[a], texts[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("large", [3, 2000])
def test_near_copies_within_orders_of_one_word_set(spark, large):
    rng = random.Random(3)
    words, texts = list(dict.fromkeys(say(rng, 90).split())), []
    for _ in range(12):
        order = rng.sample(words, len(words))
        swapped = list(order)
        swapped[3], swapped[4] = swapped[4], swapped[3]
        texts += [" ".join(order), " ".join(swapped)]
    rng.shuffle(texts)
    want = classes(texts)
    assert len(set(want.values())) == 12
    assert {r.id: r.keep for r in simhash.similar_texts(docs(spark, list(enumerate(texts))), large=large).collect()} == want


def test_copies_with_missing_tails_and_short_copies(spark):
    rng = random.Random(5)
    texts = []
    for n in (20, 20, 20, 20, 60, 60, 60, 60, 200, 200, 200, 200):
        words = say(rng, n).split()
        texts += [" ".join(words), " ".join(words[:-1] + ["changed"]) if n == 20 else " ".join(words[: n * 85 // 100])]
    want = classes(texts)
    assert len(set(want.values())) == 12
    assert {r.id: r.keep for r in simhash.similar_texts(docs(spark, list(enumerate(texts)))).collect()} == want


@pytest.mark.parametrize("name, stage", stages.STAGES[:-1])
def test_stages_keep_columns_and_odd_rows(spark, name, stage):
    rows = [(1, None), (2, ""), (3, "a quiet text of a few words."), (3, "a quiet text of a few words."), (None, "no id here, but some words."), (4, "long text. " * 30_000)]
    got = stage(spark, docs(spark, rows), SF)
    assert got.columns == docs(spark, rows).columns
    found = got.collect()
    assert all((r.th, r.score, r.row, r.id, r.n_lines, r.gone) == ("x", 1, 2, 3, 4, 5) for r in found)
    assert stage(spark, docs(spark, rows).limit(0), SF).count() == 0


def test_stages_do_their_work(spark):
    rng = random.Random(1)
    passage, own = say(rng, 60), [say(rng, 80) for _ in range(5)]
    lines = docs(spark, [(k, f"{own[k]}\n{passage}\nend {k}") for k in range(3)] + [(7, passage), (8, own[4])])
    got = {r.doc_id: (r.text, r.n_chars) for r in stages.by_lines(spark, lines, SF).collect()}
    cut = lambda k: f"{own[k]}\nend {k}"
    assert got == {0: (f"{own[0]}\n{passage}\nend 0", len(own[0]) + len(passage) + 7), 1: (cut(1), len(cut(1))), 2: (cut(2), len(cut(2))), 8: (own[4], len(own[4]))}
    near = docs(spark, [(5, own[0]), (4, own[0] + " more"), (6, own[1])])
    assert sorted(r.doc_id for r in stages.by_likeness(spark, near, SF).collect()) == [4, 6]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaks = docs(spark, [(1, f"{own[2]} {item} {own[3]}"), (2, own[2]), (None, own[3])])
    assert sorted(r.doc_id or 0 for r in stages.by_benchmark(spark, leaks, SF).collect()) == [0, 2]


def test_pipeline_runs_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [n for n, _ in stages.STAGES]
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    n = got.select("doc_id").distinct().count()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.5 * documents.count() < n < documents.count()


def test_shared_prefixes_take_one_exchange(spark):
    rows = [(1, 10, 10, 3, 1), (1, 10, 10, 3, 1), (1, 11, 11, 3, 2), (2, 10, 10, 3, 2), (2, 12, 10, 3, 1), (3, 13, 13, 1, 1)]
    found = simhash._between(spark.createDataFrame(rows, "h long, th long, root long, n int, pos int"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == [(1, 10, 10, 3, 1), (1, 11, 11, 3, 2)]


def edited(rng, base, most):
    """``base`` with up to ``most`` words replaced by ones of its own, in places of its own."""
    words = list(base)
    for p in rng.sample(range(len(words)), rng.randint(0, most)):
        words[p] = f"own{rng.randrange(10**9)}"
    return " ".join(words)


def test_large_group_of_near_copies_makes_no_table_of_pairs(spark, monkeypatch):
    rng = random.Random(11)
    base, other = say(rng, 200).split(), say(rng, 60).split()
    texts = [edited(rng, base, 8) for _ in range(220)] + [edited(rng, other, 3) for _ in range(12)] + [say(rng, 50) for _ in range(5)]
    rng.shuffle(texts)
    want, sizes, store = classes(texts), [], simhash.cut

    def counted(df, what="step"):
        stored = store(df, what)
        if {"a", "b"} <= set(stored.columns):
            sizes.append((stored.count(), what))
        return stored

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert {r.id: r.keep for r in simhash.similar_texts(docs(spark, list(enumerate(texts)))).collect()} == want
    assert len(set(want.values())) > 10
    assert max(sizes)[0] <= 10 * len(texts)


def test_groups_link_what_all_pairs_link(spark, monkeypatch):
    rng = random.Random(12)
    base = say(rng, 100).split()
    texts = [edited(rng, base, 6) for _ in range(60)] + ["", " \n"]
    rows = [(9, i, 0 if i in (1, 2) else i, len(shingles(t))) for i, t in enumerate(texts)]
    groups = spark.createDataFrame(rows, "leader long, th long, root long, n int")
    held = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    links = [(a, b) for a in range(len(texts)) for b in range(a) if alike(texts[a], texts[b])]
    for block, codes in ((512, 250_000), (7, 250_000), (512, 500)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "CODES", codes)
        got = [(r.a, r.b) for r in simhash._alike_in_groups(groups, held, 0.8, 5).collect()]
        assert {(max(p), min(p)) for p in got} <= set(links)
        found = []
        for some in (links, got):
            root = list(range(len(texts)))
            for a, b in [*some, (1, 0), (2, 0)]:
                a, b = root[a], root[b]
                root = [min(a, b) if r in (a, b) else r for r in root]
            found.append(root)
        assert found[0] == found[1]


def test_texts_of_a_common_shingle_share_a_group(spark):
    rng = random.Random(4)
    rows = [(h, th, th, 20, 1) for h in range(12) for th in rng.sample(range(30), rng.randint(2, 9))]
    found = simhash._groups(spark.createDataFrame(rows, "h long, th long, root long, n int, pos int")).collect()
    members = {}
    for r in found:
        members.setdefault(r.leader, set()).add(r.th)
    assert len(found) == sum(map(len, members.values())) <= len(rows)
    for a in rows:
        for b in rows:
            assert a[0] != b[0] or any({a[1], b[1]} <= m for m in members.values())


def test_stored_tables_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    plans = []

    def seen(df, what="step"):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return common.cut(df, what)

    monkeypatch.setattr(simhash, "cut", seen)
    monkeypatch.setattr(linededup, "cut", seen)
    rng = random.Random(2)
    same = "\n".join(say(rng, 8) for _ in range(9))
    some = docs(spark, [(k, f"{say(rng, 30)}\n{same}") for k in range(6)])
    linededup.later_copies(some).count()
    simhash.similar_texts(some).count()
    for what in ("line-suffixes", "line-windows", "simhash-parents", "simhash-met"):
        made = [p for w, p in plans if w == what]
        assert made and not any(re.search(r"BroadcastHashJoin .*(Inner|LeftOuter)", p) for p in made), what
        assert any("SortMergeJoin" in p for p in made), what


def test_prefixes_leave_out_shingles_that_very_many_texts_hold(spark):
    rng = random.Random(6)
    phrase = say(rng, 12)
    rows = [(th, th, f"{say(rng, 60)} {phrase} {say(rng, 60)}") for th in range(400)]
    texts = spark.createDataFrame(rows, "th long, root long, text string")
    known, ranks = simhash._commonness(texts, 5)
    codes = simhash._shingle_codes(phrase, 5, simhash._Words())
    assert set(codes.tolist()) <= set(known.tolist()) and list(known) == sorted(known) and min(ranks) >= 1
    groups, _ = simhash._between_classes(texts, 0.8, 5)
    assert groups.count() == 0

import random
import re

import numpy as np

from evidentia.llm.leaks import ItemSketches, find_leaks, size_class, sketch, wanted
from evidentia.llm.spans import SpanIndex, shared_words


def _shared(docs, length):
    where = {}
    cut = {k: [w for w in re.split("[ \t\n\r]+", t) if w] for k, t in docs if t is not None}
    for k, w in cut.items():
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add(k)
    out = set()
    for k, w in cut.items():
        hit = [False] * len(w)
        for i in range(len(w) - length + 1):
            if len(where[tuple(w[i : i + length])]) > 1:
                hit[i : i + length] = [True] * length
        i = 0
        while i < len(w):
            if hit[i]:
                j = i
                while j + 1 < len(w) and hit[j + 1]:
                    j += 1
                out.add((k, i, j))
                i = j
            i += 1
    return out


def _corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{p}_{i % 7}_{rng.randrange(5)}" for i in range(rng.randrange(8, 60))] for p in range(6)]
    docs = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"w{rng.randrange(400)}" for _ in range(rng.randrange(15))]
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randrange(1, 60)]
        docs.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    return [*docs, (1000, None), (1001, ""), (1002, " \n "), (1003, docs[0][1]), (1004, "a " * 5000), (1005, "b a " * 2500 + "a " * 40)]


def _frame(spark, docs):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, anchor int, record string")


def _found(df):
    return {(r.doc_id, r.from_word, r.to_word) for r in df.collect()}


def test_spans_equal_brute_force(spark):
    for seed, length, gram in ((2, 16, 16), (3, 40, 16)):
        docs = _corpus(seed)
        df = _frame(spark, docs)
        index = SpanIndex(spark, length, gram)
        index.append(df)
        assert _found(index.shared_spans(df)) == _shared(docs, length)


def test_batches_and_compaction_give_the_same(spark):
    docs = _corpus(4)
    df = _frame(spark, docs)
    index = SpanIndex(spark, 10, 4)
    for r in range(3):
        index.append(df.where(f"doc_id % 3 = {r}"))
    want = _shared(docs, 10)
    assert len(index.runs) == 3
    assert _found(index.shared_spans(df)) == want
    index.compact()
    assert len(index.runs) == 1
    assert _found(index.shared_spans(df)) == want
    new = df.where("doc_id % 3 = 2").selectExpr("doc_id as record")
    touched = _found(index.shared_spans(df, new=new))
    # Complete for the new records; for older ones the parts of true stretches that the batch touches.
    assert {x for x in want if x[0] % 3 == 2} == {x for x in touched if x[0] % 3 == 2}
    assert all(any(k == d and a <= x and y <= b for d, a, b in want) for k, x, y in touched)


def test_runs_join_without_a_shuffle(spark):
    df = _frame(spark, _corpus(5))
    index = SpanIndex(spark, 10, 4)
    index.append(df)
    plan = index.candidates()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(spot" not in plan


def test_hot_anchors_are_scattered(spark, monkeypatch):
    for name, value in (("SAMPLE", 2), ("HOT", 3), ("SALTS", 5)):
        monkeypatch.setattr(f"evidentia.llm.spans.{name}", value)
    rng = random.Random(8)
    common = " ".join(f"c{i}" for i in range(25))
    docs = _corpus(7, 40) + [(2000 + k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " " + common) for k in range(300)]
    df = _frame(spark, docs)
    index = SpanIndex(spark, 10, 4)
    index.append(df.where("doc_id % 3 <> 1 or doc_id < 2000"))
    index.append(df.where("doc_id % 3 = 1 and doc_id >= 2000"))
    assert index.hot.count() > 0
    want = _shared(docs, 10)
    assert _found(index.shared_spans(df)) == want
    index.compact()
    # No bucket place holds all rows of an anchor.
    assert index.runs[0].groupBy("spot").count().agg({"count": "max"}).first()[0] < 120 < index.runs[0].groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert _found(index.shared_spans(df)) == want
    new = df.where("doc_id % 3 = 2").selectExpr("doc_id as record")
    assert {x for x in want if x[0] % 3 == 2} == {x for x in _found(index.shared_spans(df, new=new)) if x[0] % 3 == 2}
    table = index.runs[0].scratch_table
    index.drop()
    assert not spark.catalog.tableExists(table)


def test_share_and_empty(spark):
    docs = _corpus(6)
    df = _frame(spark, docs)
    index = SpanIndex(spark, 10, 4)
    index.append(df)
    rows = {r.doc_id: r for r in shared_words(index.shared_spans(df), df).collect()}
    assert set(rows) == {k for k, _ in docs}
    assert rows[1000].share == 0.0 and rows[0].n_words == len(docs[0][1].split())
    none = df.where("false")
    empty = SpanIndex(spark, 10, 4)
    empty.append(none)
    assert empty.shared_spans(none).count() == 0


WORD = re.compile(r"[^\W_]+")


def _leaks(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [WORD.findall((t or "").lower())] for i in range(len(w) - n + 1)}
    whole = {}
    for i, u in items:
        whole.setdefault(i, set()).update(grams(u))
    return {(d, i, len(grams(t) & u)) for d, t in docs for i, u in whole.items() if grams(t) & u}


def _eval(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(["Alpha", "beta", "Gamma,", "delta-x", "Éta", "7"]) for _ in range(rng.randrange(3, 30)))) for i in range(40)]
    items += [(40, None), (41, ""), (42, "one two"), (43, items[0][1]), (3, items[5][1])]
    docs = []
    for d in range(120):
        w = [rng.choice(["zeta", "beta", "omega"]) for _ in range(rng.randrange(30))]
        if rng.random() < 0.6:
            src = items[rng.randrange(40)][1].upper().split()
            a = rng.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a : a + rng.randrange(1, 25)]
        docs.append((d, "; ".join(w) if d % 2 else " ".join(w)))
    return [*docs, (500, None), (501, ""), (502, "zeta " * 50_000 + items[5][1])], items


def test_leaks_equal_brute_force_on_both_paths(spark):
    docs, items = _eval(7)
    d = spark.createDataFrame([(k, t, 9) for k, t in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, t, 9) for k, t in items], "item_id long, text string, doc_id int")
    want = _leaks(docs, items, 5)
    assert want
    for limit in (1 << 20, 0):
        got = {tuple(r) for r in find_leaks(d, i, n=5, item_bytes=limit).collect()}
        assert got == want
        assert find_leaks(d.where("false"), i, n=5, item_bytes=limit).count() == 0
    assert find_leaks(d, i.where("false"), n=5).count() == 0


def test_containment_threshold_loses_nothing(spark):
    docs, items = _eval(8)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    grams = {}
    for k, t in items:
        w = WORD.findall((t or "").lower())
        grams.setdefault(k, set()).update(tuple(w[x : x + 5]) for x in range(len(w) - 4))
    want = {(a, b) for a, b, n in _leaks(docs, items, 5) if n >= 0.5 * len(grams[b])}
    for limit in (1 << 20, 0):
        assert {(r.doc_id, r.item_id) for r in find_leaks(d, i, n=5, containment=0.5, item_bytes=limit).collect()} == want


def test_size_classes():
    assert [size_class(n) for n in (1, 2, 3, 4, 5, 8, 9)] == [1, 2, 4, 4, 8, 8, 16]
    assert wanted(16, 0.0) == 1 and wanted(16, 1.0) == 9 and wanted(9, 0.5) == 5


def test_sketches_are_shorter_than_the_items():
    text = " ".join(f"w{i}" for i in range(400))
    whole, half, most = (ItemSketches([(1, text)], 10, t) for t in (0.0, 0.5, 0.9))
    assert len(whole.anchors) < 0.45 * len(whole.hashes)
    assert len(most.anchors) < len(half.anchors) < 0.7 * len(whole.anchors)
    # Whatever shingles are wanted, an anchor of theirs is kept.
    rng = np.random.default_rng(1)
    for _ in range(50):
        anchors = rng.integers(0, 12, rng.integers(1, 60)).astype(np.uint64)
        kept = set(sketch(anchors, 0.5).tolist())
        assert sum(a not in kept for a in anchors.tolist()) < wanted(len(anchors), 0.5)


def test_built_arrays_are_bounded():
    items = [(i, " ".join(f"w{i}_{k % 300}" for k in range(3000))) for i in range(100)]
    size = sum(len(t) for _, t in items)
    assert ItemSketches(items, 10, 0.0).nbytes < 12 * size

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions.identity import text_hash
from evidentia.operators import audit, graph, ingest, jobs, pairs, rank, runlog, search, synthesis, trust
from evidentia.operators.link import link_batch
from evidentia.operators.models import CountingJudge, HashingEncoder, OverlapArbiter, encoded
from evidentia.operators.orphans import ReferenceState, parents, references
from evidentia.scratch import written
from evidentia.operators.split import parts, seeds, split_ideas


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_quota_edges_and_padding(spark):
    scored = [("q", f"i{n}", 1 - n / 10, 0.0 if n < 6 else 0.5) for n in range(8)]
    lifted = spark.createDataFrame([(q, i, s) for q, i, s, _ in scored], "query_id string, idea_id string, raw_score double")
    ideas = spark.createDataFrame([(i, t) for _, i, _, t in scored] + [("e1", 0.9), ("e2", None)], "idea_id string, trust double")
    edges = spark.createDataFrame([("i3", "e1", 1), ("i0", "i1", 1), ("i5", "e2", 1)], "source_id string, target_id string, weight int")
    rows = {(r.rank, r.idea_id, r.via) for r in rank.retrieve(lifted, ideas, edges, 5).collect() if r.via != "cut_off"}
    assert rows == {(1, "i0", "thesis"), (2, "i6", "thesis"), (3, "i7", "thesis"), (4, "e1", "edge"), (5, "e2", "edge")}
    rows = [(r.idea_id, r.via) for r in rank.retrieve(lifted, ideas, edges.where("false"), 5).orderBy("rank").collect()]
    assert rows[:6] == [("i0", "thesis"), ("i6", "thesis"), ("i7", "thesis"), ("i1", "padding"), ("i2", "padding"), ("i3", "cut_off")]


def test_edge_topup_meets_few_neighbours_of_a_hub(spark, tmp_path, monkeypatch):
    """Against brute force; what is shuffled must not grow as queries times the neighbours of a hub."""
    from evidentia.plans import search_queries

    rng = np.random.default_rng(8)
    hub = [(f"s{s}", i) for s in range(300) for i in ["hub", *(f"i{s * 5 + n:04d}" for n in range(5))]]
    leaves = [(f"t{n}", s, i) for n, (s, i) in enumerate([*hub, *((f"few{n}", f"i{m:04d}") for n in range(40) for m in rng.integers(0, 60, 3)), ("alone", "lonely")])]
    ideas = [(i, "text", float(n % 5) / 4, None) for n, i in enumerate(sorted({i for _, _, i in leaves})) if n % 7 != 3]
    spark.createDataFrame(leaves, "id string, source_id string, idea_id string").coalesce(1).write.parquet(f"{tmp_path}/thesis_out.parquet")
    spark.createDataFrame(ideas, "id string, text string, trust_score double, updated_at string").coalesce(1).write.parquet(f"{tmp_path}/ideas.parquet")
    some = [i for i, *_ in ideas if "i0" < i < "i01"]
    asked = [(q, str(i), float(x)) for q in range(250) for i, x in zip(["hub", "lonely", *rng.choice(some, q % 30, replace=False)] if q % 10 else ["lonely", some[30]], rng.permutation(40))]
    lifted = spark.createDataFrame(asked, "query_id long, idea_id string, raw_score double")
    monkeypatch.setattr(search_queries, "_lifted", lambda *_: lifted)

    def shuffled():
        context = spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        every = context.statusStore().executorList(False)
        return sum(every.apply(n).totalShuffleWrite() for n in range(every.length()))

    before = shuffled()
    got = _set(search_queries.QUERIES["retrieve_edge_topup"](spark, str(tmp_path)))
    moved = shuffled() - before
    near, known, of, want = {}, {i for i, *_ in ideas}, {}, set()
    for _, s, i in leaves:
        of.setdefault(s, set()).add(i)
    for those in of.values():
        for i in those:
            near.setdefault(i, set()).update(those - {i})
    for q in {q for q, *_ in asked}:
        order = [i for *_, i in sorted((-x, i) for p, i, x in asked if p == q)]
        first = {}
        for p, i in enumerate(order):
            for t in near[i] & known - set(order):
                first.setdefault(t, p)
        want |= {(q, t, n + 1) for n, t in enumerate(sorted(first, key=lambda t: (first[t], t))[:5])}
    assert got == want
    assert moved < 1_500_000


def test_norm_of_equal_scores_is_one(spark):
    lifted = spark.createDataFrame([("q", "a", 0.3), ("q", "b", 0.3)], "query_id string, idea_id string, raw_score double")
    assert {r.norm for r in rank.minmax_norm(lifted).collect()} == {1.0}


def test_volume_is_priced(spark):
    hits = spark.createDataFrame([("q", "big", f"t{p}", p) for p in (1, 2, 3)] + [("q", "small", "t4", 4), ("q", "mid", "t2b", 2)], "query_id string, idea_id string, thesis_id string, pos int")
    got = {r.idea_id: (r.price, r.place) for r in rank.first_per_idea(hits).collect()}
    assert got == {"big": (3, 2), "mid": (2, 1), "small": (4, 3)}


def test_bm25_ignores_empty_texts_and_unknown_terms(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, None), (4, "")], "id int, text string")
    q = spark.createDataFrame([("a", "Red fox!"), ("b", "zebra"), ("c", "")], "query_id string, query string")
    got = [(r.query_id, r.id, r.bm25_rank) for r in search.bm25(docs, q, "id", "text").orderBy("query_id", "bm25_rank").collect()]
    assert got == [("a", 1, 1), ("a", 2, 2)]


def test_cosine_topk_ties_by_key(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(30)] + [(99, [0.0, 1.0]), (100, None)], "id int, vec array<float>").repartition(3)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, qvec array<float>")
    assert [r.id for r in search.cosine_topk(v, q, "id", "vec", 4).orderBy("vec_rank").collect()] == [0, 1, 2, 3]


def test_cosine_topk_asks_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(7).standard_normal((40, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vec array<float>").repartition(3)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:25])], "query_id int, qvec array<float>").repartition(4)
    whole = _set(search.cosine_topk(v, q, "id", "vec", 5))
    monkeypatch.setattr("evidentia.operators.search.QUERY_BATCH", 10)
    assert len(whole) == 125 and _set(search.cosine_topk(v, q, "id", "vec", 5)) == whole


def test_a_task_passes_on_its_best_only(spark, monkeypatch):
    monkeypatch.setattr("evidentia.operators.search.SCORE_CELLS", 400)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 30, 8)) for _ in range(300)]
    vecs = rng.standard_normal((300, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, t, v.tolist()) for i, (t, v) in enumerate(zip(texts, vecs, strict=True))], "id long, text string, vec array<float>").repartition(1)
    q = rows.where("id < 25").selectExpr("id as query_id", "text as query", "vec as qvec")
    some = next(search._blocks(q.select("query_id", search.F.array_distinct(search.terms(search.F.col("query"))).alias("t")), "t"))
    assert search._lexical(rows, q, some, "id", "text", 5).count() == 125
    assert search._nearest(rows, q, next(search._blocks(q)), "id", "vec", 5).count() == 125
    near = (vecs[:25].astype(float) @ vecs.astype(float).T).round(6)
    want = {(i, j, n) for i in range(25) for n, j in enumerate(np.lexsort((np.arange(300), -near[i]))[:5], 1)}
    assert {(r.query_id, r.id, r.vec_rank) for r in search.cosine_topk(rows, q, "id", "vec", 5).collect()} == want


def test_bm25_is_the_same_with_and_without_common_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"all w{i % 7} v{i % 11} v{i % 11} u{i % 3}") for i in range(200)], "id long, text string")
    q = docs.where("id < 20").selectExpr("id as query_id", "text as query")
    got = []
    for share in (0.0, 2.0):
        monkeypatch.setattr("evidentia.operators.search.COMMON", share)
        got.append({(r.query_id, r.id, r.bm25, r.bm25_rank) for r in search.bm25(docs, q, "id", "text", 9).collect()})
    assert got[0] == got[1] and len(got[0]) == 180


@pytest.mark.parametrize("classes", [4, 2048])
def test_quantiles_of_cosines_are_exact(spark, monkeypatch, classes):
    for name, value in (("CLASSES", classes), ("SCORE_CELLS", 400), ("PACK", 8), ("QUERY_BATCH", 20)):
        monkeypatch.setattr(f"evidentia.operators.search.{name}", value)
    x = np.random.default_rng(6).standard_normal((331, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:90] = x[50]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>").repartition(3)
    q = rows.where("id < 30").selectExpr("id as query_id", "vec as qvec")
    got = {r.query_id: (*r.q, r.top) for r in search.cosine_quantiles(rows, q, "vec", (0.0, 0.5, 0.99)).collect()}
    near = (x[:30].astype(float) @ x.astype(float).T).round(6)
    assert sorted(got) == list(range(30))
    assert np.allclose([got[i] for i in range(30)], np.c_[np.quantile(near, (0.0, 0.5, 0.99), axis=1).T, near.max(1)], atol=1e-9)


def test_bm25_asks_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 30, n))
    docs = spark.createDataFrame([(i, text(12)) for i in range(60)], "id int, text string").repartition(3)
    q = spark.createDataFrame([(i, text(4)) for i in range(25)], "query_id int, query string").repartition(4)
    whole = _set(search.bm25(docs, q, "id", "text", 5))
    monkeypatch.setattr("evidentia.operators.search.QUERY_BATCH", 10)
    monkeypatch.setattr("evidentia.operators.search.SCORE_CELLS", 2000)
    assert len(whole) == 125 and _set(search.bm25(docs, q, "id", "text", 5)) == whole


def test_pairs_of_large_groups_are_whole(spark, monkeypatch):
    monkeypatch.setattr("evidentia.operators.pairs.BLOCK", 30)
    x = np.random.default_rng(5).standard_normal((170, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [("big" if i < 130 else "small" if i < 168 else None, i, v.tolist(), f"s{i % 3}") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "idea string, id long, vec array<float>, s string").repartition(3)
    want = {(rows[i][0], i, j): round(float(x[i].astype(float) @ x[j].astype(float)), 6) for i in range(168) for j in range(i + 1, 168) if rows[i][0] == rows[j][0]}
    found = pairs.within(df, "idea", "id", "vec").collect()
    assert len(found) == len(want) and {(r.idea, r.a, r.b): r.cosine for r in found} == pytest.approx(want, abs=1.1e-6)
    by = pairs.agreement(df, "idea", "id", "vec", "s").agg(F.sum("pos"), F.sum("neg")).first()
    equal = sum(i % 3 == j % 3 for _, i, j in want)
    assert tuple(by) == (equal, len(want) - equal)


def test_blocks_of_one_idea_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr("evidentia.operators.pairs.BLOCK", 30)
    x = np.random.default_rng(8).standard_normal((700, 4)).astype(np.float32)
    df = spark.createDataFrame([("hot", i, v.tolist()) for i, v in enumerate(x)], "idea string, id long, vec array<float>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = pairs.within(df, "idea", "id", "vec").withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 700 * 699 // 2 == len(found[["a", "b"]].drop_duplicates()) and (found.a < found.b).all()
    assert found.task.nunique() > 1
    assert np.allclose(found.cosine, np.einsum("ij,ij->i", x[found.a].astype(float), x[found.b].astype(float)), atol=6e-7)


def test_queries_of_pairs_reach_ideas_over_64_leaves(spark, tmp_path):
    """Against brute force; the SQL of these two queries stops at 64 leaves an idea."""
    from evidentia.plans.catalogue import QUERIES

    x = np.random.default_rng(6).standard_normal((80, 384)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, f"t{i}", "big", "text", v.tolist()) for i, v in enumerate(x)], "row_id long, thesis_id string, idea_id string, text string, vec array<float>").write.parquet(f"{tmp_path}/idx_thesis.parquet")
    spark.createDataFrame([(f"t{i}", f"s{i % 2}", "big", "text", None, None) for i in range(80)], "id string, source_id string, idea_id string, text string, created_at string, run_success boolean").write.parquet(f"{tmp_path}/thesis_out.parquet")
    assert QUERIES["pair_similarity"](spark, str(tmp_path)).count() == 80 * 79 // 2
    got = QUERIES["auc_pairs"](spark, str(tmp_path)).first()
    near = (x.astype(float) @ x.astype(float).T).round(6)
    i, j = np.triu_indices(80, 1)
    same, c = i % 2 == j % 2, near[i, j]
    wins = (c[same][:, None] > c[~same][None, :]).sum() + 0.5 * (c[same][:, None] == c[~same][None, :]).sum()
    assert (got.pos, got.neg) == (same.sum(), (~same).sum()) and got.auc == pytest.approx(wins / (same.sum() * (~same).sum()), abs=2e-6)


def test_dial_equals_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 6)) * [5, 3, 1, 1, 1, 1]
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, vec array<double>").repartition(3)
    got = {r.id: (r.cosine, r.angle) for r in search.dial(df, q.tolist(), "id", "vec").collect()}
    cos = x @ q
    res = x - np.outer(cos, q)
    res -= res.mean(0)
    axes = np.linalg.svd(res)[2][:2]
    axes = np.array([a if a[np.abs(a).argmax()] > 0 else -a for a in axes])
    at = res @ axes.T
    want = np.arctan2(at[:, 1], at[:, 0])
    for i in range(1, 60):
        assert abs(got[i][0] - cos[i]) < 1e-3 and abs(got[i][1] - want[i]) < 1e-3


def test_cocitation_and_hops(spark):
    leaves = spark.createDataFrame([("l1", "s1", "a"), ("l2", "s1", "a"), ("l3", "s1", "b"), ("l4", "s2", "a"), ("l5", "s2", "b"), ("l6", "s2", "c"), ("l7", "s3", "c"), ("l8", None, "a"), ("l1", "s1", "a")], "id string, source_id string, idea_id string")
    pairs = graph.cocitation(leaves)
    assert _set(pairs) == {("a", "b", 2, 2), ("a", "c", 1, 1), ("b", "c", 1, 1)}
    edges = graph.both_directions(spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 1)], "idea_a string, idea_b string, weight long"))
    start = spark.createDataFrame([("a",)], "id string")
    assert _set(graph.neighbours(edges, start, 2)) == {("a", "b", 1, 1), ("b", "a", 1, 2), ("b", "c", 2, 2)}
    assert _set(graph.neighbours(edges, start, 3, 2)) == set()
    with pytest.raises(ValueError):
        graph.neighbours(edges, start, 0)


def test_replayed_evidence_adds_nothing(spark):
    schema = "source_id string, target_id string, evidence string, weight double"
    old = spark.createDataFrame([("a", "b", "s1", 2.0)], schema)
    new = spark.createDataFrame([("a", "b", "s1", 5.0), ("a", "b", "s2", 1.0), ("b", "c", "s2", 1.0), ("b", "c", "s2", 1.0)], schema)
    merged = graph.merge_edges(old, new)
    assert _set(graph.edge_weights(merged)) == {("a", "b", 3.0, 2), ("b", "c", 1.0, 1)}
    assert _set(graph.merge_edges(merged, new)) == _set(merged)


def test_run_log(spark):
    rows = [("root", 0.5, [], "{}"), ("up", 0.9, ["root", "dead"], '{"archetype": "A", "changes": [{"description": "d1", "explanation": "e"}, {"description": "d2"}]}'), ("dead", -1000.0, ["root"], None), ("none", None, ["root"], None), ("lost", 0.4, ["dead"], None), ("bad", 0.1, ["root"], "{oops"), ("still", 0.2, ["root"], '{"archetype": "A", "changes": []}'), ("down", 0.3, ["root", "up"], '{"archetype": "B", "changes": [{"description": "d3"}]}')]
    df = spark.createDataFrame([(p, f, i, m, "mm") for p, f, i, m in rows], "program_id string, fitness double, parent_ids array<string>, mutation_output string, mutation_model string")
    gated = runlog.with_delta(df).withColumn("mo", runlog.parse_output(F.col("mutation_output")))
    got = {r.program_id: r.reason for r in runlog.gate(gated, 0.0, F.col("mo").isNotNull(), F.size("mo.changes")).collect()}
    assert got == {"root": "root", "up": None, "dead": "dead", "none": "no_fitness", "lost": "parent_unmeasured", "bad": "unparsed", "still": "no_changes", "down": None}
    out = {r.locator: r for r in runlog.convert(df, "aime_seed1").collect()}
    assert set(out) == {"aime_seed1:up#changes[0]", "aime_seed1:up#changes[1]", "aime_seed1:down#changes[0]"}
    assert out["aime_seed1:down#changes[0]"].effect == "fitness 0.9 -> 0.3 (-0.60)" and not out["aime_seed1:down#changes[0]"].run_success
    run = spark.createDataFrame([("x/aime_seed1/results/full.csv",), ("y/log.csv",)], "p string").select(runlog.run_name(F.col("p")).alias("r"))
    assert [tuple(r) for r in run.select("r", runlog.seed(F.col("r")), runlog.task(F.col("r"))).collect()] == [("aime_seed1", "1", "aime"), ("log", "log", "log")]


def test_ingest_steps(spark):
    d = spark.createDataFrame([(g, n) for g, ns in {"a": [1, 2, 3, 5], "b": [2, 3], "c": [1, 1, 2]}.items() for n in ns], "g string, line long")
    cursor = ingest.contiguous_prefix(d, "g", "line")
    assert _set(cursor) == {("a", 3), ("b", 0), ("c", 2)}
    drafts = spark.createDataFrame([("d", f"s{s}", n) for s in range(6) for n in range(8)], "doc string, section string, n int")
    kept = ingest.ceilings(drafts, "doc", "section", "n").where("kept").groupBy("section").count()
    assert _set(kept) == {(f"s{s}", 6) for s in range(5)}


def test_split(spark):
    rng = np.random.default_rng(3)
    poles = np.eye(8)[:3]
    x = np.concatenate([p + 0.05 * rng.standard_normal((14, 8)) for p in poles])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = parts(x)
    assert sorted(map(len, found)) == [14, 14, 14] and all(len({i // 14 for i in p.tolist()}) == 1 for p in found)
    assert [len(p) for p in parts(np.ones((40, 4)) / 2)] and max(len(p) for p in parts(np.ones((40, 4)) / 2)) <= 16
    df = spark.createDataFrame([("big", f"l{i:02}", v.tolist()) for i, v in enumerate(x)] + [("small", "z", [1.0] * 8)], "idea string, leaf string, vec array<double>")
    rows = split_ideas(df, "idea", "leaf", "vec").collect()
    assert len(rows) == 42 and {r.part for r in rows} == {0, 1, 2}


def test_large_ideas_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr("evidentia.operators.split.GROUP", 50)
    x = np.random.default_rng(4).standard_normal((300, 5))
    df = spark.createDataFrame([("big", i, v.tolist()) for i, v in enumerate(x)], "idea string, leaf int, vec array<double>")
    sizes = split_ideas(df, "idea", "leaf", "vec").groupBy("part").count().collect()
    assert sum(r["count"] for r in sizes) == 300 and max(r["count"] for r in sizes) <= 16


@pytest.mark.parametrize("kind", ["spread", "equal"])
def test_large_ideas_split_as_a_whole(spark, monkeypatch, kind):
    monkeypatch.setattr("evidentia.operators.split.GROUP", 120)
    monkeypatch.setattr("evidentia.operators.pairs.BLOCK", 70)
    x = np.random.default_rng(8).standard_normal((300, 5)) if kind == "spread" else np.ones((300, 4)) / 2
    df = spark.createDataFrame([("big", i, v.tolist()) for i, v in enumerate(x)], "idea string, leaf int, vec array<double>").repartition(3)
    found = split_ideas(df, "idea", "leaf", "vec").collect()
    want = {int(i): n for n, rows in enumerate(parts(x / np.linalg.norm(x, axis=1, keepdims=True))) for i in rows}
    assert {r.leaf: r.part for r in found} == want


def test_seeds_are_the_least_similar_pair_at_any_size():
    x = np.random.default_rng(9).standard_normal((1500, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = seeds(x)
    assert x[a] @ x[b] == pytest.approx((x @ x.T).min())


def test_link_fold(spark):
    texts = [("s1", 1, "alpha beta gamma delta"), ("s1", 2, "alpha beta gamma delta"), ("s1", 3, "alpha beta gamma epsilon"), ("s1", 4, "new thing entirely here"), ("s1", 5, "new thing entirely there"), ("s2", 1, "stored already")]
    enc = HashingEncoder(32)
    rows = spark.createDataFrame([(s, n, t) for s, n, t in texts], "source_id string, line long, text string").withColumn("hash", text_hash(F.col("text"))).withColumn("vec", encoded(F.col("text"), enc))
    cand = F.when((F.col("source_id") == "s1") & (F.col("line") <= 3), F.expr("array(named_struct('place', 1, 'idea_id', 'i1', 'thesis_id', 't1'))"))
    ideas = spark.createDataFrame([("i1", "alpha beta gamma")], "idea_id string, text string")
    stored = spark.createDataFrame([("s2", "stored already")], "source_id string, text string").select("source_id", text_hash(F.col("text")).alias("hash"))
    got = {(r.source_id, r.line): (r.decision, r.idea_id or r.error) for r in link_batch(rows.withColumn("candidates", cand), ideas, stored, OverlapArbiter(0.5)).collect()}
    assert got["s1", 1] == ("linked", "i1") and got["s1", 2] == ("duplicate", None) and got["s1", 3] == ("linked", "i1")
    assert got["s1", 4][0] == "new" and got["s1", 5] == ("linked", got["s1", 4][1]) and got["s2", 1] == ("duplicate", None)


def test_a_failed_decision_waits(spark):
    class Wrong:
        def choose(self, text, candidates):
            return 7

    rows = spark.createDataFrame([("s", 1, "t", None)], "source_id string, line long, text string, vec array<float>").withColumn("hash", text_hash(F.col("text")))
    rows = rows.withColumn("candidates", F.expr("array(named_struct('place', 1, 'idea_id', 'i1', 'thesis_id', 't1'))"))
    ideas = spark.createDataFrame([("i1", "x")], "idea_id string, text string")
    none = spark.createDataFrame([], "source_id string, hash string")
    assert link_batch(rows, ideas, none, Wrong()).collect()[0].decision == "pending"
    assert "not stored" in link_batch(rows, ideas.where("false"), none, OverlapArbiter()).collect()[0].error
    assert "hash" in link_batch(rows.withColumn("hash", F.lit("h")), ideas, none, OverlapArbiter()).collect()[0].error


def test_trust_sweep_fails_closed(spark):
    class Broken:
        def score(self, idea, leaves):
            return 11

    ideas = spark.createDataFrame([("a", "x", True, "1"), ("b", "y", True, "2"), ("c", "z", False, "3"), ("d", "w", True, "4")], "id string, text string, dirty boolean, created_at string")
    leaves = spark.createDataFrame([("a", 1, "l"), ("a", 2, "m")], "idea_id string, place int, text string")
    assert _set(trust.sweep(ideas, leaves, CountingJudge(), 2)) == {("a", 0.2, "scored"), ("b", 0.0, "scored"), ("d", None, "deferred")}
    assert _set(trust.summary(trust.sweep(ideas, leaves, Broken(), 2))) == {(3, 1, 1, 1, 0.0)}


def test_audits(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    right = spark.createDataFrame([("b",), ("c",)], "id string")
    assert _set(audit.symmetric_difference(left, right, "id")) == {("a", "left"), ("c", "right")}
    moved = spark.createDataFrame([("x",), ("x",), ("y",)], "leaf_id string")
    assert _set(audit.split_guard(moved, spark.createDataFrame([("x",)], "leaf_id string"))) == {("x", "twice"), ("y", "stolen")}


def test_rate_limit(spark):
    base = datetime(2024, 1, 1)
    df = spark.createDataFrame([(c, base + timedelta(seconds=s), f"{c}{s}") for c in "ab" for s in (0, 1, 2, 3, 60, 61, 62, 200)], "client string, ts timestamp, k string").repartition(3)
    got = {r.k: (r.in_window, r.allowed) for r in jobs.rate_limit(df, "client", "ts", "k", 2, 60).collect()}
    assert len(got) == 16
    # Refused calls use nothing up: who keeps calling is let in when the window has passed.
    assert [got[f"a{s}"] for s in (0, 1, 2, 3, 60, 61, 62, 200)] == [(0, True), (1, True), (2, False), (2, False), (1, True), (1, True), (2, False), (0, True)]


def test_ideas_opened_by_two_sources_are_one(spark):
    from evidentia.operators.link import join_across

    texts = [("s1", 1, "alpha beta gamma delta"), ("s2", 2, "Alpha beta gamma delta!"), ("s2", 3, "alpha beta gamma delta epsilon"), ("s3", 4, "wholly other words"), ("s4", 5, "alpha beta gamma delta")]
    enc = HashingEncoder(32)
    rows = spark.createDataFrame([(s, n, t) for s, n, t in texts], "source_id string, line long, text string").withColumn("hash", text_hash(F.col("text"))).withColumn("vec", encoded(F.col("text"), enc))
    none = F.expr("cast(array() as array<struct<place:int,idea_id:string,thesis_id:string>>)")
    ideas = spark.createDataFrame([], "idea_id string, text string")
    stored = spark.createDataFrame([], "source_id string, hash string")
    decided = link_batch(rows.withColumn("candidates", none), ideas, stored, OverlapArbiter(0.5))
    order = rows.groupBy("source_id").agg(F.min("line").alias("turn"))
    got = {(r.source_id, r.line): (r.decision, r.idea_id) for r in join_across(decided, rows, order, OverlapArbiter(0.5)).collect()}
    first = got["s1", 1][1]
    assert got["s1", 1][0] == "new" and got["s3", 4][0] == "new"
    assert got["s2", 2] == got["s2", 3] == got["s4", 5] == ("linked", first)


def test_a_written_table_leaves_no_shuffle_behind(spark):
    from evidentia.scratch import materialise

    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.length())}

    before = shuffles()
    rows = spark.range(5000).groupBy((F.col("id") % 100).alias("g")).agg(F.sum("id").alias("n")).repartition(4, "n")
    kept = materialise(rows, "summed")
    assert not {f for f in shuffles() - before if f.startswith("shuffle_")}
    # What is read again is the table; the plan it came from still runs, and the setting is as it was.
    assert kept.count() == rows.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_pairs_are_disjoint_and_repeatable(spark):
    df = spark.createDataFrame([(f"i{n}",) for n in range(11)], "id string")
    a, b = (sorted(tuple(r) for r in synthesis.random_pairs(df, "id", 10, 5).collect()) for _ in range(2))
    ids = [x for r in a for x in r[1:]]
    assert a == b and len(a) == 5 and len(set(ids)) == 10


def test_references_wait_resolve_and_reopen(spark):
    leaf = spark.createDataFrame([("l1", "s1", "2024-01-02T00:00:00+02:00"), ("l2", "s2", ""), ("l3", "s3", "2024-02-01T00:00:00Z"), ("l4", None, None), ("l5", "", "bad"), ("l1", "s1", "2024-01-02T00:00:00+02:00")], "id string, source_id string, created_at string")
    src = spark.createDataFrame([("s1", "2024-01-01T23:00:00Z"), ("s1", None), ("s2", "2030-01-01T00:00:00Z")], "id string, retrieved_at string")
    refs = references(leaf, "leaf", "source_id", "id", "sources", "created_at")
    there = parents(src, "sources", "id", "retrieved_at")
    keys = lambda s: {(r.row_key, r.state) for r in s.waiting().collect()}
    s = ReferenceState(spark)
    s.step(new_refs=refs)
    assert keys(s) == {("l1", "waiting"), ("l2", "waiting"), ("l3", "waiting"), ("l5", "waiting")}
    s.step(arrived=there)
    assert keys(s) == {("l1", "late"), ("l3", "waiting"), ("l5", "waiting")}
    s.step(deleted=spark.createDataFrame([("sources", "s2")], "parent string, key string"))
    assert keys(s) == {("l1", "late"), ("l2", "waiting"), ("l3", "waiting"), ("l5", "waiting")}
    s.step(arrived=spark.createDataFrame([("sources", "s2", None), ("sources", "", None)], "parent string, key string, since timestamp"))
    assert keys(s) == {("l1", "late"), ("l3", "waiting")}
    counts = {(r.month, r.missing, r.late, r.refs) for r in s.counts().collect()}
    assert counts == {("2024-01", 0, 1, 1), (None, 0, 0, 2), ("2024-02", 1, 0, 1)}
    # Delivered again in a later step, a reference counts once.
    s.step(new_refs=refs)
    assert {(r.month, r.missing, r.late, r.refs) for r in s.counts().collect()} == counts
    assert ReferenceState(spark).waiting().count() == 0
    empty = ReferenceState(spark)
    empty.step(new_refs=refs.where("false"), arrived=there.where("false"))
    assert empty.waiting().count() == 0 and empty.counts().count() == 0


def test_a_step_writes_what_it_touches(spark):
    key = F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))
    refs = spark.range(40_000).select(F.lit("t").alias("tab"), F.lit("f").alias("field"), F.col("id").cast("string").alias("row_key"), F.lit("p").alias("parent"), key.alias("key"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("month"))
    there = lambda lo, hi: spark.range(lo, hi).select(F.lit("p").alias("parent"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(None).cast("timestamp").alias("since"))
    s = ReferenceState(spark)
    s.step(new_refs=refs, arrived=there(0, 4000))
    first = written(s.refs.pieces[-1][1])
    s.step(new_refs=refs.limit(20).withColumn("row_key", F.concat(F.lit("x"), "row_key")))
    s.step(arrived=there(4000, 4010))
    s.step(deleted=there(0, 3))
    assert all(20 * 8 * 3 < written(p) < first / 5 for _, p in s.refs.pieces[1:]) and len(s.refs.pieces) == 4
    assert s.waiting().count() == 8 * (1000 - 10 + 3) + s.waiting().where("row_key like 'x%'").count()
    # Merged pieces give the same.
    for n in range(10):
        s.step(arrived=there(4010 + n, 4011 + n), deleted=there(3 + n, 4 + n))
    assert len(s.refs.pieces) < 8
    assert s.waiting().where("row_key not like 'x%'").count() == 8 * (1000 - 20 + 13)
    s.refs.vacuum()
    assert s.counts().first().refs == 40_020


def test_queries_that_may_leave(spark):
    from evidentia.operators.research import discover, safe_queries

    qs = ["alpha beta gamma delta", "short", "my password: hunter2", "Alpha  beta gamma\ndelta", "known idea about caching", "other words entirely", "yet another question here"]
    c = spark.createDataFrame([("r", i, q) for i, q in enumerate(qs)], "request string, position int, query string")
    known = spark.createDataFrame([("r", "known idea about caching")], "request string, idea string")
    assert [r.position for r in safe_queries(c, known, 2).orderBy("position").collect()] == [0, 5]
    assert [r.position for r in safe_queries(c, known.where("false"), 9).orderBy("position").collect()] == [0, 4, 5, 6]
    body = '{"results": [{"url": "https://a.org/x/", "title": "t"}, {"url": "HTTPS://A.org/x", "title": "u", "score": 0.9}, {"url": "http://localhost/", "title": "v"}]}'
    got = discover(spark.createDataFrame([(body,), ("{}",)], "body string")).collect()
    assert [(r.url, r.score) for r in got] == [("https://a.org/x/", 1.0)]

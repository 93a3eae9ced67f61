import numpy as np

from evidentia.llm.neighbours import VectorIndex, _packed, _unpacked, neighbour_pairs, neighbours


def _data(seed, n, dim):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((20, dim))
    x = (c[rng.integers(0, 20, n)] + 0.5 * rng.standard_normal((n, dim))).astype(np.float32)
    x[5] = x[9]
    x[11] = 3 * x[12]
    x[100:140] = x[100]  # a crowd
    return x


def _brute(ids, x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    out = {}
    for i in range(len(ids)):
        order = [j for j in np.lexsort((ids, -s[i])) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 40), ("BLOCK_ROWS", 300)):
        monkeypatch.setattr(f"evidentia.llm.neighbours.{name}", value)
    n, dim = 1200, 48
    x = _data(1, n, dim)
    ids = np.random.default_rng(2).permutation(n) * 3
    rows = [(int(i), v.tolist(), 7) for i, v in zip(ids, x, strict=True)]
    rows += [(90001, None, 7), (90002, [1.0] * 5, 7), (90003, [0.0] * dim, 7), (90004, [float("nan")] * dim, 7), (90005, [None] + [1.0] * (dim - 1), 7)]
    df = spark.createDataFrame(rows, "row_id long, vec array<float>, id int")
    got = {}
    for r in neighbours(df, dim=dim).collect():
        got.setdefault(r.row_id, {})[r.rank] = (r.other, r.similarity)
    want = _brute(ids, x, 5)
    assert set(got) == set(want)
    hits = sum(len({o for o, _ in got[i].values()} & set(w)) for i, w in want.items())
    assert hits / (5 * n) > 0.95
    place = {int(i): j for j, i in enumerate(ids)}
    for i, near in list(got.items())[:100]:
        for other, sim in near.values():
            a, b = x[place[i]].astype(float), x[place[other]].astype(float)
            assert abs(sim - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 2e-9
    # The crowd: everyone's neighbours are its smallest keys.
    crowd = sorted(int(ids[j]) for j in range(100, 140))
    for i in crowd:
        assert [got[i][r][0] for r in range(1, 6)] == [c for c in crowd if c != i][:5]
    pairs = neighbour_pairs(neighbours(df, dim=dim)).collect()
    assert len(pairs) == len(set(pairs)) and all(p.row_a < p.row_b for p in pairs)


def test_recall_beyond_the_largest_number_of_lists(spark, monkeypatch):
    # Few large lists in small blocks: sublists, spread lists, blocks in several copies.
    for name, value in (("LIST_ROWS", 25), ("MAX_LISTS", 6), ("BLOCK_ROWS", 260), ("VISITS", 60), ("FIRST_ROWS", 600)):
        monkeypatch.setattr(f"evidentia.llm.neighbours.{name}", value)
    n, dim = 1500, 48
    x, ids = _data(3, n, dim), np.arange(n) * 7
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id long, vec array<float>")
    index = VectorIndex(x[:600], n)
    assert len(index.centroids) < n / 25 / 2 and index.copies.max() > 1
    got = {}
    for r in neighbours(df, dim=dim).collect():
        got.setdefault(r.row_id, set()).add(r.other)
    want = _brute(ids, x, 5)
    assert set(got) == set(want)
    assert sum(len(got[i] & set(w)) for i, w in want.items()) / (5 * n) > 0.9


def test_recall_with_many_more_groups_than_lists(spark, monkeypatch):
    # The groups of a large table: the members of one lie in several lists, and several blocks are asked.
    for name, value in (("LIST_ROWS", 20), ("MAX_LISTS", 8), ("BLOCK_ROWS", 120), ("FIRST_ROWS", 200)):
        monkeypatch.setattr(f"evidentia.llm.neighbours.{name}", value)
    rng = np.random.default_rng(8)
    groups, each, dim = 300, 6, 96
    x = np.repeat(rng.standard_normal((groups, dim)), each, 0) + 0.45 * rng.standard_normal((groups * each, dim))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, vec array<float>")
    got = {}
    for r in neighbours(df, dim=dim).collect():
        got.setdefault(r.row_id, set()).add(r.other)
    want = _brute(np.arange(len(x)), x.astype(np.float32), 5)
    assert sum(len(got[i] & set(w)) for i, w in want.items()) / (5 * len(x)) > 0.93


def test_vectors_travel_whole():
    x = np.random.default_rng(9).standard_normal((6, 5)).astype(np.float32)
    x[:3] = x[:3].astype(np.float16)
    x[5] = 1e9
    packed = _packed(x)
    assert [len(v) for v in packed] == [10] * 3 + [20] * 3 and (_unpacked(packed, 5) == x).all()


def test_ties_of_codes_go_to_smaller_keys(spark):
    # One direction at many lengths: all codes tie, and more rows tie than are scored again.
    rng = np.random.default_rng(5)
    one, n = rng.standard_normal(16), 400
    ids = rng.permutation(n)
    df = spark.createDataFrame([(int(i), ((1 + i) * one).tolist()) for i in ids], "row_id long, vec array<float>")
    got = {}
    for r in neighbours(df, dim=16).collect():
        got.setdefault(r.row_id, []).append(r.other)
    hits = sum(set(v) == set([i for i in range(6) if i != k][:5]) for k, v in got.items())
    assert hits > 0.95 * n


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None)], "row_id long, vec array<float>")
    assert {(r.row_id, r.other) for r in neighbours(df, dim=2).collect()} == {(1, 2), (2, 1)}
    assert neighbours(df.where("false"), dim=2).count() == 0
    assert neighbours(df.where("row_id = 3"), dim=2).count() == 0

"""Formatting duplicates, co-occurrence, batches."""

import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np

from evidentia.llm.batches import PivotTable, admit, counts_in_unary
from evidentia.llm.cooccur import ConfigurationNull, incidences, pair_counts, surprise, upper_tail
from evidentia.llm.dressed import collapsed, copies

WORD = re.compile(r"[^\W_]+")


def _fields(t):
    return tuple(sorted(f for f in (re.sub(r"[\W_]", "", p).lower() for p in re.split("[;|]", t)) if f))


def test_copies_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        f = [rng.choice(["Name: x", "name:X", "b = 2", "B: 3", "c", "C ", "é: 1", ""]) for _ in range(rng.randrange(5))]
        rows.append((f"id{i:04}", rng.choice([";", " | ", "; "]).join(f)))
    rows += [("id0001", rows[1][1]), ("n1", None), ("n2", ""), ("n3", " ;|; !"), (None, "b = 2"), ("long1", "a;b|" * 3000), ("long2", "B|A;" * 3000), ("long3", "a;b|" * 2999 + "a;a")]
    groups = {}
    for i, t in rows:
        if i is not None and t and _fields(t):
            groups.setdefault(_fields(t), set()).add(i)
    want = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "id string, text string, f1 int, n int")
    assert {tuple(r) for r in copies(df).collect()} == want
    assert {tuple(r) for r in collapsed(df).collect()} == {(min(g), len(g)) for g in groups.values()}
    assert copies(df.where("false")).count() == 0


def _pairs(rows, least, lift):
    inc = {(b, i) for b, i in rows if b is not None and i is not None}
    n = len({b for b, _ in inc})
    often = Counter(i for _, i in inc)
    both = Counter()
    for b in {b for b, _ in inc}:
        both.update(itertools.combinations(sorted(i for c, i in inc if c == b), 2))
    return {(a, b, often[a], often[b], c, n) for (a, b), c in both.items() if c >= least and c * n >= lift * often[a] * often[b]}


def test_pair_counts_with_and_without_large_baskets(spark):
    rng = random.Random(2)
    rows = []
    for b in range(80):
        theme = rng.randrange(6)
        for _ in range(rng.choice([1, 3, 6, 30])):
            rows.append((f"b{b}", f"i{theme * 8 + rng.randrange(8):02}" if rng.random() < 0.8 else f"i{rng.randrange(48):02}"))
    rows += [("b0", None), (None, "i01"), ("b1", ""), ("b2", ""), ("b3", ""), ("b4", "")] + rows[:20]
    df = spark.createDataFrame([(b, i, "x") for b, i in rows], "src string, item string, basket string")
    inc = incidences(df, "src", "item")
    want = _pairs(rows, 4, 1.5)
    assert want
    for light in (256, 10, 5, 0):
        assert {tuple(r) for r in pair_counts(inc, 4, 1.5, light).collect()} == want, light
    assert pair_counts(inc.where("false")).count() == 0


def _tail(q, count):
    """By convolution, in logarithms that lose nothing to underflow."""
    pmf = [Fraction(1)]
    for x in q:
        pmf = [(pmf[i] if i < len(pmf) else 0) * (1 - x) + (pmf[i - 1] * x if i else 0) for i in range(len(pmf) + 1)]
    return sum(pmf[count:])


def test_null_keeps_margins_and_tails_are_exact():
    freqs, sizes = {2: 10, 5: 4, 9: 1}, {1: 9, 4: 5, 10: 2}
    null = ConfigurationNull(freqs, sizes)
    assert all(abs(null.p[i] @ null.md - k) < 1e-5 for i, k in enumerate(null.k))
    assert all(abs(null.mk @ null.p[:, j] - s) < 1e-5 for j, s in enumerate(null.d))
    for a, b in ((2, 2), (5, 9), (9, 5)):
        q = [x for x, m in zip(null.probabilities(a) * null.probabilities(b), null.md, strict=True) for _ in range(int(m))]
        for c in range(7):
            assert math.isclose(null.tail(a, b, c), _tail(q, c), rel_tol=1e-6, abs_tol=1e-300), (a, b, c)


def test_tails_far_out_and_of_large_counts():
    for q, n, counts in ((0.71, 1000, (700, 710, 800, 1000)), (0.01, 400, (4, 60, 399)), (0.5, 3000, (1600, 2500))):
        for c in counts:
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(q) + (n - i) * math.log(1 - q)) for i in range(c, n + 1))
            got = upper_tail(np.array([q]), np.array([float(n)]), c)
            assert math.isclose(got, exact, rel_tol=1e-7, abs_tol=1e-300), (q, n, c)
    assert upper_tail(np.array([0.3]), np.array([5.0]), 6) == 0.0 and upper_tail(np.array([0.3]), np.array([5.0]), 0) == 1.0


def test_classes_stay_few(monkeypatch):
    rng = random.Random(3)
    freqs = {int(10 * 1.0008**i) + i: rng.randrange(1, 4) for i in range(9000)}
    null = ConfigurationNull(freqs, {i: 9000 // i + 1 for i in range(1, 5000)}, rounds=20)
    assert len(null.k) < 700 and len(null.d) < 500
    few, sizes = {k: 60 // k + 1 for k in range(1, 40)}, {k: 60 // k + 1 for k in range(1, 40)}
    fine = ConfigurationNull(few, sizes)
    monkeypatch.setattr("evidentia.llm.cooccur.EXACT", 8)
    rough = ConfigurationNull(few, sizes)
    assert len(rough.k) < len(fine.k) + 1
    for a, b in ((3, 17), (25, 31), (38, 39)):
        assert math.isclose(rough.probabilities(a) @ rough.md, a, rel_tol=1e-3)
        assert math.isclose(rough.expected(a, b), fine.expected(a, b), rel_tol=0.02)


def test_surprise_has_ordered_values(spark):
    rows = [(f"b{b}", f"i{(b % 5) * 2 + x}") for b in range(60) for x in (0, 1)] + [(f"b{b}", f"r{b % 7}") for b in range(60)]
    df = spark.createDataFrame(rows, "s string, i string")
    got = surprise(df, "s", "i", 4, 3.0).collect()
    assert len(got) == 5
    assert all(0 < r.p_value <= r.q_value <= 1 and r.expected < r.n_ab for r in got)
    assert surprise(df.where("false"), "s", "i").count() == 0


def _set(t):
    w = WORD.findall((t or "").lower())
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def _admit(history, lines):
    kept, out = {}, set()
    for s, t in history:
        if s is not None and _set(t):
            kept.setdefault(s, []).append(_set(t))
    for _, _, i, s, t in sorted(lines, key=lambda x: x[:3]):
        x = _set(t)
        if s is None or not x:
            continue
        if any(2 * len(x & y) >= len(x | y) for y in kept.get(s, [])):
            out.add(i)
        else:
            kept.setdefault(s, []).append(x)
    return out


def _texts(rng, n):
    fixed = random.Random(0)
    base = [[f"w{fixed.randrange(60)}" for _ in range(fixed.randrange(1, 40))] for _ in range(40)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"W{rng.randrange(60)},"
        out.append(" ".join(w))
    return out


def test_pivots_bound_the_distance_and_do_not_saturate():
    rng = np.random.default_rng(4)
    for size in (5, 60, 100, 300, 1000, 5000):
        level, pruned = size.bit_length() - 1, 0
        for n in range(40):
            a = rng.integers(-(2**62), 2**62, size)
            b = np.concatenate([a[: size * n // 40], rng.integers(-(2**62), 2**62, size - size * n // 40)])
            apart = int(np.bitwise_count(counts_in_unary(a, level) ^ counts_in_unary(b, level)).sum())
            assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
            pruned += n < 4 and 3 * apart > 2 * size
        assert pruned >= 3, size


def test_a_cluster_of_near_lines_lists_no_pairs(spark):
    # A third of the lines near each other under one source.
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    lines = []
    for n in range(3000):
        w = list(base) if n % 3 == 0 else [f"x{rng.randrange(10**6)}" for _ in range(20)]
        w[rng.randrange(len(w))] = f"y{n}"
        lines.append((1, n, f"l{n}", "hot" if n % 3 == 0 else f"s{n % 50}", " ".join(w)))
    b = spark.createDataFrame(lines, "batch_no int, line_no long, id string, source_id string, text string")
    assert {r.id for r in admit(PivotTable(spark), b).collect()} == _admit([], lines)


def test_batches_equal_the_sequential_rule(spark, monkeypatch):
    rng = random.Random(6)
    history = [(rng.choice(["s1", "s1", "s2", None, ""]), t) for t in _texts(rng, 150)] + [("s1", None), ("s1", ""), ("s1", "...")]
    lines = [(b, n, f"x{b}_{n}", rng.choice(["s1", "s1", "s2", "s3", "", None]), t) for b in range(4) for n, t in enumerate(_texts(rng, 60))]
    lines += [(9, 0, "e1", "s1", None), (9, 1, "e2", "s1", ""), (9, 2, "e3", "s1", "?!"), (9, 3, "e4", "s4", "long " * 20_000), (9, 4, "e5", "s4", "LONG; " * 20_000)]
    h = spark.createDataFrame([(s, t, "z") for s, t in history], "source_id string, text string, runs string")
    b = spark.createDataFrame([(*x, 3) for x in lines], "batch_no int, line_no long, id string, source_id string, text string, size int")
    want = _admit(history, lines)
    assert 20 < len(want) < len(lines)
    table = PivotTable(spark)
    table.append(h)
    assert {r.id for r in admit(table, b).collect()} == want
    # One batch after the other over the growing table, with sources split into small parts.
    monkeypatch.setattr("evidentia.llm.batches.PART_ROWS", 7)
    monkeypatch.setattr("evidentia.llm.batches.CHUNK", 9)
    monkeypatch.setattr("evidentia.llm.batches.FAN", 3)
    monkeypatch.setattr("evidentia.llm.batches.BROADCAST_BYTES", 0)
    table = PivotTable(spark)
    table.append(h)
    got = set()
    for n in (0, 1, 2, 3, 9):
        got |= {r.id for r in admit(table, b.where(f"batch_no = {n}")).collect()}
    assert got == want
    none = PivotTable(spark)
    none.append(h.where("false"))
    assert admit(none, b.where("false")).count() == 0

"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

Counting. A pair is counted exactly if it reaches ``min_count`` baskets and ``min_lift`` times
what independence expects. Both bounds prune items before any pair is made, without loss: an
item needs ``min_count`` baskets, and since n_ab <= n_b the lift bound forces n_a <= n / min_lift.
Baskets of at most ``light`` items list their pairs, added up in each task before the shuffle.
Larger baskets, at most rows / light of them, are never expanded against themselves for pairs
already seen: each item carries the list of its large baskets, and the count of a pair is the
size of the intersection. A pair seen in no light basket needs ``min_count`` common large ones, so
it shares one outside the last ``min_count - 1`` (largest) of either item; only those are joined.
One basket that holds a third of all rows therefore produces no pairs of its own.

Surprise. The null keeps, in expectation, every item's frequency and every basket's size: item i
is in basket s with probability x_i y_s / (1 + x_i y_s). It is fitted over classes of frequencies
and of sizes: every value is its own class while there are at most ``EXACT`` of them; of more, those
from ``EXACT`` on share classes as wide as a ``1 / FINE`` part of the value, each standing for its
mean, so there are some hundreds of classes at any number of rows. The number of common baskets is then
Poisson-binomial. Its upper tail is found without loss at any size: the distribution is tilted so
that its mean is the observed count, taken from its characteristic function around that count, and
tilted back. This happens once per (n_a, n_b, n_ab), spread over tasks. Benjamini-Hochberg over all
possible pairs gives ``q_value``; the p-values are ranked in steps of a hundredth of a decade,
rounded up, hence never too small.

Results: rows with a null basket or item are left out, empty strings are values; repeated rows
count once; empty tables give an empty result; ties have equal values; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.scratch import materialise

#: Largest basket whose pairs are listed.
LIGHT = 256

#: Distinct frequencies, or sizes, up to which each is a class of its own; of more, those from ``EXACT`` on share classes as wide as a ``1 / FINE`` part.
EXACT, FINE = 256, 64

#: Kinds of pairs whose tails one task finds.
KINDS = 64


def incidences(df: DataFrame, basket: str, item: str) -> DataFrame:
    """Distinct ``basket, item``."""
    return df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()


def pair_counts(inc: DataFrame, min_count: int = 4, min_lift: float = 3.0, light: int = LIGHT) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n_ab, n`` of every pair that reaches both bounds; item_a < item_b. ``inc``: distinct ``basket, item``."""
    n = inc.select("basket").distinct().count()
    often = inc.groupBy("item").agg(F.count("*").alias("n_item")).where((F.col("n_item") >= min_count) & (F.col("n_item") * min_lift <= n))
    kept = materialise(inc.join(often, "item"), "cooccur-kept")
    sizes = kept.groupBy("basket").agg(F.count("*").alias("size"))
    large = sizes.where(F.col("size") > light)
    small = kept.join(large, "basket", "left_anti")
    listed = small.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    first = listed.select("items", F.posexplode("items").alias("at", "item_a"))
    pairs = first.select("item_a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("item_b"))
    seen = pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_light"))
    if large.limit(1).count():
        of_item = kept.join(large, "basket").groupBy("item").agg(F.sort_array(F.collect_list(F.struct("size", "basket"))).alias("large"))
        of_item = materialise(of_item, "cooccur-large")
        own = lambda side: of_item.select(F.col("item").alias(f"item_{side}"), F.col("large").alias(f"large_{side}"))
        both = F.coalesce(F.size(F.array_intersect("large_a", "large_b")), F.lit(0))
        head = of_item.where(F.size("large") >= min_count).select("item", "large", F.explode(F.expr(f"slice(large, 1, size(large) - {min_count - 1})")).alias("at"))
        a, b = (head.select(F.col("item").alias(f"item_{s}"), "at") for s in "ab")
        only_large = a.join(b, "at").where("item_a < item_b").select("item_a", "item_b").distinct()
        seen = seen.unionByName(only_large.withColumn("n_light", F.lit(0).cast("long"))).groupBy("item_a", "item_b").agg(F.sum("n_light").alias("n_light"))
        seen = seen.join(own("a"), "item_a", "left").join(own("b"), "item_b", "left").select("item_a", "item_b", (F.col("n_light") + F.when(F.col("large_a").isNull() | F.col("large_b").isNull(), 0).otherwise(both)).alias("n_ab"))
    else:
        seen = seen.withColumnRenamed("n_light", "n_ab")
    seen = seen.where(F.col("n_ab") >= min_count)
    freq = lambda side: often.select(F.col("item").alias(f"item_{side}"), F.col("n_item").alias(f"n_{side}"))
    out = seen.join(freq("a"), "item_a").join(freq("b"), "item_b").withColumn("n", F.lit(n).cast("long"))
    return out.where(F.col("n_ab") * F.col("n") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")).select("item_a", "item_b", "n_a", "n_b", "n_ab", "n")


def _classes(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values and how often each occurs; beyond ``EXACT`` distinct ones, the largest in classes of nearly equal ones."""
    values = np.array(sorted(counts), float)
    often = np.array([counts[int(v)] for v in values], float)
    if len(values) <= EXACT:
        return values, often
    split = int(np.searchsorted(values, EXACT))
    group = np.floor(np.log(values[split:] / EXACT) * FINE).astype(int)
    _, first = np.unique(group, return_index=True)
    n = np.add.reduceat(often[split:], first)
    means = np.add.reduceat(values[split:] * often[split:], first) / n
    return np.concatenate([values[:split], means]), np.concatenate([often[:split], n])


class ConfigurationNull:
    """Maximum-entropy bipartite null over classes of frequency and of size."""

    def __init__(self, freqs: dict[int, int], sizes: dict[int, int], rounds: int = 200, tolerance: float = 1e-9):
        """``freqs``: items per frequency; ``sizes``: baskets per size."""
        self.k, self.mk = _classes(freqs)
        self.d, self.md = _classes(sizes)
        total = max(1.0, float(self.k @ self.mk))
        self.x, self.y = self.k / math.sqrt(total), self.d / math.sqrt(total)
        for _ in range(rounds):
            was = self.x
            self.x = self.k / np.maximum((self.md * self.y / (1 + np.outer(self.x, self.y))).sum(1), 1e-300)
            self.y = self.d / np.maximum((self.mk * self.x / (1 + np.outer(self.y, self.x))).sum(1), 1e-300)
            if np.max(np.abs(self.x / was - 1), initial=0) < tolerance:
                break
        self.p = np.outer(self.x, self.y) / (1 + np.outer(self.x, self.y))

    def probabilities(self, k: int) -> np.ndarray:
        """For an item in ``k`` baskets, its probability in a basket of each class of sizes."""
        at = int(np.searchsorted(self.k, k))
        if at < len(self.k) and self.k[at] == k:
            return self.p[at]
        # Inside a class: the item's own parameter, so that its expected frequency is its own.
        x = float(np.interp(k, self.k, self.x))
        for _ in range(60):
            xy = x * self.y
            step = (k - self.md @ (xy / (1 + xy))) / max(float(self.md @ (self.y / (1 + xy) ** 2)), 1e-300)
            x = max(x + step, x / 4)
            if abs(step) <= 1e-12 * x:
                break
        return x * self.y / (1 + x * self.y)

    def expected(self, a: int, b: int) -> float:
        return float(self.md @ (self.probabilities(a) * self.probabilities(b)))

    def tail(self, a: int, b: int, count: int) -> float:
        """P(at least ``count`` common baskets) of items with frequencies ``a`` and ``b``."""
        return upper_tail(self.probabilities(a) * self.probabilities(b), self.md, count)


def upper_tail(q: np.ndarray, often: np.ndarray, count: int) -> float:
    """P(X >= count) for X the number of successes of ``often`` trials of each probability ``q``."""
    some = (q > 0) & (often > 0)
    q, often = q[some], often[some]
    trials = float(often.sum())
    if count <= 0:
        return 1.0
    if count > trials:
        return 0.0
    mean = float(often @ q)
    if count == trials:
        return float(np.exp(often @ np.log(q)))
    odds, t = np.log(q) - np.log1p(-np.minimum(q, 1 - 1e-16)), 0.0
    if count > mean:
        low, high = 0.0, 1.0
        tilted = lambda s: 1 / (1 + np.exp(-np.clip(odds + s, -700, 700)))
        while float(often @ tilted(high)) < count and high < 700:
            low, high = high, 2 * high
        for _ in range(100):
            t = (low + high) / 2
            low, high = (t, high) if float(often @ tilted(t)) < count else (low, t)
        p = tilted(t)
    else:
        p = q
    center = float(often @ p)
    width = 12 * math.sqrt(float(often @ (p * (1 - p))) + 1) + 40
    size = 1 << math.ceil(math.log2(2 * width))
    turn = np.exp(-2j * np.pi * np.arange(size) / size)
    log_phi = np.zeros(size, complex)
    for lo in range(0, len(p), 256):
        log_phi += often[lo : lo + 256] @ np.log(1 + p[lo : lo + 256, None] * (turn[None, :] - 1))
    # The log's branch does not matter: the powers are whole numbers.
    mass = np.fft.ifft(np.exp(log_phi)).real
    k = np.arange(max(0, math.floor(center - size / 2)), math.floor(center - size / 2) + size)
    k = k[k <= trials]
    mass = np.maximum(mass[k % size], 0.0)
    if count <= mean:
        return float(min(1.0, max(0.0, 1 - mass[k < count].sum())))
    log_m = float(often @ np.log1p(q * np.expm1(min(t, 600)))) if t < 600 else float(often @ (np.logaddexp(np.log1p(-np.minimum(q, 1 - 1e-16)), np.log(q) + t)))
    up = k >= count
    return float(min(1.0, np.sum(mass[up] * np.exp(np.clip(log_m - t * k[up], -745, 0)))))


def surprise(df: DataFrame, basket: str, item: str, min_count: int = 4, min_lift: float = 3.0, light: int = LIGHT) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n_ab, n, lift, expected, p_value, q_value`` of every pair that reaches both bounds."""
    inc = materialise(incidences(df, basket, item), "cooccur-inc")
    counted = materialise(pair_counts(inc, min_count, min_lift, light), "cooccur-pairs")
    tally = lambda by: {r[0]: r[1] for r in inc.groupBy(by).agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("m")).collect()}
    freqs = tally("item")
    null = inc.sparkSession.sparkContext.broadcast(ConfigurationNull(freqs, tally("basket")))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop(columns="part")
            b["expected"] = [null.value.expected(x, y) for x, y in zip(b.n_a, b.n_b, strict=True)]
            b["p_value"] = [max(1e-300, null.value.tail(x, y, z)) for x, y, z in zip(b.n_a, b.n_b, b.n_ab, strict=True)]
            yield b

    kinds = materialise(counted.select(F.least("n_a", "n_b").alias("n_a"), F.greatest("n_a", "n_b").alias("n_b"), "n_ab").distinct(), "cooccur-kinds")
    parts = -(-kinds.count() // KINDS) or 1
    spread = kinds.withColumn("part", F.pmod(F.xxhash64("n_a", "n_b", "n_ab"), F.lit(parts)).cast("int"))
    known = materialise(spread.repartitionById(parts, "part").mapInPandas(tails, "n_a bigint, n_b bigint, n_ab bigint, expected double, p_value double"), "cooccur-tails")
    low, high = F.least(F.col("c.n_a"), F.col("c.n_b")), F.greatest(F.col("c.n_a"), F.col("c.n_b"))
    scored = counted.alias("c").join(known.alias("k"), (low == F.col("k.n_a")) & (high == F.col("k.n_b")) & (F.col("c.n_ab") == F.col("k.n_ab"))).select("c.*", "expected", "p_value")
    step = F.ceil(F.log10("p_value") * 100).cast("int")
    scored = scored.withColumn("step", step)
    # At most 30,001 steps, however many pairs there are.
    ranks = {r.step: r.m for r in scored.groupBy("step").agg(F.count("*").alias("m")).collect()}
    items = sum(freqs.values())
    tests, rank, q = items * (items - 1) / 2, sum(ranks.values()), {}
    least = 1.0
    for s in sorted(ranks, reverse=True):
        least = min(least, 10 ** (s / 100) * tests / rank)
        q[s], rank = least, rank - ranks[s]
    levels = inc.sparkSession.createDataFrame(list(q.items()), "step int, q_value double")
    out = scored.join(F.broadcast(levels), "step").withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b")))
    return out.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n", "lift", "expected", "p_value", "q_value")

"""Splitting ideas that hold too many leaves, by recursive spherical 2-means.

Only ideas over the ceiling are grouped. One group is one task, so its size is bounded: an idea
with more than ``GROUP`` leaves is bisected inside the cluster, by the same 2-means from the same
seeds, until a part fits into one task. The seeds are the least similar pair, found exactly, at any
size; that search grows with the square of a part's leaves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators import pairs
from evidentia.scratch import materialise

CEILING, ROUNDS, GROUP = 16, 20, 4096


def _least(x: np.ndarray, y: np.ndarray) -> tuple[float, int, int]:
    """The least similarity of a row of ``x`` and one of ``y``, to nine decimals so that equal rows tie, and the first such pair."""
    best = (np.inf, 0, 0)
    for lo in range(0, len(x), 512):
        sims = (x[lo : lo + 512] @ y.T).round(9) + 0.0
        at = int(sims.argmin())
        if sims.flat[at] < best[0]:
            best = (float(sims.flat[at]), lo + at // len(y), at % len(y))
    return best


def seeds(x: np.ndarray) -> tuple[int, int]:
    """The two least similar rows; of several pairs the first."""
    return _least(x, x)[1:]


def _two(x: np.ndarray) -> np.ndarray:
    """Side of each row: 2-means on the sphere from the least similar pair, falling back to the median of the first side's similarity."""
    a, b = seeds(x)
    poles = np.stack([x[a], x[b]])
    side = None
    for _ in range(ROUNDS):
        now = (x @ poles[1] > x @ poles[0]).astype(int)
        if side is not None and (now == side).all():
            break
        side = now
        for s in (0, 1):
            if (side == s).any():
                mean = x[side == s].mean(0)
                size = np.linalg.norm(mean)
                if size > 1e-12:
                    poles[s] = mean / size
    if side is None or side.min() == side.max():
        order = np.argsort(-(x @ x[a]).round(9), kind="stable")
        side = np.zeros(len(x), int)
        side[order[len(x) // 2 :]] = 1
    return side


def parts(x: np.ndarray, ceiling: int = CEILING) -> list[np.ndarray]:
    """Row numbers of each part, largest first, then by first row; none over the ceiling, none empty."""
    todo, done = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= ceiling:
            done.append(rows)
        else:
            side = _two(x[rows])
            todo += [rows[side == 0], rows[side == 1]]
    return sorted(done, key=lambda r: (-len(r), int(r[0])))


def _unit(vec: pd.Series) -> np.ndarray:
    x = np.stack(vec.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _seeds(rows: DataFrame, kinds: dict[str, str]) -> dict[tuple, tuple]:
    """The least similar pair of each part of ``rows``, as two vectors: each two blocks of a part meet in one task."""

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf")
        x, y = pdf[pdf.own == pdf.lo], pdf[pdf.own == pdf.hi]
        out = []
        # Both ways round, so that of pairs that tie the one first by leaf is found.
        for one, two in ((x, y), (y, x)):
            if len(one) and len(two):
                u, v = _unit(one.vec), _unit(two.vec)
                sim, i, j = _least(u, v)
                out.append((pdf.idea.iloc[0], pdf.cell.iloc[0], sim, one.leaf.iloc[i], two.leaf.iloc[j], u[i], v[j]))
        return pd.DataFrame(out, columns=["idea", "cell", "sim", "a", "b", "va", "vb"])

    met = pairs.blocks(rows, "leaf", "n", pairs.BLOCK).repartition("idea", "cell", "lo", "hi").groupBy("idea", "cell", "lo", "hi")
    each = met.applyInPandas(least, f"idea {kinds['idea']}, cell string, sim double, a {kinds['leaf']}, b {kinds['leaf']}, va array<double>, vb array<double>")
    first = each.groupBy("idea", "cell").agg(F.min(F.struct("sim", "a", "b", "va", "vb")).alias("m")).collect()
    return {(r.idea, r.cell): np.array([r.m.va, r.m.vb]) for r in first}


def _sums(rows: DataFrame, poles: dict, before: dict, kinds: dict[str, str]) -> dict[tuple, list]:
    """Of each part and side under ``poles``: rows, rows that were on the other side under ``before``, and their sum."""

    def partial(batches):
        for b in batches:
            for (idea, cell), own in b.groupby(["idea", "cell"], sort=False):
                if (idea, cell) not in poles:
                    continue
                x = _unit(own.vec)
                now = _side(x, poles[idea, cell])
                was = _side(x, before[idea, cell]) if before else 1 - now
                yield pd.DataFrame([(idea, cell, s, int((now == s).sum()), int(((now == s) & (was != s)).sum()), x[now == s].sum(0)) for s in (0, 1)], columns=["idea", "cell", "side", "m", "moved", "total"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        return pd.DataFrame([(one.idea, one.cell, one.side, pdf.m.sum(), pdf.moved.sum(), np.stack(pdf.total.to_numpy()).sum(0))], columns=["idea", "cell", "side", "m", "moved", "total"])

    kind = f"idea {kinds['idea']}, cell string, side int, m long, moved long, total array<double>"
    found = rows.select("idea", "cell", "vec").mapInPandas(partial, kind).groupBy("idea", "cell", "side").applyInPandas(merged, kind).collect()
    out: dict[tuple, list] = {}
    for r in found:
        out.setdefault((r.idea, r.cell), [None, None])[r.side] = r
    return out


def _side(x: np.ndarray, poles: np.ndarray) -> np.ndarray:
    return (x @ poles[1] > x @ poles[0]).astype(int)


def _bisected(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``rows`` (``idea, cell, leaf, vec, n``) with each part cut in two: what ``_two`` does, over the cluster."""
    first = _seeds(rows, kinds)
    poles, before, cut, even = dict(first), {}, {}, set()
    for _ in range(ROUNDS):
        if not poles:
            break
        then = {}
        for part, sides in _sums(rows, poles, before, kinds).items():
            if before and not any(s.moved for s in sides):
                continue
            cut[part] = poles[part]
            even = even - {part} if all(s.m for s in sides) else even | {part}
            then[part] = poles[part].copy()
            for s in sides:
                size = np.linalg.norm(np.array(s.total) / s.m) if s.m else 0.0
                if size > 1e-12:
                    then[part][s.side] = np.array(s.total) / s.m / size
        before, poles = {k: poles[k] for k in then}, then

    def place(batches):
        for b in batches:
            side, near = np.zeros(len(b), int), np.zeros(len(b))
            for part, at in b.groupby(["idea", "cell"], sort=False).indices.items():
                x = _unit(b.vec.iloc[at])
                side[at] = -1 if part in even else _side(x, cut[part])
                near[at] = x @ first[part][0]
            yield b.assign(side=side, near=near)

    placed = rows.mapInPandas(place, f"idea {kinds['idea']}, cell string, leaf {kinds['leaf']}, vec {kinds['vec']}, n long, side int, near double")
    if even:
        order = F.row_number().over(W.partitionBy("idea", "cell").orderBy(F.desc(F.round("near", 9)), "leaf"))
        placed = placed.withColumn("at", order).withColumn("side", F.when(F.col("side") >= 0, F.col("side")).otherwise((F.col("at") > F.floor(F.col("n") / 2)).cast("int")))
    return placed.select("idea", F.concat("cell", F.col("side").cast("string")).alias("cell"), "leaf", "vec")


def split_ideas(vectors: DataFrame, idea: str, leaf: str, vec: str, ceiling: int = CEILING) -> DataFrame:
    """``idea, leaf, part``: part 0 is the largest and keeps the idea's id. Ideas at or below the ceiling do not appear; leaves without a vector are refused."""
    rows = vectors.where(F.col(idea).isNotNull()).select(F.col(idea).alias("idea"), F.col(leaf).alias("leaf"), F.col(vec).alias("vec"))
    big = rows.groupBy("idea").agg(F.count("*").alias("n"), F.count_if(F.col("vec").isNull()).alias("bare")).where(F.col("n") > ceiling)
    top = big.agg(F.max("n"), F.min(F.when(F.col("bare") > 0, F.col("idea")))).first()
    if top[1] is not None:
        raise ValueError(f"leaves of {top[1]} have no vector")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.join(big.select("idea", "n"), "idea").withColumn("cell", F.lit("")).select("idea", "cell", "leaf", "vec", "n")
    ready = [rows.where(F.col("n") <= GROUP)]
    large = rows.where(F.col("n") > GROUP)
    more = bool(top[0] and top[0] > GROUP)
    while more:
        cut = materialise(_bisected(materialise(large, "large"), kinds), "halves")
        cut = cut.join(cut.groupBy("idea", "cell").agg(F.count("*").alias("n")), ["idea", "cell"]).select("idea", "cell", "leaf", "vec", "n")
        ready.append(cut.where(F.col("n") <= GROUP))
        large = cut.where(F.col("n") > GROUP)
        more = not large.isEmpty()

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("leaf")
        part = np.zeros(len(pdf), int)
        for n, members in enumerate(parts(_unit(pdf.vec), ceiling)):
            part[members] = n
        return pd.DataFrame({"idea": pdf.idea, "cell": pdf.cell, "leaf": pdf.leaf, "local": part})

    found = reduce(DataFrame.unionByName, ready).drop("n").groupBy("idea", "cell").applyInPandas(cluster, f"idea {kinds['idea']}, cell string, leaf {kinds['leaf']}, local int")
    sizes = found.groupBy("idea", "cell", "local").agg(F.count("*").alias("m"), F.min("leaf").alias("low"))
    numbered = sizes.withColumn("part", F.row_number().over(W.partitionBy("idea").orderBy(F.desc("m"), "low")) - 1)
    return found.join(numbered, ["idea", "cell", "local"]).select("idea", "leaf", F.col("part").cast("int").alias("part"))

"""Similarity of every two rows of a group, whatever the group's size.

Groups of up to ``SMALL`` rows are joined with themselves. Larger ones are cut into blocks of some
``BLOCK`` rows by a hash of the key, and each two blocks meet in one task, once, with one matrix
product: the memory of a task is bounded by ``BLOCK``, and no pair is left out. Where pairs are listed, a
group has ``PARTS`` blocks, or more once those have ``WIDE`` times ``BLOCK`` rows, which bounds the copies of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.vectors import dot

SMALL, BLOCK, PARTS, WIDE = 64, 1024, 10, 16

PAIRS = "a long, b long, cosine double"


def blocks(rows: DataFrame, key: str, n: str, size: int | Column) -> DataFrame:
    """``rows`` with ``lo``, ``hi`` and ``own``, the row's block: each row once for every block that its own meets. ``n``: rows of its group."""
    count = F.ceil(F.col(n) / size).cast("int")
    cut = rows.withColumn("own", F.pmod(F.xxhash64(key), count).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return met.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def _sized(rows: DataFrame, group: str, key: str) -> DataFrame:
    rows = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    return rows.join(rows.groupBy(group).agg(F.count("*").alias("n")), group)


def _met(pdf: pd.DataFrame, key: str, vec: str) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    """Both blocks by key, the cosines, and which of them count: each pair once, no row with itself."""
    pdf = pdf.sort_values(key)
    if pdf.lo.iloc[0] == pdf.hi.iloc[0]:
        x = y = pdf
    else:
        x, y = pdf[pdf.own == pdf.lo], pdf[pdf.own == pdf.hi]
    if not len(x) or not len(y):
        return x, y, np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), bool)
    near = (np.stack(x[vec].to_numpy()).astype(np.float64) @ np.stack(y[vec].to_numpy()).astype(np.float64).T).round(6) + 0.0
    a, b = x[key].to_numpy(), y[key].to_numpy()
    return x, y, near, a[:, None] < b[None, :] if x is y else np.ones(near.shape, bool)


def _in_blocks(rows: DataFrame, group: str, key: str, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return blocks(rows.where(F.col("n") > SMALL), key, "n", BLOCK).groupBy(group, "lo", "hi").applyInPandas(run, schema)


def _joined(rows: DataFrame, group: str, key: str, vec: str, more: Sequence[str] = ()) -> DataFrame:
    u = rows.where(F.col("n") <= SMALL).drop("n")
    b = u.select(group, F.col(key).alias("b"), F.col(vec).alias("_vb"), *(F.col(c).alias(f"_{c}") for c in more))
    return u.join(b, group).where(F.col(key) < F.col("b")).withColumn("cosine", F.round(dot(F.col(vec), F.col("_vb")), 6))


def within(rows: DataFrame, group: str, key: str, vec: str) -> DataFrame:
    """``group, a, b, cosine`` of every two rows of a group, ``a < b``; keys are long, vectors of unit length and one dimension."""
    rows = _sized(rows.select(group, key, vec), group, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = pa.Table.from_batches(batches).sort_by(key)
        ids, own = met[key].to_numpy(), met["own"].to_numpy()
        lo, hi = met["lo"][0].as_py(), met["hi"][0].as_py()
        v = np.stack(met[vec].to_numpy()).astype(np.float64)
        xs, ys = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        for i in range(0, len(xs), BLOCK):
            for j in range(i if lo == hi else 0, len(ys), BLOCK):
                x, y = xs[i : i + BLOCK], ys[j : j + BLOCK]
                near = (v[x] @ v[y].T).round(6) + 0.0
                a, b = np.repeat(ids[x], len(y)), np.tile(ids[y], len(x))
                near = near.ravel()
                if lo == hi and i == j:
                    once = a < b
                    a, b, near = a[once], b[once], near[once]
                yield pa.RecordBatch.from_arrays([pa.repeat(met[group][0], len(a)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near)], names=[group, "a", "b", "cosine"])

    size = F.least(F.greatest(F.ceil(F.col("n") / PARTS), F.lit(BLOCK)), F.lit(WIDE * BLOCK))
    # Without a shuffle of their own all blocks of a group would meet in one task.
    cut = blocks(rows.where(F.col("n") > SMALL), key, "n", size).repartition(group, "lo", "hi").groupBy(group, "lo", "hi")
    large = cut.applyInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, {PAIRS}")
    return _joined(rows, group, key, vec).select(group, F.col(key).alias("a"), "b", "cosine").unionByName(large)


def agreement(rows: DataFrame, group: str, key: str, vec: str, label: str) -> DataFrame:
    """``cosine, pos, neg``: pairs of a group with that similarity whose labels are equal, and unequal. Pairs of large groups are counted where they meet, and never listed."""
    rows = _sized(rows.select(group, key, vec, label).where(F.col(label).isNotNull()), group, key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, near, counts = _met(pdf, key, vec)
        same = (x[label].to_numpy()[:, None] == y[label].to_numpy()[None, :])[counts]
        values, at = np.unique(near[counts], return_inverse=True)
        pos = np.bincount(at[same], minlength=len(values))
        return pd.DataFrame({"cosine": values, "pos": pos, "neg": np.bincount(at, minlength=len(values)) - pos})

    small = _joined(rows, group, key, vec, [label]).withColumn("same", (F.col(label) == F.col(f"_{label}")).cast("long"))
    large = _in_blocks(rows, group, key, run, "cosine double, pos long, neg long")
    every = small.select("cosine", F.col("same").alias("pos"), (1 - F.col("same")).alias("neg")).unionByName(large)
    return every.groupBy("cosine").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def threshold_sweep(counted: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """``threshold, balanced``: of pairs counted by similarity (``agreement``), the mean of both classes' shares on their side."""
    rows = counted.select("cosine", "pos", "neg", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold"))
    over = F.col("cosine") >= F.col("threshold")
    share = lambda label, side: F.coalesce(F.sum(F.when(side, F.col(label)).otherwise(0)) / F.nullif(F.sum(label), F.lit(0)), F.lit(0.0))
    return rows.groupBy("threshold").agg(F.round((share("pos", over) + share("neg", ~over)) / 2, 6).alias("balanced"))

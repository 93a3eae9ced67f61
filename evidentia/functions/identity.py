"""Content identity: what makes two texts, sources or leaves the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.words import SPACE
from evidentia.scratch import materialise


def normalise(text: Column) -> Column:
    """White space collapsed and trimmed, lower case; null for null."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE + "+", " ")))


def text_hash(text: Column) -> Column:
    return F.md5(normalise(text))


def source_id(url: Column, version: Column) -> Column:
    """First 16 hex digits of the SHA-1 of url and version."""
    return F.substring(F.sha1(F.concat(url, version)), 1, 16)


def leaf_id(source: Column, hashed: Column) -> Column:
    """Id derived from the leaf's identity, so that a retried write makes the same id."""
    return F.concat(F.lit("th_"), F.substring(F.sha1(F.concat_ws("|", source, hashed)), 1, 12))


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the given order; the order should end in a unique column."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def with_sequence(new: DataFrame, last: int, *order: str) -> DataFrame:
    """``seq`` from ``last + 1`` on, in the given order.

    The rows are cut into ranges of the order and sorted in each; one number per range, its row count,
    tells where the next one starts. No task holds more than its range.
    """
    parts = materialise(new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "sequence")
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row per range
    starts, total = [], last
    for part, n in sizes:
        starts.append((part, total))
        total += n
    base = parts.sparkSession.createDataFrame(starts, "_part int, _base long")
    within = F.row_number().over(W.partitionBy("_part").orderBy("_at"))
    return parts.join(F.broadcast(base), "_part").withColumn("seq", within + F.col("_base")).drop("_part", "_at", "_base")

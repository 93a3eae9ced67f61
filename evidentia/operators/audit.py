"""Invariants of the store and of the index over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ideas_without_leaves(ideas: DataFrame, leaves: DataFrame, sources: DataFrame) -> DataFrame:
    """Ideas to which no leaf leads whose source exists."""
    held = leaves.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("idea_id").alias("id"))
    return ideas.select("id").distinct().join(held, "id", "left_anti")


def index_missing(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """Leaves without an index row."""
    return leaves.select("id").distinct().join(index.select(F.col("thesis_id").alias("id")), "id", "left_anti")


def stale_links(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """``id, idea_id, indexed_idea``: index rows that name another idea than the leaf."""
    own = leaves.select("id", "idea_id").distinct()
    there = index.select(F.col("thesis_id").alias("id"), F.col("idea_id").alias("indexed_idea")).distinct()
    return own.join(there, "id").where(~F.col("idea_id").eqNullSafe(F.col("indexed_idea")))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").where(F.col("l").isNull() | F.col("r").isNull()).select(key, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def counts(**tables: DataFrame) -> DataFrame:
    """``what, n``: rows of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def health(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """One row: distinct leaves and indexed leaves, how many miss, are extra or stale, and whether all is in step."""
    missing = index_missing(leaves, index).agg(F.count("*").alias("missing"))
    extra = index.select(F.col("thesis_id").alias("id")).distinct().join(leaves.select("id"), "id", "left_anti").agg(F.count("*").alias("extra"))
    stale = stale_links(leaves, index).agg(F.countDistinct("id").alias("stale"))
    n = leaves.agg(F.countDistinct("id").alias("leaves"))
    m = index.agg(F.countDistinct("thesis_id").alias("indexed"))
    row = n.crossJoin(m).crossJoin(missing).crossJoin(extra).crossJoin(stale)  # one row each
    return row.withColumn("in_sync", (F.col("missing") + F.col("extra") + F.col("stale")) == 0)


def leaf_counts(leaves: DataFrame) -> DataFrame:
    return leaves.where(F.col("idea_id").isNotNull()).groupBy("idea_id").agg(F.countDistinct("id").alias("n"))


def over_ceiling(leaves: DataFrame, ceiling: int = 16) -> DataFrame:
    return leaf_counts(leaves).where(F.col("n") > ceiling)


def multi_source_share(leaves: DataFrame) -> DataFrame:
    """One row: ideas with leaves, those with two sources or more, and their share."""
    per = leaves.where(F.col("idea_id").isNotNull()).groupBy("idea_id").agg(F.countDistinct("source_id").alias("sources"))
    many = F.sum((F.col("sources") >= 2).cast("long"))
    return per.agg(F.count("*").alias("ideas"), F.coalesce(many, F.lit(0)).alias("multi"), F.round(F.coalesce(many / F.count("*"), F.lit(0.0)), 3).alias("share"))


def trust_histogram(ideas: DataFrame) -> DataFrame:
    """``bucket, n``: ideas by tenths of trust, the last bucket holding 8 and above; unjudged ones in bucket -1."""
    bucket = F.coalesce(F.least(F.lit(8), F.bround(F.col("trust_score") * 10).cast("int")), F.lit(-1))
    return ideas.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def at_limit(value: Column, limit: int) -> Column:
    """Whether a text is exactly as long as its limit, the mark of a cut answer."""
    return F.coalesce(F.char_length(value) == limit, F.lit(False))


def split_guard(assigned: DataFrame, owned: DataFrame) -> DataFrame:
    """``leaf_id, problem``: leaves given to two parts (``twice``) or not owned by the parent (``stolen``)."""
    twice = assigned.groupBy("leaf_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("leaf_id", F.lit("twice").alias("problem"))
    stolen = assigned.select("leaf_id").distinct().join(owned.select("leaf_id"), "leaf_id", "left_anti").withColumn("problem", F.lit("stolen"))
    return twice.unionByName(stolen)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def share_by(df: DataFrame, key: str, flag: str) -> DataFrame:
    """``key, n, hit, share``: rows, rows with the flag, and their share."""
    hit = F.sum(F.col(flag).cast("long"))
    return df.groupBy(key).agg(F.count("*").alias("n"), hit.alias("hit"), F.round(hit / F.count("*"), 3).alias("share"))


def phase_report(sources: DataFrame, ideas: DataFrame, leaves: DataFrame, ceiling: int = 16) -> DataFrame:
    """One row: what the store holds, and what should not be. Only leaves with both ends count.

    An idea without leaves is a hypothesis if it was synthesised, and a broken write if not.
    """
    held = leaves.join(sources.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi").join(ideas.select(F.col("id").alias("idea_id")).distinct(), "idea_id", "left_semi")
    per = held.groupBy("idea_id").agg(F.countDistinct("source_id").alias("s"), F.countDistinct("id").alias("n"))
    bare = ideas.select("id", "origin").distinct().join(per.select(F.col("idea_id").alias("id")), "id", "left_anti")
    made = F.col("origin").eqNullSafe("synthesized")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    row = held.agg(F.countDistinct("source_id").alias("sources"), F.countDistinct("id").alias("theses"))
    row = row.crossJoin(ideas.agg(F.countDistinct("id").alias("ideas")))  # one row each
    row = row.crossJoin(per.agg(F.round(F.avg((F.col("s") >= 2).cast("int")), 3).alias("multi_source"), n(F.col("n") > ceiling).alias("over_ceiling")))
    return row.crossJoin(bare.agg(n(~made).alias("broken"), n(made).alias("hypotheses")))


def truncated(schema: T.StructType, limits: dict[str, int]) -> Column:
    """Paths, at any depth, of the texts that are exactly as long as their limit; a list's path is that of its entries, given once."""

    def at(field: Column, kind: T.DataType, path: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in at(field[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StringType):
                return [F.when(F.coalesce(F.exists(field, lambda x: at_limit(x, limits[path])), F.lit(False)), F.lit(path))] if path in limits else []
            return [c for f in getattr(kind.elementType, "fields", []) for c in at(field[f.name], T.ArrayType(f.dataType), f"{path}.{f.name}")]
        return [F.when(at_limit(field, limits[path]), F.lit(path))] if path in limits and isinstance(kind, T.StringType) else []

    marks = [c for f in schema.fields for c in at(F.col(f.name), f.dataType, f.name)]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())

"""Queries of the references to missing records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.orphans import ReferenceState, parents, references
from evidentia.plans.tables import table
from evidentia.scratch import materialise

#: Steps in which the tables are taken in, at most.
STEPS = 4


def _quarter(at: Column) -> Column:
    return F.when(at.isNull(), "0").otherwise(F.concat(F.year(at), F.lit("Q"), F.quarter(at)))


def _state(spark: SparkSession, d: str) -> ReferenceState:
    """The tables as they came in, quarter by quarter; what has no time comes first."""
    thesis, idx = table(spark, d, "thesis_out"), table(spark, d, "idx_thesis")
    sources, ideas, removed = table(spark, d, "sources"), table(spark, d, "ideas"), table(spark, d, "removals")
    refs = references(thesis, "thesis_out", "source_id", "id", "sources", "created_at").unionByName(references(thesis, "thesis_out", "idea_id", "id", "ideas", "created_at")).unionByName(references(idx, "idx_thesis", "idea_id", "thesis_id", "ideas", None))
    refs = materialise(refs.withColumn("quarter", _quarter(F.col("at"))), "orphan-new", "quarter")
    there = materialise(parents(sources, "sources", "id", "retrieved_at").unionByName(parents(ideas, "ideas", "id", "created_at")).withColumn("quarter", _quarter(F.col("since"))), "orphan-there")
    gone = removed.select(F.col("parent_table").alias("parent"), F.col("removed_id").alias("key"), _quarter(F.col("removed_at")).alias("quarter")).dropna(subset=["parent", "key"])
    # A removed key that is in no table now was there from the start; one that is, was put back in the end.
    lost = gone.join(there, ["parent", "key"], "left_anti").select("parent", "key", F.lit(None).cast("timestamp").alias("since")).distinct()
    again = there.join(gone.select("parent", "key").distinct(), ["parent", "key"], "left_semi").select("parent", "key", "since")
    tell = lambda df, what: df.select("quarter", F.lit(what).alias("what")).distinct()
    news: dict[str, set[str]] = {}
    for r in tell(refs, "refs").unionByName(tell(there, "there")).unionByName(tell(gone, "gone")).collect():
        news.setdefault(r.quarter, set()).add(r.what)
    order = sorted(news)
    state = ReferenceState(spark)
    state.step(arrived=lost)
    # At most STEPS steps, each of whole quarters.
    for part in (order[len(order) * i // STEPS : len(order) * (i + 1) // STEPS] for i in range(STEPS)):
        has = lambda what: any(what in news[q] for q in part)  # noqa: B023, E731
        some = lambda df, what: df.where(F.col("quarter").isin(part)).drop("quarter") if has(what) else None  # noqa: B023, E731
        if part:
            state.step(some(refs, "refs"), some(there, "there"), some(gone, "gone"))
    state.step(arrived=again)
    return state


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).waiting().select("tab", "field", "row_key").distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).counts()


_BASE = """
WITH parent AS (
  SELECT 'sources' AS parent, id AS key, min(TRY_CAST(nullif(trim(retrieved_at), '') AS TIMESTAMPTZ)) AS since FROM sources WHERE id IS NOT NULL GROUP BY id
  UNION ALL
  SELECT 'ideas', id, min(TRY_CAST(nullif(trim(created_at), '') AS TIMESTAMPTZ)) FROM ideas WHERE id IS NOT NULL GROUP BY id),
ref AS (
  SELECT DISTINCT * FROM (
    SELECT 'thesis_out' AS tab, 'source_id' AS field, id AS row_key, 'sources' AS parent, source_id AS key, TRY_CAST(nullif(trim(created_at), '') AS TIMESTAMPTZ) AS born FROM thesis_out WHERE source_id IS NOT NULL
    UNION ALL
    SELECT 'thesis_out', 'idea_id', id, 'ideas', idea_id, TRY_CAST(nullif(trim(created_at), '') AS TIMESTAMPTZ) FROM thesis_out WHERE idea_id IS NOT NULL
    UNION ALL
    SELECT 'idx_thesis', 'idea_id', thesis_id, 'ideas', idea_id, NULL FROM idx_thesis WHERE idea_id IS NOT NULL)),
judged AS (
  SELECT r.*, p.key IS NULL AS missing, p.key IS NOT NULL AND coalesce(p.since > r.born, false) AS late
  FROM ref r LEFT JOIN parent p ON p.parent = r.parent AND p.key = r.key)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
ORACLE = {
    "p2_found": _BASE + "SELECT DISTINCT tab, field, row_key FROM judged WHERE missing OR late",
    "p2_report": _BASE
    + """SELECT tab, field, strftime(timezone('UTC', born), '%Y-%m') AS month, CAST(sum(CAST(missing AS INT)) AS BIGINT) AS missing,
  CAST(sum(CAST(late AS INT)) AS BIGINT) AS late, count(*) AS refs FROM judged GROUP BY 1, 2, 3""",
}

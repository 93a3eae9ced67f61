"""The model's tables as the operators want them, from the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.times import instant
from evidentia.plans.tables import table


def leaves(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct leaves: deliveries repeated in full count once."""
    cols = columns or ("id", "source_id", "idea_id", "text", "created_at", "run_success")
    return table(spark, d, "thesis_out").select(*cols).distinct()


def ideas(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each idea."""
    newest = W.partitionBy("id").orderBy(F.desc_nulls_last(instant(F.col("updated_at"))), F.asc_nulls_last("text"), F.asc_nulls_last("trust_score"))
    return table(spark, d, "ideas").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The first post of each source: title and type stay as first seen."""
    first = W.partitionBy("id").orderBy(F.asc_nulls_last(instant(F.col("retrieved_at"))), F.asc_nulls_last("title"), F.asc_nulls_last("type"))
    return table(spark, d, "sources").withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "idx_thesis")


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Index rows whose vector has 384 values and unit length, ``row_id`` and ``vec``."""
    from evidentia.functions.vectors import problem

    return index(spark, d).where(problem(F.col("vec"), 384).isNull())


def scored_ideas(spark: SparkSession, d: str) -> DataFrame:
    """``idea_id, trust``: a third of the ideas counts as unjudged, so that the quota binds."""
    unjudged = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 3 == 0
    return ideas(spark, d).select(F.col("id").alias("idea_id"), F.when(unjudged, 0.0).otherwise(F.col("trust_score")).alias("trust"))


WITH = """
leaf AS (SELECT DISTINCT id, source_id, idea_id, text, created_at, run_success FROM thesis_out),
idea AS (SELECT * FROM ideas QUALIFY row_number() OVER (PARTITION BY id ORDER BY TRY_CAST(nullif(trim(updated_at), '') AS TIMESTAMPTZ) DESC NULLS LAST, text ASC NULLS LAST, trust_score ASC NULLS LAST) = 1),
src AS (SELECT * FROM sources QUALIFY row_number() OVER (PARTITION BY id ORDER BY TRY_CAST(nullif(trim(retrieved_at), '') AS TIMESTAMPTZ) ASC NULLS LAST, title ASC NULLS LAST, type ASC NULLS LAST) = 1),
unit AS (SELECT * FROM idx_thesis WHERE len(vec) = 384 AND abs(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) - 1.0) <= 1e-3),
judged AS (SELECT id AS idea_id, CASE WHEN ('0x' || substr(md5(id), 1, 4))::INT % 3 = 0 THEN 0.0 ELSE trust_score END AS trust FROM idea),
pair AS (SELECT a.source_id, a.idea_id AS idea_a, b.idea_id AS idea_b, least(a.n, b.n) AS w FROM
  (SELECT source_id, idea_id, count(DISTINCT id) AS n FROM leaf WHERE source_id IS NOT NULL AND idea_id IS NOT NULL GROUP BY 1, 2) a JOIN
  (SELECT source_id, idea_id, count(DISTINCT id) AS n FROM leaf WHERE source_id IS NOT NULL AND idea_id IS NOT NULL GROUP BY 1, 2) b ON a.source_id = b.source_id AND a.idea_id < b.idea_id),
cocited AS (SELECT idea_a, idea_b, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n_sources FROM pair GROUP BY 1, 2),
edge AS (SELECT idea_a AS source_id, idea_b AS target_id, weight FROM cocited UNION ALL SELECT idea_b, idea_a, weight FROM cocited)
"""


def sql(body: str) -> str:
    """``body`` with the model's tables before it."""
    head = "WITH RECURSIVE" + WITH
    return head + ("," + body.strip()[4:] if body.strip().upper().startswith("WITH") else body)

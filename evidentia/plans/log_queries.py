"""Queries over logs: evolution runs, jobs, traces, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators import jobs, runlog
from evidentia.plans.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# A user's events are one run: each event is a mutant of the one before it, an error is a dead one.
_LOG = """
WITH m AS (SELECT event_id AS program_id, user_id, CASE WHEN event_type = 'error' THEN -1000.0 WHEN event_type = 'signup' THEN NULL ELSE value END AS fitness, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events),
p AS (SELECT m.*, CASE WHEN q.fitness <> -1000.0 THEN q.fitness END AS parent_fitness FROM m LEFT JOIN m q ON q.program_id = m.parent),
d AS (SELECT *, round(CASE WHEN fitness <> -1000.0 THEN fitness END - parent_fitness, 6) AS delta FROM p)
"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _mutants(spark: SparkSession, d: str) -> DataFrame:
    parent = F.lag("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    fitness = F.when(F.col("event_type") == "error", F.lit(runlog.DEAD)).when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.col("value"))
    rows = _events(spark, d).select(F.col("event_id").alias("program_id"), fitness.alias("fitness"), parent.alias("parent"))
    return rows.select("program_id", "fitness", F.when(F.col("parent").isNotNull(), F.array("parent")).otherwise(F.array().cast("array<bigint>")).alias("parent_ids"))


@query(_LOG + "SELECT program_id, parent_fitness, delta FROM d")
def parent_delta(spark: SparkSession, d: str) -> DataFrame:
    return runlog.with_delta(_mutants(spark, d)).select("program_id", "parent_fitness", "delta")


@query(_LOG + "SELECT program_id, CASE WHEN fitness IS NULL THEN 'no_fitness' WHEN fitness = -1000.0 THEN 'dead' WHEN parent IS NULL THEN 'root' WHEN parent_fitness IS NULL THEN 'parent_unmeasured' WHEN abs(delta) < 1.0 THEN 'min_delta' END AS reason FROM d")
def runlog_gate(spark: SparkSession, d: str) -> DataFrame:
    return runlog.gate(runlog.with_delta(_mutants(spark, d)), 1.0).select("program_id", "reason")


@query(_LOG + "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN fitness IS NULL THEN 'no_fitness' WHEN fitness = -1000.0 THEN 'dead' WHEN parent IS NULL THEN 'root' WHEN parent_fitness IS NULL THEN 'parent_unmeasured' WHEN abs(delta) < 1.0 THEN 'min_delta' ELSE 'kept' END AS reason FROM d) GROUP BY 1")
def drop_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = runlog.gate(runlog.with_delta(_mutants(spark, d)), 1.0)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(_LOG + "SELECT program_id, delta FROM d WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, program_id LIMIT 100")
def top_delta(spark: SparkSession, d: str) -> DataFrame:
    return runlog.top_delta(runlog.with_delta(_mutants(spark, d)), 100).select("program_id", "delta")


@query(_LOG + "SELECT program_id, delta > 0 AS run_success, 'fitness ' || parent_fitness || ' -> ' || fitness || printf(' (%+.2f)', fitness - parent_fitness) AS effect FROM d WHERE delta IS NOT NULL")
def effect_strings(spark: SparkSession, d: str) -> DataFrame:
    rows = runlog.with_delta(_mutants(spark, d)).where("delta is not null")
    return rows.select("program_id", (F.col("delta") > 0).alias("run_success"), runlog.effect_text(F.col("parent_fitness"), F.col("fitness")).alias("effect"))


@query("""SELECT event_id, CASE WHEN raw IS NOT NULL AND json_valid(raw) THEN json_exists(raw, '$.archetype') AND json_exists(raw, '$.changes') ELSE false END AS parsed FROM
 (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"archetype": "a", "changes": [' || props || ']}' WHEN 1 THEN props WHEN 2 THEN substr(props, 1, 3) WHEN 3 THEN NULL ELSE '{"archetype": "b", "changes": []}' END AS raw FROM events)""")
def json_gate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit('{"archetype": "a", "changes": ['), "props", F.lit("]}"))).when(k == 1, F.col("props")).when(k == 2, F.substring("props", 1, 3)).when(k == 4, '{"archetype": "b", "changes": []}')
    return _events(spark, d).select("event_id", runlog.parse_output(raw).isNotNull().alias("parsed"))


@query(r"""SELECT DISTINCT url, regexp_extract(url, '^run://([^/]+)', 1) || '_' || version AS run, CASE WHEN regexp_matches(version, 'seed\d+$') THEN regexp_extract(version, 'seed(\d+)$', 1) ELSE regexp_extract(url, '^run://([^/]+)', 1) || '_' || version END AS seed,
 regexp_replace(regexp_extract(url, '^run://([^/]+)', 1) || '_' || version, '_seed\d+$', '') AS task FROM sources WHERE url LIKE 'run://%'""")
def run_fields(spark: SparkSession, d: str) -> DataFrame:
    run = F.concat(F.regexp_extract("url", "^run://([^/]+)", 1), F.lit("_"), F.col("version"))
    rows = table(spark, d, "sources").where(F.col("url").startswith("run://")).select("url", run.alias("run")).distinct()
    return rows.select("url", "run", runlog.seed(F.col("run")).alias("seed"), runlog.task(F.col("run")).alias("task"))


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "staged").when(F.col("event_type") == "purchase", "ok").otherwise("failed")
    return _events(spark, d).select("user_id", "ts", "event_id", status.alias("status"))


_STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'staged' WHEN 'purchase' THEN 'ok' ELSE 'failed' END"


@query(f"SELECT user_id AS job, {_STATUS} AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_last_event(spark: SparkSession, d: str) -> DataFrame:
    return jobs.last_event(_jobs(spark, d), "user_id", "ts", "event_id").select(F.col("user_id").alias("job"), "status", "event_id")


@query(f"SELECT s AS status, count(e.user_id) AS n FROM (SELECT unnest(['queued', 'running', 'staged', 'ok', 'failed']) AS s) LEFT JOIN (SELECT user_id, {_STATUS} AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON e.status = s GROUP BY 1")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return jobs.status_counts(jobs.last_event(_jobs(spark, d), "user_id", "ts", "event_id"))


@query(f"SELECT event_id, status FROM (SELECT event_id, ts, {_STATUS} AS status FROM events) WHERE status IN ('ok', 'failed') QUALIFY row_number() OVER (PARTITION BY status ORDER BY ts DESC, event_id DESC) <= 200")
def keep_finished(spark: SparkSession, d: str) -> DataFrame:
    done = _jobs(spark, d).where(F.col("status").isin("ok", "failed"))
    return jobs.keep_finished(done, "status", F.desc("ts"), F.desc("event_id")).select("event_id", "status")


@query("SELECT user_id || ':' || event_type AS key, min_by(event_id, (ts, event_id)) AS first, count(DISTINCT md5(coalesce(props, ''))) > 1 AS conflict, count(*) AS requests FROM events GROUP BY user_id, event_type")
def enqueue_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return jobs.enqueue(rows, "key", "props", "ts", "event_id")


@query("SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total, CAST(sum(CAST(event_type = 'error' AS INT)) AS BIGINT) AS failures FROM events GROUP BY 1, 2")
def trace_cost(spark: SparkSession, d: str) -> DataFrame:
    return jobs.costs(_events(spark, d).withColumn("failed", F.col("event_type") == "error"), ["user_id", "event_type"], "value")


@query(f"SELECT event_id FROM (SELECT event_id, ts, {_STATUS} AS status FROM events) WHERE status = 'queued' ORDER BY ts, event_id LIMIT 1")
def job_claim(spark: SparkSession, d: str) -> DataFrame:
    return jobs.claim(_jobs(spark, d), "queued", "ts", "event_id").select("event_id")

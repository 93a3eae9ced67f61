"""Deterministic parts of the research loop: which queries may leave, and what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.safety import KNOWN, REPEAT, SHORTEST, has_secret, jaccard, one_line, token_set
from evidentia.functions.web import canonical, is_public, web_id

#: Longest query, most queries of a request.
LENGTH, MOST = 400, 200


def safe_queries(candidates: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``request, position, query`` of the candidates that may be sent, the first ``most`` per request.

    Left out: short ones, ones with a secret, repeats of an earlier candidate that was kept, and
    whole known ideas. Keeping depends on what was kept before, so it is settled per request in
    order; a request has at most ``MOST`` candidates (more are refused).
    """
    rows = candidates.select("request", "position", one_line(F.col("query"), LENGTH).alias("query")).where(F.char_length("query") >= SHORTEST)
    rows = rows.where(~has_secret(F.col("query"))).withColumn("t", token_set(F.col("query")))
    ideas = known.select("request", token_set(F.col("idea")).alias("i"))
    repeats = rows.join(ideas, "request").where(jaccard(F.col("t"), F.col("i")) >= KNOWN).select("request", "position").distinct()
    rows = rows.join(repeats, ["request", "position"], "left_anti")
    n = F.count("*").over(W.partitionBy("request"))
    rows = rows.withColumn("n", n).withColumn("query", F.when(F.col("n") <= MOST, F.col("query")).otherwise(F.raise_error(F.lit("too many candidate queries")).cast("string")))
    all_ = F.sort_array(F.collect_list(F.struct("position", "query", "t")))
    fresh = lambda kept, x: ~F.exists(kept, lambda y: jaccard(x["t"], y["t"]) >= REPEAT)
    empty = F.expr("cast(array() as array<struct<position:int,query:string,t:array<string>>>)")
    kept = F.aggregate("c", empty, lambda acc, x: F.when((F.size(acc) < most) & fresh(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    out = rows.withColumn("position", F.col("position").cast("int")).groupBy("request").agg(all_.alias("c")).select("request", F.inline(kept.alias("k")))
    return out.select("request", "position", "query")


def discover(responses: DataFrame) -> DataFrame:
    """``id, url, title, score`` of recorded search responses (``body`` JSON): public addresses, one per canonical form, best score first."""
    hit = "struct<results:array<struct<url:string,title:string,score:double>>>"
    rows = responses.select(F.posexplode(F.from_json("body", hit)["results"]).alias("at", "r"))
    rows = rows.select(F.col("r.url").alias("url"), F.col("r.title").alias("title"), F.coalesce("r.score", 1.0 / (F.col("at") + 1)).alias("score"))
    rows = rows.where(is_public(F.col("url"))).withColumn("c", canonical(F.col("url")))
    best = W.partitionBy("c").orderBy(F.desc("score"), "url")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select(web_id(F.col("url")).alias("id"), "url", "title", "score")


def refusals(outcomes: DataFrame, kind: str = "kind") -> DataFrame:
    """``kind, n``: how often each class of refusal happened, one line per class."""
    return outcomes.groupBy(kind).agg(F.count("*").alias("n"))


def extracted(wanted: DataFrame, recorded: DataFrame) -> DataFrame:
    """``id, url, content`` of discovered addresses with a recorded answer that is not blank; the same place under two spellings once."""
    pages = recorded.withColumn("c", canonical(F.col("url"))).where(F.trim("content") != "").groupBy("c").agg(F.min_by("content", "url").alias("content"))
    rows = wanted.withColumn("c", canonical(F.col("url"))).dropDuplicates(["c"])
    return rows.join(pages, "c").select(web_id(F.col("url")).alias("id"), "url", "content")

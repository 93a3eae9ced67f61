"""From retrieved evidence to ranked ideas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.scratch import materialise

#: Weight of trust in the score, and share of the answer that untrusted ideas may fill.
TRUST_WEIGHT, UNTRUSTED_SHARE = 0.0, 0.2


def lift_max(hits: DataFrame) -> DataFrame:
    """``query_id, idea_id, raw_score``: an idea scores as its best evidence, not as the sum of it."""
    return hits.where(F.col("idea_id").isNotNull()).groupBy("query_id", "idea_id").agg(F.max("score").alias("raw_score"))


def minmax_norm(lifted: DataFrame) -> DataFrame:
    """``norm``: raw score scaled over all candidates of the query; 1 where all are equal."""
    per_query = W.partitionBy("query_id")
    low, high = F.min("raw_score").over(per_query), F.max("raw_score").over(per_query)
    return lifted.withColumn("norm", F.round(F.when(high == low, 1.0).otherwise((F.col("raw_score") - low) / (high - low)), 6))


def apply_quota(scored: DataFrame, k: int) -> DataFrame:
    """``position, accepted, place``: walk the candidates by score; of the untrusted ones (trust 0) at most floor(0.2 k) pass.

    ``place`` numbers the accepted ones; the answer holds those with ``place <= k``.
    """
    quota = int(k * UNTRUSTED_SHARE + 1e-9)
    down = W.partitionBy("query_id").orderBy(F.desc("score"), "idea_id")
    so_far = down.rowsBetween(W.unboundedPreceding, W.currentRow)
    untrusted = (F.col("trust") == 0).cast("int")
    out = scored.withColumn("position", F.row_number().over(down)).withColumn("accepted", (untrusted == 0) | (F.sum(untrusted).over(so_far) <= quota))
    return out.withColumn("place", F.when(F.col("accepted"), F.sum(F.col("accepted").cast("int")).over(so_far)).cast("long"))


def score(lifted: DataFrame, ideas: DataFrame) -> DataFrame:
    """``query_id, idea_id, raw_score, norm, trust, score``; an unjudged idea has trust 0."""
    trust = ideas.select("idea_id", F.coalesce("trust", F.lit(0.0)).alias("trust"))
    return minmax_norm(lifted).join(trust, "idea_id").withColumn("score", F.round(F.col("norm") + TRUST_WEIGHT * F.col("trust"), 6))


def edge_targets(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, idea_id, first_at``: neighbours of any candidate that are no candidates, first seen first."""
    known = scored.select("query_id", "idea_id", "position")
    out = known.join(edges.select(F.col("source_id").alias("idea_id"), "target_id"), "idea_id")
    out = out.groupBy("query_id", F.col("target_id").alias("idea_id")).agg(F.min(F.struct("position", "target_id")).alias("first_at"))
    return out.join(known.select("query_id", "idea_id"), ["query_id", "idea_id"], "left_anti")


def edge_topup(scored: DataFrame, edges: DataFrame, ideas: DataFrame, k: int) -> DataFrame:
    """``query_id, idea_id, n``: the first ``k`` of ``edge_targets`` that are ideas, by first candidate and id. ``scored`` is read several times.

    Of an idea's neighbours at most c are among the c candidates of a query. So its k + c smallest hold all that it can
    add to the first k, and nothing that is first met after a candidate with so many neighbours is among them. What is
    joined grows with the candidates, not with the neighbours of hot ideas, and the result is that of all neighbours.
    """
    most = scored.groupBy("query_id").count().agg(F.max("count").alias("most")).first().most or 0  # one row
    smallest = W.partitionBy("source_id").orderBy("target_id")
    known_ideas = ideas.select(F.col("idea_id").alias("target_id"))
    near = edges.select("source_id", "target_id").join(known_ideas, "target_id", "left_semi").withColumn("nth", F.dense_rank().over(smallest)).where(F.col("nth") <= k + most)
    near = materialise(near.select(F.col("source_id").alias("idea_id"), "target_id", "nth"), "near")
    per_query = W.partitionBy("query_id")
    known = scored.select("query_id", "idea_id", "position", (F.count("*").over(per_query) + k).alias("enough"))
    walked = known.join(near.groupBy("idea_id").agg(F.max("nth").alias("degree")), "idea_id")
    last = F.min(F.when(F.col("degree") >= F.col("enough"), F.col("position"))).over(per_query)
    walked = walked.withColumn("last", last).where(F.col("position") <= F.coalesce("last", "position"))
    met = walked.join(near, "idea_id").where(F.col("nth") <= F.col("enough")).groupBy("query_id", F.col("target_id").alias("idea_id")).agg(F.min("position").alias("first_at"))
    met = met.join(scored.select("query_id", "idea_id"), ["query_id", "idea_id"], "left_anti")
    return met.select("query_id", "idea_id", F.row_number().over(per_query.orderBy("first_at", "idea_id")).alias("n")).where(F.col("n") <= k)


def retrieve(lifted: DataFrame, ideas: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, idea_id, score, raw_score, trust, via, rank``: the answer and, as ``cut_off``, what it left out.

    Accepted candidates come first; free places go to neighbours in the graph (``edge``, score of
    trust alone), then to untrusted candidates over the quota (``padding``).
    """
    # Walked four times below: once per stage of the answer.
    scored = materialise(apply_quota(score(lifted, ideas), k), "scored")
    taken = F.coalesce(F.col("place") <= k, F.lit(False))
    per_query = W.partitionBy("query_id")
    marked = scored.withColumn("free", F.lit(k) - F.sum(taken.cast("int")).over(per_query)).withColumn("taken", taken)
    room = marked.select("query_id", "free").distinct()
    ordered = W.partitionBy("query_id").orderBy("first_at")
    # Most queries have no free place: only for the others are the edges looked at.
    short = marked.where(F.col("free") > 0).select("query_id", "idea_id", "position")
    edge = edge_targets(short, edges).join(ideas.select("idea_id", F.coalesce("trust", F.lit(0.0)).alias("trust")), "idea_id")
    edge = edge.withColumn("n", F.row_number().over(ordered)).join(room, "query_id").where(F.col("n") <= F.col("free"))
    used = edge.groupBy("query_id").agg(F.count("*").alias("edges"))
    rest = marked.join(used, "query_id", "left").withColumn("pads", F.col("free") - F.coalesce("edges", F.lit(0)))
    pad_no = F.sum((~F.col("taken")).cast("int")).over(W.partitionBy("query_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0))
    via = F.when(F.col("taken"), "thesis").when(~F.col("taken") & (pad_no <= F.col("pads")), "padding").otherwise("cut_off")
    first = rest.select("query_id", "idea_id", "score", "raw_score", "trust", via.alias("via"), "position")
    second = edge.select("query_id", "idea_id", F.round(TRUST_WEIGHT * F.col("trust"), 6).alias("score"), F.lit(0.0).alias("raw_score"), "trust", F.lit("edge").alias("via"), F.col("n").alias("position"))
    stage = F.element_at(F.create_map(*(F.lit(x) for x in ("thesis", 1, "edge", 2, "padding", 3, "cut_off", 4))), F.col("via"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(stage, "position"))
    return first.unionByName(second).withColumn("rank", rank.cast("long")).drop("position")


def first_per_idea(hits: DataFrame) -> DataFrame:
    """``query_id, idea_id, thesis_id, best, hits, price, place``: best rank times the number of hits, so that mere volume buys nothing."""
    per = hits.groupBy("query_id", "idea_id").agg(F.min("pos").alias("best"), F.count("*").alias("hits"), F.min_by("thesis_id", "pos").alias("thesis_id"))
    per = per.withColumn("price", F.col("best") * F.col("hits"))
    return per.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("price", "best")))


def divergence(hits: DataFrame, ideas: DataFrame) -> DataFrame:
    """``query_id, idea_id``: ideas that the index names and the store does not know, the mark of an index out of step."""
    return hits.where(F.col("idea_id").isNotNull()).select("query_id", "idea_id").distinct().join(ideas.select("idea_id"), "idea_id", "left_anti")


def request_log(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """``query_id, query, status, ideas, best``: one line per request, those without an answer included."""
    found = answers.where(F.col("via") != "cut_off").groupBy("query_id").agg(F.count("*").alias("ideas"), F.max("score").alias("best"))
    rows = queries.select("query_id", "query").join(found, "query_id", "left")
    return rows.select("query_id", "query", F.when(F.col("ideas").isNull(), "empty").otherwise("ok").alias("status"), F.coalesce("ideas", F.lit(0)).alias("ideas"), "best")


def logged_responses(responses: DataFrame, log: DataFrame) -> DataFrame:
    """Responses with the log line that they name; a response without its line is left out."""
    return responses.join(log, "log_id")

"""Reads and edges of the evidence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leaf_traversal(sources: DataFrame, leaves: DataFrame, ideas: DataFrame) -> DataFrame:
    """Leaves with both ends present: inner joins to sources and ideas (each unique by ``id``)."""
    s = sources.select(F.col("id").alias("source_id"), F.col("type").alias("kind"), "title")
    i = ideas.select(F.col("id").alias("idea_id"), "trust_score")
    return leaves.join(s, "source_id").join(i, "idea_id")


def ideas_with_leaves(ideas: DataFrame, leaves: DataFrame) -> DataFrame:
    """``id, n_leaves, leaves``: every idea with its leaf ids in order; without leaves an empty list."""
    own = leaves.groupBy(F.col("idea_id").alias("id")).agg(F.count("*").alias("n_leaves"), F.sort_array(F.collect_list("id")).alias("leaves"))
    return ideas.select("id").join(own, "id", "left").select("id", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("leaves", F.array().cast("array<string>")).alias("leaves"))


def leaves_of(leaves: DataFrame, idea: str | None = None, source: str | None = None) -> DataFrame:
    """The leaves of an idea and / or a source."""
    for column, wanted in (("idea_id", idea), ("source_id", source)):
        if wanted is not None:
            leaves = leaves.where(F.col(column) == wanted)
    return leaves


def leaf_page(leaves: DataFrame, idea: str | None, source: str | None, offset: int, limit: int) -> DataFrame:
    """One page of the leaves of an idea and / or a source, by id, with the ``total`` of all pages."""
    found = leaves_of(leaves, idea, source)
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy("id").offset(offset).limit(limit).crossJoin(F.broadcast(total))


def cocitation(leaves: DataFrame, min_ideas: int = 2) -> DataFrame:
    """``idea_a, idea_b, weight, n_sources``: for ideas that share sources, the sum over these of the smaller leaf count.

    Counts per (source, idea) are formed first, so pairs are made of distinct ideas only; a source
    needs ``min_ideas`` of them.
    """
    per = leaves.where(F.col("source_id").isNotNull() & F.col("idea_id").isNotNull()).groupBy("source_id", "idea_id").agg(F.countDistinct("id").alias("n"))
    wide = per.groupBy("source_id").agg(F.count("*").alias("ideas")).where(F.col("ideas") >= min_ideas).select("source_id")
    per = per.join(wide, "source_id")
    a = per.select("source_id", F.col("idea_id").alias("idea_a"), F.col("n").alias("n_a"))
    b = per.select("source_id", F.col("idea_id").alias("idea_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "source_id").where("idea_a < idea_b")
    return pairs.groupBy("idea_a", "idea_b").agg(F.sum(F.least("n_a", "n_b")).alias("weight"), F.count("*").alias("n_sources"))


def both_directions(pairs: DataFrame) -> DataFrame:
    """``source_id, target_id, weight``: a symmetric edge is stored twice."""
    there = pairs.select(F.col("idea_a").alias("source_id"), F.col("idea_b").alias("target_id"), "weight")
    return there.unionByName(pairs.select(F.col("idea_b").alias("source_id"), F.col("idea_a").alias("target_id"), "weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, weight``: the greatest weight of each unordered pair."""
    return edges.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.max("weight").alias("weight"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int, min_weight: float | None = None) -> DataFrame:
    """``source_id, target_id, weight, hop``: breadth-first from ``start`` (``id``), an edge per hop at which its source is first reached."""
    if hops < 1:
        raise ValueError("hops must be at least 1")
    if min_weight is not None:
        edges = edges.where(F.col("weight") >= min_weight)
    frontier = seen = start.select("id").distinct()
    found = None
    for hop in range(1, hops + 1):
        step = edges.join(frontier, F.col("source_id") == F.col("id"), "left_semi").withColumn("hop", F.lit(hop))
        found = step if found is None else found.unionByName(step)
        frontier = step.select(F.col("target_id").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(frontier)
    return found


def parse_parents(sources: DataFrame) -> DataFrame:
    """``id, parent, position`` from urls ``synthesis/a+b`` (with or without a further part); other urls have no parents."""
    tail = F.regexp_extract("url", r"^synthesis/([^/]+)", 1)
    rows = sources.where(F.col("url").startswith("synthesis/")).select("id", F.posexplode(F.split(tail, r"\+")).alias("position", "parent"))
    return rows.where(F.col("parent") != "")


def derived_from(children: DataFrame, ideas: DataFrame) -> DataFrame:
    """``source_id, target_id, weight, missing``: one edge per child and parent, weight 1; parents that do not exist are marked."""
    known = ideas.select(F.col("id").alias("parent"), F.lit(False).alias("gone"))
    return children.select("id", "parent").distinct().join(known, "parent", "left").select(F.col("id").alias("source_id"), F.col("parent").alias("target_id"), F.lit(1.0).alias("weight"), F.coalesce("gone", F.lit(True)).alias("missing"))


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence of co-citation after new rows ``source_id, target_id, evidence, weight`` (one per contributing record).

    Evidence is kept as rows, so an edge may have any number of records; one that is there already
    adds nothing, and a replay changes no weight. ``edge_weights`` adds them up.
    """
    fresh = new.select(old.columns).dropDuplicates(["source_id", "target_id", "evidence"])
    return old.unionByName(fresh.join(old.select("source_id", "target_id", "evidence"), ["source_id", "target_id", "evidence"], "left_anti"))


def edge_weights(evidence: DataFrame) -> DataFrame:
    """``source_id, target_id, weight, records``."""
    return evidence.groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight"), F.count("*").alias("records"))


def edge_problems(edges: DataFrame, ideas: DataFrame) -> DataFrame:
    """``source_id, target_id, problem`` of symmetric edges that may not be written: an end that is no idea, both ends the same, only one direction."""
    known = lambda c: ideas.select(F.col("id").alias(c)).distinct().withColumn(f"_{c}", F.lit(True))
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")).distinct().withColumn("_back", F.lit(True))
    rows = edges.join(known("source_id"), "source_id", "left").join(known("target_id"), "target_id", "left").join(back, ["source_id", "target_id"], "left")
    problem = F.when(F.col("source_id") == F.col("target_id"), "loop").when(F.col("_source_id").isNull() | F.col("_target_id").isNull(), "end is missing").when(F.col("_back").isNull(), "one direction")
    return rows.select("source_id", "target_id", problem.alias("problem")).where(F.col("problem").isNotNull()).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: distinct neighbours, whichever way an edge points."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other")).unionByName(edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    return both.where(F.col("id") != F.col("other")).groupBy("id").agg(F.countDistinct("other").alias("degree"))


def exported(leaves: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, from_id, to_id, weight`` of all relations, as a graph store takes them; no node relates to itself."""
    row = lambda df, kind, a, b, w: df.select(F.lit(kind).alias("kind"), F.col(a).alias("from_id"), F.col(b).alias("to_id"), w.cast("double").alias("weight"))
    yields = row(leaves, "YIELDS", "source_id", "id", F.lit(1.0))
    has = row(leaves, "HAS_LEAF", "idea_id", "id", F.lit(1.0))
    out = yields.unionByName(has).unionByName(row(edges, "RELATED", "source_id", "target_id", F.col("weight")))
    return out.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id"))).distinct()


def top_by(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """At most ``k`` rows per key in the given order."""
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)

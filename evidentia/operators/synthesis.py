"""Pairs of ideas to combine into hypotheses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.identity import source_id
from evidentia.operators.models import Combiner


def parent_pool(ideas: DataFrame, min_trust: float = 0.0) -> DataFrame:
    """Ideas that may be combined: not synthesised themselves (an unknown origin stays), with enough trust."""
    return ideas.where(~F.col("origin").eqNullSafe("synthesized") & (F.coalesce("trust_score", F.lit(0.0)) >= min_trust))


def random_pairs(ideas: DataFrame, key: str, pairs: int, seed: int) -> DataFrame:
    """``pair_no, a, b``: disjoint pairs in an order drawn by ``seed`` (an MD5, so any engine draws the same)."""
    drawn = ideas.select(F.col(key).alias("id")).distinct().withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    # Only 2 * pairs rows outlive the top-k, so one task numbers them.
    top = drawn.orderBy("draw", "id").limit(2 * pairs).withColumn("n", F.row_number().over(W.orderBy("draw", "id")) - 1)
    both = top.groupBy(F.floor(F.col("n") / 2).alias("pair_no")).agg(F.min_by("id", "n").alias("a"), F.max_by("id", "n").alias("b"), F.count("*").alias("m"))
    return both.where(F.col("m") == 2).select("pair_no", "a", "b")


def combined(pairs: DataFrame, ideas: DataFrame, combiner: Combiner) -> DataFrame:
    """``pair_no, a, b, decision, text, applicability, error`` of every pair (``pair_no, a, b``): combine, reject, or failed.

    A failure is no rejection: the pair can be asked again.
    """
    told = lambda c: ideas.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"))
    rows = pairs.join(told("a"), "a").join(told("b"), "b").select("pair_no", "a", "b", "a_text", "b_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    made = combiner.combine(r.a_text or "", r.b_text or "")
                    out.append((r.pair_no, r.a, r.b, "reject" if made is None else "combine", *(made or (None, None)), None))
                except Exception as e:  # noqa: BLE001 - whatever went wrong, the pair is logged
                    out.append((r.pair_no, r.a, r.b, "failed", None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["pair_no", "a", "b", "decision", "text", "applicability", "error"])

    return rows.mapInPandas(run, "pair_no bigint, a string, b string, decision string, text string, applicability string, error string")


def hypotheses(decided: DataFrame, created_at: str) -> DataFrame:
    """What a combined pair is stored as: an idea, its source and the one leaf that makes it findable.

    ``idea_id, origin, text, source_id, url, title, leaf_text, effect, locator``; the ids follow from the parents and the time, so a replay makes the same.
    """
    parents = F.concat("a", F.lit("+"), "b")
    made = decided.where("decision = 'combine'")
    idea = F.concat(F.lit("idea_"), F.substring(F.sha1(F.concat(parents, F.lit("|" + created_at))), 1, 12))
    rows = made.select(idea.alias("idea_id"), F.lit("synthesized").alias("origin"), "text", parents.alias("parents"), "applicability")
    url = F.concat(F.lit("synthesis/"), "parents", F.lit("/"), "idea_id")
    return rows.select(
        "idea_id", "origin", "text", source_id(url, F.lit(created_at)).alias("source_id"), url.alias("url"), F.concat(F.lit("synthesis: "), "parents").alias("title"),
        F.concat("text", F.lit("\n\nApplies: "), F.coalesce("applicability", F.lit(""))).alias("leaf_text"), F.lit("unverified").alias("effect"), F.concat(F.lit("synthesis/"), "parents").alias("locator"),
    )


def merge_log(decided: DataFrame, stored: DataFrame) -> DataFrame:
    """``pair_no, a, b, decision, persisted, idea_id``: one line per pair; ``stored``: ``pair_no, idea_id`` of the hypotheses that were written."""
    out = decided.join(stored, "pair_no", "left")
    return out.select("pair_no", "a", "b", "decision", F.col("idea_id").isNotNull().alias("persisted"), "idea_id")

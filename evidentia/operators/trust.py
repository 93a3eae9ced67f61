"""Judging ideas by their leaves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.models import Judge

#: Judge calls per pass.
CALLS = 50


def sweep(ideas: DataFrame, leaves: DataFrame, judge: Judge, calls: int = CALLS) -> DataFrame:
    """``id, trust, outcome``: the oldest dirty ideas, scored from their ``judge_leaves``.

    ``outcome``: scored, failed (trust unchanged, still dirty), deferred (beyond ``calls``). An idea
    without leaves gets 0 without a call.
    """
    due = ideas.where(F.col("dirty")).select("id", "text", "created_at").dropDuplicates(["id"])
    chosen = due.orderBy("created_at", "id").limit(calls).select("id", F.lit(True).alias("now"))
    texts = leaves.groupBy(F.col("idea_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("l"))
    rows = due.join(chosen, "id", "left").join(texts, "id", "left").select("id", "text", F.coalesce("now", F.lit(False)).alias("now"), F.col("l.text").alias("l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                if not r.now:
                    out.append((r.id, None, "deferred"))
                elif r.l is None or not len(r.l):
                    out.append((r.id, 0.0, "scored"))
                else:
                    try:
                        s = judge.score(r.text, list(r.l))
                        if isinstance(s, bool) or s not in range(11):
                            raise ValueError(s)
                        out.append((r.id, s / 10, "scored"))
                    except Exception:  # noqa: BLE001 - a failed judgement changes nothing
                        out.append((r.id, None, "failed"))
            yield pd.DataFrame(out, columns=["id", "trust", "outcome"])

    return rows.mapInPandas(run, "id string, trust double, outcome string")


def summary(swept: DataFrame) -> DataFrame:
    """One row: how many ideas were due, scored, failed, deferred, and the mean trust given."""
    n = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    parts = [F.coalesce(n(o), F.lit(0)).alias(o) for o in ("scored", "failed", "deferred")]
    return swept.agg(F.count("*").alias("due"), *parts, F.coalesce(F.round(F.avg("trust"), 3), F.lit(0.0)).alias("mean"))


def capped(swept: DataFrame, leaves: DataFrame, most: int = 16) -> DataFrame:
    """``id, leaves``: scored ideas of which the judge saw a part of the leaves only."""
    n = leaves.groupBy(F.col("idea_id").alias("id")).agg(F.countDistinct("id").alias("leaves")).where(F.col("leaves") > most)
    return swept.where("outcome = 'scored'").select("id").join(n, "id")

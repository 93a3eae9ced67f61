"""Linking staged statements to ideas.

Candidates come from one set-based search for all rows of a batch against the stored index, lexical
and by vector. The decisions of one source then depend on each other (a row may join the idea that an
earlier row of the same source opened), so they are folded in order, one group per source. A source's
group holds one batch of statements, which the per-document ceiling bounds.

Sources depend on each other only through the ideas they open. After the fold, every opened idea is
held against those that earlier sources opened: its nearest ones by words and by vector are its
candidates, the arbiter chooses, and an idea that joins an earlier one takes its leaves along, over
any number of steps. So one new thing in two sources is one idea, whichever task folded them.

A failed decision never becomes a default: the row goes to ``pending`` with the error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.identity import text_hash
from evidentia.operators import search
from evidentia.operators.models import Arbiter
from evidentia.operators.rank import first_per_idea
from evidentia.scratch import materialise

WINDOW, CANDIDATES, RRF_K = 30, 10, 60

DECISION = "source_id string, line long, thesis_id string, idea_id string, decision string, error string"


def stored_candidates(hits: DataFrame) -> DataFrame:
    """``query_id, candidates``: per row the ideas of its best hits (``query_id, idea_id, thesis_id, pos``), priced by volume."""
    per = first_per_idea(hits.where(F.col("pos") <= WINDOW)).where(F.col("place") <= WINDOW)
    return per.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", "idea_id", "thesis_id"))).alias("candidates"))


def _priced(ranked: list[str]) -> list[str]:
    """Distinct ideas of a ranked list, by best rank times number of hits."""
    first: dict[str, int] = {}
    hits: dict[str, int] = {}
    for place, idea in enumerate(ranked, 1):
        first.setdefault(idea, place)
        hits[idea] = hits.get(idea, 0) + 1
    return sorted(first, key=lambda i: (first[i] * hits[i], first[i]))


def link_batch(rows: DataFrame, ideas: DataFrame, stored_hashes: DataFrame, arbiter: Arbiter) -> DataFrame:
    """Decisions (``DECISION``) on ``rows``: ``source_id, line, text, hash, vec, candidates``.

    ``decision`` is duplicate, linked, new or pending. Texts of candidate ideas are joined in
    before the fold, so that the fold reads no table; they travel once, to their source's group.
    A row whose hash is not its text's waits.
    """
    rows = rows.withColumn("own_hash", text_hash(F.col("text")))
    known = stored_hashes.select("source_id", "hash").distinct().withColumn("stored", F.lit(True))
    each = rows.select("source_id", "line", F.inline_outer("candidates")).join(ideas.select("idea_id", F.col("text").alias("idea_text")), "idea_id", "left")
    named = each.where(F.col("idea_id").isNotNull() & F.col("source_id").isNotNull()).select(F.col("source_id").alias("of_source"), F.col("line").alias("of_line"), "place", "idea_id", "idea_text")
    full = rows.drop("candidates").join(known, ["source_id", "hash"], "left")

    def fold(pdf: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        candidates: dict[int, list[tuple[str, str | None]]] = {}
        for r in named.sort_values(["place", "idea_id"]).itertuples():
            candidates.setdefault(r.of_line, []).append((r.idea_id, r.idea_text))
        seen, texts, out = set(), {}, []
        # Vectors and ideas of the rows placed so far.
        opened: list[str] = []
        dim = max((len(v) for v in pdf.vec if v is not None), default=0)
        held, n = np.zeros((len(pdf), dim)), 0
        for r in pdf.sort_values("line").itertuples():
            if r.stored is True or r.hash in seen:
                out.append((r.source_id, r.line, None, None, "duplicate", None))
                continue
            try:
                if r.hash != r.own_hash:
                    raise ValueError("the staged hash is not that of the text")
                stored = candidates.get(r.line, [])
                gone = [i for i, t in stored if t is None]
                if gone:
                    raise LookupError(f"candidate {gone[0]} is not stored")
                near = []
                if r.vec is not None and n:
                    close = held[:n] @ r.vec
                    best = np.argpartition(-close, WINDOW - 1)[:WINDOW] if n > WINDOW else np.arange(n)
                    near = [opened[i] for i in best[np.lexsort((best, -close[best]))]]
                arms = [[i for i, _ in stored], _priced(near)]
                score: dict[str, float] = {}
                for arm in arms:
                    for place, idea in enumerate(arm, 1):
                        score[idea] = score.get(idea, 0.0) + 1 / (RRF_K + place)
                texts.update(stored)
                order = sorted(score, key=lambda i: (-score[i], i))[:CANDIDATES]
                choice = arbiter.choose(r.text, [{"idea_id": i, "text": texts[i]} for i in order]) if order else -1
                if not isinstance(choice, int) or isinstance(choice, bool) or not -1 <= choice < len(order):
                    raise ValueError(f"the arbiter answered {choice!r} for {len(order)} candidates")
            except Exception as e:  # noqa: BLE001 - whatever went wrong, the row waits
                out.append((r.source_id, r.line, None, None, "pending", f"{type(e).__name__}: {e}"))
                continue
            mark = hashlib.sha1(f"{r.source_id}|{r.hash}".encode()).hexdigest()[:12]
            idea = order[choice] if choice >= 0 else f"idea_{mark}"
            if choice < 0:
                texts[idea] = r.text
            seen.add(r.hash)
            if r.vec is not None:
                held[n] = r.vec
                opened.append(idea)
                n += 1
            out.append((r.source_id, r.line, f"th_{mark}", idea, "linked" if choice >= 0 else "new", None))
        return pd.DataFrame(out, columns=["source_id", "line", "thesis_id", "idea_id", "decision", "error"])

    return full.groupBy("source_id").cogroup(named.groupBy("of_source")).applyInPandas(fold, DECISION)


def join_across(decided: DataFrame, rows: DataFrame, order: DataFrame, arbiter: Arbiter) -> DataFrame:
    """``decided`` (``DECISION``) with the ideas that earlier sources opened as well put together.

    ``order``: ``source_id, turn``, when a source's turn comes. A decision changed from new to linked
    names the earlier idea; leaves linked to an idea that joined another follow it.
    """
    new = decided.where("decision = 'new'").join(rows.select("source_id", "line", "text", "vec"), ["source_id", "line"]).join(order, "source_id")
    new = materialise(new.select("idea_id", "source_id", "turn", "line", "text", "vec"), "opened")
    asked = new.select(F.col("idea_id").alias("query_id"), F.col("text").alias("query"), F.col("vec").alias("qvec"))
    hits = search.hybrid(new, new, asked, "idea_id", "text", "vec", WINDOW)
    mine, theirs = new.select(F.col("idea_id").alias("query_id"), F.col("turn").alias("my_turn")), new.select("idea_id", "turn")
    earlier = hits.select("query_id", "idea_id", "rank").join(mine, "query_id").join(theirs, "idea_id").where(F.col("turn") < F.col("my_turn"))
    # Texts come in last, for those candidates only that the arbiter is shown.
    shown = earlier.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= CANDIDATES)
    shown = shown.select("query_id", "idea_id", "rank").join(new.select("idea_id", F.col("text").alias("idea_text")), "idea_id")
    listed = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "idea_id", "idea_text"))).alias("c"))
    listed = listed.join(new.select(F.col("idea_id").alias("query_id"), F.col("text").alias("own")), "query_id").select("query_id", "own", "c")

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                some = list(r.c)
                try:
                    n = arbiter.choose(r.own, [{"idea_id": c["idea_id"], "text": c["idea_text"]} for c in some])
                except Exception:  # noqa: BLE001 - without an answer the idea stays its own
                    n = -1
                if isinstance(n, int) and not isinstance(n, bool) and 0 <= n < len(some):
                    out.append((r.query_id, some[n]["idea_id"]))
            yield pd.DataFrame(out, columns=["idea_id", "into"])

    joins = materialise(listed.mapInPandas(choose, "idea_id string, into string"), "joined-ideas")
    # Every step of a chain leads to an earlier turn; each round doubles the steps that are followed.
    while True:
        on = joins.select(F.col("idea_id").alias("into"), F.col("into").alias("further"))
        longer = materialise(joins.join(on, "into", "left").select("idea_id", F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved")), "joined-ideas")
        if not longer.where("moved").take(1):
            break
        joins = longer.drop("moved")
    out = decided.join(joins, "idea_id", "left")
    decision = F.when(F.col("into").isNotNull() & (F.col("decision") == "new"), "linked").otherwise(F.col("decision"))
    return out.select("source_id", "line", "thesis_id", F.coalesce("into", "idea_id").alias("idea_id"), decision.alias("decision"), "error")


def pending_rows(decided: DataFrame, rows: DataFrame) -> DataFrame:
    """What waits: the whole staged row with its candidates, and the error."""
    return rows.join(decided.where("decision = 'pending'").select("source_id", "line", "error"), ["source_id", "line"])

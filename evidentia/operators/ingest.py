"""Steps of the write path that are set operations over staged rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.identity import first_per_key, text_hash, with_sequence
from evidentia.operators.models import Extractor

#: Statements kept per section and per document.
PER_SECTION, PER_DOCUMENT = 6, 30


def dedup_leaves(rows: DataFrame, *order: str, source: str = "source_id", text: str = "text") -> DataFrame:
    """The first row of each (source, normalised text); the same text under another source stays."""
    return first_per_key(rows.where(F.col(text).isNotNull()).withColumn("hash", text_hash(F.col(text))), [source, "hash"], *order)


def already_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (source_id, hash) is stored under the same source."""
    return rows.join(stored.select("source_id", "hash"), ["source_id", "hash"], "left_semi")


def ceilings(drafts: DataFrame, doc: str, section: str, order: str, per_section: int = PER_SECTION, per_doc: int = PER_DOCUMENT) -> DataFrame:
    """``drafts`` with ``in_section``, ``in_doc``, ``kept``: first rows of each section, then of each document."""
    in_section = F.row_number().over(W.partitionBy(doc, section).orderBy(order))
    rows = drafts.withColumn("in_section", in_section)
    passed = (F.col("in_section") <= per_section).cast("int")
    running = F.sum(passed).over(W.partitionBy(doc).orderBy(section, order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("in_doc", running).withColumn("kept", (F.col("in_section") <= per_section) & (F.col("in_doc") <= per_doc))


def contiguous_prefix(done: DataFrame, group: str, line: str) -> DataFrame:
    """``group, cursor``: the greatest line up to which, from 1 on, all lines are done; 0 if line 1 is not."""
    numbered = done.select(group, line).distinct().withColumn("n", F.row_number().over(W.partitionBy(group).orderBy(line)))
    return numbered.groupBy(group).agg(F.coalesce(F.max(F.when(F.col(line) == F.col("n"), F.col(line))), F.lit(0)).cast("long").alias("cursor"))


def staging_state(lines: DataFrame, cursors: DataFrame, group: str, line: str) -> DataFrame:
    """``group, lines, ingested``: staged lines, and those up to the cursor."""
    return lines.join(cursors, group, "left").groupBy(group).agg(F.count("*").alias("lines"), F.sum((F.col(line) <= F.coalesce("cursor", F.lit(0))).cast("long")).alias("ingested"))


def replace_by_source(old: DataFrame, new: DataFrame, source: str = "source_id") -> DataFrame:
    """Staged rows after a delivery: earlier rows of the delivered sources are dropped."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def rederive_due(ideas: DataFrame, leaves: DataFrame, least: int = 3) -> DataFrame:
    """``id, n, since``: dirty ideas with at least ``least`` leaves more than at their last derivation."""
    n = leaves.groupBy(F.col("idea_id").alias("id")).agg(F.countDistinct("id").alias("n"))
    due = ideas.where(F.col("dirty")).join(n, "id").withColumn("since", F.col("n") - F.col("rederived_at_leaf_count"))
    return due.where(F.col("since") >= least).select("id", "n", "since")


def judge_leaves(leaves: DataFrame, most: int = 16) -> DataFrame:
    """``idea_id, id, place``: the leaves a judge reads: measured runs first, then by time and id."""
    order = [F.col("run_success").isNull().cast("int"), F.coalesce("created_at", F.lit("")), F.col("id")]
    rows = leaves.where(F.col("idea_id").isNotNull()).select("idea_id", "id", "run_success", "created_at").distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("idea_id").orderBy(*order))).where(F.col("place") <= most).select("idea_id", "id", "place")


def by_first_appearance(rows: DataFrame, group: str, line: str) -> DataFrame:
    """``group, first_line, lines, place``: groups in the order in which they first appear."""
    per = rows.groupBy(group).agg(F.min(line).alias("first_line"), F.count("*").alias("lines"))
    return with_sequence(per, 0, "first_line", group).withColumnRenamed("seq", "place")


def section_report(drafts: DataFrame, doc: str, section: str, order: str, per_section: int = PER_SECTION, per_doc: int = PER_DOCUMENT) -> DataFrame:
    """``doc, section, found, dropped, parsed``: what each section yields.

    Sections are read in order until the document's ceiling is reached; those after it are not
    parsed, and the section that crosses it loses what is over.
    """
    some = drafts.withColumn("n", F.row_number().over(W.partitionBy(doc, section).orderBy(order)))
    found = some.groupBy(doc, section).agg(F.sum((F.col("n") <= per_section).cast("long")).alias("found"))
    before = F.coalesce(F.sum("found").over(W.partitionBy(doc).orderBy(section).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = found.withColumn("before", before).withColumn("parsed", F.col("before") < per_doc)
    over = F.greatest(F.lit(0), F.col("before") + F.col("found") - per_doc)
    zero = F.lit(0).cast("long")
    return rows.select(doc, section, F.when(F.col("parsed"), F.col("found")).otherwise(zero).alias("found"), F.when(F.col("parsed"), over).otherwise(zero).alias("dropped"), "parsed")


def cache_keys(sections: DataFrame, text: str, prompt: str) -> DataFrame:
    """``section_hash, prompt_hash`` of extractions: another text or another prompt is another call."""
    return sections.select(F.md5(text).alias("section_hash"), F.md5(F.lit(prompt)).alias("prompt_hash")).distinct()


def extraction_calls(sections: DataFrame, text: str, prompt: str, cache: DataFrame) -> DataFrame:
    """``section_hash, prompt_hash, sections, cached``: one row per call that an extraction needs, and whether it was made before."""
    keys = ["section_hash", "prompt_hash"]
    rows = sections.select(F.md5(text).alias("section_hash"), F.md5(F.lit(prompt)).alias("prompt_hash"))
    known = cache.select(*keys).distinct().withColumn("hit", F.lit(True))
    return rows.groupBy(*keys).agg(F.count("*").alias("sections")).join(known, keys, "left").select(*keys, "sections", F.coalesce("hit", F.lit(False)).alias("cached"))


def extract(sections: DataFrame, text: str, prompt: str, cache: DataFrame, extractor: Extractor) -> DataFrame:
    """Cache rows (``section_hash, prompt_hash, drafts``) after an extraction: each missing text is extracted once, whatever repeats it.

    A failed call leaves no row, so that it is made again.
    """
    keys = ["section_hash", "prompt_hash"]
    rows = sections.select(F.col(text).alias("text"), F.md5(text).alias("section_hash"), F.md5(F.lit(prompt)).alias("prompt_hash")).where(F.col("text").isNotNull())
    missing = rows.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                try:
                    out.append((r.section_hash, r.prompt_hash, list(extractor.extract(r.text, prompt))[:PER_SECTION]))
                except Exception:  # noqa: BLE001 - the call is made again next time
                    continue
            yield pd.DataFrame(out, columns=[*keys, "drafts"])

    made = missing.select("text", *keys).mapInPandas(run, "section_hash string, prompt_hash string, drafts array<string>")
    return cache.select(*keys, "drafts").unionByName(made)

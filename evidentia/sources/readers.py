"""Readers with fixed schemas, and writers of notes and logs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.scratch import materialise, size_of

RUNLOG = "program_id string, parent_ids string, generation string, iteration string, state string, metric_fitness string, mutation_model string, mutation_output string"
STAGING = "source struct<id:string,url:string,title:string,type:string,version:string,retrieved_at:string>, section_id string, thesis struct<text:string,context:string,effect:string,locator:string,text_hash:string>, idea_fields struct<text:string,applicability_conditions:string,limitations:string,failure_modes:array<string>>, vector array<float>"
MANIFEST = "id string, kind string, url string, title string, `group` string, skip boolean"


def conform(df: DataFrame, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in exactly the columns of ``schema``; an unknown column or a null in a required one is refused."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    unknown = set(df.columns) - {f.name for f in wanted}
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    out = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
    for c in required:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is null")).cast(wanted[c].dataType)))
    return out


def read_runlog(spark: SparkSession, path: str) -> DataFrame:
    """Mutants of a CSV log: blanks become null, a number that is none raises, ``parent_ids`` is a JSON list."""
    raw = spark.read.csv(path, header=True, schema=RUNLOG, multiLine=True, escape='"', mode="FAILFAST")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    ids = F.coalesce(F.from_json(blank("parent_ids"), "array<string>"), F.array().cast("array<string>"))
    return raw.select("program_id", ids.alias("parent_ids"), blank("generation").cast("int").alias("generation"), blank("iteration").cast("int").alias("iteration"), "state", blank("metric_fitness").cast("double").alias("fitness"), "mutation_model", blank("mutation_output").alias("mutation_output"))


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """Staged rows; lines that do not fit the schema raise."""
    return spark.read.schema(STAGING).json(path, mode="FAILFAST")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Corpus manifest; a DOI becomes an address and is skipped."""
    rows = spark.read.schema(MANIFEST).json(path)
    doi = F.col("url").rlike(r"^10\.\d{4,}/")
    return rows.withColumn("skip", F.coalesce("skip", F.lit(False)) | F.coalesce(doi, F.lit(False))).withColumn("url", F.when(doi, F.concat(F.lit("https://doi.org/"), "url")).otherwise(F.col("url"))).withColumnRenamed("kind", "type")


def parse_manifest(text: str) -> list[dict[str, str]]:
    """Rows of a manifest in YAML: a list of flat maps of texts, with comments and quoted values."""
    rows: list[dict[str, str]] = []
    for number, line in enumerate(text.splitlines(), 1):
        m = re.match(r"""^(?P<new>-\s+)?\s*(?P<key>[A-Za-z_]\w*):\s*(?:"(?P<d>(?:[^"\\]|\\.)*)"|'(?P<s>(?:[^']|'')*)'|(?P<plain>.*?))\s*(?:\s#.*)?$""", line)
        if m is None:
            if line.strip() and not line.lstrip().startswith("#"):
                raise ValueError(f"line {number} of the manifest is not understood: {line.strip()[:80]!r}")
            continue
        if m["new"]:
            rows.append({})
        if not rows:
            raise ValueError(f"line {number} of the manifest is outside the list")
        value = json.loads(f'"{m["d"]}"') if m["d"] is not None else m["s"].replace("''", "'") if m["s"] is not None else m["plain"]
        rows[-1][m["key"]] = value
    return rows


def manifest_lines(manifest: DataFrame) -> list[str]:
    """The rows of a manifest as JSON lines in the order of their ids, so that the same rows are the same bytes. A manifest is a file of hundreds of rows."""
    return [r.line for r in manifest.select("id", F.to_json(F.struct(*sorted(manifest.columns)), {"ignoreNullFields": "true"}).alias("line")).orderBy("id", "line").select("line").collect()]


def group_counts(manifest: DataFrame, expected: dict[str, int]) -> DataFrame:
    """``group, n, expected`` where they differ."""
    want = manifest.sparkSession.createDataFrame(list(expected.items()), "`group` string, expected long")
    n = manifest.groupBy("group").agg(F.count("*").alias("n"))
    return n.join(want, "group", "full_outer").where(~F.col("n").eqNullSafe(F.col("expected")))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed of articles: url, version, title, summary; an entry without one of these is refused."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string").load(path)
    flat = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    needed = lambda c, n: F.coalesce(c, F.raise_error(F.concat(F.lit(f"no {n} in entry "), F.coalesce("id", F.lit("?")))).cast("string")).alias(n)
    return raw.select("id", needed(F.nullif(F.regexp_extract("id", r"(v\d+)$", 1), F.lit("")), "version"), needed(flat("title"), "title"), needed(flat("summary"), "summary"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests that no cached page answers."""
    return wanted.join(cache.select(key), key, "left_anti")


def read_through(wanted: DataFrame, cache: str, fetch: Callable[[str], str], key: str = "key") -> DataFrame:
    """``key, body`` of all wanted requests: from the cache (a folder of parquet), and what is not there fetched once and added to it.

    A request that fails stays out of the cache and has a null body and the ``error``.
    """
    spark = wanted.sparkSession
    row = f"{key} string, body string"
    have = spark.createDataFrame([], row) if not size_of(spark, cache) else spark.read.schema(row).parquet(cache)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in b[key]:
                try:
                    out.append((k, fetch(k), None))
                except Exception as e:  # noqa: BLE001 - the request is made again next time
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "body", "error"])

    asked = wanted.select(key).dropna().distinct()
    got = materialise(cache_misses(asked, have, key).mapInPandas(run, row + ", error string"), "fetched")
    got.where("error is null").select(key, "body").write.mode("append").parquet(cache)
    return have.join(asked, key, "left_semi").withColumn("error", F.lit(None).cast("string")).unionByName(got)


def first_answer(df: DataFrame, *columns: str) -> DataFrame:
    """``content`` from the first non-blank of the columns; ``reasons`` names those that were blank before it."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    found = F.coalesce(*(blank(c) for c in columns))
    missed, reasons = F.lit(True), []
    for c in columns:
        missed = missed & blank(c).isNull()
        reasons.append(F.when(missed, F.lit(f"{c}: blank")))
    return df.withColumn("content", found).withColumn("reasons", F.filter(F.array(*reasons), lambda r: r.isNotNull()))


def payload_content(answers: DataFrame, body: str) -> DataFrame:
    """``content`` of a provider's JSON answers: the first form of the markdown, or the text, that is not blank."""
    at = lambda path: F.nullif(F.trim(F.get_json_object(body, path)), F.lit(""))
    # Where markdown is a plain text, its parts are not there.
    plain = F.when(~F.get_json_object(body, "$.markdown").startswith("{"), at("$.markdown"))
    forms = [at("$.markdown.fit_markdown"), at("$.markdown.raw_markdown"), at("$.markdown.markdown_with_citations"), plain, at("$.document.md_content"), at("$.document.text_content"), at("$.text")]
    return answers.withColumn("content", F.coalesce(*forms))


def evidence_list(value: Column) -> Column:
    """Evidence as a list: a JSON list as it is, any other text as the only entry, nothing as an empty list."""
    kind = "array<string>"
    listed = F.trim(value).startswith("[")
    one = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast(kind)).otherwise(F.array(value))
    return F.when(listed, F.coalesce(F.from_json(value, kind), F.array(value))).otherwise(one)


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, row`` of a staging file: rows with the number of the physical line, blank lines counted and left out.

    ``line_no`` is the place of the line in its file, whose blocks are numbered one after another.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    # Offsets per block, then a number inside the block: no task holds more than a block.
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("file", "block").orderBy("at"))
    rows = lines.withColumn("inside", inside).join(before, ["file", "block"]).where(F.trim("value") != "")
    parsed = F.from_json("value", STAGING, {"mode": "FAILFAST"})
    return rows.select("file", (F.col("before") + F.col("inside")).alias("line_no"), parsed.alias("row"))


def full_scan(rows: DataFrame, expected: int) -> DataFrame:
    """``rows``, refused if there are more than were counted before: something writes while they are read."""
    n = rows.count()
    if n > expected:
        raise ValueError(f"{n} rows were read where {expected} were expected")
    return rows


def read_prompts(folder: str) -> dict[str, str]:
    """Prompts by step and name, from ``step/name.txt``; an empty one is refused."""
    found = {}
    for p in sorted(Path(folder).glob("*/*.txt")):
        text = p.read_text(encoding="utf-8").strip()
        if not text:
            raise ValueError(f"{p} is empty")
        found[f"{p.parent.name}/{p.stem}"] = text
    return found


def append_log(df: DataFrame, path: str, partition: str | None = None) -> None:
    """One file set per append; never rewritten."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_notes(notes: DataFrame, path: str) -> int:
    """Write ``name, body`` as one markdown text per row, grouped by the first letters of the name; returns the number of notes.

    Two rows with one name are refused before anything is written.
    """
    clash = notes.groupBy("name").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"two notes want the name {clash[0]['name']}")
    notes.select("name", "body").write.mode("overwrite").json(path)
    return notes.count()

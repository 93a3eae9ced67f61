"""The store as linked notes: one per source, idea and leaf, and a page that counts them."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.notes import escape, file_name, frontmatter, link, link_target, one_line, scalar

#: Marks a folder as one that an export may replace.
MARK = ".evidentia-notes"


def names(sources: DataFrame, ideas: DataFrame, leaves: DataFrame) -> DataFrame:
    """``kind, id, name`` of every note."""
    one = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), "id", file_name(F.col(text), F.col("id")).alias("name")).distinct()
    return one(sources, "source", "title").unionByName(one(ideas, "idea", "text")).unionByName(one(leaves, "leaf", "text"))


def links(leaves: DataFrame, named: DataFrame) -> DataFrame:
    """``from_name, to_name, broken``: leaves link to their idea and source, and are linked by both; a link is broken where there is no such note."""
    n = lambda kind, c: named.where(F.col("kind") == kind).select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    rows = leaves.select("id", "source_id", "idea_id").distinct().join(n("leaf", "id"), "id")
    out = None
    for kind, c in (("idea", "idea_id"), ("source", "source_id")):
        ends = rows.where(F.col(c).isNotNull()).join(n(kind, c), c, "left")
        there = F.col(f"{c}_name").isNotNull()
        up = ends.select(F.col("id_name").alias("from_name"), F.coalesce(f"{c}_name", c).alias("to_name"), (~there).alias("broken"))
        down = ends.where(there).select(F.col(f"{c}_name").alias("from_name"), F.col("id_name").alias("to_name"), F.lit(False).alias("broken"))
        both = up.unionByName(down)
        out = both if out is None else out.unionByName(both)
    return out.distinct()


def _listed(leaves: DataFrame, key: str) -> DataFrame:
    """Per idea or source the lines of its leaves, by id, and how many there are. A note is one text, so its lines are one list."""
    item = F.concat(F.lit("- "), link(F.col("name")), F.lit(" — "), one_line(F.col("effect")), F.lit(" — "), one_line(F.col("locator")))
    return leaves.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_set(F.struct("id", item.alias("line")))).alias("l")).select("id", F.array_join("l.line", "\n").alias("lines"), F.size("l").alias("n"))


def _text(*lines: Column) -> Column:
    return F.concat(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n"))


def notes(sources: DataFrame, ideas: DataFrame, leaves: DataFrame) -> DataFrame:
    """``name, body`` of all notes and of the page README. Null fields are empty; only leaves with both ends get a note."""
    whole = leaves.join(sources.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), file_name(F.col("title"), F.col("id")).alias("source_name")), "source_id")
    whole = whole.join(ideas.select(F.col("id").alias("idea_id"), file_name(F.col("text"), F.col("id")).alias("idea_name")), "idea_id").withColumn("name", file_name(F.col("text"), F.col("id"))).dropDuplicates(["id"])
    quoted = F.concat(F.lit("> "), F.regexp_replace(escape(F.col("text")), r"\r\n|\r|\n", "\n> "))
    head = frontmatter({"type": F.lit("leaf"), "id": scalar(F.col("id")), "idea": scalar(F.col("idea_id")), "effect": scalar(F.col("effect")), "locator": scalar(F.col("locator"))})
    leaf = whole.select("name", _text(head, quoted, F.lit(""), F.concat(F.lit("**Context.** "), one_line(F.col("context"))), F.concat(F.lit("**Idea.** "), link(F.col("idea_name"))), F.concat(F.lit("**Source.** "), link(F.col("source_name")), F.lit(" [address](<"), link_target(F.col("source_url")), F.lit(">)"))).alias("body"))

    own = ideas.join(_listed(whole, "idea_id"), "id", "left").join(whole.groupBy(F.col("idea_id").alias("id")).agg(F.countDistinct("source_id").alias("s")), "id", "left")
    n = F.coalesce("n", F.lit(0)).cast("string")
    head = frontmatter({"type": F.lit("idea"), "id": scalar(F.col("id")), "orphan": F.when(F.col("n").isNull(), "true"), "leaves": n, "sources": F.coalesce("s", F.lit(0)).cast("string"), "trust_score": F.round("trust_score", 4).cast("string")})
    modes = F.array_join(F.transform("failure_modes", lambda m: F.concat(F.lit("- "), one_line(m))), "\n")
    told = F.when(F.size("failure_modes") > 0, F.concat(F.lit("**Fails.**\n"), modes))
    table = F.concat(F.lit("\n| | |\n|---|---|\n| Claimed | "), one_line(F.col("effect_claimed")), F.lit(" |\n| Observed | "), one_line(F.col("effect_observed")), F.lit(" |\n"))
    title = F.concat(F.lit("# "), one_line(F.col("text")), F.lit("\n"))
    idea = own.select(file_name(F.col("text"), F.col("id")).alias("name"), _text(head, title, F.when(F.col("n").isNull(), "**No leaf leads here.**\n"), F.concat(F.lit("**Applies.** "), one_line(F.col("applicability_conditions"))), F.concat(F.lit("**Limits.** "), one_line(F.col("limitations"))), told, table, F.concat(F.lit("## Leaves ("), n, F.lit(")")), F.col("lines")).alias("body"))

    of_source = sources.join(_listed(whole, "source_id"), "id", "left")
    head = frontmatter({"type": F.lit("source"), "id": scalar(F.col("id")), "kind": scalar(F.col("type")), "version": scalar(F.col("version")), "retrieved_at": scalar(F.col("retrieved_at"))})
    address = F.concat(F.lit("["), one_line(F.col("url")), F.lit("](<"), link_target(F.col("url")), F.lit(">)\n"))
    source = of_source.select(file_name(F.col("title"), F.col("id")).alias("name"), _text(head, F.concat(F.lit("# "), one_line(F.col("title")), F.lit("\n")), address, F.concat(F.lit("## Leaves ("), n, F.lit(")")), F.col("lines")).alias("body"))

    count = lambda df, c: df.agg(F.countDistinct("id").cast("string").alias(c))
    page = count(ideas, "i").crossJoin(count(whole, "l")).crossJoin(count(sources, "s"))  # one row each
    readme = page.select(F.lit("README").alias("name"), _text(F.lit("# Notes\n\n| | |\n|---|---|"), F.concat(F.lit("| Ideas | "), "i", F.lit(" |")), F.concat(F.lit("| Leaves | "), "l", F.lit(" |")), F.concat(F.lit("| Sources | "), "s", F.lit(" |\n")), F.lit("The folder is made anew by each export.")).alias("body"))
    return leaf.unionByName(idea).unionByName(source).unionByName(readme)


def write_folder(found: DataFrame, folder: str) -> int:
    """One markdown file per note in ``folder``, which all executors must see; returns how many.

    Files are written beside the folder and take its place when all are there. Two notes with one name are
    refused, and so is a folder that holds something but was not made by an export.
    """
    if os.path.isdir(folder) and os.listdir(folder) and not os.path.exists(os.path.join(folder, MARK)):
        raise ValueError(f"{folder} was not made by an export")
    clash = found.groupBy("name").count().where("count > 1 or name is null").limit(1).collect()
    if clash:
        raise ValueError(f"two notes want the name {clash[0]['name']}")
    draft = f"{folder.rstrip('/')}.{uuid.uuid4().hex[:8]}"
    os.makedirs(draft)

    def write(rows: Iterator) -> Iterator:
        n = 0
        for batch in rows:
            for name, body in zip(batch["name"], batch["body"], strict=True):
                part = os.path.join(draft, f".{name}.{uuid.uuid4().hex[:8]}")
                with open(part, "w", encoding="utf-8") as f:
                    f.write(body)
                os.replace(part, os.path.join(draft, f"{name}.md"))  # a repeated task writes the same file again
                n += 1
        yield pd.DataFrame({"n": [n]})

    total = found.select("name", "body").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0
    have = sum(f.endswith(".md") for f in os.listdir(draft))
    if have != total:
        raise ValueError(f"{total} notes were written and {have} are there")
    open(os.path.join(draft, MARK), "w").close()
    if os.path.isdir(folder):
        old = f"{draft}.old"
        os.rename(folder, old)
        os.rename(draft, folder)
        shutil.rmtree(old)
    else:
        os.rename(draft, folder)
    return total

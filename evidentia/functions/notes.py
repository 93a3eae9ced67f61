"""Rendering records as linked notes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.words import SPACE

#: Longest slug of a file name.
SLUG = 40


def escape(text: Column) -> Column:
    """Square brackets made literal, so that a quotation makes no link."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def one_line(text: Column) -> Column:
    """One line for headings, cells and list items."""
    return F.replace(escape(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " "))), F.lit("|"), F.lit("\\|"))


def scalar(text: Column) -> Column:
    """A quoted YAML value: control characters dropped, brackets literal, then as a JSON string."""
    clean = escape(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", ""))
    body = F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), body, F.lit('"'))


def link_target(url: Column) -> Column:
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E"))


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, cut at a hyphen to at most ``SLUG`` characters."""
    full = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    head = F.substring(full, 1, SLUG)
    cut = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(full) > SLUG, F.regexp_replace(cut, "-+$", "")).otherwise(full)


def file_name(text: Column, node_id: Column) -> Column:
    """``slug-id``, or the id where nothing is left of the text; null for an id that is no safe file name."""
    s = slug(text)
    name = F.when(s == "", node_id).otherwise(F.concat(s, F.lit("-"), node_id))
    return F.when(node_id.rlike(r"^[A-Za-z0-9_-]+$"), name)


def link(name: Column) -> Column:
    return F.concat(F.lit("[["), name, F.lit("]]"))


def frontmatter(fields: dict[str, Column]) -> Column:
    """Key and value lines between rules; null values are left out."""
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), F.lit("\n---\n"))

"""Checks on queries before they leave the system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.words import SPACE

#: Fixed value: assignments of credentials, and tokens of well-known shapes.
SECRET = r"(?i)(?:api[_-]?key|access[_-]?token|secret|password)\s*[:=]\s*\S+|(?:sk|ghp|xox[baprs])[-_][A-Za-z0-9_-]{16,}"

#: Queries this similar to an earlier one, or to a known idea, are repeats.
REPEAT, KNOWN, SHORTEST = 0.88, 0.92, 8


def one_line(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, SPACE + "+", " ")), 1, limit)


def has_secret(text: Column) -> Column:
    return F.coalesce(text.rlike(SECRET), F.lit(False))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of at least three word characters or hyphens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]{3,}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)

"""ISO-8601 text to instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """Timestamp of ISO-8601 text with any UTC offset; null for null, empty or other text."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("timestamp")

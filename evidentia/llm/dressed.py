"""Duplicates hidden by formatting: records equal up to case, space, punctuation and field order.

A text is cut at ``;`` and ``|`` into fields, a field being a name and its value; of each field
only letters and digits count, in lower case. Every normalised field is hashed, and the hashes of
a record are added modulo a prime: the sum does not depend on the order of the fields but does on
how often each occurs (a commutative multiset hash). Two such sums of independent hashes, and the
number of fields, make the fingerprint. Groups of equal fingerprints are then verified against
their smallest id, field by field, by counting each distinct field in both, without sorting; records of
more than ``MANY`` fields are counted in a table, so that the work stays in proportion to them.

Groups are aggregated before the shuffle (smallest and greatest id), so copies of one record, be
they a third of all rows, meet as one row per task. The rows of such groups are then written and
read again, and so are split where they meet the fields of their smallest id.

Results: null and empty texts, and texts without a letter or digit, are in no group. A repeated
id is one record. Ties are broken by the smallest id; rows without an id are left out. Texts of
any length are used whole. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.scratch import materialise

#: Prime 2**61 - 1: sums of two residues stay inside 64 bits.
PRIME = (1 << 61) - 1
#: Fields of a record up to which each is counted by going through the others.
MANY = 64


def fields(text: Column) -> Column:
    """Normalised, non-empty fields of a text, in their order."""
    kept = F.transform(F.split(text, "[;|]"), lambda f: F.lower(F.regexp_replace(f, r"[^\p{L}\p{N}]+", "")))
    return F.filter(kept, lambda f: f != "")


def multiset_hash(items: Column, seed: int) -> Column:
    """Sum modulo ``PRIME`` of the items' hashes; equal for equal multisets."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, f: F.pmod(acc + F.xxhash64(F.lit(seed), f).bitwiseAND(F.lit(PRIME)), F.lit(PRIME)))


def same_fields(a: Column, b: Column) -> Column:
    """Whether two lists hold the same fields as often, in any order."""
    often = lambda xs, f: F.size(F.filter(xs, lambda x: x == f))
    return (F.size(a) == F.size(b)) & F.forall(F.array_distinct(a), lambda f: often(a, f) == often(b, f))


@F.pandas_udf(T.BooleanType())
def _same_many(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([Counter(x) == Counter(y) for x, y in zip(a, b, strict=True)], dtype=bool)


def fingerprints(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id, f, f1, f2, n``: one row per row of ``df`` whose text has a letter or digit."""
    cut = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), fields(F.col(text)).alias("f"))
    return cut.where(F.size("f") > 0).select("id", "f", multiset_hash(F.col("f"), 1).alias("f1"), multiset_hash(F.col("f"), 2).alias("f2"), F.size("f").alias("n"))


def copies(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id_kept, id_copy`` for every id that is the same record as a smaller one."""
    marked = materialise(fingerprints(df, key, text), "dressed")
    prints = ["f1", "f2", "n"]
    several = marked.groupBy(*prints).agg(F.min("id").alias("id_kept"), F.max("id").alias("high")).where("id_kept < high").drop("high")
    members = materialise(marked.join(several, prints), "dressed-groups")
    kept = members.where("id = id_kept").select(*prints, F.col("f").alias("kept_f")).dropDuplicates(prints)
    pairs = members.where("id <> id_kept").join(kept, prints)
    few = pairs.where(F.col("n") <= MANY).where(same_fields(F.col("f"), F.col("kept_f")))
    many = pairs.where(F.col("n") > MANY).where(_same_many("f", "kept_f"))
    return few.unionByName(many).select("id_kept", F.col("id").alias("id_copy")).distinct()


def collapsed(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``id_kept, copies``: one row per record, with the number of ids that carry it, itself included."""
    ids = fingerprints(df, key, text).select("id").distinct()
    found = copies(df, key, text)
    alone = ids.join(found.select(F.col("id_copy").alias("id")), "id", "left_anti")
    counts = found.groupBy(F.col("id_kept").alias("id")).agg(F.count("*").alias("more"))
    return alone.join(counts, "id", "left").select(F.col("id").alias("id_kept"), (F.coalesce("more", F.lit(0)) + 1).cast("long").alias("copies"))

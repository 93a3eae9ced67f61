"""References to records that do not exist, kept up to date as rows arrive and vanish.

``ReferenceState`` keeps two logs: the *parent index* (a key arrived at a step, or went) and the
*references* with their state: resolved, late (the parent's time is after the reference's own), or
waiting. A step takes arriving parents, deletions and new references, in this order:

* new references probe the parent index and are resolved or wait;
* an arriving parent resolves the references that wait for its key;
* a deletion reopens the references to its key.

A step writes its own parents, and the references whose state it sets: it never rewrites what it
does not touch. Of the stored references it reads those that wait or are late, for arrivals, and
those of the hashed key buckets that a deletion names; of the index, one small row per key. The newest row of a reference holds. Pieces of the logs are merged from time to time
(``scratch.Pieces``). ``counts`` is the snapshot per table, field and period.

Joins go from references to the parent index, which is reduced to one row per key: a key that a
third of all references name is one row on the other side, and adaptive execution splits its
partition. Written pieces are evened out, so that a hot key's bucket is several files.

Results: null keys refer to nothing; an empty string is a key. A parent that arrived later than a
reference's own time makes it *late*; a null, empty or unreadable time is never late. Rows
delivered again, in one step or a later one, count once (a reference is its table, field, row key,
key and time). Empty tables are fine; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.times import instant
from evidentia.scratch import Pieces

REFERENCE = "tab string, field string, row_key string, parent string, key string, at timestamp, month string"
PARENT = "parent string, key string, since timestamp"

#: Hashed buckets of keys in a piece.
BUCKETS = 8

_SAME = ["tab", "field", "row_key", "parent", "key", "at", "month"]


def references(df: DataFrame, tab: str, field: str, row_key: str, parent: str, at: str | None) -> DataFrame:
    """The references of one column, in the shape of ``REFERENCE``. ``month`` is that of the time as an instant in UTC."""
    time = instant(F.col(at)) if at else F.lit(None).cast("timestamp")
    cols = [F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col(row_key).cast("string").alias("row_key"), F.lit(parent).alias("parent"), F.col(field).cast("string").alias("key"), time.alias("at")]
    return df.where(F.col(field).isNotNull()).select(cols).withColumn("month", F.date_format("at", "yyyy-MM"))


def parents(df: DataFrame, parent: str, key: str, at: str) -> DataFrame:
    """One row per key, with its earliest readable time."""
    rows = df.where(F.col(key).isNotNull()).select(F.lit(parent).alias("parent"), F.col(key).cast("string").alias("key"), instant(F.col(at)).alias("since"))
    return rows.groupBy("parent", "key").agg(F.min("since").alias("since"))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("parent", "key"), F.lit(BUCKETS)).cast("int")


def _lives(rows: DataFrame) -> DataFrame:
    """Per key its last deletion and the arrivals after it; a key has few rows, one or two per piece."""
    per = rows.groupBy("parent", "key").agg(F.collect_list(F.struct("step", "alive", "since")).alias("e"))
    per = per.withColumn("gone", F.coalesce(F.array_max(F.transform(F.filter("e", lambda x: ~x["alive"]), lambda x: x["step"])), F.lit(0)))
    return per.withColumn("after", F.filter("e", lambda x: x["alive"] & (x["step"] > F.col("gone"))))


def _merge_parents(rows: DataFrame) -> DataFrame:
    earliest = F.array_min(F.transform("after", lambda x: x["since"]))
    here = F.when(F.size("after") > 0, F.struct(F.array_max(F.transform("after", lambda x: x["step"])).alias("step"), F.lit(True).alias("alive"), earliest.alias("since")))
    went = F.when(F.col("gone") > 0, F.struct(F.col("gone").alias("step"), F.lit(False).alias("alive"), F.lit(None).cast("timestamp").alias("since")))
    kept = F.filter(F.array(here, went), lambda x: x.isNotNull())
    return _lives(rows).select("parent", "key", F.inline(kept)).select("parent", "key", "since", "alive", "step", _bucket().alias("bucket"))


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_SAME).agg(F.max_by("state", "step").alias("state"), F.max("step").alias("step"))


def _merge_refs(rows: DataFrame) -> DataFrame:
    return _newest(rows).withColumn("pending", F.col("state") != "resolved").withColumn("bucket", _bucket())


class ReferenceState:
    """Logs of parents and of references with their state."""

    def __init__(self, spark: SparkSession):
        self.spark, self.steps = spark, 0
        self.index = Pieces(spark, "orphan-index", _merge_parents)
        self.refs = Pieces(spark, "orphan-refs", _merge_refs, "pending", "bucket")

    def step(self, new_refs: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Apply one batch: first parents that arrive, then deletions (``parent, key``), then references."""
        self.steps += 1
        changes = []
        if arrived is not None:
            changes.append(arrived.groupBy("parent", "key").agg(F.min("since").alias("since")).withColumn("alive", F.lit(True)))
        if deleted is not None:
            changes.append(deleted.select("parent", "key").distinct().select("parent", "key", F.lit(None).cast("timestamp").alias("since"), F.lit(False).alias("alive")))
        old, probed, asked = self.refs.read(), [], set()
        if changes:
            rows = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1])
            piece = self.index.append(rows.withColumn("step", F.lit(self.steps)).withColumn("bucket", _bucket()))
            touched: dict[bool, list[int]] = {}
            for r in piece.select("alive", "bucket").distinct().collect():  # at most 2 * BUCKETS rows
                touched.setdefault(r.alive, []).append(r.bucket)
            for alive, buckets in touched.items() if old is not None else ():
                # Waiting references whose parent arrived, and any whose parent went.
                some = old.where(F.col("bucket").isin(buckets) & (F.col("pending") if alive else F.lit(True)))
                keys = piece.where(F.col("alive") == alive).select("parent", "key")
                probed.append(some.join(keys, ["parent", "key"], "left_semi").select(*_SAME))
                asked |= set(buckets)
        if new_refs is not None:
            probed.append(new_refs.select(*_SAME))
            asked |= set(range(BUCKETS))
        if probed:
            rows = probed[0]
            for more in probed[1:]:
                rows = rows.unionByName(more)
            self.refs.append(self._probe(rows.distinct(), sorted(asked)).withColumn("step", F.lit(self.steps)))

    def _probe(self, refs: DataFrame, buckets: list[int]) -> DataFrame:
        log = self.index.read()
        if log is None:
            out = refs.withColumn("state", F.lit("waiting"))
        else:
            if len(buckets) < BUCKETS:
                log = log.where(F.col("bucket").isin(buckets))
            here = _lives(log).where(F.size("after") > 0).select("parent", "key", F.array_min(F.transform("after", lambda x: x["since"])).alias("since"), F.lit(True).alias("there"))
            late = F.coalesce(F.col("since") > F.col("at"), F.lit(False))
            state = F.when(F.col("there").isNull(), "waiting").when(late, "late").otherwise("resolved")
            out = refs.join(here, ["parent", "key"], "left").withColumn("state", state)
        return out.select(*_SAME, "state", (F.col("state") != "resolved").alias("pending"), _bucket().alias("bucket"))

    def _now(self) -> DataFrame:
        rows = self.refs.read()
        if rows is None:
            fields = (f.strip().rsplit(" ", 1) for f in (REFERENCE + ", state string").split(","))
            return self.spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in fields))
        return _newest(rows)

    def waiting(self, late: bool = True) -> DataFrame:
        """References that wait for their parent, and with ``late`` those whose parent came after them."""
        return self._now().where(F.col("state").isin("waiting", "late") if late else F.col("state") == "waiting")

    def counts(self) -> DataFrame:
        """``tab, field, month, missing, late, refs``: the state per table, field and month; month is null without a readable time."""
        n = lambda s: F.sum((F.col("state") == s).cast("long"))
        return self._now().groupBy("tab", "field", "month").agg(n("waiting").alias("missing"), n("late").alias("late"), F.count("*").alias("refs"))

"""Snapshots of several tables, published together, and the writes over them.

A snapshot is a manifest: a small file that names, per table, the folder of parquet files with its
rows. A publish writes the changed tables only; the others keep their folders. Manifests are numbered,
and a new one comes into being by a rename that fails if its number is taken, so of two writers that
started from one snapshot the second is refused, a reader never sees a half-written one, and a writer
that dies leaves nothing locked.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.identity import with_sequence
from evidentia.functions.vectors import problem


class Conflict(Exception):
    """A write that the store's rules refuse."""


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def current(self) -> str | None:
        """Name of the newest snapshot."""
        numbers = self._manifests()
        return str(numbers[-1]) if numbers else None

    def _tables(self, snapshot: str | None) -> dict[str, str]:
        if snapshot is None:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{snapshot}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str, snapshot: str | None = None) -> DataFrame:
        snapshot = snapshot or self.current()
        if snapshot is None:
            raise LookupError("the store is empty")
        return self.spark.read.parquet(f"{self.root}/{self._tables(snapshot)[table]}")

    def tables(self, snapshot: str | None = None) -> list[str]:
        return sorted(self._tables(snapshot or self.current()))

    def publish(self, changed: dict[str, DataFrame], base: str | None) -> str:
        """Write the changed tables and a manifest that names them beside the others of ``base``."""
        named = self._tables(base)
        for table, df in changed.items():
            named[table] = f"data/{table}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.root}/{named[table]}")
        number = int(base or 0) + 1
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(json.dumps(named).encode())
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        final = self._path(f"{self.root}/manifests/{number}")
        # Created exclusively first: some file systems let a rename replace a file.
        if not self._fs.createNewFile(self._path(f"{self.root}/drafts/take-{number}")):
            if self._fs.exists(final) or not self._stale(number):
                raise Conflict("the store moved on since this write began")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise Conflict("the store moved on since this write began")
        return str(number)

    def _stale(self, number: int, seconds: int = 60) -> bool:
        """Whether a number was taken long ago and never used: its writer is dead."""
        taken = self._fs.getFileStatus(self._path(f"{self.root}/drafts/take-{number}")).getModificationTime()
        return time.time() * 1000 - taken > seconds * 1000


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; columns in ``keep`` stay as they were, new rows are numbered on."""
    last = old.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last")).first()["last"]
    fresh = with_sequence(new.drop("seq").join(old.select(key), key, "left_anti"), last, key)
    kept = old.select(key, *keep)
    replaced = new.drop(*keep).join(kept, key)
    untouched = old.join(new.select(key), key, "left_anti")
    return untouched.unionByName(replaced.select(old.columns)).unionByName(fresh.select(old.columns))


def refuse_any(df: DataFrame, message: str) -> None:
    first = df.limit(1).collect()
    if first:
        raise Conflict(f"{message}: {first[0].asDict()}")


def append_problems(leaves: DataFrame, new: DataFrame, sources: DataFrame, ideas: DataFrame) -> DataFrame:
    """``source_id, text_hash, problem`` of new leaves that may not be stored: no source, no idea, stored already, delivered twice."""
    known = lambda df, c, mark: df.select(F.col("id").alias(c)).distinct().withColumn(mark, F.lit(True))
    own = ["source_id", "text_hash"]
    there = leaves.select(*own).distinct().withColumn("_stored", F.lit(True))
    twice = new.groupBy(*own).agg((F.count("*") > 1).alias("_twice"))
    rows = new.join(known(sources, "source_id", "_source"), "source_id", "left").join(known(ideas, "idea_id", "_idea"), "idea_id", "left").join(there, own, "left").join(twice, own, "left")
    problem_ = F.when(F.col("_source").isNull(), "source is missing").when(F.col("_idea").isNull(), "idea is missing").when(F.col("_stored"), "stored already").when(F.col("_twice"), "delivered twice")
    return rows.select(*own, problem_.alias("problem")).where(F.col("problem").isNotNull())


def append_leaves(leaves: DataFrame, new: DataFrame, sources: DataFrame, ideas: DataFrame) -> DataFrame:
    """Leaves after an append; both ends must exist, and (source, text) must be new. One look at the new rows tells."""
    refuse_any(append_problems(leaves, new, sources, ideas), "a leaf may not be stored")
    return leaves.unionByName(new.select(leaves.columns))


def mark_dirty(ideas: DataFrame, touched: DataFrame) -> DataFrame:
    """Ideas that got leaves become dirty in the same snapshot."""
    hit = touched.select(F.col("idea_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return ideas.join(hit, "id", "left").withColumn("dirty", F.col("dirty") | F.coalesce("_hit", F.lit(False))).select(ideas.columns)


def set_trust(ideas: DataFrame, scores: DataFrame) -> DataFrame:
    """Trust written, and dirty lowered with it; scores outside 0..1 are refused."""
    refuse_any(scores.where(~F.col("trust").between(0, 1)), "trust is outside 0..1")
    out = ideas.join(scores.select("id", "trust"), "id", "left")
    return out.withColumn("trust_score", F.coalesce("trust", "trust_score")).withColumn("dirty", F.col("dirty") & F.col("trust").isNull()).select(ideas.columns)


#: Fields of an idea that a patch may write, and the one that may become null.
PATCHABLE = ("text", "applicability_conditions", "limitations", "failure_modes", "differentiation", "effect_claimed", "effect_observed", "rederived_at_leaf_count")
NULLABLE = ("differentiation",)


def patch_problems(patches: DataFrame, ideas: DataFrame) -> DataFrame:
    """``id, problem`` of patches (``id, fields``, a map of field to text) that may not be applied: empty, unknown field, null value, negative count, unknown idea."""
    names = F.map_keys("fields")
    unknown = F.exists(names, lambda k: ~k.isin(*PATCHABLE))
    null = F.exists(F.map_entries("fields"), lambda e: e["value"].isNull() & ~e["key"].isin(*NULLABLE))
    count = F.try_element_at(F.col("fields"), F.lit("rederived_at_leaf_count"))
    wrong = count.isNotNull() & (F.coalesce(count.try_cast("int"), F.lit(-1)) < 0)
    known = ideas.select("id").distinct().withColumn("_known", F.lit(True))
    rows = patches.join(known, "id", "left")
    problem_ = F.when(F.col("fields").isNull() | (F.size(names) == 0), "empty").when(unknown, "unknown field").when(null, "null").when(wrong, "count").when(F.col("_known").isNull(), "unknown idea")
    return rows.select("id", problem_.alias("problem")).where(F.col("problem").isNotNull())


def apply_patches(ideas: DataFrame, patches: DataFrame) -> DataFrame:
    """Ideas with the fields of their patches written; any patch that may not be applied refuses all. Lists are JSON."""
    refuse_any(patch_problems(patches, ideas), "a patch may not be applied")
    refuse_any(patches.groupBy("id").count().where("count > 1"), "an idea is patched twice")
    rows = ideas.join(patches.select("id", "fields"), "id", "left")
    for name in PATCHABLE:
        if name in ideas.columns:
            kind = ideas.schema[name].dataType
            value = F.try_element_at(F.col("fields"), F.lit(name))
            typed = F.from_json(value, kind) if kind.simpleString().startswith("array") else value.cast(kind)
            rows = rows.withColumn(name, F.when(F.coalesce(F.map_contains_key("fields", F.lit(name)), F.lit(False)), typed).otherwise(F.col(name)))
    return rows.select(ideas.columns)


def lookup(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` for ``wanted`` (``pos, key``), in that order with ``pos``; ids that are not there are dropped."""
    return wanted.select("pos", key).join(table, key).orderBy("pos")


def split_problems(leaves: DataFrame, moves: DataFrame, parent: str, children: DataFrame) -> DataFrame:
    """``what, problem``: a leaf moved twice, one that is not the parent's, a child without leaves, a parent that would be left empty."""
    twice = moves.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("what"), F.lit("twice").alias("problem"))
    own = leaves.where(F.col("idea_id") == parent).select("id")
    stolen = moves.select("id").distinct().join(own, "id", "left_anti").select(F.col("id").alias("what"), F.lit("stolen").alias("problem"))
    empty = children.select(F.col("new_idea")).distinct().join(moves.select("new_idea"), "new_idea", "left_anti").select(F.col("new_idea").alias("what"), F.lit("empty child").alias("problem"))
    left = own.join(moves.select("id"), "id", "left_anti").agg(F.count("*").alias("n")).where("n = 0").select(F.lit(parent).alias("what"), F.lit("emptied parent").alias("problem"))
    return twice.unionByName(stolen).unionByName(empty).unionByName(left)


def apply_split(leaves: DataFrame, moves: DataFrame) -> DataFrame:
    """Leaves with ``idea_id`` rewritten from ``moves`` (``id, new_idea``); a leaf moved twice is refused."""
    refuse_any(moves.groupBy("id").count().where("count > 1"), "a leaf is moved twice")
    return leaves.join(moves, "id", "left").withColumn("idea_id", F.coalesce("new_idea", "idea_id")).select(leaves.columns)


def index_insert(index: DataFrame, new: DataFrame, dim: int = 384) -> DataFrame:
    """Index rows added; a replayed row is skipped; a changed one is refused, and one whose vector is not valid."""
    if "vec" in new.columns:
        refuse_any(new.where(problem(F.col("vec"), dim).isNotNull()).select("thesis_id"), "a vector is not valid")
    both = new.join(index.select("thesis_id", F.col("idea_id").alias("_i"), F.col("text").alias("_t")), "thesis_id")
    refuse_any(both.where(~F.col("idea_id").eqNullSafe(F.col("_i")) | ~F.col("text").eqNullSafe(F.col("_t"))).select("thesis_id"), "an index row changed")
    return index.unionByName(new.join(index.select("thesis_id"), "thesis_id", "left_anti").select(index.columns))


def reconcile(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """``id, action``: what brings the index in step with the store. ``leaves``: ``id, idea_id`` of the leaves of the store.

    ``insert`` (no index row), ``relink`` (a row that names another idea), ``drop`` (a row without a leaf), ``keep``.
    """
    own = leaves.select("id", "idea_id").distinct().withColumn("_own", F.lit(True))
    there = index.select(F.col("thesis_id").alias("id"), F.col("idea_id").alias("_idea")).distinct().withColumn("_there", F.lit(True))
    rows = own.join(there, "id", "full_outer")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_own").isNull(), "drop").when(~F.col("idea_id").eqNullSafe(F.col("_idea")), "relink").otherwise("keep")
    return rows.select("id", action.alias("action")).distinct()


def rebuild_index(leaves: DataFrame, dim: int = 384) -> DataFrame:
    """Index rows made anew from the store's leaves (``id, idea_id, text, vec``); one leaf that cannot be indexed refuses all, and the old index stands."""
    refuse_any(leaves.where(F.col("text").isNull() | problem(F.col("vec"), dim).isNotNull()).select("id"), "a leaf cannot be indexed")
    refuse_any(leaves.groupBy("id").count().where("count > 1"), "a leaf is there twice")
    return leaves.select(F.col("id").alias("thesis_id"), "idea_id", "text", "vec")


def all_leaves(leaves: DataFrame) -> DataFrame:
    """Every leaf with its vector, in the order of ``seq``; one without text or vector means a broken store and raises."""
    whole = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c} is missing in leaf "), F.col("id"))).cast(leaves.schema[c].dataType)).alias(c)
    return leaves.select("id", "idea_id", whole("text"), whole("vec"), "seq").orderBy("seq")


def idea_view(ideas: DataFrame, vectors: bool = False) -> DataFrame:
    """Ideas as they are answered: the vector on demand only."""
    return ideas if vectors else ideas.drop("vec")

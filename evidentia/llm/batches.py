"""Deduplicating new batches against all history with a table of pivot distances.

A text is the set of its runs of three words. The distance of two sets is the number of runs in
only one of them, a metric; two texts are near if at least half of all their runs are common, that
is, if their distance is at most a third of the sum of their sizes. Pivots are fixed: the empty
set, whose distance is the size, and classes of the hashed universe of runs, whose distance from a
set is given by how many of its runs fall into the class. Counts of one class differ by no more
than the sets do inside it, so by the triangle inequality the sum of their differences over the
classes is at most the distance. Two tables of counts are kept:

* 256 classes, counted up to one: 256 bits, compared inside generated code, which tell apart texts
  of up to some 150 runs;
* for larger texts, ``2 ** (range + 1)`` classes (twice to four times the runs), counted up to two,
  in unary, so that one bit count sums the differences. Their number grows with the text, so they
  do not saturate.

``PivotTable`` stores, per accepted text, source, size, pivot distances and runs, in immutable
pieces; history lies in folders by a hash of the source, and a batch reads those it names. A batch
is joined with it inside its source and inside the range of sizes that the empty-set pivot leaves
(size ranges by powers of two, three of them per line), pruned by the pivots, and verified by the
true distance. A batch is broadcast up to ``BROADCAST_BYTES``. A source that holds very many texts is
split: its stored rows are spread over parts of at most ``PART_ROWS`` rows, and lines visit each.

Within a batch the order counts: a line is dropped if an accepted text or an earlier accepted line
is near it. Exact copies keep their first line. Of the rest, the first ``CHUNK`` lines of every
source are settled in one task, in order, against the accepted ones among them only; where a
source has more, its other lines are held against what was accepted and the next ``CHUNK`` follow.
So no pairs of a cluster are listed, a task holds at most ``CHUNK`` lines, and there are as many
rounds as the largest source has chunks that survive.

Results: null and empty texts and texts without a word are never near anything, and so are lines
without a source. Repeated history rows count once. Ties in (batch, line) are broken by id. Texts
are used whole. Empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.words import words
from evidentia.operators.jobs import in_order
from evidentia.scratch import FAN, bounded, materialise, release

#: Size range from which texts have the larger table of counts.
LARGE = 7
#: Stored rows of one source and size range that one part takes.
PART_ROWS = 2048
#: Lines of one source that one task settles at a time.
CHUNK = 16_384
#: Folders of a bulk piece of history.
BUCKETS = 16
#: Written size of a batch up to which it is broadcast.
BROADCAST_BYTES = 8 << 20

_BITS = ["d0", "d1", "d2", "d3"]


def _runs(w: Column) -> Column:
    three = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, F.array_distinct(three)).when(F.size(w) > 0, F.array(F.xxhash64(w)))


def _reach(runs: Column, lane: int) -> Column:
    own = F.filter(runs, lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(3)) == lane)
    return F.aggregate(own, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def counts_in_unary(runs: np.ndarray, level: int) -> np.ndarray:
    """Runs per class, up to two, of the classes of a size range: two bits each, as 64-bit words."""
    if level < LARGE:
        n = np.zeros(256, bool)
        n[runs & 255] = True
        return np.packbits(n).view(np.uint64)
    n = np.bincount(runs & ((2 << level) - 1), minlength=2 << level)
    return np.packbits(np.stack([n >= 1, n >= 2])).view(np.uint64)


def _with_fine(df: DataFrame, level: str = "range") -> DataFrame:
    """``df`` with ``fine``, the larger table of counts at the size range in ``level``; null for small texts."""
    kind = T.ArrayType(T.LongType())
    names = df.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lv = names.index("runs"), names.index(level)
        for b in batches:
            bounds = b.column(at).offsets.to_numpy()
            flat = b.column(at).values.to_numpy()
            rows = [counts_in_unary(flat[lo:hi], v).view(np.int64) for lo, hi, v in zip(bounds, bounds[1:], b.column(lv).to_pylist(), strict=False)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            fine = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, fine], names=[*names, "fine"])

    small = df.where(F.col(level) < LARGE).withColumn("fine", F.lit(None).cast(kind))
    large = df.where(F.col(level) >= LARGE).mapInArrow(add, T.StructType([*df.schema.fields, T.StructField("fine", kind)]))
    return small.unionByName(large)


def pivot_rows(df: DataFrame, source: str, text: str, *more: str) -> DataFrame:
    """``source, runs, size, d0..d3, range`` and ``more`` of each row with a source and a word."""
    cut = df.where(F.col(source).isNotNull() & F.col(text).isNotNull()).select(F.col(source).alias("source"), *more, words(F.col(text)).alias("w"))
    cut = cut.where(F.size("w") > 0).select("source", *more, F.sort_array(_runs(F.col("w"))).alias("runs"))
    cut = cut.select("source", *more, "runs", F.size("runs").alias("size"), *(_reach(F.col("runs"), i).alias(d) for i, d in enumerate(_BITS)))
    return cut.withColumn("range", (F.length(F.bin("size")) - 1))


def _marks() -> list[Column]:
    """128 bits that stand for a set of runs."""
    return [F.xxhash64("runs").alias("h1"), F.xxhash64(F.lit(1), "runs").alias("h2")]


def _near(new: DataFrame, old: DataFrame, parts: DataFrame | None) -> DataFrame:
    """``line`` of each row of ``new``, a written table, that some row of ``old`` (with ``fine``) of its source is near.

    ``parts``: ``source, range, spread`` of the large groups of ``old``.
    """
    probe = new.withColumn("range", F.explode(F.expr("sequence(greatest(0, range - 1), range + 1)")))
    probe = bounded(materialise(_with_fine(probe), "batch-probe"), BROADCAST_BYTES)
    if parts is not None:
        side = bounded(parts, BROADCAST_BYTES)
        old = old.join(side, ["source", "range"], "left").withColumn("part", F.pmod(F.xxhash64(*_BITS), F.coalesce("spread", F.lit(1))).cast("int")).drop("spread")
        probe = probe.join(parts, ["source", "range"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1))).drop("spread")
    else:
        old, probe = old.withColumn("part", F.lit(0)), probe.withColumn("part", F.lit(0))
    o = old.select(*(F.col(c).alias(f"{c}_o") for c in ["source", "range", "part", "size", "runs", "fine", *_BITS]))
    both = F.col("size") + F.col("size_o")
    apart = sum((F.bit_count(F.col(d).bitwiseXOR(F.col(f"{d}_o"))) for d in _BITS[1:]), F.bit_count(F.col("d0").bitwiseXOR(F.col("d0_o"))))
    finer = F.aggregate(F.zip_with("fine", "fine_o", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x)
    same_place = (F.col("source") == F.col("source_o")) & (F.col("range") == F.col("range_o")) & (F.col("part") == F.col("part_o"))
    # One conditional expression: as separate conjuncts the optimiser would verify before it prunes.
    left = (3 * F.abs(F.col("size") - F.col("size_o")) <= both) & (3 * apart <= both)
    near = F.when(~left, False).when(F.col("fine").isNotNull() & (3 * finer > both), False).otherwise(3 * F.size(F.array_intersect("runs", "runs_o")) >= both)
    return probe.join(o, same_place & near).select("line").distinct()


class PivotTable:
    """Stored pivot distances of everything accepted so far, in immutable pieces."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.bulk: list[DataFrame] = []
        self.small: list[DataFrame] = []
        self.parts: DataFrame | None = None

    def append(self, df: DataFrame, source: str = "source_id", text: str = "text") -> None:
        """Add history; each set of runs of a source once."""
        cut = pivot_rows(df, source, text)
        keep = [c for c in cut.columns if c != "source"]
        rows = cut.groupBy("source", *_marks()).agg(F.first(F.struct(*keep)).alias("r")).select("source", "r.*")
        self._add(materialise(rows, "pivot-cut"))

    def _add(self, cut: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")
        self.bulk.append(materialise(_with_fine(cut).withColumn("bucket", bucket), "pivot-rows", "bucket"))
        release(cut)
        parts = self.rows().groupBy("source", "range").agg(F.count("*").alias("m")).where(F.col("m") > PART_ROWS)
        self.parts = materialise(parts.select("source", "range", F.ceil(F.col("m") / PART_ROWS).cast("int").alias("spread")), "pivot-parts")
        if not self.parts.take(1):
            self.parts = None

    def append_rows(self, rows: DataFrame) -> None:
        """Add the accepted lines of a batch; of every ``FAN`` such pieces a bulk piece is made before the next one."""
        if len(self.small) >= FAN:
            merged, self.small = self.small, []
            self._add(materialise(reduce(DataFrame.unionByName, merged).drop("fine"), "pivot-cut"))
        self.small.append(materialise(rows, "pivot-lines"))

    def rows(self, buckets: list[int] | None = None) -> DataFrame | None:
        bulk = [b if buckets is None else b.where(F.col("bucket").isin(buckets)) for b in self.bulk]
        pieces = [b.drop("bucket") for b in bulk] + self.small
        return reduce(DataFrame.unionByName, pieces) if pieces else None

    def near(self, lines: DataFrame) -> DataFrame:
        """``line`` of each row of ``lines`` (a written table, as ``pivot_rows``) that is near a stored text."""
        named = lines.select(F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()  # at most BUCKETS rows
        return _near(lines, self.rows([r.b for r in named]), self.parts)


def _settle(rows: Iterator[tuple], _: tuple) -> Iterator[tuple]:
    """Of the lines of one source, in order, those that an earlier one, not dropped itself, is near. A row: source, b, l, k, runs, size, range."""
    kept: dict[int, list] = {}  # per size range: sets of runs, their sizes and pivot counts, how many
    for _, b, l, k, runs, size, level in rows:  # noqa: E741 - names of the line's parts
        runs, mine, near = np.asarray(runs), None, False
        for v in range(level - 1, level + 2):
            if v not in kept:
                continue
            sets, sizes, table, n = kept[v]
            both = sizes[:n] + size
            left = np.flatnonzero(3 * np.abs(sizes[:n] - size) <= both)
            if len(left):
                apart = np.bitwise_count(table[left] ^ counts_in_unary(runs, v)).sum(1, dtype=np.int64)
                left = left[3 * apart <= both[left]]
            for j in left.tolist():
                mine = set(runs.tolist()) if mine is None else mine
                if 3 * len(mine & sets[j]) >= both[j]:
                    near = True
                    break
            if near:
                break
        if near:
            yield b, l, k
            continue
        own = counts_in_unary(runs, level)
        sets, sizes, table, n = kept.get(level) or [[], np.zeros(4, np.int64), np.zeros((4, len(own)), np.uint64), 0]
        if n == len(sizes):
            sizes, table = np.concatenate([sizes, np.zeros_like(sizes)]), np.concatenate([table, np.zeros_like(table)])
        sets.append(set(runs.tolist()) if mine is None else mine)
        sizes[n], table[n] = size, own
        kept[level] = [sets, sizes, table, n + 1]


def admit(table: PivotTable, lines: DataFrame, key: str = "id", source: str = "source_id", text: str = "text", batch: str = "batch_no", line: str = "line_no") -> DataFrame:
    """``key`` of the lines that bring nothing new; the others are appended to ``table``."""
    named = lines.select(F.struct(F.col(batch).alias("b"), F.col(line).alias("l"), F.col(key).alias("k")).alias("line"), F.col(source).alias("s"), F.col(text).alias("t"))
    rows = materialise(pivot_rows(named, "s", "t", "line"), "batch-rows")
    shape = ["runs", "size", *_BITS, "range"]
    first = materialise(rows.groupBy("source", *_marks()).agg(F.min_by(F.struct("line", *shape), "line").alias("r")).select("source", "r.*"), "batch-first")
    gone = [rows.select("line").join(first.select("line"), "line", "left_anti").distinct()]
    fresh = first
    if table.bulk or table.small:
        gone.append(materialise(table.near(first), "batch-known"))
        fresh = first.join(gone[-1], "line", "left_anti")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema["line"].dataType.fields)
    at = F.row_number().over(W.partitionBy("source").orderBy("line"))
    while True:
        most = fresh.groupBy("source").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        now = fresh if most <= CHUNK else materialise(fresh.withColumn("at", at).where(F.col("at") <= CHUNK).drop("at"), "batch-chunk")
        flat = now.select("source", "line.*", "runs", "size", "range")
        dropped = materialise(in_order(flat, ["source"], ["b", "l", "k"], _settle, kinds).select(F.struct("b", "l", "k").alias("line")), "batch-out")
        gone.append(dropped)
        kept = _with_fine(now.join(dropped, "line", "left_anti").select("source", *shape))
        table.append_rows(kept)
        if most <= CHUNK:
            break
        rest = materialise(fresh.join(now.select("line"), "line", "left_anti"), "batch-rest")
        again = materialise(_near(rest, table.small[-1] if table.small else table.rows(), None), "batch-known")
        gone.append(again)
        fresh = rest.join(again, "line", "left_anti")
    return reduce(DataFrame.unionByName, gone).select(F.col("line.k").alias(key))

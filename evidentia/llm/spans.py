"""Long exact spans shared between records, over a log-structured index of window hashes.

A window is a run of ``length`` words. Its anchor is the least hash among the short runs of
words (``gram``) inside it, so equal windows have equal anchors wherever they stand, and
neighbouring windows mostly share one: the index holds each record's distinct anchors, about one
in ``(length - gram + 2) / 2`` words, instead of all windows.

``SpanIndex`` keeps them in immutable runs, bucketed by the anchor and sorted inside each bucket;
the number of buckets follows from the size of the first batch, and again at each compaction. A new
batch writes one run; finding anchors of several records is a merge of the sorted runs without a
shuffle; ``compact`` merges all runs into one.

An anchor that stands in very many records would fill a bucket of its own. Such anchors are found in
one of ``SAMPLE`` records before a run is written (at ``HOT`` of these or more); their rows are
scattered over ``SALTS`` places, and as they are known to be shared, they need not be met in a bucket. The
sample decides where rows lie, never whether they count.

What the anchors point to is then verified: the windows of exactly those records and anchors are taken from the texts again and
compared by two independent 64-bit hashes of their words, so two windows count as equal only if
128 bits agree.

Each occurrence is reduced before it is shuffled (least and greatest record per window), so a
window that stands in a third of all records costs each task one row. Nothing is listed in pairs.

Results: null, empty and short texts share nothing; a text repeated under one key counts as one
record; repeats inside one record are not shared; empty tables give an empty result; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.functions.words import run_hashes, sliding_min
from evidentia.scratch import bounded, materialise, release, write_sorted_run

BASE_1, BASE_2, BASE_3 = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93

#: One record in so many is looked at for frequent anchors; how many of these make an anchor hot; places its rows are scattered over.
SAMPLE, HOT, SALTS = 64, 64, 256
#: Input bytes per bucket of a run, buckets at most, bytes of hot anchors that are broadcast.
BUCKET_BYTES, MOST_BUCKETS, BROADCAST_BYTES = 64 << 20, 16_384, 8 << 20

#: Words are what stands between these.
GAPS = "[ \\t\\n\\r]+"


def word_codes(text: str) -> F.Column:
    """One 64-bit code per word of the text, in order."""
    return F.transform(F.filter(F.split(F.col(text), GAPS), lambda w: w != ""), lambda w: F.xxhash64(w))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row bounds of a list column, without copying the values."""
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    return values.view(np.uint64), bounds - bounds[0]


def _windows(codes: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and anchor of every window that lies inside one row."""
    anchors = sliding_min(run_hashes(codes, gram, BASE_1), length - gram + 1)
    starts = np.arange(len(anchors))
    row = np.searchsorted(bounds, starts, side="right") - 1
    inside = starts + length <= bounds[row + 1]
    return starts[inside], row[inside], anchors[inside]


class SpanIndex:
    """Sorted runs of (anchor, record); ``length`` words make a span."""

    def __init__(self, spark: SparkSession, length: int = 40, gram: int = 16, buckets: int | None = None):
        self.spark, self.length, self.gram, self.buckets = spark, length, gram, buckets
        self.runs: list[DataFrame] = []
        self.hot: DataFrame | None = None  # column ``anchor``

    def _sized(self, *tables: DataFrame) -> int:
        """Buckets for the planner's estimate of the tables' bytes, from file sizes; an estimate beyond a petabyte means that it knows none."""
        bytes_ = sum(int(str(t._jdf.queryExecution().analyzed().stats().sizeInBytes())) for t in tables)
        bytes_ = 0 if bytes_ > 1 << 50 else bytes_
        return min(MOST_BUCKETS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // BUCKET_BYTES)))

    def append(self, batch: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Write the run of a new batch; earlier runs stay as they are."""
        length, gram = self.length, self.gram

        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, bounds = _flat(b.column(1))
                if len(codes) < length:
                    continue
                _, row, anchor = _windows(codes, bounds, length, gram)
                new = np.ones(len(row), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64)), b.column(0).take(pa.array(row[new]))], names=["anchor", "record"])

        kind = batch.schema[key].dataType.simpleString()
        if self.buckets is None:
            self.buckets = self._sized(batch)
        cut = batch.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("record"), F.col(text).alias("text"))
        coded = lambda rows: rows.select("record", word_codes("text").alias("codes")).where(F.size("codes") >= length).mapInArrow(anchors, f"anchor bigint, record {kind}")
        some = coded(cut.where(F.pmod(F.xxhash64("record"), F.lit(SAMPLE)) == 0))
        hot = some.groupBy("anchor").agg(F.countDistinct("record").alias("n")).where(F.col("n") >= HOT).select("anchor")
        self._heat(hot)
        self.runs.append(write_sorted_run(self._placed(coded(cut)), "span_run", "spot", self.buckets))

    def _heat(self, hot: DataFrame) -> None:
        new = materialise(hot if self.hot is None else hot.unionByName(self.hot).distinct(), "span-hot")
        if new.take(1):
            self.hot = new

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``anchor, record`` with ``spot``: the anchor, or one of ``SALTS`` places if it is hot."""
        if self.hot is None:
            return rows.withColumn("spot", F.col("anchor"))
        marked = rows.join(bounded(self.hot, BROADCAST_BYTES).withColumn("hot", F.lit(True)), "anchor", "left")
        salted = F.xxhash64("anchor", F.pmod(F.xxhash64("record"), F.lit(SALTS)))
        return marked.select("anchor", "record", F.when(F.col("hot"), salted).otherwise(F.col("anchor")).alias("spot"))

    def compact(self) -> None:
        """Merge all runs into one; the old ones are deleted."""
        if len(self.runs) > 1:
            old = self.runs
            self.buckets = self._sized(*old)
            self.runs = [write_sorted_run(self._placed(self._merged().select("anchor", "record")), "span_run", "spot", self.buckets)]
            release(*old)

    def drop(self) -> None:
        """Delete the runs."""
        release(*self.runs)
        self.runs = []

    def _merged(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.runs)

    def candidates(self, records: DataFrame | None = None) -> DataFrame:
        """(record, anchor) of every anchor that several records hold; with ``records``, only anchors these hold."""
        cold = runs = self._merged()
        hot = None
        if self.hot is not None:
            side = bounded(self.hot, BROADCAST_BYTES)
            cold, hot = runs.join(side, "anchor", "left_anti"), runs.join(side, "anchor", "left_semi")
        # Where no anchor is hot, a spot is an anchor.
        several = cold.groupBy("spot").agg(F.min("record").alias("low"), F.max("record").alias("high")).where("low <> high").select("spot")
        if records is not None:
            several = several.join(cold.join(records, "record", "left_semi").select("spot"), "spot", "left_semi")
        out = cold.join(several, "spot").select("record", "anchor")
        if hot is not None:
            if records is not None:
                hot = hot.join(hot.join(records, "record", "left_semi").select("anchor").distinct(), "anchor", "left_semi")
            out = out.unionByName(hot.select("record", "anchor"))
        return out

    def shared_spans(self, texts: DataFrame, key: str = "doc_id", text: str = "text", new: DataFrame | None = None) -> DataFrame:
        """``key, from_word, to_word, n_words``: longest stretches of shared words of each record.

        ``new`` (a column ``record``) restricts the work to what a new batch touches: stretches of
        its own records are complete; of older records only those parts come out that lie under
        an anchor of the batch, to be united with what was reported before.
        """
        length, gram = self.length, self.gram
        kind = texts.schema[key].dataType.simpleString()

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, bounds = _flat(b.column(1))
                if len(codes) < length:
                    continue
                start, row, anchor = _windows(codes, bounds, length, gram)
                wanted, held = _flat(b.column(2))
                listed = np.repeat(np.arange(b.num_rows), np.diff(held))
                change = np.ones(len(row), bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(change)
                keep_run = _among(listed, wanted, row[first], anchor[first])
                keep = np.repeat(keep_run, np.diff(np.append(first, len(row))))
                start, row = start[keep], row[keep]
                if not len(start):
                    continue
                h1, h2 = run_hashes(codes, length, BASE_2)[start], run_hashes(codes, length, BASE_3)[start]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), b.column(0).take(pa.array(row)), pa.array((start - bounds[row]).astype(np.int64))], names=["h1", "h2", "record", "at"])

        held = self.candidates(new).groupBy("record").agg(F.collect_set("anchor").alias("anchors"))
        cut = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("record"), F.col(text).alias("text")).join(held, "record").select("record", word_codes("text").alias("codes"), "anchors")
        seen = materialise(cut.mapInArrow(windows, f"h1 bigint, h2 bigint, record {kind}, at bigint"), "span-windows")
        shared = seen.groupBy("h1", "h2").agg(F.min("record").alias("low"), F.max("record").alias("high")).where("low <> high").select("h1", "h2")
        starts = seen.join(shared, ["h1", "h2"]).select("record", "at").distinct()
        by_record = W.partitionBy("record").orderBy("at")
        gap = (F.col("at") > F.lag("at").over(by_record) + length).cast("int")
        island = starts.withColumn("island", F.sum(F.coalesce(gap, F.lit(0))).over(by_record))
        out = island.groupBy("record", "island").agg(F.min("at").alias("from_word"), (F.max("at") + (length - 1)).alias("to_word"))
        return out.select(F.col("record").alias(key), "from_word", "to_word", (F.col("to_word") - F.col("from_word") + 1).alias("n_words"))


def _among(rows: np.ndarray, anchors: np.ndarray, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whether each (row, anchor) is one of (rows, anchors). A false match only adds windows that are then verified."""
    with np.errstate(over="ignore"):
        key = lambda r, a: a ^ (r.astype(np.uint64) * np.uint64(BASE_1))
        return np.isin(key(row, anchor), key(rows, anchors))


def shared_words(spans: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, shared_words, share`` of every record, 0 where it shares nothing."""
    sums = spans.groupBy(key).agg(F.sum("n_words").alias("shared_words"))
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), GAPS), lambda w: w != ""))
    out = texts.select(key, n.cast("long").alias("n_words")).join(sums, key, "left").withColumn("shared_words", F.coalesce("shared_words", F.lit(0)))
    return out.withColumn("share", F.round(F.when(F.col("n_words") > 0, F.col("shared_words") / F.col("n_words")).otherwise(0.0), 6))

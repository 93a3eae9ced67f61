"""Many readers, one writer: a stream of staged rows is prepared in parallel and published in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.sources.store import SnapshotStore


def publish_stream(stream: DataFrame, store: SnapshotStore, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Every micro-batch becomes one snapshot of ``store``, with the rows of ``prepare`` added to ``table``.

    The number of the batch is published with its rows, so a batch that is run again after a failure is
    not added twice. A micro-batch is the only writer; any other writer in between makes it fail and run again.
    """

    def write(rows: DataFrame, number: int) -> None:
        base = store.current()
        there = store.tables(base)
        if "batches" in there and store.read("batches", base).where((F.col("batch") == number) & (F.col("table") == table)).take(1):
            return
        new = prepare(rows)
        done = rows.sparkSession.createDataFrame([(number, table)], "batch long, table string")
        changed = {
            table: store.read(table, base).unionByName(new) if table in there else new,
            "batches": store.read("batches", base).unionByName(done) if "batches" in there else done,
        }
        store.publish(changed, base)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

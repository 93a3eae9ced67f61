"""Tables written between the stages of a plan, in the folder all executors share.

Lineage is cut by writing a parquet table and reading it back: the files outlive any
executor, hold only the columns that are needed, and are compressed. All tables of an
application lie in one folder, which is removed when the application ends; what a plan has
used up earlier is given back with ``release``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces of one level that a log merges into one of the next.
FAN = 8

#: Whether Spark deletes the shuffle files of a statement when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FOLDERS: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The application's folder inside the session's ``spark.checkpoint.dir``.

    Where that is unset, a local folder is made for a local master (one machine, as in tests); on a
    cluster it would lose data, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is not set; {master} needs a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/evidentia-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        path, fs = _file_system(spark, folder)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _FOLDERS[folder] = folder
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Shuffles of a write go with it: nothing reads them again, and else they lie there until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder, in folders by the columns ``by``, and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _no_shuffles_left(spark):
        if by:
            # Partitions are evened out first: few files per folder, and no task with all of a hot one.
            df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)
        else:
            df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.scratch_path = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete written tables that no plan will read again."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            p, fs = _file_system(df.sparkSession, path)
            fs.delete(p, True)
            name = getattr(df, "scratch_table", None)
            if name:
                df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def write_sorted_run(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as one immutable run: hash-bucketed by ``key``, sorted inside each bucket.

    Joins and aggregations on ``key`` over such runs need no shuffle. The data is an
    external table in the shared folder; the catalog entry is private to the session.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.scratch_path, out.scratch_table = path, table
    return out


class Pieces:
    """A log of rows in immutable pieces; an append writes its own rows only.

    ``FAN`` pieces of one level are merged, by ``merge``, into one of the next level, so a row is
    written again once per level: about log(rows) times in all.
    """

    def __init__(self, spark: SparkSession, name: str, merge: Callable[[DataFrame], DataFrame], *by: str):
        self.spark, self.name, self.merge, self.by = spark, name, merge, by
        self.pieces: list[tuple[int, DataFrame]] = []
        self.used_up: list[DataFrame] = []

    def append(self, rows: DataFrame) -> DataFrame:
        """Write one piece and return it."""
        piece = materialise(rows, self.name, *self.by)
        self.pieces.append((0, piece))
        while len(self.pieces) >= FAN and len({level for level, _ in self.pieces[-FAN:]}) == 1:
            last, level = self.pieces[-FAN:], self.pieces[-1][0]
            whole = reduce(DataFrame.unionByName, (p for _, p in last))
            self.pieces[-FAN:] = [(level + 1, materialise(self.merge(whole), self.name, *self.by))]
            self.used_up += [p for _, p in last]
        return piece

    def read(self) -> DataFrame | None:
        """All pieces, or None before the first append."""
        return reduce(DataFrame.unionByName, (p for _, p in self.pieces)) if self.pieces else None

    def vacuum(self) -> None:
        """Delete the pieces that were merged; plans made before must have run."""
        release(*self.used_up)
        self.used_up = []


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes under ``path`` as the file system counts them, without reading any row."""
    p, fs = _file_system(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def written(df: DataFrame) -> int:
    """Bytes of a table that ``materialise`` wrote."""
    return size_of(df.sparkSession, df.scratch_path)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, to be broadcast if its files hold at most ``most`` bytes; else as it is."""
    return F.broadcast(df) if written(df) <= most else df

"""The durable job queue in batch form, and limits on callers.

Rules that go through events in order (the states of a job, the calls of a client) are folded by
sorted partitions: a key's events pass one after another, and only its state is held.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ("queued", "running", "staged", "ok", "failed")
#: States in which a job holds its key.
LIVE = ("queued", "running", "staged")
#: Attempts per phase, finished jobs kept, calls a client may make in a window of seconds, unfinished jobs at most.
ATTEMPTS, KEEP, CALLS, SECONDS, CEILING = 3, 200, 120, 60, 100


class Slot:
    """Room for one piece of work in this process; who finds it taken is told what holds it."""

    def __init__(self) -> None:
        self._lock, self.holder = threading.Lock(), None

    @contextmanager
    def held(self, name: str) -> Iterator[None]:
        if not self._lock.acquire(blocking=False):
            raise RuntimeError(f"{self.holder} is running")
        self.holder = name
        try:
            yield
        finally:
            self.holder = None
            self._lock.release()


def last_event(events: DataFrame, job: str, *order: str) -> DataFrame:
    """The newest event of each job: its state."""
    return events.groupBy(job).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("e")).select("e.*")


def status_counts(jobs: DataFrame, status: str = "status") -> DataFrame:
    """``status, n`` for every status, zeros included."""
    names = jobs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    n = jobs.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return names.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def keep_finished(jobs: DataFrame, group: str, *order, keep: int = KEEP) -> DataFrame:
    """The newest ``keep`` finished jobs of each group."""
    return jobs.withColumn("age", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("age") <= keep)


def claim(jobs: DataFrame, status: str, *order: str) -> DataFrame:
    """The oldest job in a status, or none."""
    return jobs.where(F.col("status") == status).orderBy(*order).limit(1)


def claims(jobs: DataFrame, status: str, workers: int, *order: str) -> DataFrame:
    """``worker`` and the job it takes: the oldest jobs in a status, one per worker, none twice."""
    # Only as many rows as workers outlive the top-k, so one task numbers them.
    oldest = jobs.where(F.col("status") == status).orderBy(*order).limit(workers)
    return oldest.withColumn("worker", F.row_number().over(W.orderBy(*order)) - 1)


def backlog(jobs: DataFrame, status: str = "status", ceiling: int = CEILING) -> DataFrame:
    """One row: unfinished jobs, and whether the queue takes no more."""
    n = jobs.agg(F.coalesce(F.sum(F.col(status).isin(*LIVE).cast("long")), F.lit(0)).alias("waiting"))
    return n.withColumn("full", F.col("waiting") >= ceiling)


def merged_registers(durable: DataFrame, running: DataFrame, key: str, created: str, limit: int) -> DataFrame:
    """The newest ``limit`` jobs of both registers; where both know a job, the durable one is right."""
    rows = durable.unionByName(running.join(durable.select(key), key, "left_anti"))
    return rows.orderBy(F.desc(created), key).limit(limit)


def enqueue(requests: DataFrame, key: str, payload: str, *order: str) -> DataFrame:
    """``key, first, conflict, requests``: the request that becomes the job, and whether a later one with its key differs."""
    digest = F.md5(F.coalesce(F.col(payload), F.lit("")))
    return requests.groupBy(key).agg(F.min(F.struct(*order)).alias("f"), (F.countDistinct(digest) > 1).alias("conflict"), F.count("*").alias("requests")).select(key, F.col(f"f.{order[-1]}").alias("first"), "conflict", "requests")


def enqueue_live(log: DataFrame, key: str, payload: str, ends: str, *order: str) -> DataFrame:
    """Requests of a log (``ends``: whether a row ends the live job of its key) with ``outcome`` and ``job``.

    A request with a free key is accepted and its place in ``order`` names the job; until the job ends,
    a request with the same payload, or with none, is a replay of it, and any other one a conflict.
    """
    before = W.partitionBy(key).orderBy(*order)
    term = F.sum(F.col(ends).cast("int")).over(before.rowsBetween(W.unboundedPreceding, -1))
    rows = log.withColumn("_term", F.coalesce(term, F.lit(0))).where(~F.col(ends))
    inside = W.partitionBy(key, "_term").orderBy(*order)
    first = lambda c: F.first(c).over(inside)
    other = F.col(payload).isNotNull() & first(payload).isNotNull() & (F.col(payload) != first(payload))
    outcome = F.when(F.row_number().over(inside) == 1, "accepted").when(other, "conflict").otherwise("replay")
    return rows.withColumn("outcome", outcome).withColumn("job", first(order[-1])).drop("_term")


def in_order(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[tuple], tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of ``fold`` over each key's rows in order, read as a stream: ``fold`` gets them one by one, and the key."""
    names = df.columns
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        ahead = next(rows, None)
        columns = [f.strip().split(" ")[0] for f in schema.split(",")]
        out: list[tuple] = []
        while ahead is not None:
            key = tuple(ahead[i] for i in at)

            def own() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and tuple(ahead[i] for i in at) == key:  # noqa: B023
                    now = ahead
                    ahead = next(rows, None)
                    yield now

            for made in fold(own(), key):
                out.append(made)
                if len(out) >= 10_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        yield pd.DataFrame(out, columns=columns)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


#: Fixed value: which events a state accepts, and where they lead. A job is claimed twice: for its first phase when queued, for its second when staged.
MOVES = {("new", "enqueue"): "queued", ("queued", "claim"): "running", ("running", "stage"): "staged", ("staged", "claim"): "running", ("running", "finish"): "ok"}


def advance(state: tuple[str, int, int], event: str, permanent: bool = False) -> tuple[str, int, int]:
    """Status, phase and attempts after an event; one that the status does not accept changes nothing.

    A failure puts the job back where it was claimed, up to ``ATTEMPTS`` times per phase; a permanent one
    ends it. A release puts it back too, and gives the attempt back.
    """
    status, phase, attempts = state
    back = "staged" if phase == 2 else "queued"
    if status == "running" and event == "fail":
        return ("failed", phase, attempts) if permanent or attempts >= ATTEMPTS else (back, phase, attempts)
    if status == "running" and event == "release":
        return back, phase, max(0, attempts - 1)
    to = MOVES.get((status, event))
    if to is None:
        return state
    return to, {"queued": 1, "staged": 2}.get(to, phase), {"claim": attempts + 1, "stage": 0}.get(event, attempts)


def replay(events: DataFrame) -> DataFrame:
    """``job, status, phase, attempts`` after all events of a log ``job, seq, event, permanent``; events of no job are left out."""

    def fold(rows: Iterator[tuple], key: tuple) -> Iterator[tuple]:
        state = ("new", 1, 0)
        for _, _, event, permanent in rows:
            state = advance(state, event, bool(permanent))
        yield key[0], *state

    kind = events.schema["job"].dataType.simpleString()
    return in_order(events.where(F.col("job").isNotNull()).select("job", "seq", "event", "permanent"), ["job"], ["seq"], fold, f"job {kind}, status string, phase int, attempts int")


def rate_limit(calls: DataFrame, client: str, ts: str, key: str, limit: int = CALLS, seconds: int = SECONDS) -> DataFrame:
    """``key, in_window, allowed`` of each call: allowed calls of the client in the last ``seconds``, and whether it passes.

    Refused calls use nothing up. A pause of a whole window empties it, so the calls between two
    pauses are folded apart from the others: a busy client is spread over tasks. Ties go by ``key``.
    """
    at, window = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000
    rows = calls.select(F.col(client).cast("string").alias("_client"), at.alias("_at"), F.col(key).alias(key))
    down = W.partitionBy("_client").orderBy("_at", key)
    fresh = F.coalesce((F.col("_at") - F.lag("_at").over(down) >= window).cast("int"), F.lit(0))
    rows = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(down)).select("_client", "_run", "_at", key)

    def fold(events: Iterator[tuple], _: tuple) -> Iterator[tuple]:
        recent: deque[int] = deque()
        for _, _, now, name in events:
            while recent and now - recent[0] >= window:
                recent.popleft()
            n = len(recent)
            if n < limit:
                recent.append(now)
            yield name, n, n < limit

    return in_order(rows, ["_client", "_run"], ["_at", key], fold, f"{key} {calls.schema[key].dataType.simpleString()}, in_window bigint, allowed boolean")


def costs(traces: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Calls, summed cost and failures of each run and operation."""
    return traces.groupBy(*keys).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("total"), F.sum(F.col("failed").cast("long")).alias("failures"))

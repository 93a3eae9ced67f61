"""The job queue and the rate limiter as stateful streams, with state in the RocksDB store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.operators.jobs import CALLS, SECONDS, advance

JOB = "job string, status string, phase int, attempts int, error string"

#: Fixed value: the state store that such streams need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Jobs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, phase int, attempts int, error string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        *now, error = self.state.get() if self.state.exists() else ("new", 1, 0, None)
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            now = advance((now[0], int(now[1]), int(now[2])), r.event, bool(r.permanent))
            error = r.error if r.event == "fail" else error
        self.state.update((*now, error))
        yield pd.DataFrame({"job": [key[0]], "status": [now[0]], "phase": [now[1]], "attempts": [now[2]], "error": [error]})

    def close(self) -> None:
        pass


class _Calls(StatefulProcessor):
    def __init__(self, limit: int, seconds: int):
        self.limit, self.window = limit, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("recent", "at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - names of the interface
        recent = list(self.state.get()[0]) if self.state.exists() else []
        calls, allowed = pd.concat(list(rows)).sort_values("ts"), []
        for ts in calls["ts"]:
            now = int(pd.Timestamp(ts).value // 1000)
            recent = [t for t in recent if t > now - self.window]
            allowed.append(len(recent) < self.limit)
            if allowed[-1]:
                recent.append(now)
        self.state.update((recent,))
        yield pd.DataFrame({"client": key[0], "ts": calls["ts"], "allowed": allowed})

    def close(self) -> None:
        pass


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df.groupBy(key).transformWithStateInPandas(processor, schema, mode, "None")


def job_stream(events: DataFrame) -> DataFrame:
    """State of each job after each trigger, from a stream of ``job, seq, event, permanent, error``."""
    return _stateful(events, "job", _Jobs(), JOB, "Update")


def rate_stream(calls: DataFrame, limit: int = CALLS, seconds: int = SECONDS) -> DataFrame:
    """``client, ts, allowed`` for a stream of ``client, ts``; the state keeps the allowed calls of the last window only."""
    return _stateful(calls, "client", _Calls(limit, seconds), "client string, ts timestamp, allowed boolean", "Append")


def trace_stream(traces: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Calls and cost per operation and five minutes of event time; rows later than ``late`` are dropped. An addition to the reference's surface."""
    return traces.withWatermark("ts", late).groupBy(F.window("ts", "5 minutes"), "op").agg(F.count("*").alias("calls"), F.sum("value").alias("total"))

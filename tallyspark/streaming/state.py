"""Streams that remember: a request counter whose windows start at their first hit, and pairs of repeats within hours."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Most requests, and minutes, of each kind of request.
LIMITS = {"login": (10, 10), "register": (5, 60), "forgotPassword": (5, 60), "upload": (20, 60)}


@contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state on disk, not in the executors' memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class _Window(StatefulProcessor):
    """The end of a key's window and the hits in it; forgotten when the watermark has passed the end."""

    def __init__(self, limits: dict[str, tuple[int, int]]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "ends long, hits long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kind, who = key
        most, minutes = self.limits[kind]
        batch = pd.concat(list(rows)).sort_values(["ts", "request_id"], ignore_index=True)
        times = batch["ts"].astype("datetime64[us]").astype("int64").tolist()
        ends, hits = self.window.get() if self.window.exists() else (None, 0)
        first, out = ends, []
        for at in times:
            if ends is None or ends < at:
                ends, hits = at + minutes * 60_000_000, 0
            allowed = hits < most
            hits += allowed
            out.append((allowed, most - hits, ends))
        self.window.update((ends, hits))
        if ends != first:
            self.handle.registerTimer(ends // 1000 + 1)
        allowed, remaining, reset = zip(*out, strict=True)
        yield pd.DataFrame({"kind": kind, "who": who, "request_id": batch["request_id"], "ts": batch["ts"], "allowed": allowed, "remaining": remaining, "reset_at": pd.to_datetime(list(reset), unit="us")})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.window.exists() and self.window.get()[0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def counted_requests(requests: DataFrame, delay: str = "1 minute", limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A stream of requests (kind, who, request_id, ts) with allowed, remaining and reset_at.

    A key's window starts at its first request and ends a fixed time later; a request just at the end is still in it, and
    the first one after it starts the next. Refused requests do not count. In a batch requests are taken by time, then by
    request_id. One that comes late counts in the window that is open; one later than the delay is dropped. Requests of
    kinds without a limit have no rows. Start it within durable_state, in update or append mode.
    """
    limits = limits or LIMITS
    known = requests.where(F.col("kind").isin(list(limits)) & F.col("ts").isNotNull()).select("kind", F.coalesce("who", F.lit("unknown")).alias("who"), "request_id", F.col("ts").cast("timestamp").alias("ts"))
    schema = f"kind string, who string, request_id {requests.schema['request_id'].dataType.simpleString()}, ts timestamp, allowed boolean, remaining long, reset_at timestamp"
    return known.withWatermark("ts", delay).groupBy("kind", "who").transformWithStateInPandas(_Window(limits), schema, "update", "eventTime")


def repeat_pairs(events: DataFrame, key: list[str], id_col: str = "tx_id", time_col: str = "ts", hours: int = 48, delay: str = "1 hour") -> DataFrame:
    """A stream's pairs (key, first_id, first_ts, second_id, second_ts) of rows with one key at most so many hours apart, by time, then by id.

    Each pair comes once, when its second row does, whichever of the two is delivered first. A row that is older than the newest time seen so far less
    the delay, when its batch begins, is dropped and has no pairs. State goes back hours and delay, no further. Null keys, times and
    ids have no pairs. Start it within durable_state, in append mode.
    """
    rows = events.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*key, id_col, time_col)))).withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, delay)
    side = lambda n: rows.select(*(F.col(c).alias(f"{n}_{c}") for c in key), F.col(id_col).alias(f"{n}_id"), F.col(time_col).alias(f"{n}_ts"))
    same = reduce(lambda a, b: a & b, (F.col(f"first_{c}") == F.col(f"second_{c}") for c in key))
    apart = F.expr(f"second_ts >= first_ts AND second_ts <= first_ts + INTERVAL {hours} HOURS") & ((F.col("second_ts") > F.col("first_ts")) | (F.col("second_id") > F.col("first_id")))
    joined = side("first").join(side("second"), same & apart)
    return joined.select(*(F.col(f"first_{c}").alias(c) for c in key), "first_id", "first_ts", "second_id", "second_ts")

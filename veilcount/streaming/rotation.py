"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def distinct_clients(closes: DataFrame, period: str = "10 minutes", lateness: str = "10 minutes") -> DataFrame:
    """ST2, ST3: closes (ip, ts) to window and number of clients, in append mode.

    Exact: one level by window and client, one by window. The last windows stay open until the
    watermark passes them.
    """
    first = closes.withWatermark("ts", lateness).groupBy(F.window("ts", period).alias("w"), "ip").agg(F.count("*").alias("n"))
    return first.groupBy(F.window(F.window_time("w"), period).alias("w")).agg(F.count("*").alias("clients"), F.sum("n").alias("closes")).select(F.col("w.start").alias("start"), "clients", "closes")


def client_windows(closes: DataFrame, period: int = 600, lateness: int = 600) -> DataFrame:
    """ST2: closes (ip, active, ts, created; times as timestamps) to the batch form's columns, with each window's start.

    A close counts in its window and, without a completion, in the one before if it began there. Such a row is a
    period older than its close, so the watermark waits for a period more. Append mode; the last windows stay open.
    """
    at = F.unix_micros("ts") / 1e6
    w = F.floor(at / period)
    row = lambda k, done: F.struct(F.timestamp_seconds(k * period).alias("at"), F.lit(done).alias("done"))
    began = F.unix_micros("created") / 1e6
    rows = F.array_compact(F.array(row(w, 1), F.when(began < w * period, row(w - 1, 0))))
    each = closes.select("ip", "active", F.explode(rows).alias("r")).select("ip", "active", "r.*")
    span = f"{period} seconds"
    done = lambda c: F.sum(F.when(c, F.col("done")).otherwise(0))
    clients = (
        each.withWatermark("at", f"{lateness + period} seconds")
        .groupBy(F.window("at", span).alias("w"), "ip")
        .agg(
            F.max(F.col("active").cast("int")).alias("is_active"),
            done(F.col("active")).alias("active_done"),
            done(~F.col("active")).alias("inactive_done"),
        )
    )
    return (
        clients.groupBy(F.window(F.window_time("w"), span).alias("w"))
        .agg(
            F.count("*").alias("clients"),
            F.sum("is_active").alias("active_clients"),
            (F.count("*") - F.sum("is_active")).alias("inactive_clients"),
            F.sum("active_done").alias("active_completed"),
            F.sum("inactive_done").alias("inactive_completed"),
        )
        .select(
            F.col("w.start").alias("start"),
            "clients",
            "active_clients",
            "inactive_clients",
            "active_completed",
            "inactive_completed",
        )
    )


class CircuitState(StatefulProcessor):
    """ST1: streams gather by circuit; a close emits their number once and evicts them.

    A circuit that never closes leaves when nothing was added to it for ttl_ms milliseconds; without, it stays.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = StructType([StructField("n", LongType()), StructField("bytes", LongType())])
        self.streams = handle.getValueState("streams", kept, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, size = self.streams.get() if self.streams.exists() else (0, 0)
        out = []
        for batch in rows:
            for kind, amount in batch.sort_values(["ts", "kind"])[["kind", "bytes"]].itertuples(index=False, name=None):
                if kind == 0:
                    n, size = n + 1, size + int(amount)
                elif n:
                    out.append((int(key[0]), n, size))
                    n, size = 0, 0
        if n:
            self.streams.update((n, size))
        elif self.streams.exists():
            self.streams.clear()
        yield pd.DataFrame(out, columns=["circuit", "streams", "bytes"]).astype("int64")

    def close(self) -> None:
        pass


def circuits(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """ST1: events (circuit, kind 0 stream or 1 close, ts, bytes) to closed circuits with their streams.

    ttl_ms, in processing time, bounds the state by what arrives within it.
    """
    mode = "none" if ttl_ms is None else "processingtime"
    out = "circuit long, streams long, bytes long"
    return events.groupBy("circuit").transformWithStateInPandas(CircuitState(ttl_ms), out, "append", mode)

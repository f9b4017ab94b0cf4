"""Circuits as state (ST1): streams wait by circuit until a close claims them (M12), and are told once.

A close claims the streams that ended at or before it and after the close before, as a channel's circuit numbers
recur. Both may arrive in any order within the watermark's delay: a close is settled when the watermark passes
it, so no stream that it could claim is still to come. Streams of circuits that never close leave `max_age`
seconds after they ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilcount.functions.scalars import port_class
from veilcount.operators.fanout import Measure, class_cells, named

STREAM, CLOSE = 0, 1
KEYS = ("party", "channel", "circuit")
CIRCUIT_ROWS = "party string, channel long, circuit long, closed_us long, label string, streams long, gaps array<double>"
CLAIMED_ROWS = "party string, channel long, circuit long, port int, start double, ended_us long, closed_us long"


def marks_of(streams: DataFrame, closes: DataFrame) -> DataFrame:
    """Streams (keys, port, start, end) and closes (keys, closed), times in seconds, as one stream of events."""
    at = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))
    own = streams.select(*KEYS, at("end").alias("at"), F.lit(STREAM).alias("kind"), F.col("port").cast("int").alias("port"), F.col("start").cast("double").alias("start"))
    done = closes.select(*KEYS, at("closed").alias("at"), F.lit(CLOSE).alias("kind"), F.lit(None).cast("int").alias("port"), F.lit(None).cast("double").alias("start"))
    return own.unionByName(done)


class ClosedCircuits(StatefulProcessor):
    """What closes claim, by circuit and class of ports, or by stream."""

    def __init__(self, max_age: float, by_stream: bool) -> None:
        self.max_age_ms, self.by_stream = int(max_age * 1000), by_stream

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.streams = handle.getListState("streams", "us long, port int, label string, start double")
        self.closes = handle.getListState("closes", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            us = batch["us"].to_numpy()
            closes = batch["kind"].to_numpy() == CLOSE
            if closes.any():
                self.closes.appendList([(int(u),) for u in us[closes]])
                for ms in sorted({int(u) // 1000 for u in us[closes]}):
                    self.handle.registerTimer(ms)
            own = batch[~closes]
            if len(own):
                self.streams.appendList([(int(u), int(p), lab, float(s)) for u, p, lab, s in zip(own["us"], own["port"], own["label"], own["start"], strict=True)])
                self.handle.registerTimer(int(own["us"].max()) // 1000 + self.max_age_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        closes = sorted(u for (u,) in self.closes.get()) if self.closes.exists() else []
        waiting = sorted(self.streams.get()) if self.streams.exists() else []
        out = []
        for us in [u for u in closes if u // 1000 <= now]:
            mine = [s for s in waiting if s[0] <= us]
            waiting = waiting[len(mine) :]
            out += self._told(key, us, mine)
        kept = [(u,) for u in closes if u // 1000 > now]
        waiting = [s for s in waiting if s[0] // 1000 + self.max_age_ms > now]
        for state, left in ((self.closes, kept), (self.streams, waiting)):
            if left:
                state.put([tuple(x) for x in left])
            else:
                state.clear()
        columns = [c.split()[0] for c in (CLAIMED_ROWS if self.by_stream else CIRCUIT_ROWS).split(", ")]
        yield pd.DataFrame(out, columns=columns)

    def _told(self, key, us: int, mine: list) -> list[tuple]:
        if self.by_stream:
            return [(*key, port, start, ended, us) for ended, port, _, start in mine]
        out = []
        for label in ["", *sorted({s[2] for s in mine})] if mine else []:
            starts = sorted(s[3] for s in mine if label in ("", s[2]))
            out.append((*key, us, label, len(starts), [b - a for a, b in zip(starts, starts[1:], strict=False)]))
        return out

    def close(self) -> None:
        pass


def closed_circuits(marks: DataFrame, lateness: str = "10 minutes", max_age: float = 86400.0, by_stream: bool = False) -> DataFrame:
    """ST1: streaming marks_of() to each closed circuit's streams: of all (label '') and by class of ports, with the times
    between their starts. by_stream: each claimed stream with its close (M12) instead.

    Needs the RocksDB state store. Append mode; closes beyond the watermark stay open.
    """
    timed = marks.withWatermark("at", lateness)
    rows = timed.select(*KEYS, "at", "kind", "port", "start", F.unix_micros("at").alias("us"), port_class(F.col("port")).alias("label"))
    out = CLAIMED_ROWS if by_stream else CIRCUIT_ROWS
    return rows.groupBy(*KEYS).transformWithStateInPandas(ClosedCircuits(max_age, by_stream), out, "append", "eventtime")


def closed_circuit_counters(circuits: DataFrame, wanted: list[str] | None = None, bins=None) -> DataFrame:
    """closed_circuits() to the counters that exit_circuit_counters() gives, by party; for each batch of a stream."""
    label = {"label": F.col("label")}
    name = lambda lead: F.array(F.concat(F.lit(lead), F.col("label")))
    sizes = class_cells(circuits, label, [Measure("StreamHistogram", None, F.col("streams"))], bins)
    counts = class_cells(circuits.where("label <> ''"), label, [Measure("CircuitCount")], bins)
    gaps = circuits.select("party", "label", F.explode("gaps").alias("gap"))
    times = class_cells(gaps, label, [Measure("InterStreamCreationTime", None, F.col("gap"))], bins)
    return named((sizes, name("ExitCircuit")), (counts, name("Exit")), (times, name("ExitCircuit")), wanted=wanted)


def closes_within(streams: DataFrame, closes: DataFrame, within: str, lateness: str = "10 minutes", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """M12 as an interval join of two streams: streams (keys, ended, other columns) with the closes (keys, closed) of their
    circuit up to so long after; times are timestamps. Where numbers don't recur that soon, that is the one close."""
    left, right = streams.withWatermark("ended", lateness).alias("s"), closes.withWatermark("closed", lateness).alias("c")
    met: Column = F.expr(f"c.closed >= s.ended AND c.closed <= s.ended + INTERVAL {within}")
    for k in keys:
        met = met & (F.col(f"s.{k}") == F.col(f"c.{k}"))
    return left.join(right, met).select("s.*", "c.closed")

"""Circuit state, client rotation windows, and time gaps, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rotation_rows(closes: DataFrame, period: int, ts: str = "ts", created: str = "created") -> DataFrame:
    """ST2: each close counts in its window, and, without a completion, in the one before if it began there.

    closes: ip, active, ts and created in seconds.
    """
    w = F.floor(F.col(ts) / period)
    own = F.struct(w.alias("w"), F.lit(1).alias("completed"))
    earlier = F.when(F.col(created) < w * period, F.struct((w - 1).alias("w"), F.lit(0).alias("completed")))
    by = [c for c in ("party",) if c in closes.columns]
    return closes.select(*by, "ip", "active", F.explode(F.array_compact(F.array(own, earlier))).alias("r")).select(*by, "ip", "active", "r.*")


def client_windows(closes: DataFrame, period: int = 600) -> DataFrame:
    """ST2: w, ip, active and completions of each client in each window, as each party saw them where closes tell it."""
    by = [c for c in ("party",) if c in closes.columns]
    completed = lambda c: F.sum(F.when(c, F.col("completed")))
    return rotation_rows(closes, period).groupBy(*by, "w", "ip").agg(
        F.max(F.col("active").cast("int")).alias("active"),
        completed(F.col("active")).alias("active_completed"),
        completed(~F.col("active")).alias("inactive_completed"),
    )


def rotation(closes: DataFrame, period: int = 600) -> DataFrame:
    """A6, ST2: distinct clients by window, all and active, and completions. Two levels, so it is exact
    and no window's clients meet in one task."""
    done = lambda c: F.coalesce(F.sum(f"{c}_completed"), F.lit(0)).alias(f"{c}_completed")
    return client_windows(closes, period).groupBy("w").agg(
        F.count("*").alias("clients"),
        F.sum("active").alias("active_clients"),
        (F.count("*") - F.sum("active")).alias("inactive_clients"),
        done("active"),
        done("inactive"),
    )


def gaps_between(
    events: DataFrame, keys: list[str], at: Column, out: str = "gap", ties: tuple[str, ...] = ()
) -> DataFrame:
    """time since the event before of the same key, null for the first; events of one time by the ties' order."""
    own = Window.partitionBy(*keys).orderBy("_at", *ties)
    return events.withColumn("_at", at).withColumn(out, F.col("_at") - F.lag("_at").over(own)).drop("_at")


#: Bits of a sketch's table: 2 ** bits buckets, and a relative error of about 1.04 / 2 ** (bits / 2), one deviation.
SKETCH_BITS = 12


def client_sketches(closes: DataFrame, period: int = 600, bits: int = SKETCH_BITS) -> DataFrame:
    """What each party saw of clients by window (party, w, seen, active), as sketches of a few KB that can be united
    over parties, windows and rounds; no client leaves its party. closes as rotation_rows() takes them, with party."""
    rows = rotation_rows(closes, period)
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(bits))
    return rows.groupBy("party", "w").agg(sketch(F.col("ip")).alias("seen"), sketch(F.when(F.col("active"), F.col("ip"))).alias("active"))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """Sketches of each of `by`, whatever they were split by before; they can be united again."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(c, F.lit(True)).alias(c) for c in ("seen", "active")])


def estimated_clients(sketches: DataFrame, *by: str, deviations: float = 3.0, bits: int = SKETCH_BITS) -> DataFrame:
    """By, clients and active_clients as united sketches tell them, and error: how far off they may be, as a share."""
    told = lambda c: F.hll_sketch_estimate(c)
    error = deviations * 1.04 / 2 ** (bits / 2)
    return united(sketches, *by).select(*by, told("seen").alias("clients"), told("active").alias("active_clients"), F.lit(error).alias("error"))

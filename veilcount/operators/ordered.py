"""What lies before a row in one order over a whole table, without one task that holds it.

Rows are dealt to ranges of their key; a range is swept by a window, and what the ranges before it leave goes in
as one value a range. Ranges are cut at keys that a bounded sample by hash gives, so they are alike whenever they are
worked out, and hold about as many rows each where keys differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.checkpoints import is_stored, stored

#: Keys that tell where ranges are cut, and the most ranges.
SAMPLED, RANGES = 4096, 512


def cuts(rows: DataFrame, key: str, ranges: int) -> list[str]:
    """Up to ranges - 1 keys that cut the sampled keys into equal parts."""
    some = [r[0] for r in rows.select(key).orderBy(F.xxhash64(key), key).limit(SAMPLED).collect()]
    kept = sorted({k for k in some if k is not None}, key=lambda k: k.encode("utf-8", "surrogatepass"))
    return [kept[i * len(kept) // ranges] for i in range(1, ranges)] if len(kept) >= ranges else kept[1:]


def range_of(key: Column, bounds: list[str], low: int = 0) -> Column:
    """How many of the sorted bounds are at or before the key: a tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], range_of(key, bounds[:mid], low)).otherwise(range_of(key, bounds[mid + 1 :], low + mid + 1))


#: So many marks, at most, are looked up by comparisons in place.
FEW = 128


def few(rows: DataFrame) -> list | None:
    """The rows, if they are few; else none, and last_at() is the way."""
    found = rows.limit(FEW + 1).collect()
    return found if len(found) <= FEW else None


def in_order(marks: dict[str, object]) -> list[tuple[str, object]]:
    """Marks by the bytes of their keys."""
    return sorted(marks.items(), key=lambda m: m[0].encode("utf-8", "surrogatepass"))


def last_of(key: Column, marks: list[tuple[str, Column]], before: Column) -> Column:
    """The value of the last of these marks at or before the key, by a tree of comparisons; `before` where there is none."""
    if not marks:
        return before
    mid = len(marks) // 2
    at, value = marks[mid]
    return F.when(key < at, last_of(key, marks[:mid], before)).otherwise(last_of(key, marks[mid + 1 :], value))


def carried(rows: DataFrame, key: str, value: str, out: str, greatest: bool = False, ranges: int | None = None) -> DataFrame:
    """rows with `out`: the last value that isn't null of the rows before (or the greatest), null where there is none.

    Keys are texts, in the order of their bytes. Of rows with one key none is before another. Repeated keys of rows
    without values should be few: they stay in one range. rows are read for the cuts, for what each range leaves, and to
    be swept, so they should be a stored table.
    """
    spark = rows.sparkSession
    n = ranges or min(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("_range", range_of(F.col(key), cuts(rows, key, n)))
    known = dealt.where(F.col(value).isNotNull())
    each = known.groupBy("_range").agg((F.max(value) if greatest else F.max_by(value, key)).alias("_left"))
    # As many rows as ranges.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = spark.range(n).select(F.col("id").cast("int").alias("_range")).join(each, "_range", "left")
    left = every.select("_range", (F.max("_left") if greatest else F.last("_left", ignorenulls=True)).over(before).alias("_left"))
    within = Window.partitionBy("_range").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    if greatest:
        within = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = (F.max(value) if greatest else F.last(value, ignorenulls=True)).over(within)
    met = dealt.withColumn("_own", own).join(F.broadcast(left), "_range")
    found = F.greatest("_own", "_left") if greatest else F.coalesce("_own", "_left")
    return met.withColumn(out, found).drop("_range", "_own", "_left")


def last_at(points: DataFrame, marks: DataFrame, key: str, value: str, ranges: int | None = None) -> DataFrame:
    """An as-of join: points (key, distinct) with the value of the last mark (key, value; distinct keys) at or before.

    A mark's value must not be null; make it a struct to hold one.
    """
    kind = marks.schema[value].dataType
    points, marks = (df if is_stored(df) else stored(df, "ordered") for df in (points.select(key), marks.select(key, value)))
    rows = points.select(key, F.lit(None).cast(kind).alias(value), F.lit(True).alias("_point"))
    rows = rows.unionByName(marks.select(key, value, F.lit(False).alias("_point")))
    return carried(rows, key, value, "_found", ranges=ranges).where("_point").select(key, F.col("_found").alias(value))

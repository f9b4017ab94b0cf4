"""Counts and histograms: values to bins, bins to sums modulo q."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.functions.scalars import MODULUS, signed, whole

INF = float("inf")
Bins = tuple[tuple[float, float], ...]


def in_bin(value: Column, low: Column, high: Column) -> Column:
    """A2: low <= value < high, or high is infinite; NaN is in no bin, although Spark sorts it last."""
    return ~F.isnan(value) & (value >= low) & ((value < high) | (high == INF))


def bin_of(value: Column, bins: Bins) -> Column:
    """The first bin that holds the value, as a CASE: no join for a few bins. Null in a gap."""
    v, out = value.cast("double"), None
    for i, (low, high) in enumerate(bins):
        test = in_bin(v, F.lit(float(low)), F.lit(float(high)))
        out = F.when(test, i) if out is None else out.when(test, i)
    return out


def modular_sum(inc: Column, modulus: int = MODULUS) -> Column:
    """A1: sums are taken modulo q; decimal(22,0) addends leave room for 10^10 rows a group."""
    q = whole(modulus)
    return F.pmod(F.sum(inc.cast("decimal(22,0)")).cast("decimal(38,0)"), q)


def bin_join(facts: DataFrame, bins: DataFrame) -> DataFrame:
    """A1 for many counters: facts (counter, value, inc) against bins (counter, bin_idx, lo, hi).

    An equality on counter keeps this a hash join; Spark broadcasts bins where they are small.
    """
    hit = (F.col("f.counter") == F.col("b.counter")) & in_bin(F.col("f.value"), F.col("b.lo"), F.col("b.hi"))
    return facts.alias("f").join(bins.alias("b"), hit).groupBy("b.counter", "b.bin_idx").agg(modular_sum(F.col("f.inc")).alias("count"))


def list_bins(lists: int) -> Bins:
    """M8: one bin for each list, and one for what matches none."""
    return tuple((float(i), float(i + 1)) for i in range(lists)) + ((float(lists), INF),)


def bins_in_error(bins: DataFrame) -> DataFrame:
    """Bins that are empty, overlap the one before, or whose number doesn't fit the name."""
    order = Window.partitionBy("counter").orderBy("lo", "hi")
    single = F.col("counter").rlike("(Count|DelayTime)$")
    checked = bins.withColumn("n", F.count("*").over(Window.partitionBy("counter"))).withColumn("before", F.lag("hi").over(order))
    return checked.withColumn("problem", F.when(F.col("lo") >= F.col("hi"), "empty").when(F.col("before") > F.col("lo"), "overlap").when(single != (F.col("n") == 1), "bin count")).where("problem is not null").select("counter", "lo", "hi", "problem")


def tally(facts: DataFrame, modulus: int = MODULUS, strict: bool = False, parties: int | None = None) -> DataFrame:
    """A3: facts (party, counter, bin_idx, count) of collectors and keepers to signed totals.

    Each counter must come with the same bins from every party: others are left out or, where strict, end the job;
    incomplete() names them. parties: how many there are, where the caller knows; else all that the facts hold.
    """
    held = facts.groupBy("counter", "bin_idx").agg(
        modular_sum(F.col("count"), modulus).alias("count"), F.count_distinct("party").alias("held")
    )
    # A total must have every party.
    expected = facts.agg(F.count_distinct("party")).scalar() if parties is None else F.lit(parties)
    whole = F.min(F.col("held") == F.col("parties")).over(Window.partitionBy("counter"))
    checked = held.withColumn("parties", expected).withColumn("whole", whole)
    if strict:
        said = F.concat(F.lit("not tallied by every party: "), F.col("counter"))
        kept = checked.withColumn("count", F.when(F.col("whole"), F.col("count")).otherwise(F.raise_error(said)))
    else:
        kept = checked.where("whole")
    return kept.select("counter", "bin_idx", signed(F.col("count"), modulus).alias("count"))


def incomplete(facts: DataFrame) -> DataFrame:
    """Counters that a party lacks, or has with other bins."""
    held = facts.groupBy("counter", "bin_idx").agg(F.count_distinct("party").alias("held"))
    parties = facts.agg(F.count_distinct("party")).scalar()
    return held.withColumn("parties", parties).where("held < parties").select("counter").distinct()


def list_counter_bins(counters: DataFrame, lists: DataFrame) -> DataFrame:
    """M8: counter, bin_idx, lo, hi: bins of the counters that count a kind's lists, and one for what is in none.

    lists: name_part (what such counters' names hold, as "CountryMatch") and lists (how many).
    """
    of_kind = counters.where(F.endswith("counter", F.lit("CountList")))
    of_kind = of_kind.join(F.broadcast(lists), F.contains("counter", F.col("name_part")))
    places = F.explode(F.sequence(F.lit(0), F.col("lists").cast("int")))
    rows = of_kind.select("counter", "lists", places.alias("bin_idx"))
    hi = F.when(F.col("bin_idx") < F.col("lists"), F.col("bin_idx") + 1.0).otherwise(F.lit(INF))
    return rows.select("counter", "bin_idx", F.col("bin_idx").cast("double").alias("lo"), hi.alias("hi"))


def config_problems(bins: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Counter and problem: bins in error, sigmas that are null or negative, bins without sigmas."""
    noise = sigmas.where("sigma is null or isnan(sigma) or sigma < 0").select("counter", F.lit("sigma").alias("problem"))
    silent = bins.select("counter").distinct().join(sigmas, "counter", "left_anti")
    silent = silent.select("counter", F.lit("no sigma").alias("problem"))
    return bins_in_error(bins).select("counter", "problem").unionByName(noise).unionByName(silent).distinct()


def zero_count_bins(spark) -> DataFrame:
    """The counter that must tally to 0: one bin for everything, without noise."""
    rows = [("ZeroCount", 0, -INF, INF, 0.0)]
    return spark.createDataFrame(rows, "counter string, bin_idx int, lo double, hi double, sigma double")


def elementary_bins(bins: DataFrame, endings: Iterable[str]) -> dict[str, Bins]:
    """Of bins (counter, lo, hi): for each ending of names, the stretches between neighbouring ends of any such bin.

    Fan-outs that count by these can be summed to any of the bins; configuration, as large as the bins.
    """
    ends: dict[str, set[float]] = {}
    for r in bins.select("counter", "lo", "hi").distinct().collect():
        known = [e for e in endings if r["counter"].endswith(e)]
        if known:
            ends.setdefault(max(known, key=len), set()).update((r["lo"], r["hi"]))
    return {s: tuple(zip(sorted(e), sorted(e)[1:], strict=False)) for s, e in ends.items()}


def to_configured(counted: DataFrame, fine: dict[str, Bins], bins: DataFrame) -> DataFrame:
    """counted (counter, bin_idx, maybe party) by elementary bins to the counters' own bins (counter, bin_idx, lo, hi).

    Bins of lists and of one bin keep their places. Counters without bins leave. Nothing but configuration is broadcast.
    """
    spark = counted.sparkSession
    rows = [(s, i, float(lo), float(hi)) for s, b in fine.items() for i, (lo, hi) in enumerate(b)]
    small = spark.createDataFrame(rows, "ending string, fine_idx int, from double, to double")
    longest = F.max_by("ending", F.length("ending"))
    ending = bins.select("counter").distinct().join(F.broadcast(small.select("ending").distinct()), F.endswith("counter", F.col("ending")))
    own = bins.join(ending.groupBy("counter").agg(longest.alias("ending")), "counter", "left")
    inside = (F.col("from") >= F.col("lo")) & (F.col("to") <= F.col("hi"))
    cut = own.where("ending is not null").join(small, "ending").where(inside)
    places = cut.select("counter", "bin_idx", "fine_idx").unionByName(
        own.where("ending is null").select("counter", "bin_idx", F.col("bin_idx").alias("fine_idx"))
    )
    met = counted.withColumnRenamed("bin_idx", "fine_idx").join(F.broadcast(places), ["counter", "fine_idx"])
    keys = [c for c in ("party", "counter", "bin_idx") if c in met.columns]
    return met.groupBy(*keys).agg(modular_sum(F.col("count")).alias("count"))


def count_bins(bins: DataFrame) -> DataFrame:
    """A5."""
    return bins.agg(F.count("*").alias("bins"))

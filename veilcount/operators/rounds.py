"""Rules between collection rounds, and checks of prefix maps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.functions.scalars import needs_delay, signed, tolerance_floor
from veilcount.operators.binning import modular_sum, tally
from veilcount.operators.privacy import blinded, noised


def changes(before: DataFrame, proposed: DataFrame, tolerance: float | None = None) -> DataFrame:
    """ST5: counters (counter, sigma) that one side lacks, or whose noise falls by more than the tolerance.

    Counters without a sigma count as missing.
    """
    known = lambda df, name: df.where("sigma is not null").select("counter", F.col("sigma").alias(name))
    both = known(before, "before").join(known(proposed, "proposed"), "counter", "full")
    least = tolerance_floor() if tolerance is None else tolerance
    return both.where(F.coalesce(needs_delay(F.col("before"), F.col("proposed"), least), F.lit(True)))


def next_start(before: DataFrame | None, proposed: DataFrame, last_end: float | None, delay: float, round_trip: float = 0.0, always: bool = False, tolerance: float | None = None) -> float:
    """ST5: when a round with the proposed noise may start; 0 where no round has succeeded yet."""
    if last_end is None:
        return 0.0
    changed = before is not None and not changes(before, proposed, tolerance).isEmpty()
    return last_end + delay + round_trip if always or changed else last_end


def baseline(before: DataFrame | None, used: DataFrame, succeeded: bool = True, always: bool = False, tolerance: float | None = None) -> DataFrame | None:
    """ST5: what the next round is held against. The first of equivalent allocations stays, so that
    noise can't fall step by step within the tolerance. A failed round changes nothing."""
    if not succeeded:
        return before
    if before is None or always or not changes(before, used, tolerance).isEmpty():
        return used
    return before


HISTORY = "deployment string, round long, next_start double, permitted boolean, baseline long"


def history(
    rounds: DataFrame, sigmas: DataFrame, delay: float, round_trip: float = 0.0, always: bool = False, tolerance: float | None = None
) -> DataFrame:
    """ST5 over rounds in order: when each might have started, whether it did not before, and the round whose allocation
    the next one is held against (null before the first success).

    rounds: deployment, round (their order), start, end, succeeded. sigmas: deployment, round, counter, sigma; of a counter
    that recurs in a round the smallest counts, and one without a sigma is missing. The first of equivalent
    allocations stays the baseline. One pass over sorted rows: a task holds a deployment's baseline and one
    round's counters, however long the history.
    """
    least = tolerance_floor() if tolerance is None else tolerance
    known = sigmas.where("sigma is not null").groupBy("deployment", "round", "counter").agg(F.min("sigma").alias("sigma"))
    rows = rounds.select("deployment", "round", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "succeeded").join(known, ["deployment", "round"], "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: tuple | None = None  # the round whose counters are being read: deployment, round, start, end, succeeded
        own: dict[str, float] = {}
        deployment, base, base_round, last_end = None, None, None, None

        def done() -> tuple:
            nonlocal deployment, base, base_round, last_end
            if at[0] != deployment:
                deployment, base, base_round, last_end = at[0], None, None, None
            changed = base is not None and (base.keys() != own.keys() or any(s < base[c] - least for c, s in own.items()))
            wait = delay + round_trip if always or changed else 0.0
            start = 0.0 if last_end is None else last_end + wait
            if at[4]:
                last_end = at[3]
                if base is None or always or changed:
                    base, base_round = own, at[1]
            return at[0], at[1], start, bool(at[2] >= start), base_round

        for batch in batches:
            out = []
            for *key, counter, sigma in batch[["deployment", "round", "start", "end", "succeeded", "counter", "sigma"]].itertuples(index=False, name=None):
                if at is None or (key[0], key[1]) != at[:2]:
                    if at is not None:
                        out.append(done())
                    at, own = tuple(key), {}
                if counter is not None:
                    own[counter] = sigma
            yield pd.DataFrame(out, columns=["deployment", "round", "next_start", "permitted", "baseline"]).astype({"baseline": "Int64"})
        if at is not None:
            yield pd.DataFrame([done()], columns=["deployment", "round", "next_start", "permitted", "baseline"]).astype({"baseline": "Int64"})

    named = rows.withColumn("deployment", F.col("deployment").cast("string")).withColumn("round", F.col("round").cast("long"))
    return named.repartition("deployment").sortWithinPartitions("deployment", "round", "counter").mapInPandas(fold, HISTORY)


def prefix_map_problems(prefixes: DataFrame, lists: DataFrame) -> DataFrame:
    """M9: prefixes (ipver, ...) must hold both versions or none, and come with lists of systems or not at all."""
    seen = prefixes.select("ipver", F.lit(False).alias("listed")).unionByName(lists.select(F.lit(None).cast(prefixes.schema["ipver"].dataType).alias("ipver"), F.lit(True).alias("listed")))
    n = seen.agg(F.count_if(F.col("ipver") == 4).alias("v4"), F.count_if(F.col("ipver") == 6).alias("v6"), F.count_if(~F.col("listed") & ~F.coalesce(F.col("ipver").isin(4, 6), F.lit(False))).alias("other"), F.count_if("listed").alias("lists"))
    found = F.array_compact(F.array(
        F.when((F.col("v4") > 0) != (F.col("v6") > 0), "one version only"),
        F.when(F.col("other") > 0, "unknown version"),
        F.when((F.col("lists") > 0) & (F.col("v4") + F.col("v6") == 0), "lists without maps"),
        F.when((F.col("lists") == 0) & (F.col("v4") + F.col("v6") > 0), "maps without lists"),
    ))
    return n.select(F.explode(found).alias("problem"))


def round_of(at: Column, start: float, period: float, rounds: int | None = None) -> Column:
    """ST4: the collection window of a time in seconds, from 0; null before the first and after the last."""
    k = F.floor((at - F.lit(start)) / F.lit(period))
    inside = k >= 0 if rounds is None else (k >= 0) & (k < rounds)
    return F.when(inside, k)


def round_tallies(facts: DataFrame, collectors: int, keepers: int, period: float | None = None) -> DataFrame:
    """ST4: round, counter, bin_idx, count, early of rounds with at least so many parties of each kind.

    facts: round, party, is_keeper, counter, bin_idx, count, and, where a period is given, seconds (how
    long the party counted). A round that ended before its period keeps its results and is marked.
    A counter that one of the round's parties lacks, or has with another number of bins, isn't tallied.
    """
    spent = F.min("seconds") if period is not None else F.lit(None).cast("double")
    parties = facts.groupBy("round", "party").agg(F.first("is_keeper").alias("is_keeper"), spent.alias("seconds"))
    early = F.coalesce(F.min("seconds") < F.lit(period), F.lit(False)) if period is not None else F.lit(False)
    held = parties.groupBy("round").agg(F.count_if(~F.col("is_keeper")).alias("dcs"), F.count_if("is_keeper").alias("sks"), F.count("*").alias("parties"), early.alias("early")).where((F.col("dcs") >= collectors) & (F.col("sks") >= keepers))
    bins = facts.groupBy("round", "counter", "party").agg(F.count_distinct("bin_idx").alias("bins"))
    whole = bins.groupBy("round", "counter").agg(F.count("*").alias("seen"), F.min("bins").alias("least"), F.max("bins").alias("most")).where("least = most").join(held, "round").where("seen = parties").select("round", "counter", "early")
    sums = facts.groupBy("round", "counter", "bin_idx").agg(modular_sum(F.col("count")).alias("count"))
    return sums.join(whole, ["round", "counter"]).select("round", "counter", "bin_idx", signed(F.col("count")).alias("count"), "early")


def facts_of_round(counted: DataFrame, bins: DataFrame, parties: list[str]) -> DataFrame:
    """party, counter, bin_idx, count: every configured bin of every party, 0 where it counted nothing."""
    every = bins.select("counter", "bin_idx", F.explode(F.array(*[F.lit(p) for p in parties])).alias("party"))
    met = every.join(counted.select("party", "counter", "bin_idx", "count"), ["party", "counter", "bin_idx"], "left")
    return met.withColumn("count", F.coalesce("count", F.lit(0).cast("decimal(38,0)")))


def round_totals(
    counted: DataFrame,
    bins: DataFrame,
    sigmas: DataFrame,
    parties: list[str],
    keepers: list[str],
    weights: DataFrame | None = None,
    seed: int | None = None,
) -> DataFrame:
    """A round from counts by party to signed noisy totals: counter, bin_idx, lo, hi, count.

    counted: party, counter, bin_idx, count, by the bins (counter, bin_idx, lo, hi). Each party's bins get their noise
    and each keeper's shares; the total is of collectors and keepers. Parties without a weight leave the round; a
    counter that a party lacks ends it.
    """
    noisy = noised(facts_of_round(counted, bins, parties), sigmas, weights, seed)
    return tally(blinded(noisy, keepers), strict=True).join(bins.select("counter", "bin_idx", "lo", "hi"), ["counter", "bin_idx"])

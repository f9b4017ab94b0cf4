"""Hidden-Markov traffic models: counting paths, normalising tallies, re-estimation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: how far probabilities' sum may be from 1, as a part of the larger of both.
SUM_TOLERANCE = 1e-9


def path_items(events: DataFrame, path_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Paths (JSON with ';' for ',') as rows: columns to keep, pos, state, obs, delay, following. Short items are
    skipped but still stand between their neighbours. A successor is taken by its place, before the items part."""
    items = F.from_json(F.translate(path_col, ";", ","), "array<array<string>>")
    sound = lambda x: F.size(x) >= 3
    part = lambda x, i: F.when(sound(x), F.get(x, F.lit(i)))

    def item(x: Column, i: Column) -> Column:
        after = F.get("_items", i + 1)
        return F.struct(i.alias("pos"), part(x, 0).alias("state"), part(x, 1).alias("obs"), part(x, 2).cast("long").alias("delay"), part(after, 0).alias("following"))

    rows = events.select(*keep, F.explode(F.array(items)).alias("_items")).select(*keep, F.explode(F.transform("_items", item)).alias("_item"))
    return rows.select(*keep, "_item.*").where("state is not null")


def log_delay(delay: Column) -> Column:
    """Delays under 1 count as 0; halves round away from zero."""
    return F.when(delay < 1, 0).otherwise(F.round(F.log(delay.cast("double")))).cast("long")


def path_counters(events: DataFrame, path_col: str, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    """Counter, count (by more columns). Items are summed by state, observation and successor before they fan out."""
    items = path_items(events, path_col, by)
    ld = log_delay(F.col("delay"))
    cells = items.groupBy(*by, "state", "obs", "following", (F.col("pos") == 0).alias("first")).agg(F.count("*").alias("n"), F.sum(ld).alias("ld"), F.sum(ld * ld).alias("sq"), F.sum("delay").alias("d"))
    logged = F.col("obs").isin("+", "-") | ((F.col("obs") == "$") & F.contains("state", F.lit("Dwell")))
    plain = ~logged & (F.col("obs") == "$") & F.contains("state", F.lit("Active"))
    tail = F.concat_ws("_", F.lit(""), "state", "obs")
    one = lambda name, value, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.concat(F.lit(prefix), name).alias("counter"), value.alias("inc")))
    lit = F.lit
    wanted = [one(lit("EmissionCount"), F.col("n")), one(F.concat(lit("EmissionCount"), tail), F.col("n"))]
    for name, value in (("LogDelayTime", F.col("ld")), ("SquaredLogDelayTime", F.col("sq"))):
        wanted += [one(lit(name), value, logged), one(F.concat(lit(name), tail), value, logged)]
    wanted += [one(lit("DelayTime"), F.col("d"), plain), one(F.concat(lit("DelayTime"), tail), F.col("d"), plain)]
    wanted += [one(F.concat(lit("TransitionCount_START_"), "state"), F.col("n"), F.col("first"))]
    moved = F.col("following").isNotNull()
    wanted += [one(lit("TransitionCount"), F.col("n"), moved), one(F.concat(lit("TransitionCount_"), F.col("state"), lit("_"), F.col("following")), F.col("n"), moved)]
    return cells.select(*by, F.explode(F.array_compact(F.array(*wanted))).alias("r")).groupBy(*by, "r.counter").agg(F.sum("r.inc").alias("count"))


def shares(tallies: DataFrame, groups: list[str], value: str, out: str = "share") -> DataFrame:
    """Negative tallies count as 0; each divided by its group's sum, 0 over nothing."""
    clean = F.greatest(F.col(value).cast("double"), F.lit(0.0))
    whole = F.sum(clean).over(Window.partitionBy(*groups))
    return tallies.withColumn(out, F.when(whole > 0, clean / whole).otherwise(0.0))


def updated_transitions(model: DataFrame, tallies: DataFrame, inertia: float = 0.5) -> DataFrame:
    """H4: model (src, dst, p) blended with tallies (src, dst, n), then normalised by source."""
    seen = shares(model.join(tallies, ["src", "dst"], "left").na.fill({"n": 0}), ["src"], "n")
    mixed = seen.withColumn("p", inertia * F.col("p") + (1 - inertia) * F.col("share"))
    return shares(mixed.drop("share"), ["src"], "p").select("src", "dst", F.col("share").alias("p"))


def updated_emissions(model: DataFrame, tallies: DataFrame, inertia: float = 0.5) -> DataFrame:
    """H4: model (state, obs, dp, mu, sigma, lam) blended with tallies (state, obs, n, ld, sq, d).

    A delay tally of 0 keeps the rate as it was. Observations without delays stay as they are.
    """
    seen = shares(model.join(tallies, ["state", "obs"], "left").na.fill(0, ["n", "ld", "sq", "d"]), ["state"], "n")
    logged = F.col("obs").isin("+", "-") | ((F.col("obs") == "$") & F.contains("state", F.lit("Dwell")))
    plain = ~logged & (F.col("obs") == "$") & F.contains("state", F.lit("Active"))
    mu = F.when((F.col("n") > 0) & (F.col("ld") > 0), F.col("ld") / F.col("n")).otherwise(0.0)
    var = F.when((F.col("n") > 0) & (F.col("sq") > 0), F.col("sq") / F.col("n") - mu * mu).otherwise(0.0)
    sigma = F.when(var < 0.1, 0.01).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    rate = F.when((F.col("n") > 0) & (F.col("d") > 0), F.col("n") / F.col("d"))
    blend = lambda old, new: inertia * F.col(old) + (1 - inertia) * new
    lam = F.when(rate.isNull(), F.col("lam")).otherwise(1 / (inertia / F.col("lam") + (1 - inertia) / rate))
    return seen.select("state", "obs", F.when(logged | plain, blend("dp", F.col("share"))).otherwise(F.col("dp")).alias("dp"), F.when(logged, blend("mu", mu)).when(plain, 0.0).otherwise(F.col("mu")).alias("mu"), F.when(logged, blend("sigma", sigma)).when(plain, 0.0).otherwise(F.col("sigma")).alias("sigma"), F.when(plain, lam).when(logged, 0.0).otherwise(F.col("lam")).alias("lam"))


def model_errors(start: DataFrame, transitions: DataFrame) -> DataFrame:
    """H1: probabilities that don't sum to 1; states whose name holds End need no transitions."""
    s = start.agg(F.sum("p").alias("p")).select(F.lit("START").alias("src"), "p")
    t = transitions.where(~F.contains("src", F.lit("End"))).groupBy("src").agg(F.sum("p").alias("p"))
    return s.unionByName(t).where(F.abs(F.col("p") - 1) > SUM_TOLERANCE * F.greatest("p", F.lit(1.0)))


#: What is summed over a whole model.
TOTALS = ("StreamCount", "EmissionCount", "TransitionCount", "DelayTime", "LogDelayTime", "SquaredLogDelayTime")


def model_counters(spark: SparkSession, prefix: str, transitions: DataFrame, emissions: DataFrame) -> DataFrame:
    """H3: counter, template, kind and the cell (a, b) of each counter that a model needs.

    transitions (src, dst, p) hold the start as the source START; those without probability get no
    counter. emissions (state, obs). Totals have no cell and are their own template.
    """
    total = spark.createDataFrame([(t,) for t in TOTALS], "kind string").select(F.concat(F.lit(prefix), "kind").alias("counter"), F.concat(F.lit(prefix), "kind").alias("template"), "kind", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    start = F.col("src") == "START"
    named = lambda kind, *tail: F.concat_ws("_", F.concat(F.lit(prefix), kind), *tail)
    count = F.lit("TransitionCount")
    moves = transitions.where("p > 0").select(named(count, "src", "dst").alias("counter"), F.when(start, named(count, F.lit("START_<STATE>"))).otherwise(named(count, F.lit("<SRCSTATE>_<DSTSTATE>"))).alias("template"), count.alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    logged = F.col("obs").isin("+", "-") | ((F.col("obs") == "$") & F.contains("state", F.lit("Dwell")))
    plain = ~logged & (F.col("obs") == "$") & F.contains("state", F.lit("Active"))
    kinds = F.explode(F.array_compact(F.array(F.lit("EmissionCount"), F.when(logged, "LogDelayTime"), F.when(logged, "SquaredLogDelayTime"), F.when(plain, "DelayTime"))))
    seen = emissions.select("state", "obs", kinds.alias("kind")).select(named(F.col("kind"), "state", "obs").alias("counter"), named(F.col("kind"), F.lit("<STATE>_<OBS>")).alias("template"), "kind", F.col("state").alias("a"), F.col("obs").alias("b"))
    return total.unionByName(moves).unionByName(seen)


#: How the counters of each part of a model begin, and the event that they need.
MODEL_PARTS = {"packet_model": ("ExitStreamTrafficModel", "VITERBI_PACKETS"), "stream_model": ("ExitCircuitTrafficModel", "VITERBI_STREAMS")}


def registered_names(spark: SparkSession, parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Counter, template, event, is_static: the names that a model brings along, of all its parts.

    parts as sources/config.py's read_model gives them. Static names are the totals, which every model has.
    """
    out = None
    for kind, (transitions, emissions) in parts.items():
        prefix, event = MODEL_PARTS[kind]
        own = model_counters(spark, prefix, transitions, emissions).select("counter", "template", F.lit(event).alias("event"), F.col("a").isNull().alias("is_static"))
        out = own if out is None else out.unionByName(own)
    return out


def unknown_templates(counters: DataFrame, noise: DataFrame) -> DataFrame:
    """H3: templates of a noise table that no counter of the model has; noise with any isn't valid."""
    return noise.select("template").join(counters, "template", "left_anti")


def expanded(counters: DataFrame, noise: DataFrame) -> DataFrame:
    """H3: the noise of each counter whose template has one, and its single bin."""
    return counters.select("counter", "template").join(noise, "template").drop("template").withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(float("inf")))


def updated_model(counters: DataFrame, transitions: DataFrame, emissions: DataFrame, tallies: DataFrame, inertia: float = 0.5) -> tuple[DataFrame, DataFrame] | None:
    """H5: transitions and emissions after tallies (counter, bin_idx, count), of which bin 0 counts.

    None where a counter of a cell has no tally. The start comes along as the source START.
    """
    cells = counters.where("a is not null").join(tallies.where("bin_idx = 0").select("counter", F.col("count").cast("double").alias("n")), "counter", "left")
    if not cells.where("n is null").isEmpty():
        return None
    moved = cells.where("kind = 'TransitionCount'").select(F.col("a").alias("src"), F.col("b").alias("dst"), "n")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    sent = cells.where("kind <> 'TransitionCount'").groupBy(F.col("a").alias("state"), F.col("b").alias("obs")).agg(of("EmissionCount").alias("n"), of("LogDelayTime").alias("ld"), of("SquaredLogDelayTime").alias("sq"), of("DelayTime").alias("d"))
    return updated_transitions(transitions, moved, inertia), updated_emissions(emissions, sent, inertia)

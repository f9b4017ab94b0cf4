"""Relays' selection weights and their share of a hash ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def position_weight(flags: Column, position: str, w: dict[str, float]) -> Column:
    """The weight of a relay's bandwidth for g(uard), m(iddle), e(xit), i(ntro) or r(end)."""
    has = lambda f: F.array_contains(flags, f)
    lead = {"g": "Wg", "e": "We"}.get(position[0], "Wm")
    out = F.when(has("Guard") & has("Exit"), w[f"{lead}d"]).when(has("Guard"), w[f"{lead}g"])
    if position == "g":
        return out.when(~has("Exit"), w["Wgm"]).otherwise(0.0)
    out = out.when(has("Exit"), w[f"{lead}e"]).otherwise(w[f"{lead}m"])
    return F.when(has("Stable"), out).otherwise(0.0) if position == "i" else out


def position_fractions(relays: DataFrame, mine: Column, w: dict[str, float], positions: str = "gmei") -> DataFrame:
    """A10: relays (flags, bandwidth): for each position the weighted share of those that are mine."""
    weighted = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), (F.col("bandwidth") * position_weight(F.col("flags"), p, w)).alias("w")) for p in positions]))
    return relays.select(mine.alias("mine"), weighted.alias("x")).groupBy("x.position").agg(F.sum("x.w").alias("total"), F.sum(F.when(F.col("mine"), F.col("x.w")).otherwise(0.0)).alias("own")).withColumn("fraction", F.coalesce(F.try_divide("own", "total"), F.lit(0.0)))


#: The version from which relays are directories of the third kind, the versions of protocols that
#: directories and rendezvous points of that kind speak, and how far stored descriptors of two periods overlap.
LEAST_VERSION, DIRECTORY, RENDEZVOUS = (0, 3, 0, 8), 2, 2
OVERLAP = {"h2": 1 + 1 / 24, "h3": 2.0}
POSITIONS = ("g", "m", "e", "h2", "h3", "i", "r2", "r3")


def supports(protocols: Column, name: str, version: int) -> Column:
    """Whether a map of protocols to versions ('1-2,4') holds this one."""
    end = lambda part, i: F.substring_index(part, "-", i).try_cast("int")
    found = F.exists(F.split(protocols[name], ","), lambda p: F.lit(version).between(end(p, 1), end(p, -1)))
    return F.coalesce(found, F.lit(False))


def at_least(version: Column, least: tuple[int, ...]) -> Column:
    """Whether the leading numbers of a version are at least these; false without any."""
    numbers = F.transform(F.split(F.regexp_extract(version, r"^(\d+(\.\d+)*)", 1), r"\."), lambda x: x.try_cast("int"))
    return F.coalesce((numbers >= F.array(*[F.lit(n) for n in least])) & version.rlike(r"^\d"), F.lit(False))


def position_amount(position: str, w: dict[str, float]) -> Column:
    """What a relay brings to a position, 0 where it can't serve there.

    Of relays: flags, bandwidth, exits (whether its policy allows any), version, protocols, spread. Directories count
    by their part of the ring (h2) or each as one (h3), all others by weighted bandwidth.
    """
    flags = F.col("flags")
    has = lambda f: F.array_contains(flags, f)
    if position == "h2":
        serves, amount = has("HSDir"), F.col("spread")
    elif position == "h3":
        serves = has("HSDir") & at_least(F.col("version"), LEAST_VERSION) & supports(F.col("protocols"), "HSDir", DIRECTORY)
        amount = F.lit(1.0)
    else:
        amount = F.col("bandwidth") * position_weight(flags, position, w)
        serves = {
            "g": has("Guard") & has("Fast") & has("Stable"),
            "e": ~has("BadExit") & F.col("exits"),
            "r3": supports(F.col("protocols"), "HSRend", RENDEZVOUS),
        }.get(position, F.lit(True))
    return F.coalesce(F.when(serves, amount).cast("double"), F.lit(0.0))


def network_fractions(relays: DataFrame, mine: Column, w: dict[str, float]) -> DataFrame:
    """For all eight positions total, own and fraction; served_fraction adds what directories hold of the
    period before. Relays as position_amount takes them; w as shares of 1."""
    amounts = F.array(*[F.struct(F.lit(p).alias("position"), position_amount(p, w).alias("w")) for p in POSITIONS])
    held = relays.select(mine.alias("mine"), F.explode(amounts).alias("x")).groupBy("x.position")
    sums = held.agg(F.sum("x.w").alias("total"), F.sum(F.when(F.col("mine"), F.col("x.w")).otherwise(0.0)).alias("own"))
    overlap = F.when(F.col("position") == "h2", OVERLAP["h2"]).when(F.col("position") == "h3", OVERLAP["h3"])
    share = lambda own: F.coalesce(F.try_divide(own, F.col("total")), F.lit(0.0))
    return sums.withColumn("fraction", share(F.col("own"))).withColumn(
        "served_fraction", share(F.col("own") * F.coalesce(overlap, F.lit(1.0)))
    )


#: Hexadecimal digits that one exact long holds.
LIMB = 15


def ring_spread(relays: DataFrame, fingerprint: str = "fp", back: int = 3) -> DataFrame:
    """The part of the ring between each fingerprint and the one `back` places before it.

    Fingerprints are hexadecimal numbers; differences are taken limb by limb, so near neighbours keep theirs.
    Places are counted by range of the first digits: each range ranks by itself and adds what lies before it, so no
    task holds the ring. The first places wrap around by reading the last ones.
    """
    n_digits = F.length(fingerprint)
    limbs = [F.coalesce(F.conv(F.rpad(F.substring(fingerprint, 1 + LIMB * i, LIMB), LIMB, "0"), 16, 10).cast("long"), F.lit(0)) for i in range(3)]
    ring = relays.withColumn("limbs", F.when(n_digits > 0, F.array(*limbs))).withColumn("range", F.lower(F.substring(fingerprint, 1, 3)))
    sizes = ring.groupBy("range").agg(F.count("*").alias("held"))  # 4,096 rows at most
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    bases = sizes.select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.sum("held").over(everything).alias("n"))
    within = Window.partitionBy("range").orderBy(F.lower(fingerprint))
    ring = ring.withColumn("k", F.row_number().over(within)).join(F.broadcast(bases), "range").withColumn("k", F.col("k") + F.col("base"))
    behind = ring.select((F.pmod(F.col("k") - 1 + back, F.col("n")) + 1).alias("k"), F.col("limbs").alias("other"))
    met = ring.join(behind, "k")
    scale = [16.0 ** -(LIMB * (i + 1)) for i in range(3)]
    gap = sum((F.get("limbs", F.lit(i)) - F.get("other", F.lit(i))).cast("double") * scale[i] for i in (2, 1, 0))
    less = F.array_sort(F.array("limbs", "other"))
    wrapped = F.when((F.get(less, F.lit(0)) == F.col("limbs")) & (F.col("limbs") != F.col("other")), gap + 1).otherwise(gap)
    spread = F.when(F.pmod(F.lit(back), F.col("n")) == 0, 1.0).otherwise(wrapped)
    return met.withColumn("spread", spread).drop("limbs", "other", "range", "k", "base", "n")


def mean_fractions(fractions: DataFrame) -> DataFrame:
    """The mean over consensuses of each position's fraction; fractions: consensus, position, fraction."""
    return fractions.groupBy("position").agg(F.avg("fraction").alias("fraction"), F.count_distinct("consensus").alias("consensuses"))

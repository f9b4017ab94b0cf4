"""Noise, blinding, and the allocation of a privacy budget.

One Spark application sees all shares: blinding here shows that totals come out right; it isn't
the protection that several parties with separate machines give.
"""

from __future__ import annotations

import math
import random
import secrets as csprng
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.checkpoints import checkpointed
from veilcount.functions.scalars import MODULUS, unblind, whole

Counters = dict[str, tuple[float, float]]  # sensitivity, estimated value


def satisfies_dp(sensitivity: float, epsilon: float, delta: float, std: float) -> bool:
    """Whether Gaussian noise of this deviation is (epsilon, delta) private."""
    x = sensitivity / 2 - epsilon * std * std / sensitivity
    return 0.5 * math.erfc(-x / std / math.sqrt(2)) <= delta


def bisect(holds: Callable[[float], bool], low: float, high: float, tolerance: float) -> float:
    """The least argument, to the tolerance, from which holds() is true; to 12 digits at most."""
    if not holds(high):
        raise ValueError("the condition holds nowhere in the interval")
    while high - low > tolerance and f"{low:.12g}" != f"{high:.12g}":
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def private_std(sensitivity: float, epsilon: float, delta: float, tolerance: float = 1e-6) -> float:
    """The least deviation that is private."""
    most = sensitivity / epsilon * 4 / 3 * math.sqrt(2 * math.log(1 / delta))
    return bisect(lambda s: satisfies_dp(sensitivity, epsilon, delta, s), tolerance, most, tolerance)


def private_epsilon(sensitivity: float, std: float, delta: float, tolerance: float = 1e-9) -> float:
    """The least epsilon for the deviation; 0 without noise."""
    if std == 0:
        return 0.0
    most = sensitivity / std * 4 / 3 * math.sqrt(2 * math.log(1 / delta))
    return bisect(lambda e: satisfies_dp(sensitivity, e, delta, std), 0.0, max(most, tolerance), tolerance)


def sigma_of(excess: float, ratio: float, value: float) -> float:
    """N6."""
    return ratio * value / math.sqrt(excess) if excess else 0.0


def noise_ratio(excess: float, sigma: float, value: float) -> float:
    """The inverse of sigma_of."""
    return math.sqrt(excess) * sigma / value if value else 0.0


def approximate_allocation(epsilon: float, delta: float, counters: Counters) -> dict[str, tuple[float, float]]:
    """(epsilon, sigma) by counter, epsilon in proportion to sensitivity / value. Dummies get (1, 0)."""
    share = {k: s / v for k, (s, v) in counters.items() if v}
    total = sum(share.values())
    each = {k: epsilon * share[k] / total if k in share else 1.0 for k in counters}
    return {k: (each[k], private_std(s, each[k], delta / len(counters)) if s else 0.0) for k, (s, _) in counters.items()}


def optimal_allocation(epsilon: float, delta: float, excess: float, counters: Counters, tolerance: float = 1e-6) -> tuple[dict[str, tuple[float, float]], float]:
    """One noise ratio for all counters, as small as the budget allows; and that ratio."""
    sigmas = approximate_allocation(epsilon, delta, counters)
    ratios = [noise_ratio(excess, sigmas[k][1], v) for k, (_, v) in counters.items()]

    def spent(ratio: float) -> dict[str, float]:
        return {k: private_epsilon(s, sigma_of(excess, ratio, v), delta / len(counters)) if s else 0.0 for k, (s, v) in counters.items()}

    ratio = bisect(lambda r: sum(spent(r).values()) <= epsilon, min(ratios), max(ratios) * (1 + tolerance), tolerance)
    used = spent(ratio)
    return {k: (used[k], sigma_of(excess, ratio, v)) for k, (_, v) in counters.items()}, ratio


def allocate(counters: DataFrame, epsilon: float, delta: float, excess: float, sample_rate: float = 1.0, sampled_prefix: str = "^$") -> DataFrame:
    """Counters (counter, sensitivity, estimated_value) with sigma, epsilon and expected_noise_ratio.

    Counters are configuration: hundreds of names, not data. Estimates of sampled counters are scaled
    for the allocation, not for the ratio. ZeroCount, which must tally to 0, is added (C2).
    """
    import re

    given = {r["counter"]: (float(r["sensitivity"]), float(r["estimated_value"])) for r in counters.select("counter", "sensitivity", "estimated_value").collect()}
    scaled = {k: (s, v * sample_rate if re.search(sampled_prefix, k) else v) for k, (s, v) in given.items()}
    found, _ = optimal_allocation(epsilon, delta, excess, scaled)
    rows = [(k, *given[k], found[k][1], found[k][0], noise_ratio(excess, found[k][1], given[k][1])) for k in given] + [("ZeroCount", 0.0, 0.0, 0.0, 1.0, 0.0)]
    return counters.sparkSession.createDataFrame(rows, "counter string, sensitivity double, estimated_value double, sigma double, epsilon double, expected_noise_ratio double")


def noised(
    facts: DataFrame, sigmas: DataFrame, weights: DataFrame | None = None, seed: int | None = None
) -> DataFrame:
    """Rounded Gaussian noise on facts (party, counter, bin_idx, count), by sigma and party weight.

    Noise comes from the system's generator and is written once (a checkpoint): drawn again, it would be other
    noise. With a seed (tests only) it comes from randn. The weight of party '*' stands for parties without their
    own; parties with neither leave the round. B3: counters without a sigma leave, so no count goes without noise.
    """
    q = whole(MODULUS)
    gauss = lambda s: s.map(lambda x: random.SystemRandom().gauss(0.0, x) if x else 0.0)
    draw = F.pandas_udf(gauss, "double").asNondeterministic()
    out = facts.join(sigmas.where("sigma is not null").select("counter", "sigma"), "counter")
    out = out.withColumn("_weight", F.lit(1.0))
    if weights is not None:
        found = [r["weight"] for r in weights.where("party = '*'").select("weight").take(2)]
        if len(found) > 1:
            raise ValueError("two default weights")
        named = weights.where("party <> '*'").select("party", F.col("weight").alias("_own"))
        weight = F.coalesce("_own", F.lit(found[0] if found else None).cast("double"))
        out = out.join(named, "party", "left").withColumn("_weight", weight).where("_weight is not null")
    sigma = F.col("sigma") * F.col("_weight")
    checkpointed(facts.sparkSession)
    noise = sigma * F.randn(seed) if seed is not None else draw(sigma)
    noisy = F.pmod(F.col("count") + F.round(noise).cast("decimal(22,0)"), q)
    return out.withColumn("count", noisy).select("party", "counter", "bin_idx", "count").checkpoint()


def weight_total(weights: DataFrame, parties: int) -> float:
    """The sum of the weights, with the default for the parties beyond one that a threshold asks for."""
    r = weights.agg(
        F.sum(F.when(F.col("party") != "*", F.col("weight"))).alias("named"),
        F.max(F.when(F.col("party") == "*", F.col("weight"))).alias("default"),
    ).first()
    named, default = r["named"] or 0.0, r["default"]
    return named + (parties - 1) * default if default is not None else named


def blinded(facts: DataFrame, keepers: list[str]) -> DataFrame:
    """B1, B2: facts of collectors plus those of keepers; each keeper adds what cancels its shares.

    Shares are written once (a checkpoint): drawn again, they wouldn't cancel.
    """
    draw = F.pandas_udf(lambda s: s.map(lambda _: str(csprng.randbelow(MODULUS))), "string").asNondeterministic()
    q = whole(MODULUS)
    shares = facts
    for i, _ in enumerate(keepers):
        shares = shares.withColumn(f"_share{i}", draw(F.col("counter")).cast("decimal(38,0)"))
    checkpointed(facts.sparkSession)
    shares = shares.checkpoint()
    total = sum((F.col(f"_share{i}") for i in range(len(keepers))), F.col("count").cast("decimal(38,0)"))
    out = shares.select("party", "counter", "bin_idx", F.pmod(total, q).alias("count"))
    for i, keeper in enumerate(keepers):
        own = shares.groupBy("counter", "bin_idx").agg(F.pmod(F.sum(unblind(F.col(f"_share{i}")).cast("decimal(22,0)")).cast("decimal(38,0)"), q).alias("count"))
        out = out.unionByName(own.select(F.lit(keeper).alias("party"), "counter", "bin_idx", "count"))
    return out

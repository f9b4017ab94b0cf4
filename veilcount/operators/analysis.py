"""Published totals: errors, confidence bounds, reliability, totals over experiments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 10**18


def confidence(deviations: float) -> float:
    """The share of results within so many deviations."""
    return math.erf(deviations / math.sqrt(2))


def bounded(v: Column, at_zero: bool) -> Column:
    """R2."""
    low = F.least(v, F.lit(float(MOST)))
    return F.greatest(low, F.lit(0.0)) if at_zero else low


def with_errors(results: DataFrame, deviations: float = 2.0, at_zero: bool = True) -> DataFrame:
    """Results (value, sigma, excess): error, bounds and reliability; no noise, no error."""
    variance = F.col("excess") * F.col("sigma") * F.col("sigma")
    out = results.withColumn("error", F.coalesce(F.round(deviations * F.sqrt(variance)), F.lit(0.0)))
    v, e = F.col("value").cast("double"), F.col("error")
    out = out.withColumn("bound_value", bounded(v, at_zero)).withColumn("error_low", bounded(v - e, at_zero)).withColumn("error_high", bounded(v + e, at_zero))
    out = out.withColumn("proportion", F.when(v != 0, e / F.abs(v)).otherwise(F.when(e > 0, float("inf")).otherwise(0.0)))
    return out.withColumn("is_noisy", F.col("proportion") >= 1).withColumn("is_possibly_zero", v - e <= 0).withColumn("is_bounded", v != F.col("bound_value"))


def shown(results: DataFrame, ignore_noisy: bool = True, ignore_zero: bool = False, keys: tuple[str, ...] = ("counter", "bin_idx")) -> DataFrame:
    """A bin stays if any experiment shows it."""
    ignored = (F.col("is_noisy") & F.lit(ignore_noisy)) | (F.col("is_possibly_zero") & F.lit(ignore_zero))
    return results.withColumn("_out", F.min(ignored.cast("int")).over(Window.partitionBy(*keys))).where("_out = 0").drop("_out")


def totals(results: DataFrame) -> DataFrame:
    """Sums over experiments by counter and bin; an unknown addend makes the sum unknown."""
    known = lambda c: F.when(F.count("*") == F.count(c), F.sum(c))
    variance = results.withColumn("variance", F.col("excess") * F.col("sigma") * F.col("sigma"))
    return variance.groupBy("counter", "bin_idx").agg(F.sum("value").alias("value"), known("variance").alias("variance"), known("excess").alias("excess"))


def plotted(results: DataFrame, labels: list[str]) -> DataFrame:
    """K3: counter, bin_idx and, for each labelled experiment, its value and the errors below and above it.

    results as shown() gives them; the labels are the experiments, so that the pivot needs no pass of its own.
    """
    return results.groupBy("counter", "bin_idx").pivot("experiment", labels).agg(F.first("bound_value").alias("value"), (F.first("bound_value") - F.first("error_low")).alias("below"), (F.first("error_high") - F.first("bound_value")).alias("above"))


def draw(results: DataFrame, labels: list[str], path: str) -> None:
    """K3: a page of bars for each counter; needs matplotlib."""
    from matplotlib import pyplot
    from matplotlib.backends.backend_pdf import PdfPages

    table = plotted(results, labels).toPandas()
    with PdfPages(path) as pages:
        for counter, bins in table.sort_values(["counter", "bin_idx"]).groupby("counter"):
            figure, axis = pyplot.subplots()
            for i, label in enumerate(labels):
                at = [k + 0.8 * i / len(labels) for k in range(len(bins))]
                axis.bar(at, bins[f"{label}_value"], 0.8 / len(labels), yerr=[bins[f"{label}_below"], bins[f"{label}_above"]], label=label)
            axis.set_title(counter)
            axis.legend()
            pages.savefig(figure)
            pyplot.close(figure)

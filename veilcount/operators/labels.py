"""Labels of bins, links between experiments of one counter, and results as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilcount.operators.analysis import confidence

INF = float("inf")
#: The longest label of a graph, what marks one that was cut, and the label of the last bin.
LONGEST, CUT, UNMATCHED = 15, "...", "(unmatched)"


def list_kind(counter: Column) -> Column:
    """The kind of match list whose parts a counter's bins are; null where bins are ranges.

    A name that several kinds fit belongs to the most special one.
    """
    held = lambda part: F.contains(counter, F.lit(part))
    ends = lambda part: F.endswith(counter, F.lit(part))
    directory = F.startswith(counter, F.lit("HSDir"))
    kind = (
        F.when(directory & (held("Store") | held("Fetch")) & ends("OnionAddressCountList"), "onion_address")
        .when(ends("FailureCircuitReasonCountList"), "circuit_failure")
        .when(directory & held("Fetch") & ends("ReasonCountList"), "hsdir_fetch")
        .when(directory & held("Store") & ends("ReasonCountList"), "hsdir_store")
        .when(held("ASMatch"), "as")
        .when(held("CountryMatch"), "country")
        .when(F.startswith(counter, F.lit("ExitDomain")), "domain")
    )
    return F.when(ends("CountList"), kind)


def short_label(label: Column) -> Column:
    """A summary of one item as that item, and a path as its file's name without the ending."""
    quoted = F.regexp_replace(F.left(label, F.length(label) - 4), "^'+|'+$", "")
    item = F.when(F.endswith(label, F.lit(" (1)")), quoted).otherwise(label)
    name = F.regexp_extract(F.substring_index(item, "/", -1), r"(?s)^(.*)\.", 1)
    return F.when(F.startswith(item, F.lit("/")), name).otherwise(item)


def fixed(x: Column) -> Column:
    """A number with one place, ties to even; infinite ones as inf."""
    return F.when(x == INF, "inf").when(x == -INF, "-inf").otherwise(F.format_string("%.1f", F.bround(x, 1)))


def between(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), low, F.lit(","), high, F.lit(")"))


def range_label(low: Column, high: Column) -> Column:
    return between(fixed(low), fixed(high))


def graph_range(counter: Column, low: Column, high: Column) -> Column:
    """Whole ends but for ratios, and infinity as graphs typeset it."""
    end = lambda x: F.when(F.endswith(counter, F.lit("Ratio")), x.cast("string")).otherwise(
        x.cast("long").cast("string")
    )
    return between(
        F.when(low == -INF, r"$-\infty$").otherwise(end(low)), F.when(high == INF, r"$\infty$").otherwise(end(high))
    )


def read_labels(spark: SparkSession, path: str, kind: str = "custom") -> DataFrame:
    """Kind, position and label of a file with one label a line; it has as many lines as a counter has bins."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("value"))
    lines = whole.select(F.posexplode(F.split("value", "\n")).alias("position", "label"))
    return lines.select(F.lit(kind).alias("kind"), "position", F.trim("label").alias("label"))


def bin_labels(bins: DataFrame, lists: DataFrame, kind: Column | None = None) -> DataFrame:
    """Bins (counter, bin_idx, lo, hi) with range_label, label and graph_label.

    lists: kind, position (from 0) and label of each list, of files or of contents. Bins of counters with a list have
    its labels; where it has one less than the counter has bins, the last is '(unmatched)', and any other number
    fails the job. kind: F.lit('custom') labels all counters by one list.
    """
    own = list_kind(F.col("counter")) if kind is None else kind
    n_labels = lists.groupBy("kind").agg(F.count("*").alias("_labels"))
    named = lists.select("kind", F.col("position").alias("bin_idx"), short_label(F.col("label")).alias("_label"))
    met = (
        bins.withColumn("_bins", F.count("*").over(Window.partitionBy("counter")))
        .withColumn("kind", own)
        .join(n_labels, "kind", "left")
        .join(named, ["kind", "bin_idx"], "left")
    )
    ranged = range_label(F.col("lo"), F.col("hi"))
    wrong = F.raise_error(F.concat("counter", F.lit(" has another number of bins than of labels"))).cast("string")
    fits = F.col("_labels").isin(F.col("_bins"), F.col("_bins") - 1)
    listed = F.when(F.col("_labels").isNotNull(), F.when(fits, F.coalesce("_label", F.lit(UNMATCHED))).otherwise(wrong))
    short = F.when(F.length(listed) > LONGEST, F.concat(F.left(listed, F.lit(LONGEST - len(CUT))), F.lit(CUT)))
    graph = F.coalesce(short, listed, graph_range(F.col("counter"), F.col("lo"), F.col("hi")))
    out = [ranged.alias("range_label"), F.coalesce(listed, ranged).alias("label"), graph.alias("graph_label")]
    return met.select(*bins.columns, *out)


def linked(results: DataFrame) -> DataFrame:
    """Each counter with the experiments that have it, in order. Results hold one row a bin and experiment."""
    return results.groupBy("counter").agg(F.array_sort(F.collect_set("experiment")).alias("experiments"))


def sigma_label(deviations: float) -> str:
    """R3: ' (2.0 sigma = 95.4% CI)', with one place more than tells the share from 1."""
    share = confidence(deviations)
    places = next((d for d in range(9) if round(share, d) != 1.0), 8)
    return f" ({deviations} sigma = {100 * round(share, places + 1):.12g}% CI)"


def text_lines(results: DataFrame, at_zero: bool = True) -> DataFrame:
    """K2: experiment, counter, bin_idx and line; results as with_errors gives them, with lo and hi.

    A label, where there is such a column, is shown unless it is the range.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)").cast("string")
    has_error = F.coalesce((F.col("sigma") > 0) & (F.col("excess") > 0), F.lit(False))
    width = F.when(has_error, F.length(whole("error")) + 3).otherwise(14)
    padded = lambda text, n: F.concat(F.repeat(F.lit(" "), F.greatest(n - F.length(text), F.lit(0))), text)
    shown = lambda c: padded(whole(c), width)
    end = lambda c: padded(fixed(F.col(c)), F.lit(8))
    percent = padded(fixed(F.col("proportion") * 100), F.lit(7))
    error = F.when(has_error, F.concat(F.lit(" +- "), whole("error"), F.lit(" ("), percent, F.lit("%)"))).otherwise("")
    status = F.concat(
        F.when(F.col("is_noisy"), "obscured").otherwise(" visible"),
        F.lit(", "),
        F.when(F.col("is_possibly_zero"), "    zero").otherwise("positive"),
    )
    moved = F.array_compact(
        F.array(
            F.when(F.col("is_bounded"), "value"),
            F.when(has_error & (F.col("bound_value") - F.col("error_low") != F.col("error")), "error low"),
            F.when(has_error & (F.col("error_high") - F.col("bound_value") != F.col("error")), "error high"),
        )
    )
    bounds = F.concat(F.lit(" ["), shown("error_low"), F.lit(", "), shown("error_high"), F.lit("]"))
    what = F.when(F.size(moved) > 0, F.array_join(moved, ", ")).otherwise("no change")
    bound = F.concat(
        F.lit(" bound: "), shown("bound_value"), F.when(has_error, bounds).otherwise(""), F.lit(" ("), what, F.lit(")")
    )
    label = F.lit("")
    if "label" in results.columns:
        other = F.col("label") != range_label(F.col("lo"), F.col("hi"))
        label = F.when(other, F.concat(F.lit(" '"), "label", F.lit("'"))).otherwise("")
    line = F.concat(
        F.col("counter"), F.lit(" ["), end("lo"), F.lit(","), end("hi"), F.lit(")"), label, F.lit(" = "), shown("value"),
        error, F.lit(" ("), status, F.lit(")"), F.when(F.lit(at_zero) | (F.size(moved) > 0), bound).otherwise(""),
    )
    return results.select("experiment", "counter", "bin_idx", line.alias("line"))


def write_text(results: DataFrame, path: str, deviations: float = 2.0, at_zero: bool = True) -> None:
    """K2: the lines of all experiments, each under its heading, as text files in order of their names."""
    lines = text_lines(results, at_zero)
    noisy = F.max(F.coalesce((F.col("sigma") > 0) & (F.col("excess") > 0), F.lit(False)))
    named = F.concat(F.lit("Experiment Label: "), "experiment", F.when(noisy, sigma_label(deviations)).otherwise(""))
    none = F.lit(None)
    heads = results.groupBy("experiment").agg(
        none.cast("string").alias("counter"), none.cast("int").alias("bin_idx"), named.alias("line")
    )
    ordered = lines.unionByName(heads).orderBy("experiment", "counter", "bin_idx")
    ordered.select(F.col("line").alias("value")).write.text(path)

"""Network consensus documents: relays with their flags and bandwidths, and the position weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """A document, or all of a pattern such as folder/*consensus, split at the separator."""
    return spark.read.option("lineSep", separator).text(path).select(F.col("_metadata.file_path").alias("document"), "value")


def _line(keyword: str) -> Column:
    """The rest of the record's line that starts with the keyword, after the first line; empty without one."""
    return F.regexp_extract("value", rf"\n{keyword} ([^\n]*)", 1)


def read_relays(spark: SparkSession, path: str) -> DataFrame:
    """Document, nickname, fp (upper-case hex), address, flags, bandwidth, exits (whether its policy allows any
    port), version and protocols (name to versions); one row a relay and document.

    Spark's reader splits the documents at their router lines, so no document is one row. A document's
    preamble isn't a relay. Flags are empty and the bandwidth is null where a relay has none.
    """
    router = F.split(F.substring_index("value", "\n", 1), " ")
    part = lambda i: F.get(router, F.lit(i))
    padded = F.concat(part(1), F.lit("="))
    relays = _records(spark, path, "\nr ").where(part(1).rlike("^[A-Za-z0-9+/]{27}$") & (F.size(router) >= 8))
    flags = F.filter(F.split(_line("s"), " "), lambda x: x != "")
    bandwidth = F.regexp_extract(_line("w"), r"(?:^| )Bandwidth=(\d+)", 1).try_cast("long")
    policy = _line("p")
    exits = F.when(policy != "", ~policy.rlike(r"^reject 1-65535\s*$"))
    version = F.regexp_extract(_line("v"), r"^Tor (\S+)", 1)
    spoken = F.filter(F.split(_line("pr"), " "), lambda x: F.contains(x, F.lit("=")))
    named = F.transform(spoken, lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1)))
    # a name that a line holds twice counts once
    protocols = F.map_from_entries(F.filter(named, lambda x, i: ~F.exists(F.slice(named, 1, i), lambda y: y["col1"] == x["col1"])))
    return relays.select(
        "document",
        part(0).alias("nickname"),
        F.hex(F.unbase64(padded)).alias("fp"),
        part(5).alias("address"),
        flags.alias("flags"),
        bandwidth.alias("bandwidth"),
        exits.alias("exits"),
        F.when(version != "", version).alias("version"),
        protocols.alias("protocols"),
    )


def read_weights(spark: SparkSession, path: str, scale: float = 10_000.0) -> DataFrame:
    """Document, weights (name to share) of the footer; documents without weights have no row."""
    pairs = F.transform(F.filter(F.split("value", " "), lambda x: x.rlike(r"^\w+=-?\d+$")), lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1).cast("double") / scale))
    return _records(spark, path, "\n").where(F.startswith("value", F.lit("bandwidth-weights "))).select("document", F.map_from_entries(pairs).alias("weights"))

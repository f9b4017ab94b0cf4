"""Queries of a whole collection round, and of the checks around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilcount.operators import binning, fanout, matching, rounds
from veilcount.plans.registry import query, table
from veilcount.plans.samples import s_bin
from veilcount.sources import events as ev

INF = float("inf")
#: Counters of a round with their own bins; two histograms of one kind are cut at other places.
ROUND_BINS = {
    "EntryConnectionCount": ((-INF, INF),),
    "EntryConnectionByteHistogram": ((0.0, 1000.0), (1000.0, 5000.0), (5000.0, INF)),
    "NonEntryConnectionByteHistogram": ((0.0, 2000.0), (2000.0, 2500.0), (3000.0, INF)),
    "EntryConnectionLifeTime": ((0.0, 100.0), (100.0, INF)),
    "NonEntryConnectionCountryMatchCountList": ((0.0, 1.0), (1.0, 2.0), (2.0, INF)),
    "ZeroCount": ((-INF, INF),),
}
PARTIES, KEEPERS = [f"dc{i}" for i in range(4)], ["sk1", "sk2"]


def round_bins(spark):
    rows = [(c, i, lo, hi) for c, bins in ROUND_BINS.items() for i, (lo, hi) in enumerate(bins)]
    return spark.createDataFrame(rows, "counter string, bin_idx int, lo double, hi double")


def connection_lines(spark, sf_dir):
    """orders as logged lines of closed connections, by who saw them: some with a field out of bounds, some malformed."""
    k, mod = F.col("o_orderkey"), lambda n: F.pmod("o_orderkey", F.lit(n))
    fields = {
        "EventTimestamp": F.format_string("%d.5", 1000 + mod(5000)),
        "CreatedTimestamp": F.lit("1000.5"),
        "ChannelId": k,
        "RemoteIsClientFlag": mod(2),
        "RemoteIPAddress": F.concat(F.lit("192.0.2."), mod(250)),
        "RemoteIPAddressConnectionCount": mod(9),
        "PeerIPAddressConsensusRelayCount": F.when(mod(11) == 0, 500).otherwise(mod(3)),
        "InboundByteCount": F.col("o_custkey"),
        "OutboundByteCount": mod(5000),
        "InboundCircuitCount": mod(4),
        "OutboundCircuitCount": mod(3),
    }
    shown = [F.concat(F.lit(f"{n}="), v) for n, v in fields.items()]
    country = F.when(mod(3) == 0, "RemoteCountryCode=AA").when(mod(3) == 2, "RemoteCountryCode=bb")
    twice = F.when(mod(13) == 0, "ChannelId=1")
    line = F.concat_ws(" ", F.lit("650 COUNTED_CONNECTION_CLOSE"), *shown, country, twice)
    party = F.concat(F.lit("dc"), F.pmod("o_custkey", F.lit(4)))
    return table(spark, sf_dir, "orders").select(party.alias("party"), line.alias("value"))


def connections_of(events):
    """Valid events of closed connections as connection_counters takes them, but for the lists."""
    number = lambda n, kind="int": ev.typed(F.col("tags"), n, kind, 0)
    size = lambda n: number(n).cast("long")
    return events.where("valid and code = 'CONNECTION_CLOSE'").select(
        *[c for c in ("party",) if c in events.columns],
        ev.typed(F.col("tags"), "RemoteIsClientFlag", "flag").alias("is_client"),
        size("PeerIPAddressConsensusRelayCount").alias("relays"),
        size("InboundByteCount").alias("in_bytes"),
        size("OutboundByteCount").alias("out_bytes"),
        size("InboundCircuitCount").alias("in_circuits"),
        size("OutboundCircuitCount").alias("out_circuits"),
        size("RemoteIPAddressConnectionCount").alias("overlap"),
        (number("EventTimestamp", "float") - number("CreatedTimestamp", "float")).alias("lifetime"),
        ev.typed(F.col("tags"), "RemoteCountryCode", "string", "!!").alias("country"),
    )


def counted_round(spark, sf_dir):
    """Counts by party and configured bin."""
    lines = ev.enabled(ev.fields_of(connection_lines(spark, sf_dir), "COUNTED_"), ["CONNECTION_CLOSE"])
    events = ev.accepted(lines, {"CONNECTION_CLOSE": ev.CONNECTION_CLOSE})
    lists = spark.createDataFrame([(0, "aa"), (1, "BB")], "list_idx int, item string")
    known = matching.exact_match(connections_of(events), lists, "country", "country_list").withColumn("as_list", F.lit(INF))
    fine = binning.elementary_bins(round_bins(spark), fanout.DEFAULT_BINS)
    counted = fanout.connection_counters(known, list(ROUND_BINS), fine, 2)
    return binning.to_configured(counted, fine, round_bins(spark))


def s_round(counter: str, where: str, value: str | None) -> str:
    bin_idx = "0" if value is None else s_bin(value, ROUND_BINS[counter])
    return f"SELECT '{counter}' AS counter, CAST({bin_idx} AS INTEGER) AS bin_idx FROM e WHERE {where}"


S_ROUND = " UNION ALL ".join(
    [
        s_round("EntryConnectionCount", "k % 2 = 1", None),
        s_round("EntryConnectionByteHistogram", "k % 2 = 1", "bytes"),
        s_round("NonEntryConnectionByteHistogram", "k % 2 = 0", "bytes"),
        s_round("EntryConnectionLifeTime", "k % 2 = 1", "life"),
        s_round("NonEntryConnectionCountryMatchCountList", "k % 2 = 0", "[0, 2, 1][k % 3 + 1]"),
    ]
)
S_CONFIG = ", ".join(f"('{c}', {i}, CAST('{lo}' AS DOUBLE), CAST('{hi}' AS DOUBLE))" for c, b in ROUND_BINS.items() for i, (lo, hi) in enumerate(b))


@query(
    f"""WITH e AS (SELECT o_orderkey AS k, o_custkey + o_orderkey % 5000 AS bytes, o_orderkey % 5000 AS life FROM orders
 WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0), f AS ({S_ROUND}),
 n AS (SELECT counter, bin_idx, count(*) AS n FROM f WHERE bin_idx IS NOT NULL GROUP BY 1, 2),
 b AS (SELECT * FROM (VALUES {S_CONFIG}) AS t(counter, bin_idx, lo, hi))
 SELECT counter, bin_idx, CAST(coalesce(n, 0) AS DECIMAL(38,0)) AS count, lo, hi FROM b LEFT JOIN n USING (counter, bin_idx)"""
)
def round_totals(spark, sf_dir):
    """Lines to totals, over 4 collectors and 2 keepers; sigmas of 0, so that SQL can tell what comes out."""
    bins = round_bins(spark)
    sigmas = bins.select("counter", F.lit(0.0).alias("sigma")).distinct()
    return rounds.round_totals(counted_round(spark, sf_dir), bins, sigmas, PARTIES, KEEPERS)


@query(
    """WITH l AS (SELECT p_partkey % 3 AS list_idx, lower(p_brand) AS item FROM part),
 f AS (SELECT item, min(list_idx) AS first FROM l GROUP BY 1)
 SELECT DISTINCT list_idx, item FROM l JOIN f USING (item) WHERE first <> list_idx"""
)
def m7_list_problems(spark, sf_dir):
    lists = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(3)).alias("list_idx"), F.col("p_brand").alias("item"))
    return matching.list_problems(lists)


@query(
    """WITH c AS (SELECT p_brand || CASE p_size % 2 WHEN 0 THEN 'CountryMatchCountList' ELSE 'ASMatchCountList' END AS counter,
 CASE p_size % 2 WHEN 0 THEN 3 ELSE 2 END AS n FROM part), d AS (SELECT DISTINCT * FROM c),
 b AS (SELECT counter, n, unnest(range(n + 1)) AS i FROM d)
 SELECT counter, CAST(i AS INTEGER) AS bin_idx, CAST(i AS DOUBLE) AS lo, CASE WHEN i < n THEN i + 1.0 ELSE CAST('inf' AS DOUBLE) END AS hi FROM b"""
)
def m8_list_bins(spark, sf_dir):
    tail = F.when(F.col("p_size") % 2 == 0, "CountryMatchCountList").otherwise("ASMatchCountList")
    counters = table(spark, sf_dir, "part").select(F.concat("p_brand", tail).alias("counter")).distinct()
    lists = spark.createDataFrame([("CountryMatch", 3), ("ASMatch", 2)], "name_part string, lists int")
    return binning.list_counter_bins(counters, lists)

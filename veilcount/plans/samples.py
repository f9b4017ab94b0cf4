"""The driver's tables as events, and the SQL that makes the same of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.operators import fanout
from veilcount.plans.registry import table

BYTES, RATIOS, TIMES, COUNTS = fanout.BYTE_BINS, fanout.RATIO_BINS, fanout.TIME_BINS, fanout.COUNT_BINS


def streams(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """lineitem as ended streams, with more of its columns."""
    li = table(spark, sf_dir, "lineitem")
    host = F.when(F.col("l_returnflag") == "A", "IPv4Literal").when(F.col("l_returnflag") == "N", "IPv6Literal").otherwise("Hostname")
    return li.select(*more, "l_orderkey", "l_linenumber", F.pmod("l_partkey", F.lit(7000)).cast("int").alias("port"), F.when(F.col("l_linestatus") == "O", "4").otherwise("6").alias("ip_version"), host.alias("host_class"), F.col("l_linenumber").cast("int").alias("stream_number"), F.col("l_quantity").cast("long").alias("read_bytes"), F.floor("l_extendedprice").cast("long").alias("write_bytes"), (F.pmod("l_suppkey", F.lit(977)) * 120.0).alias("lifetime"))


S_STREAMS = """streams AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 7000 AS INTEGER) AS port, CASE l_linestatus WHEN 'O' THEN '4' ELSE '6' END AS ip_version,
  CASE l_returnflag WHEN 'A' THEN 'IPv4Literal' WHEN 'N' THEN 'IPv6Literal' ELSE 'Hostname' END AS host_class, l_linenumber AS stream_number,
  CAST(trunc(l_quantity) AS BIGINT) AS read_bytes, CAST(floor(l_extendedprice) AS BIGINT) AS write_bytes, (l_suppkey % 977) * 120.0 AS lifetime FROM lineitem)"""
S_PORT = """CASE WHEN port IN (80, 443) THEN 'Web' WHEN port IN (22, 194, 994, 6679, 6697, 7000) OR port BETWEEN 6660 AND 6670 THEN 'Interactive'
  WHEN port IN (1214, 6699, 45682, 51413) OR port BETWEEN 4661 AND 4666 OR port BETWEEN 6346 AND 6429 OR port BETWEEN 6881 AND 6999 THEN 'P2P' ELSE 'OtherPort' END"""
S_RATIO = "CASE WHEN {i} = 0 AND {o} = 0 THEN 0.0 WHEN {i} = 0 THEN 1024.0 WHEN {o} = 0 THEN -1021.0 ELSE log2(CAST({o} AS DOUBLE) / {i}) END"




def s_bin(v: str, bins) -> str:
    show = lambda x: f"CAST('{x}' AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN {v} >= {show(lo)} AND {v} < {show(hi)} THEN {i}" if hi != float("inf") else f"WHEN {v} >= {show(lo)} THEN {i}" for i, (lo, hi) in enumerate(bins)) + " END"


def circuits(spark, sf_dir):
    """orders as closed circuits."""
    o = table(spark, sf_dir, "orders")
    position = F.element_at(F.array(*[F.lit(p) for p in ("Entry", "Mid", "End", "Exit", "HSDir2", "Intro3", "Rend2")]), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    return o.select("o_orderkey", F.regexp_replace(position, r"\d", "").alias("position"), F.when(F.pmod("o_orderkey", F.lit(7)) > 3, F.when(F.pmod("o_custkey", F.lit(3)) == 0, "Client").when(F.pmod("o_custkey", F.lit(3)) == 1, "Service")).alias("role"), (F.col("o_orderstatus") == "F").alias("failed"), F.pmod("o_orderkey", F.lit(13)).cast("long").alias("inbound_cells"), F.pmod(F.floor("o_totalprice"), F.lit(5000)).cast("long").alias("outbound_cells"), (F.pmod("o_custkey", F.lit(997)) * 100.0).alias("lifetime"), F.substring("o_orderpriority", 1, 1).cast("int").alias("reason_list"))


S_CIRCUITS = """circuits AS (SELECT o_orderkey, ['Entry', 'Mid', 'End', 'Exit', 'HSDir', 'Intro', 'Rend'][o_orderkey % 7 + 1] AS position, CASE WHEN o_orderkey % 7 > 3 THEN CASE o_custkey % 3 WHEN 0 THEN 'Client' WHEN 1 THEN 'Service' END END AS role, o_orderstatus = 'F' AS failed,
 o_orderkey % 13 AS inbound_cells, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS outbound_cells, (o_custkey % 997) * 100.0 AS lifetime, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS reason_list FROM orders)"""


def flagged_circuits(spark, sf_dir):
    """orders as closed circuits with the flags of all their positions."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    hit = lambda m, r: F.pmod(k, F.lit(m)) == r
    return o.select(hit(11, 0).alias("is_origin"), hit(2, 0).alias("is_entry"), hit(5, 1).alias("is_mid"), hit(3, 0).alias("is_end"), hit(7, 3).alias("is_exit"), hit(9, 4).alias("is_dir"), hit(7, 4).alias("is_hsdir"), hit(7, 5).alias("is_intro"), hit(5, 2).alias("is_rend"), F.when(F.pmod("o_custkey", F.lit(3)) < 2, F.pmod("o_custkey", F.lit(3)) == 0).alias("is_client"), F.when(F.pmod("o_custkey", F.lit(4)) < 2, F.pmod("o_custkey", F.lit(4)) + 2).cast("int").alias("hs_version"), (F.col("o_orderstatus") == "F").alias("failed"), F.pmod(k, F.lit(13)).cast("long").alias("inbound_cells"), F.pmod(F.floor("o_totalprice"), F.lit(5000)).cast("long").alias("outbound_cells"), (F.pmod("o_custkey", F.lit(997)) * 100.0).alias("lifetime"), F.substring("o_orderpriority", 1, 1).cast("int").alias("reason_list"))


S_FLAGGED = """flagged AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 < 2 THEN o_custkey % 3 = 0 END AS client, CASE WHEN o_custkey % 4 < 2 THEN o_custkey % 4 + 2 END AS version, o_orderstatus = 'F' AS failed,
 o_orderkey % 13 AS i, CAST(floor(o_totalprice) AS BIGINT) % 5000 AS o, (o_custkey % 997) * 100.0 AS life,
 CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS reason FROM orders)"""


def s_fan(source: str, head: str, measures: list[tuple[str, str, str]]) -> str:
    """SQL of named counters: rows of the source to head || suffix, bin and increment; nulls are left out."""
    facts = ", ".join(f"{{'m': '{m}', 'b': {b}, 'n': CAST({n} AS BIGINT)}}" for m, b, n in measures)
    return f"""SELECT {head} || q.m AS counter, CAST(q.b AS INTEGER) AS bin_idx, CAST(sum(q.n) AS DECIMAL(38,0)) AS count
 FROM (SELECT *, unnest([{facts}]) AS q FROM {source}) WHERE q.b IS NOT NULL AND q.n IS NOT NULL GROUP BY 1, 2"""

"""Queries of named counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import fanout, matching, state
from veilcount.plans.registry import query, seconds, table
from veilcount.plans.samples import (
    BYTES,
    COUNTS,
    RATIOS,
    S_CIRCUITS,
    S_FLAGGED,
    S_PORT,
    S_RATIO,
    S_STREAMS,
    TIMES,
    circuits,
    flagged_circuits,
    s_bin,
    s_fan,
    streams,
)

ALL = "(read_bytes + write_bytes)"
S_RATIO_OF_STREAM = S_RATIO.format(i="read_bytes", o="write_bytes")
BINNED = [
    ("ByteHistogram", s_bin(ALL, BYTES), "1"),
    ("OutboundByteHistogram", s_bin("write_bytes", BYTES), "1"),
    ("InboundByteHistogram", s_bin("read_bytes", BYTES), "1"),
    ("ByteRatio", s_bin("ratio", RATIOS), "1"),
    ("LifeTime", s_bin("lifetime", TIMES), "1"),
]
SUMS = [("ByteCount", "0", ALL), ("OutboundByteCount", "0", "write_bytes"), ("InboundByteCount", "0", "read_bytes")]


@query(
    f"""WITH {S_STREAMS}, e AS (SELECT *, {S_PORT} AS pc, CASE WHEN port IN (80, 443) THEN 'Web' ELSE 'NonWeb' END AS web,
 CASE stream_number WHEN 1 THEN 'Initial' ELSE 'Subsequent' END AS pos, {S_RATIO_OF_STREAM} AS ratio FROM streams
 WHERE read_bytes >= 0 AND write_bytes >= 0 AND read_bytes + write_bytes > 0),
 subs AS (SELECT *, unnest(['', pc, CASE WHEN web = 'NonWeb' THEN web END, 'IPv' || ip_version, 'IPv' || ip_version || pos,
  host_class, host_class || pos, pos, CASE WHEN host_class = 'Hostname' THEN 'Hostname' || web END,
  CASE WHEN host_class = 'Hostname' THEN 'Hostname' || web || pos END]) AS sub FROM e)
 {s_fan("(SELECT * FROM subs WHERE sub IS NOT NULL)", "'Exit' || sub || 'Stream'", [("Count", "0", "1"), *SUMS, *BINNED])}"""
)
def x1_x2_stream_counters(spark, sf_dir):
    return fanout.stream_counters(streams(spark, sf_dir))


EXACT = [(0, "H1.example1.org"), (1, "h2.example2.org"), (1, "h1.example1.org"), (1, "h7.example2.org")]
SUFFIXES = [(0, "example3.org"), (1, ".example4.org"), (1, "h3.example3.org"), (1, "example4.org")]
S_LISTED = [(f"{lead}CountList", "list", n) for lead, n in (("", "1"), ("Byte", ALL), ("OutboundByte", "write_bytes"), ("InboundByte", "read_bytes"))]


def s_domain(kind: str, listed: str) -> str:
    rows = f"(SELECT *, {listed} AS list FROM e)"
    hit = f"'ExitDomain' || CASE list WHEN 0 THEN '' ELSE 'No' END || '{kind}MatchWebInitialStream'"
    return s_fan(rows, hit, BINNED) + " UNION ALL " + s_fan(rows, f"'ExitDomain{kind}MatchWebInitialStream'", S_LISTED)


@query(
    f"""WITH named AS (SELECT *, 'h' || (l_partkey % 50) || '.example' || (l_suppkey % 5) || '.org' AS host,
 CAST(trunc(l_quantity) AS BIGINT) AS read_bytes, CAST(floor(l_extendedprice) AS BIGINT) AS write_bytes,
 (l_suppkey % 977) * 120.0 AS lifetime FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 < 2
 AND l_returnflag NOT IN ('A', 'N')), e AS (SELECT *, {S_RATIO_OF_STREAM} AS ratio,
 CASE host WHEN 'h1.example1.org' THEN 0 WHEN 'h2.example2.org' THEN 1 WHEN 'h7.example2.org' THEN 1 ELSE 2 END AS exact,
 CASE WHEN host LIKE '%.example3.org' THEN 0 WHEN host LIKE '%.example4.org' THEN 1 ELSE 2 END AS suffix FROM named
 WHERE read_bytes >= 0 AND write_bytes >= 0 AND read_bytes + write_bytes > 0)
 {s_domain("Exact", "exact")} UNION ALL {s_domain("Suffix", "CASE WHEN exact < 2 THEN exact ELSE suffix END")}"""
)
def x3_x4_domain_counters(spark, sf_dir):
    named = streams(spark, sf_dir, "l_partkey", "l_suppkey")
    port = F.element_at(F.array(*[F.lit(p) for p in (80, 443, 22)]), (F.pmod("l_partkey", F.lit(3)) + 1).cast("int"))
    parts = F.lit("h"), F.pmod("l_partkey", F.lit(50)), F.lit(".example"), F.pmod("l_suppkey", F.lit(5)), F.lit(".org")
    named = named.withColumns({"port": port, "host": F.concat(*parts)})
    lists = spark.createDataFrame(SUFFIXES, "list_idx int, item string")
    hosts = matching.suffix_match(named.select("host").distinct(), lists, "host", "suffix_list")
    exact = matching.exact_match(hosts, spark.createDataFrame(EXACT, "list_idx int, item string"), "host", "exact_list")
    return fanout.domain_counters(named.join(exact, "host"), 2)


def s_circuit(i: str, o: str, life: str, reason: str, position: str) -> list[tuple[str, str, str]]:
    shown = f"'Active', CASE WHEN {position} IN ('Exit', 'Dir', 'HSDir') THEN '' END"
    return [
        ("Count", "0", "1"),
        ("InboundCellCount", "0", i),
        ("OutboundCellCount", "0", o),
        ("InboundCellHistogram", s_bin(i, BYTES), "1"),
        ("OutboundCellHistogram", s_bin(o, BYTES), "1"),
        ("CellRatio", f"CASE WHEN active AND a IN ({shown}) THEN {s_bin('ratio', RATIOS)} END", "1"),
        ("LifeTime", s_bin(life, TIMES), "1"),
        ("ReasonCountList", f"CASE WHEN s = 'Failure' THEN {reason} END", "1"),
    ]


S_OF_CIRCUIT = s_circuit("inbound_cells", "outbound_cells", "lifetime", "reason_list", "position")


@query(
    f"""WITH {S_CIRCUITS}, e AS (SELECT *, inbound_cells + outbound_cells >= 8 AS active,
 {S_RATIO.format(i="inbound_cells", o="outbound_cells")} AS ratio FROM circuits),
 v AS (SELECT *, unnest(['', CASE WHEN failed THEN 'Failure' ELSE 'Success' END]) AS s FROM e),
 w AS (SELECT *, unnest(CASE WHEN position IN ('Exit', 'Dir', 'HSDir') THEN ['']
  ELSE ['', CASE WHEN active THEN 'Active' ELSE 'Inactive' END] END) AS a FROM v),
 x AS (SELECT *, unnest(CASE WHEN role IS NULL THEN [''] ELSE ['', role] END) AS r FROM w)
 {s_fan("x", "position || r || a || s || 'Circuit'", S_OF_CIRCUIT)}"""
)
def x5_x8_circuit_counters(spark, sf_dir):
    return fanout.circuit_counters(circuits(spark, sf_dir))


LISTS = [(0, "click"), (1, "view"), (1, "click"), (2, "Purchase")]
#: Networks and the systems that announce them; the last has none of its own lists.
PREFIXES = [(0, 1, 64500), (0, 3, 64501), (2**31, 2, 64502)]
SYSTEMS = [(0, "64501"), (1, "64502")]
S_SIDES = [(f"{lead}{what}", n) for what, n in (("Byte", "bytes"), ("Circuit", "circuits")) for lead, n in (("", f"(in_{n} + out_{n})"), ("Inbound", f"in_{n}"), ("Outbound", f"out_{n}"))]
S_HISTOGRAMS = [(f"{k}Histogram", s_bin(n, BYTES if "Byte" in k else COUNTS), "1") for k, n in S_SIDES]
S_HISTOGRAMS += [("LifeTime", s_bin("life", TIMES), "1"), ("OverlapHistogram", s_bin("overlap", COUNTS), "1")]


def s_matched(kind: str, listed: str) -> str:
    head = f"h || '{kind}' || CASE {listed} WHEN 0 THEN '' ELSE 'No' END || 'Match'"
    lists = [("CountList", listed, "1"), *((f"{k}CountList", listed, n) for k, n in S_SIDES)]
    return s_fan("n", head, S_HISTOGRAMS) + " UNION ALL " + s_fan("n", f"h || '{kind}Match'", lists)


@query(
    f"""WITH m AS (SELECT user_id % 2 = 0 AS c, user_id % 3 > 0 AS r, CAST(floor(value) AS BIGINT) AS in_bytes,
 event_id % 5000 AS out_bytes, user_id % 4 AS in_circuits, event_id % 6 AS out_circuits, user_id % 9 AS overlap,
 (event_id % 997) * 100.0 AS life, event_id * 2654435 % 4294967296 AS address,
 coalesce(CASE lower(event_type) WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END, 3) AS country FROM events),
 n AS (SELECT *, CASE WHEN address < 536870912 THEN 0 WHEN address BETWEEN 2147483648 AND 3221225471 THEN 1 ELSE 3 END AS sys,
 CASE WHEN c THEN 'Entry' ELSE 'NonEntry' END || unnest(['', CASE WHEN r THEN 'RelayOnAddress' ELSE 'NoRelayOnAddress' END])
 || 'Connection' AS h FROM m)
 {s_fan("n", "h", [("Count", "0", "1"), *((f"{k}Count", "0", n) for k, n in S_SIDES), *S_HISTOGRAMS])}
 UNION ALL {s_matched("Country", "country")} UNION ALL {s_matched("AS", "sys")}"""
)
def x9_x11_connection_counters(spark, sf_dir):
    mod = lambda c, n: F.pmod(c, F.lit(n))
    e = table(spark, sf_dir, "events").select(
        "event_id",
        (mod("user_id", 2) == 0).alias("is_client"),
        mod("user_id", 3).alias("relays"),
        F.floor("value").cast("long").alias("in_bytes"),
        mod("event_id", 5000).alias("out_bytes"),
        mod("user_id", 4).alias("in_circuits"),
        mod("event_id", 6).alias("out_circuits"),
        mod("user_id", 9).alias("overlap"),
        (mod("event_id", 997) * 100.0).alias("lifetime"),
        F.pmod(F.col("event_id") * 2654435, F.lit(2**32)).alias("address"),
        "event_type",
    )
    prefixes = spark.createDataFrame(PREFIXES, "net long, prefix_len int, asn long").withColumn("digits", scalars.ipv4_digits(F.col("net")))
    e = matching.with_longest_prefix(e, prefixes, scalars.ipv4_digits(F.col("address"))).withColumn("asn", F.col("asn").cast("string"))
    lists, systems = (spark.createDataFrame(x, "list_idx int, item string") for x in (LISTS, SYSTEMS))
    e = matching.exact_match(matching.exact_match(e, lists, "event_type", "country_list"), systems, "asn", "as_list")
    return fanout.connection_counters(e)


REASONS = [(0, "reason0"), (1, "REASON1"), (2, "Reason2")]
ONIONS = [(0, "brand#13"), (2, "brand#22")]
S_SIZES = [
    ("IntroByteCount", "0", "intro"),
    ("DescriptorByteCount", "0", "bytes"),
    ("IntroByteHistogram", s_bin("intro", BYTES), "1"),
    ("DescriptorByteHistogram", s_bin("bytes", BYTES), "1"),
    ("ReasonCountList", "reason", "1"),
]
S_SECOND = [("OnionAddressCountList", "onion", "1"), ("IntroPointHistogram", s_bin("points", COUNTS), "1")]
S_ENTRIES = """e AS (SELECT CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS v, p_partkey % 3 > 0 AS a,
 coalesce(p_partkey % 5 > 1, false) AS c, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 = 0 END AS au,
 CAST(floor(p_retailprice) AS BIGINT) AS bytes, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 700 END AS intro,
 least(p_size % 5, 3) AS reason,
 CASE WHEN p_size % 2 = 0 THEN CASE p_brand WHEN 'Brand#13' THEN 0 WHEN 'Brand#21' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 3 END
 END AS onion, CASE WHEN p_size % 2 = 0 THEN p_partkey % 10 END AS points, CASE WHEN p_size % 2 = 1 THEN p_partkey % 12 END AS rev,
 CASE WHEN p_size % 2 = 0 AND p_partkey % 7 > 0 THEN 0 END AS delay FROM part),
 g AS (SELECT *, unnest(['', CASE WHEN a THEN 'Add' ELSE 'Reject' END]) AS x FROM e)"""


def s_cache(kind: str, source: str, second: list) -> str:
    stored = "x || " if kind == "Store" else ""
    both = [("Count", "0", "1"), *S_SIZES]
    third = [("RevisionHistogram", s_bin("rev", COUNTS), "1")]
    return f"""h AS (SELECT *, unnest(['', CASE WHEN c THEN 'Cached' ELSE 'Uncached' END]) AS y FROM {source}),
 i AS (SELECT *, unnest(CASE WHEN v = 2 AND au IS NOT NULL THEN ['', CASE WHEN au THEN 'ClientAuth' ELSE 'NoClientAuth' END]
  ELSE [''] END) AS z FROM h) {s_fan("h", f"'HSDir{kind}' || {stored}y", both)}
 UNION ALL {s_fan("(SELECT * FROM i WHERE v = 2)", f"'HSDir2{kind}' || {stored}y || z", [*both, *second])}
 UNION ALL {s_fan("(SELECT * FROM i WHERE v = 3)", f"'HSDir3{kind}' || {stored}y", [*both, *third])}"""


def cache_entries(spark, sf_dir) -> DataFrame:
    """part as cache events."""
    k, second = F.col("p_partkey"), F.col("p_size") % 2 == 0
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.lit("reason"), F.col("p_size") % 5).alias("reason"),
        F.when(second, F.lower("p_brand")).alias("address"),
        F.when(second, 2).otherwise(3).alias("version"),
        (k % 3 > 0).alias("added"),
        (k % 5 > 1).alias("cached"),
        F.when(k % 4 < 3, k % 4 == 0).alias("auth"),
        F.floor("p_retailprice").cast("long").alias("desc_bytes"),
        F.when(k % 6 > 0, k % 700).alias("intro_bytes"),
        F.when(second, k % 10).alias("intro_points"),
        F.when(second & (k % 7 > 0), (k % 1000).cast("double") - 3).alias("upload_delay"),
        F.when(~second, k % 12).alias("revision"),
    )
    reasons = spark.createDataFrame(REASONS, "list_idx int, item string")
    hashed = spark.createDataFrame([("brand#21",)], "name string").select(F.lit(1).alias("list_idx"), scalars.onion_md5(F.col("name")).alias("item"))
    onions = spark.createDataFrame(ONIONS, "list_idx int, item string").unionByName(hashed)
    found = matching.any_match(p, onions, p.columns, [F.col("address"), scalars.onion_md5(F.col("address"))], "onion_list")
    p = matching.exact_match(found, reasons, "reason", "reason_list")
    return p.withColumn("onion_list", F.when(F.col("address").isNotNull(), F.col("onion_list")))


@query(f"WITH {S_ENTRIES}, {s_cache('Store', 'g', [*S_SECOND, ('UploadDelayTime', 'delay', '1')])}")
def x12_x14_cache_counters(spark, sf_dir):
    return fanout.cache_counters(cache_entries(spark, sf_dir))


@query(f"WITH {S_ENTRIES}, {s_cache('Fetch', 'e', S_SECOND)}")
def x14_fetch_counters(spark, sf_dir):
    return fanout.cache_counters(cache_entries(spark, sf_dir), "Fetch")


ONE_OF = "pos NOT IN ('HSDir', 'Intro', 'Rend')"


@query(
    f"""WITH {S_FLAGGED}, p AS (SELECT *, {S_RATIO.format(i="i", o="o")} AS ratio, k % 2 = 0 AND k % 3 = 0 AS single,
 CASE WHEN (k % 7 = 5 OR k % 5 = 2) AND version IS NULL THEN false WHEN k % 7 IN (3, 4) OR k % 9 = 4 THEN true
  ELSE i + o >= 8 END AS active,
 unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'Origin' END, CASE WHEN k % 2 = 0 THEN 'Entry' END,
  CASE WHEN k % 5 = 1 THEN 'Mid' END, CASE WHEN k % 3 = 0 THEN 'End' END, CASE WHEN k % 6 = 0 THEN 'SingleHop' END,
  CASE WHEN k % 7 = 3 THEN 'Exit' END, CASE WHEN k % 9 = 4 THEN 'Dir' END, CASE WHEN k % 7 = 4 THEN 'HSDir'
  WHEN k % 7 = 5 THEN 'Intro' WHEN k % 5 = 2 THEN 'Rend' END], lambda x: x IS NOT NULL)) AS pos FROM flagged),
 v AS (SELECT *, unnest(CASE WHEN {ONE_OF} OR (pos = 'HSDir' AND version IS NULL) THEN ['']
  ELSE ['', coalesce(CAST(version AS VARCHAR), 'U')] END) AS v FROM p),
 r AS (SELECT *, unnest(CASE WHEN {ONE_OF} OR client IS NULL THEN ['']
  WHEN client THEN ['', 'Client', CASE WHEN single THEN 'Tor2WebClient' ELSE 'MultiHopClient' END]
  ELSE ['', 'Service', CASE WHEN single THEN 'SingleOnionService' ELSE 'MultiHopService' END] END) AS r FROM v),
 a AS (SELECT *, unnest(CASE WHEN pos IN ('Exit', 'Dir', 'HSDir') THEN ['']
  ELSE ['', CASE WHEN active THEN 'Active' ELSE 'Inactive' END] END) AS a FROM r),
 s AS (SELECT *, unnest(['', CASE WHEN failed THEN 'Failure' ELSE 'Success' END]) AS s FROM a)
 {s_fan("s", "pos || v || r || a || s || 'Circuit'", s_circuit("i", "o", "life", "reason", "pos"))}"""
)
def x6_x7_versioned_circuits(spark, sf_dir):
    return fanout.versioned_circuit_counters(flagged_circuits(spark, sf_dir))


@query(
    f"""WITH {S_FLAGGED}, s AS (SELECT unnest([CASE WHEN k % 7 = 3 THEN 'Client' END, CASE WHEN k % 7 = 3 THEN 'Service' END,
 CASE WHEN k % 5 = 2 AND version = 2 THEN CASE WHEN client THEN 'Client' WHEN NOT client THEN 'Service' END END]) AS side
 FROM flagged) SELECT 'ExitAndRend2' || side || 'CircuitCount' AS counter, 0 AS bin_idx,
 CAST(count(*) AS DECIMAL(38,0)) AS count FROM s WHERE side IS NOT NULL GROUP BY side"""
)
def x7_exit_and_rend(spark, sf_dir):
    return fanout.exit_and_rend_counters(flagged_circuits(spark, sf_dir))


S_CLASSES = ("Web", "Interactive", "P2P", "OtherPort")
S_PER = [(f"ExitCircuit{c}StreamHistogram", s_bin(f"CASE WHEN n{i} > 0 THEN n{i} END", COUNTS), "1") for i, c in enumerate(("", *S_CLASSES))]
S_PER += [(f"Exit{c}CircuitCount", "0", f"CASE WHEN n{i} > 0 THEN 1 END") for i, c in enumerate(S_CLASSES, 1)]
S_GAP = [("InterStreamCreationTime", s_bin("gap", TIMES), "1")]
S_EACH = ", ".join(f"count(*) FILTER (WHERE pc = '{c}') AS n{i}" for i, c in enumerate(S_CLASSES, 1))


@query(
    f"""WITH {S_STREAMS}, e AS (SELECT l_orderkey, {S_PORT} AS pc, CAST(l_linenumber * 3000 + port AS DOUBLE) AS started
 FROM (SELECT * REPLACE ([80, 22, 6699, 9001, 443][port % 5 + 1] AS port) FROM streams)
 WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')),
 per AS (SELECT l_orderkey, count(*) AS n0, {S_EACH} FROM e GROUP BY 1),
 g AS (SELECT '' AS c, started - lag(started) OVER (PARTITION BY l_orderkey ORDER BY started) AS gap FROM e
  UNION ALL SELECT pc, started - lag(started) OVER (PARTITION BY l_orderkey, pc ORDER BY started) FROM e)
 {s_fan("per", "''", S_PER)} UNION ALL {s_fan("(SELECT * FROM g WHERE gap IS NOT NULL)", "'ExitCircuit' || c", S_GAP)}"""
)
def x15_exit_circuits(spark, sf_dir):
    ports = F.element_at(F.array(*[F.lit(p) for p in (80, 22, 6699, 9001, 443)]), (F.col("port") % 5 + 1).cast("int"))
    s = streams(spark, sf_dir).withColumn("port", ports)
    s = s.withColumn("start", F.col("l_linenumber") * 3000 + F.col("port"))
    closes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return fanout.exit_circuit_counters(s, closes, ["l_orderkey"])


S_CLIENTS = [
    ("EntryClientIPActiveCircuitHistogram", s_bin("coalesce(ac, 0)", COUNTS), "1"),
    ("EntryClientIPInactiveCircuitHistogram", s_bin("coalesce(ic, 0)", COUNTS), "1"),
    ("EntryClientIPCount", "0", "1"),
    ("EntryActiveClientIPCount", "0", "active"),
    ("EntryInactiveClientIPCount", "0", "1 - active"),
]


@query(
    f"""WITH e AS (SELECT user_id AS ip, value > 50 AS active, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
 CAST(floor(epoch(ts)) AS BIGINT) - event_id % 90000 AS created FROM events),
 w AS (SELECT *, CAST(floor(ts / 86400.0) AS BIGINT) AS w FROM e),
 r AS (SELECT ip, active, w, 1 AS done FROM w UNION ALL SELECT ip, active, w - 1, 0 FROM w WHERE created < w * 86400),
 c AS (SELECT w, ip, max(CAST(active AS INTEGER)) AS active, sum(CASE WHEN active THEN done END) AS ac,
  sum(CASE WHEN NOT active THEN done END) AS ic FROM r GROUP BY 1, 2) {s_fan("c", "''", S_CLIENTS)}"""
)
def st2_client_counters(spark, sf_dir):
    at = F.floor(seconds("ts")).cast("long")
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ip"),
        (F.col("value") > 50).alias("active"),
        at.alias("ts"),
        (at - F.pmod("event_id", F.lit(90000))).alias("created"),
    )
    return fanout.client_counters(state.client_windows(e, 86400))


@query(
    """SELECT CASE event_id % 3 WHEN 0 THEN 'ExitStreamTrafficModelStreamCount' ELSE 'ExitCircuitTrafficModelCircuitCount' END
 AS counter, 0 AS bin_idx, CAST(count(*) AS DECIMAL(38,0)) AS count FROM events WHERE event_id % 3 < 2 GROUP BY 1"""
)
def x17_model_events(spark, sf_dir):
    k = F.pmod("event_id", F.lit(3))
    code = F.when(k == 0, "VITERBI_PACKETS").when(k == 1, "VITERBI_STREAMS").otherwise("STREAM_ENDED")
    return fanout.model_event_counters(table(spark, sf_dir, "events").select(code.alias("code")))

"""Queries over a mixed event log: the driver's tables as lines, through the source, to every family's counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilcount.checkpoints import shared_path
from veilcount.functions import scalars
from veilcount.plans import counter_queries as cq
from veilcount.plans.registry import ORACLE_SQL, query, table
from veilcount.plans.samples import COUNTS, S_FLAGGED, S_PORT, S_STREAMS, TIMES, s_bin, s_fan
from veilcount.sources import eventlog, families

PREFIX = "COUNTED_"


def _line(code: str, **fields: Column | str) -> Column:
    """A tagged line; null fields are left out."""
    shown = [F.concat(F.lit(f"{n}="), v if isinstance(v, Column) else F.lit(v)) for n, v in fields.items()]
    return F.concat_ws(" ", F.lit(f"650 {PREFIX}{code}"), *shown)


def _mod(c: str, n: int) -> Column:
    return F.pmod(F.col(c), F.lit(n))


def _party(c: str) -> Column:
    return F.concat(F.lit("dc"), _mod(c, 4))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int").cast("string")


def _given(c: Column) -> Column:
    """A flag that is there only where it is set."""
    return F.when(c, "1")


def stream_lines(spark, sf_dir):
    """lineitem as ended streams; one in 17 lacks a field, one in 19 has a port that is no number."""
    host = F.concat(F.lit("h"), _mod("l_partkey", 50), F.lit(".Example"), _mod("l_suppkey", 5), F.lit(".org"))
    requested = F.when(F.col("l_returnflag") == "A", "192.0.2.7").when(F.col("l_returnflag") == "N", "2001:db8::7").otherwise(host)
    resolved = F.when(F.col("l_linestatus") == "O", "192.0.2.9").otherwise("2001:db8::9")
    port = F.when(_mod("l_suppkey", 19) == 3, "http").otherwise(_mod("l_partkey", 7000).cast("string"))
    end = F.format_string("%.1f", 1000 + _mod("l_suppkey", 977) * 120.0)
    parts = [_mod("l_orderkey", 97), F.col("l_orderkey"), F.col("l_linenumber"), port, F.col("l_quantity").cast("long"), F.floor("l_extendedprice"), F.lit("1000.0"), end, requested, resolved]
    last = F.when(_mod("l_suppkey", 17) > 0, F.col("l_linenumber").cast("string"))
    line = F.concat_ws(" ", F.lit(f"650 {PREFIX}STREAM_ENDED"), *[p.cast("string") for p in parts], last)
    return table(spark, sf_dir, "lineitem").select(_party("l_orderkey").alias("party"), line.alias("value"))


def circuit_lines(spark, sf_dir):
    """orders as closed circuits; one in 23 has a state that is too long, one in 29 repeats a field."""
    hit = lambda m, r: _given(_mod("o_orderkey", m) == r)
    ip = F.concat(F.lit("10.0."), F.floor(F.col("o_custkey") / 250) % 250, F.lit("."), _mod("o_custkey", 250))
    line = _line(
        "CIRCUIT_CLOSE",
        CreatedTimestamp="1000.5",
        EventTimestamp=F.format_string("%.1f", 1000.5 + _mod("o_custkey", 997) * 100.0),
        IsLegacyCircuitEndEventFlag=_flag(_mod("o_custkey", 2) == 0),
        StateString=F.when(_mod("o_orderkey", 23) == 1, F.repeat(F.lit("s"), 51)).otherwise("open"),
        PurposeCode="5",
        PreviousChannelId=_mod("o_orderkey", 97),
        PreviousCircuitId=F.col("o_orderkey"),
        PreviousNodeIPAddress=ip,
        InboundExitByteCount="1",
        OutboundExitByteCount=F.when(_mod("o_custkey", 10) > 0, "2"),
        InboundSentCellCount=_mod("o_orderkey", 13),
        InboundReceivedCellCount=F.when(_mod("o_orderkey", 13) > 4, "4"),
        OutboundExitCellCount=F.pmod(F.floor("o_totalprice"), F.lit(5000)),
        IsOriginFlag=hit(11, 0), IsEntryFlag=hit(2, 0), IsMidFlag=hit(5, 1), IsEndFlag=hit(3, 0), IsExitFlag=hit(7, 3),
        IsDirFlag=hit(9, 4), IsHSDirFlag=hit(7, 4), IsIntroFlag=hit(7, 5), IsRendFlag=hit(5, 2),
        IsHSClientSideFlag=F.when(_mod("o_custkey", 3) < 2, _flag(_mod("o_custkey", 3) == 0)),
        HiddenServiceVersionNumber=F.when(_mod("o_custkey", 4) < 2, _mod("o_custkey", 4) + 2),
        FailureReasonString=F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Reason"), F.substring("o_orderpriority", 1, 1))),
    )
    twice = F.when(_mod("o_orderkey", 29) == 2, " PurposeCode=5").otherwise("")
    return table(spark, sf_dir, "orders").select(_party("o_orderkey").alias("party"), F.concat(line, twice).alias("value"))


def connection_lines(spark, sf_dir):
    """events as closed connections of IPv4 addresses; one in 31 tells a client by 2."""
    number = F.pmod(F.col("event_id") * 2654435, F.lit(2**32))
    part = lambda k: F.shiftright(number, k).bitwiseAND(F.lit(255))
    address = F.concat_ws(".", *[part(k).cast("string") for k in (24, 16, 8, 0)])
    line = _line(
        "CONNECTION_CLOSE",
        CreatedTimestamp="1000.5",
        EventTimestamp=F.format_string("%.1f", 1000.5 + _mod("event_id", 997) * 100.0),
        ChannelId=F.col("event_id"),
        RemoteIsClientFlag=F.when(_mod("event_id", 31) == 0, "2").otherwise(_flag(_mod("user_id", 2) == 0)),
        RemoteIPAddress=address,
        RemoteIPAddressConnectionCount=_mod("user_id", 9),
        PeerIPAddressConsensusRelayCount=_mod("user_id", 3),
        InboundByteCount=F.floor("value"),
        OutboundByteCount=_mod("event_id", 5000),
        InboundCircuitCount=_mod("user_id", 4),
        OutboundCircuitCount=_mod("event_id", 6),
        RemoteCountryCode=F.when(F.col("event_type") != "error", F.upper(F.substring("event_type", 1, 2))),
    )
    return table(spark, sf_dir, "events").select(_party("user_id").alias("party"), line.alias("value"))


def cache_lines(spark, sf_dir):
    """part as stores and fetches of descriptors; one in 37 has more introduction bytes than a descriptor."""
    second = _mod("p_size", 2) == 0
    common = {
        "HiddenServiceVersionNumber": F.when(second, "2").otherwise("3"),
        "EventTimestamp": "2000.0",
        "CacheReasonString": F.concat(F.lit("Reason"), _mod("p_size", 5)),
        "RequiresClientAuthFlag": F.when(second & (_mod("p_partkey", 4) < 3), _flag(_mod("p_partkey", 4) == 0)),
        "EncodedDescriptorByteCount": F.floor("p_retailprice"),
        "EncodedIntroPointByteCount": F.when(_mod("p_partkey", 37) == 1, "40000").when(_mod("p_partkey", 6) > 0, _mod("p_partkey", 700).cast("string")),
        "IntroPointCount": F.when(second, _mod("p_partkey", 10)),
        "OnionAddress": F.when(second, F.rpad(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), 16, "a")),
        "DescriptorCreationTime": F.when(second & (_mod("p_partkey", 7) > 0), F.format_string("%.1f", 2003.0 - _mod("p_partkey", 1000))),
        "RevisionNumber": F.when(~second, _mod("p_partkey", 12)),
    }
    cached = _given(_mod("p_partkey", 5) > 1)
    store = _line("HSDIR_CACHE_STORE", **common, WasAddedToCacheFlag=_flag(_mod("p_partkey", 3) > 0), HasExistingCacheEntryFlag=cached)
    fetch = _line("HSDIR_CACHE_FETCH", **common, CacheQueryByteCount="10", HasCacheEntryFlag=cached)
    return table(spark, sf_dir, "part").select(_party("p_partkey").alias("party"), F.explode(F.array(store, fetch)).alias("value"))


def model_lines(spark, sf_dir):
    """Runs of up to 100 numbers of a user's events as paths of packets; users as empty paths of streams, one in 41 without its time."""
    e = table(spark, sf_dir, "events")
    obs = F.element_at(F.array(*[F.lit(x) for x in "+-$F"]), (_mod("event_id", 4) + 1).cast("int"))
    item = F.concat(F.lit('["'), F.when(F.col("event_type") == "click", "sActive").otherwise("sDwell"), F.lit('";"'), obs, F.lit('";"'), _mod("event_id", 5000), F.lit('"]'))
    runs = e.groupBy("user_id", F.floor(F.col("event_id") / 100)).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items"))
    path = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ";"), F.lit("]"))
    packets = runs.select(_party("user_id").alias("party"), _line("VITERBI_PACKETS", ViterbiPathPackets=path, EventTimestamp="1.5").alias("value"))
    time = F.when(_mod("c_custkey", 41) > 0, "1.5")
    streams = table(spark, sf_dir, "customer").select(_party("c_custkey").alias("party"), _line("VITERBI_STREAMS", ViterbiPathStreams="[]", EventTimestamp=time).alias("value"))
    return packets.unionByName(streams)


def odd_lines(spark, sf_dir):
    """nation as lines that no counter wants: codes that nobody knows, legacy events, and malformed ones."""
    kinds = [f"650 {PREFIX}NEWS a b", f"650 {PREFIX}CONNECTION_ENDED 1 2 3 4 5", f"650 {PREFIX}CONNECTION_ENDED 1", f"650 {PREFIX}CIRCUIT_CLOSE A=b=c", f"650 {PREFIX}CIRCUIT_CELL EventTimestamp=1"]
    line = F.element_at(F.array(*[F.lit(k) for k in kinds]), (_mod("n_nationkey", 5) + 1).cast("int"))
    return table(spark, sf_dir, "nation").select(_party("n_nationkey").alias("party"), line.alias("value"))


def mixed_lines(spark, sf_dir):
    makers = (stream_lines, circuit_lines, connection_lines, cache_lines, model_lines, odd_lines)
    out = makers[0](spark, sf_dir)
    for make in makers[1:]:
        out = out.unionByName(make(spark, sf_dir))
    return out


def stored_events(spark, sf_dir, *makers):
    """The lines written to the shared folder as a log, read through the source, judged once and stored by code."""
    lines = mixed_lines(spark, sf_dir) if not makers else makers[0](spark, sf_dir)
    log = eventlog.write_log(lines, shared_path(spark, "log"), "gzip")
    return families.write_events(families.judged(eventlog.read_log(spark, log, PREFIX)), shared_path(spark, "events"))


def lists_of(spark) -> families.Lists:
    frame = lambda rows: spark.createDataFrame(rows, "list_idx int, item string")
    onions = [(0, "brand13" + "a" * 9), (2, "brand22" + "a" * 9)]
    hashed = spark.createDataFrame([("brand21" + "a" * 9,)], "name string").select(F.lit(1).alias("list_idx"), scalars.onion_md5(F.col("name")).alias("item"))
    prefixes = [("0.0.0.0", 1, 64500), ("0.0.0.0", 3, 64501), ("128.0.0.0", 2, 64502)]
    reasons = frame([(0, "reason0"), (1, "REASON1"), (2, "Reason2")])
    return families.Lists(
        domains=frame(cq.EXACT), suffixes=frame(cq.SUFFIXES), countries=frame([(0, "cl"), (1, "VI"), (2, "Pu")]), systems=frame(cq.SYSTEMS),
        prefixes=spark.createDataFrame(prefixes, "net string, prefix_len int, asn long"), failures=frame([(i, f"reason{i}") for i in range(6)]),
        stores=reasons, fetches=reasons, onions=frame(onions).unionByName(hashed),
        sizes={"domains": 2, "suffixes": 2, "countries": 3, "systems": 3, "failures": 6, "stores": 3, "fetches": 3, "onions": 3},
    )


# The SQL: each family's own, over the rows whose lines are accepted.

S_LINES = "lineitem WHERE l_suppkey % 17 > 0 AND l_suppkey % 19 <> 3"
S_CLOSES = "orders WHERE o_orderkey % 23 <> 1 AND o_orderkey % 29 <> 2"
S_EXIT = "(k % 7 = 3 AND k % 9 <> 4 AND k % 5 <> 2)"


def s_streams() -> str:
    return ORACLE_SQL["x1_x2_stream_counters"].replace("FROM lineitem", f"FROM {S_LINES}", 1)


def s_domains() -> str:
    own = ORACLE_SQL["x3_x4_domain_counters"]
    return own.replace("FROM lineitem WHERE", f"FROM {S_LINES} AND", 1).replace("l_partkey % 3 < 2", "l_partkey % 7000 IN (80, 443)")


def s_circuits(name: str) -> str:
    """Flags of internal circuits leave no exit."""
    own = ORACLE_SQL[name].replace("FROM orders", f"FROM {S_CLOSES}", 1)
    return own.replace("k % 7 IN (3, 4)", f"({S_EXIT} OR k % 7 = 4)").replace("k % 7 = 3 THEN", f"{S_EXIT} THEN")


S_CLIENTS = f"""WITH e AS (SELECT o_orderkey % 4 AS party, o_custkey % 62500 AS ip, o_orderkey % 13 + CAST(floor(o_totalprice) AS BIGINT) % 5000 >= 8 AS active,
 1000.5 + (o_custkey % 997) * 100.0 AS ts, 1000.5 AS created FROM {S_CLOSES} AND o_orderkey % 2 = 0 AND o_custkey % 2 = 0 AND o_custkey % 10 > 0),
 w AS (SELECT *, CAST(floor(ts / 600.0) AS BIGINT) AS w FROM e),
 r AS (SELECT party, ip, active, w, 1 AS done FROM w UNION ALL SELECT party, ip, active, w - 1, 0 FROM w WHERE created < w * 600),
 c AS (SELECT party, w, ip, max(CAST(active AS INTEGER)) AS active, sum(CASE WHEN active THEN done END) AS ac,
  sum(CASE WHEN NOT active THEN done END) AS ic FROM r GROUP BY 1, 2, 3) {s_fan("c", "''", cq.S_CLIENTS)}"""

S_EXITS = f"""WITH {S_STREAMS.replace("FROM lineitem", f"FROM {S_LINES}")}, {S_FLAGGED.replace("SELECT o_orderkey AS k", "SELECT o_custkey, o_orderkey AS k").replace("FROM orders", f"FROM {S_CLOSES}")},
 e AS (SELECT l_orderkey, {S_PORT} AS pc, 1000.0 AS started FROM streams JOIN flagged ON l_orderkey = k
 WHERE {S_EXIT} AND k % 2 = 1 AND o_custkey % 2 = 0 AND o_custkey % 10 > 0 AND 1000.0 + lifetime <= 1000.5 + life
 AND read_bytes >= 0 AND write_bytes >= 0 AND read_bytes + write_bytes > 0),
 per AS (SELECT l_orderkey, count(*) AS n0, {cq.S_EACH} FROM e GROUP BY 1),
 g AS (SELECT '' AS c, started - lag(started) OVER (PARTITION BY l_orderkey ORDER BY started) AS gap FROM e
  UNION ALL SELECT pc, started - lag(started) OVER (PARTITION BY l_orderkey, pc ORDER BY started) FROM e)
 {s_fan("per", "''", [(f"ExitCircuit{c}StreamHistogram", s_bin(f"CASE WHEN n{i} > 0 THEN n{i} END", COUNTS), "1") for i, c in enumerate(("", *cq.S_CLASSES))] + [(f"Exit{c}CircuitCount", "0", f"CASE WHEN n{i} > 0 THEN 1 END") for i, c in enumerate(cq.S_CLASSES, 1)])}
 UNION ALL {s_fan("(SELECT * FROM g WHERE gap IS NOT NULL)", "'ExitCircuit' || c", [("InterStreamCreationTime", s_bin("gap", TIMES), "1")])}"""


def s_connections() -> str:
    return ORACLE_SQL["x9_x11_connection_counters"].replace("FROM events)", "FROM events WHERE event_id % 31 > 0)", 1)


def s_caches(kind: str) -> str:
    own = ORACLE_SQL["x12_x14_cache_counters" if kind == "Store" else "x14_fetch_counters"]
    return own.replace("FROM part)", "FROM part WHERE p_partkey % 37 <> 1)", 1)


def s_paths() -> str:
    own = ORACLE_SQL["x16_path_counters"].replace("PARTITION BY user_id", "PARTITION BY user_id, event_id // 100")
    own = own.replace("'P", "'ExitStreamTrafficModel").replace("SELECT user_id, row_number()", "SELECT user_id, event_id, row_number()")
    return f"SELECT counter, 0 AS bin_idx, CAST(count AS DECIMAL(38,0)) AS count FROM ({own})"


S_MODELS = """SELECT 'ExitStreamTrafficModelStreamCount' AS counter, 0 AS bin_idx, CAST(count(*) AS DECIMAL(38,0)) AS count FROM (SELECT DISTINCT user_id, event_id // 100 FROM events)
 UNION ALL SELECT 'ExitCircuitTrafficModelCircuitCount', 0, CAST(count(*) AS DECIMAL(38,0)) FROM customer WHERE c_custkey % 41 > 0"""


def s_families() -> str:
    parts = [s_streams(), s_domains(), s_circuits("x6_x7_versioned_circuits"), s_circuits("x7_exit_and_rend"), S_CLIENTS, S_EXITS, s_connections(), s_caches("Store"), s_caches("Fetch"), s_paths(), S_MODELS]
    return " UNION ALL ".join(f"SELECT counter, CAST(bin_idx AS INTEGER) AS bin_idx, CAST(count AS DECIMAL(38,0)) AS count FROM ({p})" for p in parts)


@query(s_families())
def round_all_families(spark, sf_dir):
    """S1-S2, P1-P7, V1, V3-V10, F5, F7, F8, X1-X17, M1-M5, M12, ST2, A1, A4: one mixed log to every counter."""
    return families.totals(families.all_counters(spark, stored_events(spark, sf_dir), lists_of(spark)))


@query(
    """WITH r AS (SELECT 'STREAM_ENDED' AS code, CASE WHEN l_suppkey % 17 = 0 THEN 'number of fields' WHEN l_suppkey % 19 = 3 THEN 'port' END AS reason FROM lineitem
 UNION ALL SELECT 'CIRCUIT_CLOSE', CASE WHEN o_orderkey % 29 = 2 THEN 'malformed' WHEN o_orderkey % 23 = 1 THEN 'StateString' END FROM orders
 UNION ALL SELECT 'CONNECTION_CLOSE', CASE WHEN event_id % 31 = 0 THEN 'RemoteIsClientFlag' END FROM events
 UNION ALL SELECT 'HSDIR_CACHE_' || unnest(['STORE', 'FETCH']), CASE WHEN p_partkey % 37 = 1 THEN 'EncodedIntroPointByteCount' END FROM part
 UNION ALL SELECT 'VITERBI_STREAMS', CASE WHEN c_custkey % 41 = 0 THEN 'EventTimestamp' END FROM customer
 UNION ALL SELECT ['NEWS', 'CONNECTION_ENDED', 'CONNECTION_ENDED', 'CIRCUIT_CLOSE', 'CIRCUIT_CELL'][n_nationkey % 5 + 1],
  ['unknown code', NULL, 'number of fields', 'malformed', 'IsSentFlag'][n_nationkey % 5 + 1] FROM nation)
 SELECT code, reason AS reject_reason, count(*) AS events FROM r WHERE reason IS NOT NULL GROUP BY 1, 2"""
)
def round_rejects(spark, sf_dir):
    """What the mixed log's lines are rejected for."""
    return families.rejects(spark, stored_events(spark, sf_dir))


PUSHED = ["ExitStreamCount", "EntryConnectionCount"]


@query(
    """SELECT code, CAST(count(*) AS BIGINT) AS events, CAST(sum(n) AS BIGINT) AS fields FROM (SELECT 'STREAM_ENDED' AS code, CASE WHEN l_suppkey % 17 = 0 THEN 10 ELSE 11 END AS n FROM lineitem
 UNION ALL SELECT 'CONNECTION_CLOSE', 11 + CASE WHEN event_type = 'error' THEN 0 ELSE 1 END FROM events) GROUP BY 1"""
)
def s1_s2_pushed_log(spark, sf_dir):
    """A log read for two counters; the codes that they need are pushed down to the source."""
    log = eventlog.write_log(mixed_lines(spark, sf_dir), shared_path(spark, "log"), "gzip")
    found = eventlog.read_log(spark, log, PREFIX, counters=PUSHED)
    return found.groupBy("code").agg(F.count("*").alias("events"), F.sum(F.size("fields")).alias("fields"))

"""Queries over the driver's tables, which stand in for event logs, with the SQL that they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import analysis, binning, hmm, matching, privacy, rounds, state, weights
from veilcount.plans import counter_queries, report_queries, round_queries  # noqa: F401  their queries are registered too
from veilcount.plans.registry import ORACLE_SQL, QUERIES, query, seconds, table  # noqa: F401
from veilcount.plans.samples import BYTES, S_CIRCUITS, S_STREAMS, circuits, s_bin, streams  # noqa: F401
from veilcount.sources import events as ev

@query(f"WITH {S_STREAMS} SELECT 'ExitStreamByteHistogram' AS counter, CAST({s_bin('(read_bytes + write_bytes)', BYTES)} AS INTEGER) AS bin_idx, CAST(count(*) AS DECIMAL(38,0)) AS count FROM streams GROUP BY 2")
def a1_a2_histogram(spark, sf_dir):
    bins = spark.createDataFrame([("ExitStreamByteHistogram", i, lo, hi) for i, (lo, hi) in enumerate(BYTES)], "counter string, bin_idx int, lo double, hi double")
    facts = streams(spark, sf_dir).select(F.lit("ExitStreamByteHistogram").alias("counter"), (F.col("read_bytes") + F.col("write_bytes")).cast("double").alias("value"), F.lit(1).alias("inc"))
    return binning.bin_join(facts, bins)


LISTS = [(0, "click"), (1, "view"), (1, "click"), (2, "Purchase")]


@query("""SELECT o_orderkey, CASE WHEN p IN (80, 443) THEN 'Web' WHEN p IN (22, 194, 994, 6679, 6697, 7000) OR p BETWEEN 6660 AND 6670 THEN 'Interactive' WHEN p IN (1214, 6699, 45682, 51413) OR p BETWEEN 4661 AND 4666 OR p BETWEEN 6346 AND 6429 OR p BETWEEN 6881 AND 6999 THEN 'P2P' ELSE 'OtherPort' END AS port_class,
 i + o >= 8 AS active, CASE WHEN i = 0 AND o = 0 THEN 0.0 WHEN i = 0 THEN 1024.0 WHEN o = 0 THEN -1021.0 ELSE log2(CAST(o AS DOUBLE) / i) END AS ratio, CASE WHEN o = 0 THEN 0.0 ELSE CAST(i AS DOUBLE) / o END AS divided, i - 5 AS adjusted
 FROM (SELECT o_orderkey, o_orderkey % 7003 AS p, o_orderkey % 13 AS i, o_custkey % 11 AS o FROM orders)""")
def f1_f21_scalars(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(7003)).alias("p"), F.pmod("o_orderkey", F.lit(13)).alias("i"), F.pmod("o_custkey", F.lit(11)).alias("o"))
    q = scalars.whole(scalars.MODULUS)
    raised = F.pmod((F.col("i") - 5).cast("decimal(38,0)") + q, q)
    return o.select("o_orderkey", scalars.port_class(F.col("p")).alias("port_class"), scalars.is_active(F.col("i"), F.col("o")).alias("active"), scalars.encode_ratio(F.col("i"), F.col("o")).alias("ratio"), scalars.safe_divide(F.col("i"), F.col("o")).alias("divided"), scalars.signed(raised).cast("long").alias("adjusted"))


@query("""SELECT page_id, host, regexp_full_match(host, '[A-Za-z0-9._-]+') AS is_domain, md5(lower(host) || '.onion') AS hashed, list_filter(string_split(lower(host), '.'), lambda x: x <> '' AND x <> 'onion')[-1] AS name
 FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)""")
def f9_f12_names(spark, sf_dir):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host")).select("page_id", "host", scalars.is_domain(F.col("host")).alias("is_domain"), scalars.onion_md5(F.col("host")).alias("hashed"), scalars.onion_name(F.col("host")).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS channel, CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN 'EventTimestamp' WHEN o_custkey % 3 = 0 THEN 'RemoteIsClientFlag' END AS reject_reason FROM orders""")
def p1_p6_tagged_events(spark, sf_dir):
    """Orders written as tagged lines, some malformed, then parsed and validated."""
    key = F.pmod("o_orderkey", F.lit(5))
    line = F.concat(F.lit("EventTimestamp=1.5  ChannelId="), "o_custkey", F.lit(" RemoteIsClientFlag="), F.when(F.col("o_custkey") % 3 == 0, "2").otherwise("1"), F.when(key == 0, " ChannelId=7").when(key == 1, " A=b=c").when(key == 2, " =x").otherwise(""))
    rules = (ev.Rule("EventTimestamp", "float", True, 0), ev.Rule("ChannelId", "int", True, 0), ev.Rule("RemoteIsClientFlag", "flag", True))
    o = table(spark, sf_dir, "orders").select("o_orderkey", ev.tagged(F.split(line, " ")).alias("tags"))
    return ev.validate(o, rules).select("o_orderkey", F.col("tags")["ChannelId"].alias("channel"), "reject_reason")


@query("""SELECT list_idx, count(*) AS n FROM (SELECT CASE lower(event_type) WHEN 'click' THEN 0.0 WHEN 'view' THEN 1.0 WHEN 'purchase' THEN 2.0 ELSE CAST('inf' AS DOUBLE) END AS list_idx FROM events) GROUP BY 1""")
def m1_m2_exact_match(spark, sf_dir):
    return matching.exact_match(table(spark, sf_dir, "events").select("event_type"), spark.createDataFrame(LISTS, "list_idx int, item string"), "event_type").groupBy("list_idx").agg(F.count("*").alias("n"))


def hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))


SUFFIXES = [(0, "m.example.org"), (1, "example.com"), (1, ".org."), (2, "cheap-pills.example.com"), (2, "net")]
S_HOSTS = "hosts AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)"


@query(f"""WITH {S_HOSTS} SELECT page_id, CASE WHEN host = 'example.com' OR host LIKE '%.example.com' THEN 1.0 WHEN host = 'org' OR host LIKE '%.org' THEN 1.0 WHEN host = 'net' OR host LIKE '%.net' THEN 2.0 ELSE CAST('inf' AS DOUBLE) END AS list_idx FROM hosts""")
def m4_suffix_match(spark, sf_dir):
    return matching.suffix_match(hosts(spark, sf_dir), spark.createDataFrame(SUFFIXES, "list_idx int, item string"), "host").select("page_id", "list_idx")


@query(f"""WITH {S_HOSTS} SELECT DISTINCT host FROM hosts WHERE host LIKE '%.example.com' OR host LIKE '%.m.example.org'""")
def m6_reverse_suffix(spark, sf_dir):
    lists = spark.createDataFrame([("example.com",), ("m.example.org",)], "item string")
    return matching.has_listed_suffix(hosts(spark, sf_dir), lists, "host")


@query("""WITH p AS (SELECT DISTINCT 8 + n_nationkey % 3 * 8 AS len, ((n_nationkey * 16777216 + n_regionkey * 65536) >> (24 - n_nationkey % 3 * 8)) << (24 - n_nationkey % 3 * 8) AS net, n_nationkey AS asn FROM nation),
 a AS (SELECT c_custkey, c_nationkey * 16777216 + (c_custkey % 5) * 65536 + c_custkey % 256 AS ip FROM customer)
 SELECT c_custkey, (SELECT max_by(asn, len) FROM p WHERE (ip >> (32 - len)) << (32 - len) = net) AS asn FROM a""")
def m5_longest_prefix(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    width = F.pmod("n_nationkey", F.lit(3)) * 8 + 8
    step = F.pow(F.lit(2.0), 32 - width)
    prefixes = n.select(width.cast("int").alias("prefix_len"), (F.floor((F.col("n_nationkey") * 16777216 + F.col("n_regionkey") * 65536) / step) * step).cast("long").alias("net"), F.col("n_nationkey").alias("asn"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") * 16777216 + F.pmod("c_custkey", F.lit(5)) * 65536 + F.pmod("c_custkey", F.lit(256))).cast("long").alias("ip"))
    return matching.longest_prefix(customers, prefixes, "c_custkey", "ip")


@query("""SELECT s.event_id, min(c.ts) AS closed_at FROM (SELECT event_id, user_id, epoch_us(ts) AS ts FROM events WHERE event_id % 4 > 0) s LEFT JOIN (SELECT user_id, epoch_us(ts) AS ts FROM events WHERE event_id % 4 = 0) c ON c.user_id = s.user_id AND c.ts >= s.ts GROUP BY 1""")
def m12_next_close(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    closed = matching.next_close(e.where(F.pmod("event_id", F.lit(4)) > 0), e.where(F.pmod("event_id", F.lit(4)) == 0), ["user_id"], "ts", "ts")
    return closed.select("event_id", "closed_at")


@query("""SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS gap FROM events""")
def f6_stream_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return state.gaps_between(e, ["user_id"], at, ties=("event_id",)).select("event_id", "gap")


@query("""WITH e AS (SELECT user_id AS ip, value > 50 AS active, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(floor(epoch(ts)) AS BIGINT) - event_id % 90000 AS created FROM events), w AS (SELECT *, CAST(floor(ts / 86400.0) AS BIGINT) AS w FROM e),
 r AS (SELECT ip, active, w, 1 AS done FROM w UNION ALL SELECT ip, active, w - 1, 0 FROM w WHERE created < w * 86400), c AS (SELECT w, ip, max(CAST(active AS INTEGER)) AS active, sum(CASE WHEN active THEN done END) AS ac, sum(CASE WHEN NOT active THEN done END) AS ic FROM r GROUP BY 1, 2)
 SELECT w, count(*) AS clients, CAST(sum(active) AS BIGINT) AS active_clients, CAST(count(*) - sum(active) AS BIGINT) AS inactive_clients, CAST(coalesce(sum(ac), 0) AS BIGINT) AS active_completed, CAST(coalesce(sum(ic), 0) AS BIGINT) AS inactive_completed FROM c GROUP BY 1""")
def st2_a6_rotation(spark, sf_dir):
    at = F.floor(seconds("ts")).cast("long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("ip"), (F.col("value") > 50).alias("active"), at.alias("ts"), (at - F.pmod("event_id", F.lit(90000))).alias("created"))
    return state.rotation(e, 86400)


def collector_facts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.concat(F.lit("dc"), F.pmod("l_suppkey", F.lit(8))).alias("party"), F.col("l_returnflag").alias("counter"), F.pmod("l_linenumber", F.lit(3)).cast("int").alias("bin_idx")).agg(F.sum(F.floor("l_quantity").cast("long") - 20).cast("decimal(22,0)").alias("count"))


S_TALLY = "SELECT l_returnflag AS counter, CAST(l_linenumber % 3 AS INTEGER) AS bin_idx, CAST(sum(CAST(floor(l_quantity) AS BIGINT) - 20) AS DECIMAL(38,0)) AS count FROM lineitem GROUP BY 1, 2"


@query(S_TALLY)
def a3_tally(spark, sf_dir):
    return binning.tally(collector_facts(spark, sf_dir))


@query(S_TALLY)
def b1_b2_blinded_tally(spark, sf_dir):
    """Collectors' counts, blinded for three keepers, tally to the plain sums."""
    from veilcount.checkpoints import checkpointed

    checkpointed(spark)
    return binning.tally(privacy.blinded(collector_facts(spark, sf_dir), ["sk0", "sk1", "sk2"]))


@query("""SELECT n_name AS counter FROM nation WHERE n_regionkey < 3 AND n_nationkey % 2 = 0 AND regexp_matches(n_name, '[0-2]$')
 AND NOT regexp_matches(n_name, '_1')""")
def p8_p10_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "counter")
    return matching.common_counters(matching.name_filter(n.where("n_regionkey < 3"), "[0-2]$", "_1"), n.where("n_nationkey % 2 = 0"))


S_LIMBS = ", ".join(f"CAST(CAST('0x' || rpad(substr(fp, {1 + 15 * i}, 15), 15, '0') AS UBIGINT) AS BIGINT) AS a{i}" for i in range(3))


@query(
    f"""WITH f AS (SELECT s_suppkey, md5(CAST(s_suppkey AS VARCHAR)) AS fp FROM supplier),
 h AS (SELECT s_suppkey, fp, {S_LIMBS}, row_number() OVER (ORDER BY fp) - 1 AS k, count(*) OVER () AS n FROM f),
 p AS (SELECT h.*, o.fp AS other, CAST(h.a2 - o.a2 AS DOUBLE) * pow(16.0, -45) + CAST(h.a1 - o.a1 AS DOUBLE) * pow(16.0, -30)
  + CAST(h.a0 - o.a0 AS DOUBLE) * pow(16.0, -15) AS gap FROM h JOIN h o ON o.k = (h.k - 3 + h.n) % h.n)
 SELECT s_suppkey, CASE WHEN fp < other THEN gap + 1 ELSE gap END AS spread FROM p"""
)
def m10_ring_spread(spark, sf_dir):
    relays = table(spark, sf_dir, "supplier").select("s_suppkey", F.md5(F.col("s_suppkey").cast("string").cast("binary")).alias("fp"))
    return weights.ring_spread(relays).select("s_suppkey", "spread")


WEIGHTS = {"Wgd": 0.1, "Wgg": 0.6, "Wgm": 0.6, "Wmd": 0.2, "Wmg": 0.4, "Wme": 0.3, "Wmm": 1.0, "Wed": 0.7, "Weg": 0.5, "Wee": 0.9, "Wem": 0.8}


@query("""WITH r AS (SELECT s_suppkey % 2 = 0 AS g, s_suppkey % 3 = 0 AS e, s_suppkey % 5 > 0 AS st, s_acctbal + 1000 AS b, s_nationkey < 5 AS mine FROM supplier), w AS (SELECT *, unnest([{'p': 'g', 'w': b * CASE WHEN g AND e THEN 0.1 WHEN g THEN 0.6 WHEN NOT e THEN 0.6 ELSE 0.0 END}, {'p': 'm', 'w': b * CASE WHEN g AND e THEN 0.2 WHEN g THEN 0.4 WHEN e THEN 0.3 ELSE 1.0 END}, {'p': 'e', 'w': b * CASE WHEN g AND e THEN 0.7 WHEN g THEN 0.5 WHEN e THEN 0.9 ELSE 0.8 END}, {'p': 'i', 'w': CASE WHEN NOT st THEN 0.0 ELSE b * CASE WHEN g AND e THEN 0.2 WHEN g THEN 0.4 WHEN e THEN 0.3 ELSE 1.0 END END}]) AS x FROM r)
 SELECT x.p AS position, round(sum(x.w), 3) AS total, round(sum(CASE WHEN mine THEN x.w ELSE 0 END), 3) AS own FROM w GROUP BY 1""")
def a10_m11_weights(spark, sf_dir):
    k = F.col("s_suppkey")
    flags = F.array_compact(F.array(F.when(k % 2 == 0, "Guard"), F.when(k % 3 == 0, "Exit"), F.when(k % 5 > 0, "Stable")))
    relays = table(spark, sf_dir, "supplier").select(flags.alias("flags"), (F.col("s_acctbal") + 1000).alias("bandwidth"), (F.col("s_nationkey") < 5).alias("is_mine"))
    out = weights.position_fractions(relays, F.col("is_mine"), WEIGHTS)
    return out.select("position", F.round("total", 3).alias("total"), F.round("own", 3).alias("own"))


S_PATH = """items AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, CASE event_type WHEN 'click' THEN 'sActive' ELSE 'sDwell' END AS state, ['+', '-', '$', 'F'][event_id % 4 + 1] AS obs, event_id % 5000 AS delay FROM events)"""


@query(f"""WITH {S_PATH}, i AS (SELECT *, lead(state) OVER (PARTITION BY user_id ORDER BY pos) AS nxt, CASE WHEN delay < 1 THEN 0 ELSE CAST(round(ln(delay)) AS BIGINT) END AS ld FROM items), j AS (SELECT *, obs IN ('+', '-') OR (obs = '$' AND state LIKE '%Dwell%') AS lg, obs = '$' AND state LIKE '%Active%' AS ac FROM i),
 f AS (SELECT unnest([{{'c': 'PEmissionCount', 'n': 1}}, {{'c': 'PEmissionCount_' || state || '_' || obs, 'n': 1}}, {{'c': CASE WHEN lg THEN 'PLogDelayTime' END, 'n': ld}}, {{'c': CASE WHEN lg THEN 'PLogDelayTime_' || state || '_' || obs END, 'n': ld}}, {{'c': CASE WHEN lg THEN 'PSquaredLogDelayTime' END, 'n': ld * ld}}, {{'c': CASE WHEN lg THEN 'PSquaredLogDelayTime_' || state || '_' || obs END, 'n': ld * ld}},
  {{'c': CASE WHEN ac THEN 'PDelayTime' END, 'n': delay}}, {{'c': CASE WHEN ac THEN 'PDelayTime_' || state || '_' || obs END, 'n': delay}}, {{'c': CASE WHEN pos = 0 THEN 'PTransitionCount_START_' || state END, 'n': 1}}, {{'c': CASE WHEN nxt IS NOT NULL THEN 'PTransitionCount' END, 'n': 1}}, {{'c': 'PTransitionCount_' || state || '_' || nxt, 'n': 1}}]) AS q FROM j)
 SELECT q.c AS counter, CAST(sum(q.n) AS BIGINT) AS count FROM f WHERE q.c IS NOT NULL GROUP BY 1""")
def x16_path_counters(spark, sf_dir):
    """Each user's events as a path in the model's JSON, then counted."""
    e = table(spark, sf_dir, "events")
    item = F.concat(F.lit('["'), F.when(F.col("event_type") == "click", "sActive").otherwise("sDwell"), F.lit('";"'), F.element_at(F.array(*[F.lit(x) for x in "+-$F"]), (F.pmod("event_id", F.lit(4)) + 1).cast("int")), F.lit('";"'), F.pmod("event_id", F.lit(5000)), F.lit('"]'))
    paths = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items")).select("user_id", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ";"), F.lit("]")).alias("path"))
    return hmm.path_counters(paths, "path", "P").select("counter", F.col("count").cast("long").alias("count"))


@query("""SELECT event_type AS src, user_id % 4 AS dst, CASE WHEN sum(greatest(s, 0)) OVER (PARTITION BY event_type) > 0 THEN greatest(s, 0) / sum(greatest(s, 0)) OVER (PARTITION BY event_type) ELSE 0 END AS share FROM (SELECT event_type, user_id % 4 AS user_id, CAST(sum(CAST(floor(value) AS BIGINT) - 100) + 5000 AS DOUBLE) AS s FROM events GROUP BY 1, 2)""")
def a12_h2_shares(spark, sf_dir):
    t = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("src"), F.pmod("user_id", F.lit(4)).alias("dst")).agg((F.sum(F.floor("value").cast("long") - 100) + 5000).alias("n"))
    return hmm.shares(t, ["src"], "n").select("src", "dst", "share")


S_RESULTS = "results AS (SELECT p_brand AS counter, p_size % 5 AS bin_idx, p_type AS experiment, CAST(sum(CAST(floor(p_retailprice) AS BIGINT) - 900) AS DOUBLE) AS value, CAST(count(*) * 20 AS DOUBLE) AS sigma, 2.0 AS excess FROM part GROUP BY 1, 2, 3)"


def results(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("counter"), F.pmod("p_size", F.lit(5)).alias("bin_idx"), F.col("p_type").alias("experiment")).agg(F.sum(F.floor("p_retailprice").cast("long") - 900).cast("double").alias("value"), (F.count("*") * 20).cast("double").alias("sigma")).withColumn("excess", F.lit(2.0))


@query(f"""WITH {S_RESULTS}, e AS (SELECT *, round(2 * sqrt(excess * sigma * sigma)) AS error FROM results), f AS (SELECT *, CASE WHEN value <> 0 THEN error / abs(value) WHEN error > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END >= 1 AS noisy FROM e), g AS (SELECT *, min(CAST(noisy AS INTEGER)) OVER (PARTITION BY counter, bin_idx) AS hidden FROM f)
 SELECT counter, bin_idx, experiment, value, error, greatest(value, 0) AS bound_value, greatest(value - error, 0) AS error_low, greatest(value + error, 0) AS error_high, noisy AS is_noisy, value - error <= 0 AS is_possibly_zero FROM g WHERE hidden = 0""")
def r2_r6_reliability(spark, sf_dir):
    out = analysis.shown(analysis.with_errors(results(spark, sf_dir)))
    return out.select("counter", "bin_idx", "experiment", "value", "error", "bound_value", "error_low", "error_high", "is_noisy", "is_possibly_zero")


@query(f"WITH {S_RESULTS} SELECT counter, bin_idx, sum(value) AS value, sum(excess * sigma * sigma) AS variance, sum(excess) AS excess FROM results GROUP BY 1, 2")
def a9_totals(spark, sf_dir):
    return analysis.totals(results(spark, sf_dir))


@query("""SELECT counter, lo, hi, problem FROM (SELECT *, CASE WHEN lo >= hi THEN 'empty' WHEN before > lo THEN 'overlap' WHEN regexp_matches(counter, '(Count|DelayTime)$') <> (n = 1) THEN 'bin count' END AS problem FROM (SELECT *, count(*) OVER (PARTITION BY counter) AS n, lag(hi) OVER (PARTITION BY counter ORDER BY lo, hi) AS before FROM (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN 'Count' ELSE 'Histogram' END AS counter, CAST(s_suppkey AS DOUBLE) AS lo, CAST(s_suppkey + s_suppkey % 60 AS DOUBLE) AS hi FROM supplier JOIN nation ON s_nationkey = n_nationkey))) WHERE problem IS NOT NULL""")
def c1_bin_checks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "Count").otherwise("Histogram")).alias("counter"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("counter", F.col("s_suppkey").cast("double").alias("lo"), (F.col("s_suppkey") + F.pmod("s_suppkey", F.lit(60))).cast("double").alias("hi"))
    return binning.bins_in_error(s)


@query()
def n8_allocation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("counter"), (F.col("n_nationkey") + 1.0).alias("sensitivity"), (F.col("n_nationkey") * 1000 + 500.0).alias("estimated_value"))
    return privacy.allocate(n, 0.3, 1e-3, len(LISTS))


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS end_ts FROM events WHERE epoch(ts) BETWEEN 1704500000 AND 1705500000""")
def s4_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", seconds("ts").alias("end_ts"))
    return ev.replay(e, F.lit(1704500000.0), F.lit(1705500000.0)).select("event_id", F.floor("end_ts").cast("long").alias("end_ts"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey ELSE 999 END AS asn FROM customer""")
def m5_longest_prefix_ipv6(spark, sf_dir):
    """Every other nation has a /48 within one /32."""
    hexed = lambda c: F.lower(F.hex(c))
    nets = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("2001:db8:"), hexed("n_nationkey"), F.lit("::")).alias("net"), F.lit(48).alias("prefix_len"), F.col("n_nationkey").cast("long").alias("asn"))
    nets = nets.unionByName(spark.createDataFrame([("2001:DB8::", 32, 999)], "net string, prefix_len int, asn long"))
    # A key of 64 bits takes four groups; one of 16 bits is written as the last alone.
    k = F.col("c_custkey")
    groups = [hexed(F.shiftrightunsigned(k, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in (3, 2, 1, 0)]
    host = F.when(k.between(0, 0xFFFF), hexed(k)).otherwise(F.concat_ws(":", *groups))
    addresses = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("2001:db8:"), hexed("c_nationkey"), F.lit("::"), host).alias("address"))
    nets = nets.select(scalars.address_digits(F.col("net")).alias("digits"), "prefix_len", "asn")
    return matching.with_longest_prefix(addresses, nets, scalars.address_digits(F.col("address"))).select("c_custkey", "asn")


@query("""SELECT o_orderkey, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S UTC') AS moment, CASE WHEN t >= 604800 THEN t // 604800 || 'w ' ELSE '' END || CASE WHEN t >= 86400 THEN t // 86400 % 7 || 'd ' ELSE '' END || CASE WHEN t >= 3600 THEN t // 3600 % 24 || 'h ' ELSE '' END || CASE WHEN t >= 60 THEN t // 60 % 60 || 'm ' ELSE '' END || t % 60 || 's' AS period FROM (SELECT o_orderkey, o_custkey * 977 AS t FROM orders)""")
def f18_times(spark, sf_dir):
    t = F.col("o_custkey") * 977
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.moment(t).alias("moment"), scalars.period(t).alias("period"))


@query("""SELECT s_name AS counter FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 3 = 2""")
def st5_changed_noise(spark, sf_dir):
    """Noise falls by 0, 1 or 2, of which 1.5 is tolerated; some counters are gone."""
    s = table(spark, sf_dir, "supplier")
    proposed = s.where("s_suppkey % 10 > 0").select(F.col("s_name").alias("counter"), (5000.0 - F.col("s_suppkey") % 3).alias("sigma"))
    return rounds.changes(s.select(F.col("s_name").alias("counter"), F.lit(5000.0).alias("sigma")), proposed, 1.5).select("counter")


@query("""WITH t AS (SELECT DISTINCT CASE WHEN n_regionkey = 0 THEN 'START' ELSE 's' || n_regionkey END AS src, n_name AS dst, n_nationkey % 4 > 0 AS has FROM nation), e AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'sActive' WHEN 1 THEN 'sDwell' ELSE 'sEnd' END || n_nationkey AS s, ['+', '-', '$', 'F'][n_nationkey % 4 + 1] AS o FROM nation),
 k AS (SELECT s, o, unnest(CASE WHEN o IN ('+', '-') OR (o = '$' AND s LIKE '%Dwell%') THEN ['EmissionCount', 'LogDelayTime', 'SquaredLogDelayTime'] WHEN o = '$' AND s LIKE '%Active%' THEN ['EmissionCount', 'DelayTime'] ELSE ['EmissionCount'] END) AS kind FROM e)
 SELECT 'M' || kind || '_' || s || '_' || o AS counter, 'M' || kind || '_<STATE>_<OBS>' AS template FROM k UNION ALL SELECT 'MTransitionCount_' || src || '_' || dst, CASE src WHEN 'START' THEN 'MTransitionCount_START_<STATE>' ELSE 'MTransitionCount_<SRCSTATE>_<DSTSTATE>' END FROM t WHERE has
 UNION ALL SELECT 'M' || c, 'M' || c FROM (SELECT unnest(['StreamCount', 'EmissionCount', 'TransitionCount', 'DelayTime', 'LogDelayTime', 'SquaredLogDelayTime']) AS c)""")
def h3_model_counters(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    moves = n.select(F.when(F.col("n_regionkey") == 0, "START").otherwise(F.concat(F.lit("s"), "n_regionkey")).alias("src"), F.col("n_name").alias("dst"), (k % 4 / 4).alias("p"))
    sent = n.select(F.concat(F.when(k % 3 == 0, "sActive").when(k % 3 == 1, "sDwell").otherwise("sEnd"), k).alias("state"), F.element_at(F.array(*[F.lit(o) for o in "+-$F"]), (k % 4 + 1).cast("int")).alias("obs"))
    return hmm.model_counters(spark, "M", moves, sent).select("counter", "template")


@query("""WITH f AS (SELECT CAST(floor((epoch(ts) - 1704067200) / 86400) AS BIGINT) AS round, user_id % 5 AS party, event_type AS counter, CAST(floor(value) AS BIGINT) - 50 AS n FROM events WHERE epoch(ts) >= 1704067200),
 held AS (SELECT round, count(DISTINCT party) AS parties FROM f GROUP BY 1 HAVING count(DISTINCT CASE WHEN party < 3 THEN party END) >= 2 AND count(DISTINCT CASE WHEN party >= 3 THEN party END) >= 1)
 SELECT round, counter, 0 AS bin_idx, CAST(sum(n) AS DECIMAL(38,0)) AS count FROM f JOIN held USING (round) WHERE round < 20 GROUP BY round, counter, parties HAVING count(DISTINCT party) = parties""")
def st4_round_tallies(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(rounds.round_of(seconds("ts"), 1704067200.0, 86400.0, 20).alias("round"), F.pmod("user_id", F.lit(5)).alias("party"), F.col("event_type").alias("counter"), (F.floor("value").cast("long") - 50).alias("n")).where("round is not null")
    facts = e.groupBy("round", "party", (F.col("party") >= 3).alias("is_keeper"), "counter", F.lit(0).alias("bin_idx")).agg(binning.modular_sum(F.col("n")).alias("count"))
    return rounds.round_tallies(facts, 2, 1).drop("early")


from veilcount.plans import history_queries, log_queries, server_queries, value_queries  # noqa: E402, F401  some of their SQL builds on that of the queries above

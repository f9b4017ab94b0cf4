"""Queries over runs and rounds: round delays, relays' metadata, client sketches, models, files of results and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilcount.checkpoints import shared_path
from veilcount.functions import scalars
from veilcount.operators import hmm, matching, privacy, relays, rounds, state
from veilcount.plans.registry import query, seconds, table
from veilcount.sources import consensus, results
from veilcount.sources import events as ev

DELAY, RTT, TOLERANCE = 100.0, 2.0, 1.0


@query(
    f"""WITH RECURSIVE a AS (SELECT CAST(o_custkey AS VARCHAR) AS deployment, o_orderkey AS round, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k,
  o_orderkey * 0.1 AS s, o_orderkey * 0.1 + 0.05 AS e, o_orderstatus <> 'P' AS ok, o_orderkey % 7 = 0 AS more, 10 - (o_orderkey % 5) * 0.6 AS sigma FROM orders),
 f AS (SELECT deployment, round, k, CAST(0 AS DOUBLE) AS next_start, true AS permitted, CASE WHEN ok THEN round END AS baseline,
  CASE WHEN ok THEN more END AS base_more, CASE WHEN ok THEN sigma END AS base_sigma, CASE WHEN ok THEN e END AS last_end FROM a WHERE k = 1
 UNION ALL SELECT a.deployment, a.round, a.k, n.next_start, a.s >= n.next_start, CASE WHEN a.ok AND n.changed THEN a.round ELSE f.baseline END,
  CASE WHEN a.ok AND n.changed THEN a.more ELSE f.base_more END, CASE WHEN a.ok AND n.changed THEN a.sigma ELSE f.base_sigma END, CASE WHEN a.ok THEN a.e ELSE f.last_end END
 FROM f JOIN a ON a.deployment = f.deployment AND a.k = f.k + 1,
 LATERAL (SELECT f.baseline IS NULL OR a.more <> f.base_more OR a.sigma < f.base_sigma - {TOLERANCE} AS changed, CASE WHEN f.last_end IS NULL THEN 0
  ELSE f.last_end + CASE WHEN a.more <> f.base_more OR a.sigma < f.base_sigma - {TOLERANCE} THEN {DELAY} + {RTT} ELSE 0 END END AS next_start) n)
 SELECT deployment, round, CAST(next_start AS DOUBLE) AS next_start, permitted, baseline FROM f"""
)
def st5_history(spark, sf_dir):
    """ST5, F25: each customer's orders as rounds; their noise falls and rises in steps, and some count one thing more."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    own = o.select(F.col("o_custkey").cast("string").alias("deployment"), k.alias("round"), (k * F.lit(0.1)).alias("start"), (k * F.lit(0.1) + 0.05).alias("end"), (F.col("o_orderstatus") != "P").alias("succeeded"))
    sigma = F.lit(10) - F.pmod(k, F.lit(5)) * F.lit(0.6)
    names = F.array_compact(F.array(F.lit("A"), F.lit("B"), F.when(F.pmod(k, F.lit(7)) == 0, "C")))
    sigmas = o.select(F.col("o_custkey").cast("string").alias("deployment"), k.alias("round"), F.explode(names).alias("counter"), sigma.cast("double").alias("sigma"))
    return rounds.history(own, sigmas, DELAY, RTT, tolerance=TOLERANCE)


S_FACTS = """f AS (SELECT s_nationkey AS relay, s_suppkey AS seq, ['nickname', 'orport', 'version', 'address', 'fingerprint', 'flags'][s_suppkey % 6 + 1] AS field,
 CASE s_suppkey % 6 WHEN 0 THEN CASE WHEN s_suppkey % 9 = 0 THEN 'bad name' ELSE ' Relay' || s_suppkey % 4 || ' ' END WHEN 1 THEN (9000 + s_suppkey % 3) || ''
  WHEN 2 THEN 'Tor version 0.' || s_suppkey % 5 WHEN 3 THEN '192.0.2.' || CASE WHEN s_suppkey % 15 = 0 THEN 'x' ELSE (s_suppkey % 7) || '' END
  WHEN 4 THEN CASE WHEN s_suppkey % 10 = 0 THEN 'short' ELSE repeat(['A', 'b', '0'][s_suppkey % 3 + 1], 40) END ELSE CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE 'Exit Fast' || s_suppkey % 2 END END AS value FROM supplier)"""


@query(
    rf"""WITH {S_FACTS}, c AS (SELECT *, CASE WHEN regexp_full_match(v, p) THEN v END AS clean FROM (SELECT *, trim(CASE field WHEN 'version' THEN regexp_replace(value, '^.*?version', '') ELSE value END) AS v,
  CASE field WHEN 'nickname' THEN '[A-Za-z0-9]{{0,19}}' WHEN 'address' THEN '[0-9.]{{7,15}}' WHEN 'fingerprint' THEN '[0-9A-Fa-f]{{40}}' ELSE '.*' END AS p FROM f)),
 m AS (SELECT *, CASE field WHEN 'fingerprint' THEN first_value(clean) OVER w WHEN 'orport' THEN NULL ELSE lag(clean) OVER w END AS kept FROM c WHERE clean IS NOT NULL
  WINDOW w AS (PARTITION BY relay, field ORDER BY seq)),
 g AS (SELECT relay, field, CASE field WHEN 'fingerprint' THEN arg_min(clean, seq) WHEN 'orport' THEN string_agg(DISTINCT clean, ', ' ORDER BY clean) ELSE arg_max(clean, seq) END AS value,
  count(*) AS accepted, count(*) FILTER (WHERE kept <> clean) AS changes FROM m GROUP BY 1, 2)
 SELECT relay, field, g.value AS value, coalesce(accepted, 0) AS accepted, rejected, coalesce(changes, 0) AS changes
 FROM (SELECT relay, field, count(*) FILTER (WHERE value IS NOT NULL AND clean IS NULL) AS rejected FROM c GROUP BY 1, 2) LEFT JOIN g USING (relay, field)"""
)
def v11_relay_metadata(spark, sf_dir):
    """Suppliers as what the relays of their nations say of themselves, some of it unsound."""
    k = F.col("s_suppkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    field = F.element_at(F.array(*[F.lit(x) for x in ("nickname", "orport", "version", "address", "fingerprint", "flags")]), (mod(6) + 1).cast("int"))
    digit = F.element_at(F.array(*[F.lit(x) for x in "Ab0"]), (mod(3) + 1).cast("int"))
    value = F.when(mod(6) == 0, F.when(mod(9) == 0, "bad name").otherwise(F.concat(F.lit(" Relay"), mod(4), F.lit(" "))))
    value = value.when(mod(6) == 1, (mod(3) + 9000).cast("string")).when(mod(6) == 2, F.concat(F.lit("Tor version 0."), mod(5)))
    value = value.when(mod(6) == 3, F.concat(F.lit("192.0.2."), F.when(mod(15) == 0, "x").otherwise(mod(7).cast("string"))))
    value = value.when(mod(6) == 4, F.when(mod(10) == 0, "short").otherwise(F.repeat(digit, 40)))
    value = value.otherwise(F.when(mod(4) != 3, F.concat(F.lit("Exit Fast"), mod(2))))
    facts = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("relay"), k.alias("seq"), field.alias("field"), value.alias("value"))
    return relays.relay_metadata(facts)


@query(
    """WITH e AS (SELECT user_id AS ip, value > 50 AS active, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS w, CAST(floor(epoch(ts)) AS BIGINT) - event_id % 90000 < CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS earlier FROM events),
 r AS (SELECT ip, active, w FROM e UNION ALL SELECT ip, active, w - 1 FROM e WHERE earlier)
 SELECT w, count(DISTINCT ip) AS clients, count(DISTINCT ip) FILTER (WHERE active) AS active_clients, true AS within, true AS active_within FROM r GROUP BY 1"""
)
def a6_client_sketches(spark, sf_dir):
    """Distinct clients of all parties by window, exact, and whether united sketches of four parties are within their error."""
    at = F.floor(seconds("ts")).cast("long")
    party = F.concat(F.lit("dc"), F.pmod("event_id", F.lit(4)))
    closes = table(spark, sf_dir, "events").select(party.alias("party"), F.col("user_id").alias("ip"), (F.col("value") > 50).alias("active"), at.alias("ts"), (at - F.pmod("event_id", F.lit(90000))).alias("created"))
    exact = state.rotation(closes.drop("party"), 86400).select("w", "clients", "active_clients")
    told = state.estimated_clients(state.client_sketches(closes, 86400), "w").withColumnsRenamed({"clients": "about", "active_clients": "active_about"})
    near = lambda a, n: (F.abs(F.col(a) - F.col(n)) <= F.col("error") * F.col(n))
    return exact.join(told, "w").select("w", "clients", "active_clients", near("about", "clients").alias("within"), near("active_about", "active_clients").alias("active_within"))


S_MOVES = "SELECT event_type AS src, CAST(user_id % 4 AS VARCHAR) AS dst, sum(CAST(floor(value) AS BIGINT) - 60) AS n FROM events GROUP BY 1, 2"


@query(
    f"""WITH t AS ({S_MOVES}), m AS (SELECT src, dst, 0.25 AS p, greatest(n, 0) AS n FROM t),
 s AS (SELECT *, 0.5 * p + 0.5 * CASE WHEN sum(n) OVER (PARTITION BY src) > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src) ELSE 0 END AS mixed FROM m)
 SELECT src, dst, mixed / sum(mixed) OVER (PARTITION BY src) AS p FROM s"""
)
def h4_transitions(spark, sf_dir):
    """Transitions blended with tallies, of which some are negative."""
    e = table(spark, sf_dir, "events")
    tallies = e.groupBy(F.col("event_type").alias("src"), F.pmod("user_id", F.lit(4)).cast("string").alias("dst")).agg(F.sum(F.floor("value").cast("long") - 60).alias("n"))
    return hmm.updated_transitions(tallies.select("src", "dst", F.lit(0.25).alias("p")), tallies)


@query(
    """WITH i AS (SELECT CASE event_type WHEN 'click' THEN 'sActive' ELSE 'sDwell' END AS state, ['+', '-', '$', 'F'][event_id % 4 + 1] AS obs, event_id % 5000 AS d,
  CASE WHEN event_id % 5000 < 1 THEN 0 ELSE round(ln(event_id % 5000)) END AS l FROM events),
 t AS (SELECT state, obs, count(*) AS n, sum(l) AS ld, sum(l * l) AS sq, sum(d) AS d, obs IN ('+', '-') OR (obs = '$' AND state = 'sDwell') AS lg, obs = '$' AND state = 'sActive' AS pl FROM i GROUP BY 1, 2),
 u AS (SELECT *, CASE WHEN ld > 0 THEN ld / n ELSE 0 END AS mu1, CASE WHEN sq > 0 THEN sq / n - (CASE WHEN ld > 0 THEN ld / n ELSE 0 END) ** 2 ELSE 0 END AS var, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY state) AS share FROM t)
 SELECT state, obs, CASE WHEN lg OR pl THEN 0.5 * 0.25 + 0.5 * share ELSE 0.25 END AS dp, CASE WHEN lg THEN 0.5 * 1.5 + 0.5 * mu1 WHEN pl THEN 0 ELSE 1.5 END AS mu,
  CASE WHEN lg THEN 0.5 * 2.5 + 0.5 * CASE WHEN var < 0.1 THEN 0.01 ELSE sqrt(var) END WHEN pl THEN 0 ELSE 2.5 END AS sigma, CASE WHEN pl THEN CASE WHEN d > 0 THEN 1 / (0.5 / 0.1 + 0.5 / (n / d)) ELSE 0.1 END WHEN lg THEN 0 ELSE 0.1 END AS lam FROM u"""
)
def h4_emissions(spark, sf_dir):
    """H4: emissions' shares, log delays and rates blended with tallies of events."""
    delay = F.pmod("event_id", F.lit(5000))
    obs = F.element_at(F.array(*[F.lit(x) for x in "+-$F"]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    i = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "sActive").otherwise("sDwell").alias("state"), obs.alias("obs"), delay.alias("d"), hmm.log_delay(delay).alias("l"))
    tallies = i.groupBy("state", "obs").agg(F.count("*").alias("n"), F.sum("l").alias("ld"), F.sum(F.col("l") * F.col("l")).alias("sq"), F.sum("d").alias("d"))
    model = tallies.select("state", "obs", F.lit(0.25).alias("dp"), F.lit(1.5).alias("mu"), F.lit(2.5).alias("sigma"), F.lit(0.1).alias("lam"))
    return hmm.updated_emissions(model, tallies)


@query(
    """SELECT 'outcome.1-9.json' AS experiment, n_name AS counter, CAST(r AS INTEGER) AS bin_idx, CAST(r AS DOUBLE) AS lo, CASE r WHEN 2 THEN CAST('inf' AS DOUBLE) ELSE r + 1.0 END AS hi,
 CAST(n_nationkey * 1180591620717411303424 + r AS DECIMAL(38,0)) AS value, n_nationkey + 0.5 AS sigma, 3.0 AS excess FROM nation, (SELECT unnest([0, 1, 2]) AS r)"""
)
def s10_k1_results(spark, sf_dir):
    """Counts beyond 64 bits as an outcome in the shared folder, read back with their noise."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("counter"), "n_nationkey", F.explode(F.array(*map(F.lit, range(3)))).alias("bin_idx"))
    hi = F.when(F.col("bin_idx") == 2, F.lit(float("inf"))).otherwise(F.col("bin_idx") + 1.0)
    value = F.col("n_nationkey").cast("decimal(5,0)") * scalars.whole(2**70).cast("decimal(22,0)") + F.col("bin_idx")
    found = n.select("counter", "bin_idx", F.col("bin_idx").cast("double").alias("lo"), hi.alias("hi"), value.cast("decimal(38,0)").alias("value"))
    noise = table(spark, sf_dir, "nation").select(F.col("n_name").alias("counter"), (F.col("n_nationkey") + 0.5).cast("double").alias("sigma"))
    context = results.context_of(noise, {"excess_noise_ratio": 3.0}, 1.0, 8.0, 9.0)
    path = results.write_outcome(found, context, shared_path(spark, "results"), 1.0, 9.0)
    read = results.read_results(spark, path)
    return read.withColumn("experiment", F.lit(path.rsplit("/", 1)[1]))


@query(
    """WITH r AS (SELECT s_suppkey AS k, s_nationkey % 3 AS doc FROM supplier) SELECT CAST(doc AS BIGINT) AS doc, 'r' || k AS nickname, upper(substr(md5('relay' || k) || md5('relay' || k), 1, 40)) AS fp, '192.0.2.' || k % 250 AS address,
 list_filter([CASE WHEN k % 2 = 0 THEN 'Guard' END, CASE WHEN k % 3 = 0 THEN 'Exit' END], lambda x: x IS NOT NULL) AS flags, CASE WHEN k % 7 > 0 THEN k * 10 END AS bandwidth, k % 3 = 0 AS exits, 2 AS links FROM r"""
)
def s11_consensus(spark, sf_dir):
    """Suppliers as relays of three consensus documents, written to the shared folder and read back."""
    k = F.col("s_suppkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    digest = F.substring(F.concat(F.md5(F.concat(F.lit("relay"), k)), F.md5(F.concat(F.lit("relay"), k))), 1, 40)
    named = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    lines = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit("r"), F.concat(F.lit("r"), k), named, F.lit("digest 2024-01-01 00:00:00"), F.concat(F.lit("192.0.2."), mod(250)), F.lit("9001 0")),
        F.concat_ws(" ", F.lit("s"), F.when(mod(2) == 0, "Guard"), F.when(mod(3) == 0, "Exit")),
        F.lit("v Tor 0.4.8"),
        F.lit("pr Cons=1-2 Link=1-5"),
        F.when(mod(7) > 0, F.concat(F.lit("w Bandwidth="), k * 10)),
        F.when(mod(3) == 0, "p accept 80,443").otherwise("p reject 1-65535"),
    )
    relays_of = table(spark, sf_dir, "supplier").select(F.pmod("s_nationkey", F.lit(3)).cast("long").alias("doc"), lines.alias("value"), k.alias("place"))
    heads = relays_of.select("doc").distinct().select("doc", F.lit("network-status-version 3\nvote-status consensus").alias("value"), F.lit(-1).cast("long").alias("place"))
    path = shared_path(spark, "consensus")
    relays_of.unionByName(heads).repartition(3, "doc").sortWithinPartitions("doc", "place").drop("place").write.partitionBy("doc").text(path)
    read = consensus.read_relays(spark, f"{path}/doc=*/*.txt")
    doc = F.regexp_extract("document", r"doc=(\d+)", 1).cast("long")
    return read.select(doc.alias("doc"), "nickname", "fp", "address", "flags", "bandwidth", "exits", F.size("protocols").alias("links"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 0 ELSE CAST('inf' AS DOUBLE) END AS list_idx FROM events"""
)
def m3_onion_match(spark, sf_dir):
    """Names listed plain, as MD5, or not at all."""
    name = F.concat(F.lit("name"), F.pmod("event_id", F.lit(3)), F.lit("aaaaaaaaaaa"))
    e = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    plain = spark.createDataFrame([(1, "name0aaaaaaaaaaa"), (2, "NAME1aaaaaaaaaaa")], "list_idx int, item string")
    hashed = spark.createDataFrame([("name1aaaaaaaaaaa",)], "name string").select(F.lit(0).alias("list_idx"), scalars.onion_md5(F.col("name")).alias("item"))
    return matching.onion_match(e, plain.unionByName(hashed), ["event_id"], "name")


@query(
    """SELECT n_name AS counter, CAST(n_regionkey AS DOUBLE) AS lo, n_regionkey + 1.0 AS hi, n_nationkey + 0.5 AS sigma FROM nation
 WHERE n_nationkey % 4 > 0 AND n_nationkey % 5 > 0 AND n_nationkey % 3 > 0"""
)
def p9_p11_combined(spark, sf_dir):
    """Bins and sigmas that counters have both of; parts that are missing are left out."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    bins = n.select(F.col("n_name").alias("counter"), F.when(k % 4 > 0, F.col("n_regionkey").cast("double")).alias("lo"), (F.col("n_regionkey") + 1.0).alias("hi"))
    sigmas = n.where("n_nationkey % 3 > 0").select(F.col("n_name").alias("counter"), F.when(k % 5 > 0, k + 0.5).alias("sigma"))
    return matching.combine_counters(bins, sigmas)


@query(
    """WITH e AS (SELECT event_id, event_id % 4 AS k, (event_id % 997) * 10.5 AS a, (event_id % 997) * 10.5 + event_id % 50 AS b FROM events),
 t AS (SELECT event_id, CASE k WHEN 1 THEN b ELSE a END AS start_ts, b AS end_ts FROM e WHERE k < 3)
 SELECT event_id, 9000.0 - (end_ts - start_ts) AS start_ts, 9000.0 AS end_ts FROM t WHERE start_ts >= 500"""
)
def s5_st6_times(spark, sf_dir):
    """S5, ST6: times of positional and tagged events; what began before 500 is left out, the rest ends at 9000."""
    k, a = F.pmod("event_id", F.lit(4)), F.pmod("event_id", F.lit(997)) * 10.5
    b = a + F.pmod("event_id", F.lit(50))
    text = lambda c: F.format_string("%.1f", c)
    code = F.when(k == 0, "STREAM_ENDED").when(k == 1, "STREAM_BYTES_TRANSFERRED").when(k == 2, "CIRCUIT_CLOSE").otherwise("CIRCUIT_CLOSE")
    positional = F.when(k == 0, F.concat_ws(" ", F.lit("1 1 1 80 5 5"), text(a), text(b), F.lit("h 192.0.2.1 1"))).when(k == 1, F.concat(F.lit("1 1 1 0 5 "), text(b)))
    tags = F.when(k == 2, F.concat(F.lit("CreatedTimestamp="), text(a), F.lit(" EventTimestamp="), text(b)))
    e = table(spark, sf_dir, "events").select("event_id", code.alias("code"), F.split(F.coalesce(positional, tags, F.lit("")), " ").alias("fields"))
    timed = ev.with_times(e.withColumn("tags", F.when(F.col("code") == "CIRCUIT_CLOSE", ev.tagged(F.col("fields")))))
    return ev.moved_to(ev.begun_after(timed, F.lit(500.0)), F.lit(9000.0)).select("event_id", "start_ts", "end_ts")


@query(
    """WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k, 'item' || k AS item, CAST(167772160 + k * 65536 AS BIGINT) AS net, 4 AS ipver, lower(printf('0a%02x0000', k)) AS digits, 16 AS prefix_len, 64500 + k AS asn FROM n WHERE k % 5 > 0"""
)
def s6_s7_lists(spark, sf_dir):
    """Lists and prefix maps with comments and blank lines, written as text and read back."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    k = F.col("n_nationkey")
    note = F.element_at(F.array(*[F.lit(x) for x in ("# {}", "// {}", "; {}", "", "  ")]), (F.floor(k / 5) % 5 + 1).cast("int"))
    item = F.when(k % 5 > 0, F.concat(F.lit(" Item"), k, F.lit(" "))).otherwise(note)
    net = F.when(k % 5 > 0, F.concat(F.lit("10."), k, F.lit(".0.0/16\t"), k + 64500)).otherwise(note)
    paths = [shared_path(spark, x) for x in ("items", "nets")]
    for c, path in zip((item, net), paths, strict=True):
        n.select(c.alias("value")).write.text(path)
    items = matching.load_list(spark.read.text(paths[0])).select(F.regexp_extract("item", r"(\d+)", 1).cast("long").alias("k"), "item")
    nets = matching.load_prefixes(spark.read.text(paths[1])).withColumn("k", F.col("asn") - 64500)
    return items.join(nets, "k").select("k", "item", "net", "ipver", "digits", "prefix_len", "asn")


NOISED, SIGMA = 400, 50.0


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS party, true AS centred, true AS spread, true AS whole FROM supplier GROUP BY 1""")
def n9_n10_noise(spark, sf_dir):
    """Rounded noise of each party by its weight, seeded: mean and deviation within 6 standard errors, all integers."""
    parties = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("party")).distinct()
    bins = parties.select("party", F.lit("C").alias("counter"), F.explode(F.sequence(F.lit(0), F.lit(NOISED - 1))).alias("bin_idx"), F.lit(0).cast("decimal(38,0)").alias("count"))
    weights = parties.select("party", (F.col("party").cast("int") % 4 / 4 + 0.25).alias("weight"))
    sigmas = spark.createDataFrame([("C", SIGMA)], "counter string, sigma double")
    noisy = privacy.noised(bins, sigmas, weights, seed=7).withColumn("count", scalars.signed(F.col("count")))
    found = noisy.groupBy("party").agg(F.avg(F.col("count").cast("double")).alias("mean"), F.stddev(F.col("count").cast("double")).alias("sd"), F.count("*").alias("n")).join(weights, "party")
    s = F.col("weight") * SIGMA
    centred = F.abs("mean") <= 6 * s / NOISED**0.5
    spread = F.abs(F.col("sd") - s) <= 6 * s / (2 * NOISED) ** 0.5
    return found.select("party", centred.alias("centred"), spread.alias("spread"), (F.col("n") == NOISED).alias("whole"))

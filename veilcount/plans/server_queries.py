"""Queries of what a tally server knows: its clients and their contexts, the events and names that counters need."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilcount.checkpoints import shared_path
from veilcount.operators import binning, clients, hmm
from veilcount.plans import catalog
from veilcount.plans.registry import ORACLE_SQL, query, seconds, table
from veilcount.sources import config, results

NOW, START, CHECKIN, PADDING = 1706640000.0, 1704067200.0, 3600.0, 2.0

#: Events as statuses of their users; most leave something out.
S_REGISTRY = f"""e AS (SELECT user_id AS client, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS alive,
  CASE WHEN user_id % 4 = 0 THEN '{clients.KEEPER}' ELSE '{clients.COLLECTOR}' END AS kind,
  CASE WHEN event_id % 11 > 0 THEN CASE WHEN event_id % 5 < 3 THEN 'active' ELSE 'idle' END END AS state,
  CASE WHEN event_id % 13 = 0 THEN '0.' || event_id % 7 END AS version,
  CASE WHEN event_id % 17 = 0 THEN floor(epoch(ts)) - 5.0 END AS last_event,
  CASE WHEN event_id % 6 = 0 THEN CAST(event_id % 3 + 0.5 AS DOUBLE) END AS rtt, CASE WHEN event_id % 9 = 0 THEN 'f' || event_id END AS fingerprint FROM events),
 l AS (SELECT client, max(seq) AS seq, arg_max(alive, seq) AS alive, max(kind) AS kind, arg_max(state, seq) FILTER (WHERE state IS NOT NULL) AS state,
  arg_max(version, seq) FILTER (WHERE version IS NOT NULL) AS version, arg_max(last_event, seq) FILTER (WHERE last_event IS NOT NULL) AS last_event,
  arg_max(rtt, seq) FILTER (WHERE rtt IS NOT NULL) AS rtt, arg_min(fingerprint, seq) FILTER (WHERE fingerprint IS NOT NULL) AS fingerprint FROM e GROUP BY 1),
 b AS (SELECT client, max(e.seq) AS before FROM e JOIN l USING (client) WHERE e.state <> l.state GROUP BY 1),
 w AS (SELECT client, arg_min(alive, seq) AS since FROM e LEFT JOIN b USING (client) WHERE state IS NOT NULL AND (before IS NULL OR seq > before) GROUP BY 1),
 h AS (SELECT *, kind <> '{clients.COLLECTOR}' OR version IS NOT NULL OR {NOW - START - PADDING - clients.CONTROL_SECONDS - CHECKIN} <= trip AS control_ok,
  kind <> '{clients.COLLECTOR}' OR {NOW} - coalesce(last_event, {START + PADDING}) <= {clients.EVENT_SECONDS + 2 * CHECKIN} + trip AS event_recent,
  {NOW} - alive > {clients.LATE * CHECKIN} + trip AS late, {NOW} - alive > {clients.DEAD * CHECKIN} + trip AS dead
  FROM (SELECT *, coalesce(rtt, {clients.ROUND_TRIP}) + {clients.JITTER} AS trip FROM l LEFT JOIN w USING (client)))"""


def registered(spark, sf_dir):
    e = lambda n: F.pmod("event_id", F.lit(n))
    alive = F.floor(seconds("ts")).cast("long")
    statuses = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("client"),
        F.col("event_id").alias("seq"),
        alive.alias("alive"),
        F.when(F.pmod("user_id", F.lit(4)) == 0, clients.KEEPER).otherwise(clients.COLLECTOR).alias("kind"),
        F.when(e(11) > 0, F.when(e(5) < 3, "active").otherwise("idle")).alias("state"),
        F.when(e(13) == 0, F.concat(F.lit("0."), e(7))).alias("version"),
        F.when(e(17) == 0, alive - 5.0).alias("last_event"),
        F.when(e(6) == 0, e(3) + 0.5).alias("rtt"),
        F.when(e(9) == 0, F.concat(F.lit("f"), "event_id")).alias("fingerprint"),
    )
    return clients.with_health(clients.registry(statuses), NOW, CHECKIN, START, PADDING)


@query(f"WITH {S_REGISTRY} SELECT * EXCLUDE (trip) FROM h")
def p12_registry(spark, sf_dir):
    """Each user as a client: what it said last, since when it is in its state, and whether it is well."""
    return registered(spark, sf_dir)


@query(
    f"""WITH {S_REGISTRY} SELECT client % 20 AS deployment, count(*) FILTER (WHERE kind = '{clients.COLLECTOR}' AND state = 'idle') AS collectors_idle,
 count(*) FILTER (WHERE kind = '{clients.COLLECTOR}' AND state = 'active') AS collectors_active, count(*) FILTER (WHERE kind = '{clients.KEEPER}' AND state = 'idle') AS keepers_idle,
 count(*) FILTER (WHERE kind = '{clients.KEEPER}' AND state = 'active') AS keepers_active, count(*) FILTER (WHERE kind = '{clients.COLLECTOR}' AND state = 'active' AND version IS NOT NULL) AS collectors_control,
 count(*) FILTER (WHERE kind = '{clients.COLLECTOR}' AND state = 'active' AND version IS NOT NULL AND event_recent) AS collectors_event FROM h GROUP BY 1"""
)
def p12_round_counts(spark, sf_dir):
    """Clients by kind and state of each of 20 deployments."""
    found = registered(spark, sf_dir).withColumn("deployment", F.pmod("client", F.lit(20)))
    return clients.round_counts(found, "deployment")


ASKED = ["EntryConnectionCount", "HSDir3StoreCount"]


@query("SELECT s_suppkey, s_suppkey % 2 = 0 OR s_suppkey % 7 = 0 AS expected FROM supplier")
def p13_expected_events(spark, sf_dir):
    """Relays by their flags, for counters of guards and of the third version's directories."""
    names = {"Guard": 2, "Exit": 3, "HSDir": 5, "HSDir3": 7}
    flags = F.array_compact(F.array(*[F.when(F.pmod("s_suppkey", F.lit(n)) == 0, f) for f, n in names.items()]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", catalog.events_expected(ASKED, flags).alias("expected"))


#: Counters of several families, one that needs nothing; then names of a round's own, of which some are registered.
FAMILIES = ("ExitWebStreamByteHistogram", "EntryConnectionCount", "HSDir2StoreCount", "ExitCircuitWebStreamHistogram", "ZeroCount")


@query(
    f"""WITH a AS (SELECT DISTINCT c_nationkey, c_custkey % 6 AS k FROM customer WHERE c_custkey % 9 < 4 OR c_nationkey % 3 = 0),
 n AS (SELECT c_nationkey, k, CASE k WHEN 0 THEN ['STREAM_ENDED'] WHEN 1 THEN ['CONNECTION_CLOSE'] WHEN 2 THEN ['HSDIR_CACHE_STORE']
  WHEN 3 THEN ['STREAM_ENDED', 'CIRCUIT_CLOSE'] WHEN 5 THEN CASE WHEN c_nationkey % 2 = 0 THEN ['CIRCUIT_CLOSE'] END END AS events FROM a)
 SELECT c_nationkey, coalesce(string_agg(DISTINCT event, ',' ORDER BY event), '') AS events, coalesce(bool_or(event IN ('STREAM_ENDED', 'CIRCUIT_CLOSE')), false) AS sampled,
  coalesce(max(CASE WHEN k = 5 AND c_nationkey % 2 > 0 THEN 'Own' || c_nationkey END), '') AS unknown
 FROM (SELECT c_nationkey, k, unnest(coalesce(events, [NULL])) AS event FROM n) GROUP BY 1"""
)
def p14_p16_needed_events(spark, sf_dir):
    """Each nation's customers ask for counters; even nations' own names are registered, with an event that nobody sends."""
    own = F.concat(F.lit("Own"), "c_nationkey")
    counter = F.coalesce(F.get(F.array(*map(F.lit, FAMILIES)), F.pmod("c_custkey", F.lit(6)).cast("int")), own)
    chosen = (F.pmod("c_custkey", F.lit(9)) < 4) | (F.pmod("c_nationkey", F.lit(3)) == 0)
    asked = table(spark, sf_dir, "customer").where(chosen).select("c_nationkey", counter.alias("counter"))
    more = catalog.registered({f"Own{n}": {"CIRCUIT_CLOSE", "NOBODY_SENDS"} for n in range(0, 25, 2)})
    found = catalog.needed_events(asked, ["c_nationkey"], more)
    return found.select("c_nationkey", F.array_join("events", ",").alias("events"), "sampled", F.array_join("unknown", ",").alias("unknown"))


@query(
    """WITH s AS (SELECT DISTINCT 's' || n_regionkey || CASE WHEN n_regionkey % 2 = 0 THEN 'Dwell' ELSE 'Active' END AS s FROM nation),
 p AS (SELECT * FROM (VALUES ('ExitStreamTrafficModel', 'VITERBI_PACKETS', ['+', '-', 'F']), ('ExitCircuitTrafficModel', 'VITERBI_STREAMS', ['$', 'F'])) AS v(p, event, obs)),
 o AS (SELECT p, event, s, unnest(obs) AS o FROM s, p), k AS (SELECT *, unnest(CASE WHEN o IN ('+', '-') OR (o = '$' AND s LIKE '%Dwell%')
  THEN ['EmissionCount', 'LogDelayTime', 'SquaredLogDelayTime'] WHEN o = '$' THEN ['EmissionCount', 'DelayTime'] ELSE ['EmissionCount'] END) AS kind FROM o)
 SELECT p || kind || '_' || s || '_' || o AS counter, p || kind || '_<STATE>_<OBS>' AS template, event, false AS is_static FROM k
 UNION ALL SELECT p || 'TransitionCount_START_' || s, p || 'TransitionCount_START_<STATE>', event, false FROM s, p
 UNION ALL SELECT p || 'TransitionCount_' || a.s || '_' || b.s, p || 'TransitionCount_<SRCSTATE>_<DSTSTATE>', event, false FROM s a, s b, p
 UNION ALL SELECT p || t, p || t, event, true FROM (SELECT *, unnest(['StreamCount', 'EmissionCount', 'TransitionCount', 'DelayTime', 'LogDelayTime', 'SquaredLogDelayTime']) AS t FROM p)"""
)
def s9_model_names(spark, sf_dir):
    """A model whose states are regions and whose moves are their nations' shares, from its file to its names."""
    held = {r["n_regionkey"]: r["count"] for r in table(spark, sf_dir, "nation").groupBy("n_regionkey").count().collect()}  # as many as regions
    total = sum(held.values())
    shares = {f"s{k}{'Active' if k % 2 else 'Dwell'}": n / total for k, n in held.items()}

    def part(*observed: str) -> dict:
        sent = {o: [1 / len(observed)] + [1.0] * (0 if o == "F" else 3) for o in observed}
        spaces = {"state_space": list(shares), "observation_space": list(observed), "start_probability": shares}
        return spaces | {"transition_probability": dict.fromkeys(shares, shares), "emission_probability": dict.fromkeys(shares, sent)}

    path = shared_path(spark, "model")
    text = json.dumps({"packet_model": part("+", "-", "F"), "stream_model": part("$", "F")})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return hmm.registered_names(spark, config.read_model(spark, path))


@query(
    f"""WITH n AS (SELECT n_name AS client, n_nationkey AS k, n_nationkey % 3 = 0 AS keeper FROM nation),
 f AS (SELECT client, keeper, unnest([{{'part': 'Status', 'field': 'alive', 'value': k || ''}}, {{'part': 'Status', 'field': 'state', 'value': CASE WHEN k % 2 = 0 THEN 'idle' ELSE 'active' END}},
  {{'part': 'Status', 'field': 'public_key', 'value': CASE WHEN keeper THEN '(public key)' END}}, {{'part': 'Config', 'field': 'state', 'value': '(state path)'}},
  {{'part': 'Config', 'field': 'period', 'value': k || ''}}, {{'part': 'Config', 'field': 'key', 'value': CASE WHEN keeper THEN '(key path)' ELSE 'key' || k END}},
  {{'part': 'Config', 'field': 'Start', 'value': '{{"counters":"(counter bins, no counts)","noise":{{"counters":"(counter sigmas, no counts)"}},"sharekeepers":' ||
   CASE WHEN keeper THEN '{{"a":"' || k || '"}}' ELSE '{{"a":"(public key)"}}' END || '}}'}}]) AS x FROM n WHERE k % 4 < 3)
 SELECT CASE WHEN keeper THEN '{clients.KEEPER}' ELSE '{clients.COLLECTOR}' END AS kind, client, x.part AS part, x.field AS field, x.value AS value FROM f WHERE x.value IS NOT NULL
 UNION ALL SELECT CASE WHEN keeper THEN '{clients.KEEPER}' ELSE '{clients.COLLECTOR}' END, client, 'Status', unnest(['alive', 'state']), unnest([k || '', CASE WHEN k % 2 = 0 THEN 'idle' ELSE 'active' END]) FROM n WHERE k % 4 = 3
 UNION ALL SELECT '{clients.KEEPER}', client, 'Status', 'public_key', '(public key)' FROM n WHERE k % 4 = 3 AND keeper"""
)
def k1_contexts(spark, sf_dir):
    """K1: nations as clients, most with a configuration, in an outcome of the shared folder: what is read back tells no paths and keys."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    keeper = k % 3 == 0
    parties = n.select(
        F.col("n_name").alias("client"),
        F.when(keeper, clients.KEEPER).otherwise(clients.COLLECTOR).alias("kind"),
        k.alias("alive"),
        F.when(k % 2 == 0, "idle").otherwise("active").alias("state"),
        F.when(keeper, F.concat(F.lit("key"), k)).alias("public_key"),
    )
    configs = {
        r["n_name"]: {
            "state": f"/states/{r['n_name']}",
            "key": f"key{r['n_nationkey']}",
            "period": r["n_nationkey"],
            "Start": {"counters": {"A": {"bins": [[0, 1]]}}, "noise": {"counters": {"A": 1.0}}, "sharekeepers": {"a": str(r["n_nationkey"])}},
        }
        for r in n.where("n_nationkey % 4 < 3").collect()  # a configuration for each party
    }
    tally = n.select(F.col("n_name").alias("counter"), F.lit(0).alias("bin_idx"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), k.cast("decimal(38,0)").alias("value"))
    noise = n.select(F.col("n_name").alias("counter"), F.lit(1.0).alias("sigma"))
    context = results.context_of(noise, {}, 1.0, 8.0, 9.0, **results.client_contexts(parties, configs))
    path = results.write_outcome(tally, context, shared_path(spark, "contexts"), 1.0, 9.0)
    return results.read_contexts(spark, path).drop("experiment")


@query(
    f"""WITH b AS ({ORACLE_SQL["c1_bin_checks"]}), c AS (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN 'Count' ELSE 'Histogram' END AS counter, n_nationkey AS k FROM nation),
 s AS (SELECT counter, CASE WHEN k % 10 > 0 THEN k - 3.0 END AS sigma FROM c WHERE k % 4 <> 1)
 SELECT counter, problem FROM b UNION SELECT counter, 'sigma' FROM s WHERE sigma IS NULL OR sigma < 0
 UNION SELECT counter, 'no sigma' FROM c WHERE k % 4 = 1 AND k IN (SELECT s_nationkey FROM supplier)"""
)
def c1_sigma_checks(spark, sf_dir):
    """Bins and sigmas of nations' counters together; some sigmas are negative, null, or not there."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select(k, F.concat("n_name", F.when(k % 2 == 0, "Count").otherwise("Histogram")).alias("counter"))
    s = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == k)
    bins = suppliers.select("counter", s.cast("double").alias("lo"), (s + F.pmod(s, F.lit(60))).cast("double").alias("hi"))
    return binning.config_problems(bins, n.where(k % 4 != 1).select("counter", F.when(k % 10 > 0, k - 3.0).alias("sigma")))

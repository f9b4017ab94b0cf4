"""Names, rules, lists, noise and whole rounds."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilcount.operators import binning, fanout, matching, privacy, rounds, weights
from veilcount.plans import catalog, round_queries
from veilcount.plans.queries import ORACLE_SQL, QUERIES
from veilcount.sources import events as ev

SF = "/root/testdata/sf0.001"
INF = float("inf")


def test_the_catalogue_holds_every_family():
    sizes = {
        "streams": len(catalog.stream_names()),
        "domains": len(catalog.domain_names()),
        "circuits": len(set(catalog.circuit_names())),
        "connections": len(set(catalog.connection_names())),
        "stores": len(set(catalog.cache_names("Store"))),
        "fetches": len(set(catalog.cache_names("Fetch"))),
        "exits": len(catalog.exit_circuit_names()),
        "models": len(catalog.model_names()),
    }
    assert sizes == {"streams": 261, "domains": 28, "circuits": 4166, "connections": 366, "stores": 360, "fetches": 111, "exits": 14, "models": 12}
    assert len(catalog.all_names()) == 5325 + 1


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n.startswith("x") and n != "x16_path_counters"])
def test_queries_count_known_names_only(name):
    """By their SQL, which other tests hold them against."""
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = {r[0] for r in con.sql(f"SELECT DISTINCT counter FROM ({ORACLE_SQL[name]})").fetchall()}
    assert got and got <= set(catalog.all_names())


def test_events_of_names():
    assert catalog.events_for(["ZeroCount", "ExitWebCircuitCount"]) == {"STREAM_ENDED", "CIRCUIT_CLOSE"}
    assert catalog.is_sampled("ExitStreamCount") and not catalog.is_sampled("EntryConnectionCount")
    more = catalog.registered({"Mine": {"CIRCUIT_CLOSE", "NOBODY"}})
    assert catalog.events_for(["Mine"], more) == {"CIRCUIT_CLOSE"} and catalog.is_sampled("Mine", more)
    with pytest.raises(KeyError):
        catalog.events_for(["Mine"])


def test_rules_of_events(spark):
    good = "HiddenServiceVersionNumber=2 EventTimestamp=1.5 CacheReasonString=x WasAddedToCacheFlag=1"
    lines = {
        f"HSDIR_CACHE_STORE {good}": None,
        f"HSDIR_CACHE_STORE {good} EncodedIntroPointByteCount=9 EncodedDescriptorByteCount=8": "EncodedIntroPointByteCount",
        f"HSDIR_CACHE_STORE {good} EncodedDescriptorByteCount=40961": "EncodedDescriptorByteCount",
        f"HSDIR_CACHE_STORE {good} RevisionNumber=3": "RevisionNumber",
        f"HSDIR_CACHE_STORE {good.replace('=2', '=3')} EncodedDescriptorByteCount=40961 RevisionNumber=3": None,
        f"HSDIR_CACHE_FETCH {good} CacheQueryByteCount=1 CacheCreatedTime=4": "CacheCreatedTime",
        "CIRCUIT_CELL EventTimestamp=1 IsSentFlag=1 CellCircuitId=0 CellCommandString=PADDING": None,
        "CIRCUIT_CELL EventTimestamp=1 CellCircuitId=0 CellCommandString=PADDING": "IsSentFlag",
        "CIRCUIT_CLOSE EventTimestamp=1 CreatedTimestamp=1 IsLegacyCircuitEndEventFlag=0 StateString=s PurposeCode=5 RendSpliceIsExitFlag=2": "RendSpliceIsExitFlag",
        "VITERBI_PACKETS EventTimestamp=1 ViterbiPathPackets=[]": "no traffic model",
        "VITERBI_STREAMS EventTimestamp=1": "no traffic model",
        "CIRCUIT_CELL A=1 A=2": "malformed",
        "OTHER A=1": "unknown code",
    }
    df = spark.createDataFrame([(f"650 {x}",) for x in lines], "value string")
    got = ev.accepted(ev.fields_of(df), model=False).select("code", F.concat_ws(" ", "code", F.concat_ws(" ", "fields")).alias("line"), "reject_reason", "valid").collect()
    assert {r["line"]: r["reject_reason"] for r in got} == lines and all(r["valid"] == (r["reject_reason"] is None) for r in got)
    assert ev.accepted(ev.fields_of(df)).where("valid and code = 'VITERBI_PACKETS'").count() == 1


def test_fields_and_times(spark):
    df = spark.createDataFrame([("STREAM_ENDED 1 2 3 4 5 6 10.25 20.5 a b 1",), ("STREAM_ENDED 1 2",), ("CIRCUIT_CLOSE CreatedTimestamp=3 EventTimestamp=9 L=a,,b E=",)], "value string")
    events = ev.fields_of(df).withColumn("tags", ev.tagged(F.filter("fields", lambda x: F.contains(x, F.lit("=")))))
    got = [(r["start_ts"], r["end_ts"]) for r in ev.with_times(events).collect()]
    assert got == [(10.25, 20.5), (None, None), (3.0, 9.0)]
    assert [r["valid"] for r in ev.with_arity(ev.fields_of(df), {"STREAM_ENDED": 11}).collect()] == [True, False, False]
    tags = F.col("tags")
    row = events.where("code = 'CIRCUIT_CLOSE'").select(
        ev.typed(tags, "L", "list").alias("l"), ev.typed(tags, "E", "list", ["x"]).alias("e"), ev.typed(tags, "M", "list", ["x"]).alias("m"),
        ev.typed(tags, "EventTimestamp", "float").alias("f"), ev.typed(tags, "N", "int", 4).alias("n"), ev.typed(tags, "F", "flag", False).alias("g"),
    ).first()
    assert (row["l"], row["e"], row["m"], row["f"], int(row["n"]), row["g"]) == (["a", "b"], [], ["x"], 9.0, 4, False)
    assert ev.begun_after(ev.with_times(events), F.lit(5.0)).count() == 1


def test_lists_and_maps(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [r[0] for r in matching.load_list(lines("# c", "", " De ", "!!", ";x", "//y"), kind="country").collect()] == ["de", "!!"]
    assert [r[0] for r in matching.load_list(lines("http://abcdefghij234567.onion/x"), kind="onion").collect()] == ["abcdefghij234567"]
    with pytest.raises(PySparkException):
        matching.load_list(lines("de", "deu"), kind="country").collect()
    got = matching.load_prefixes(lines("192.0.2.0/24 64500", "2001:db8:: 32 64501", "# x")).collect()
    assert [(r["ipver"], r["prefix_len"], r["asn"]) for r in got] == [(4, 24, 64500), (6, 32, 64501)] and got[0]["net"] == 0xC0000200
    assert got[1]["digits"] == "20010db8" + "0" * 24
    with pytest.raises(PySparkException):
        matching.load_prefixes(lines("192.0.2.0/33 64500")).collect()
    lists = spark.createDataFrame([(0, "b.org"), (1, "a.b.org"), (1, "c.org")], "list_idx int, item string")
    assert [tuple(r) for r in matching.list_problems(lists, suffix=True).collect()] == [(1, "a.b.org")]
    assert matching.list_problems(lists, suffix=True, reject_overlapping=False).count() == 0


def test_configuration_is_checked(spark):
    bins = spark.createDataFrame([("aHistogram", 0.0, 1.0), ("aHistogram", 0.5, 2.0), ("bCount", 0.0, INF), ("cCount", 0.0, INF)], "counter string, lo double, hi double")
    sigmas = spark.createDataFrame([("aHistogram", 1.0), ("bCount", -1.0)], "counter string, sigma double")
    got = {tuple(r) for r in binning.config_problems(bins, sigmas).collect()}
    assert got == {("aHistogram", "overlap"), ("bCount", "sigma"), ("cCount", "no sigma")}
    assert binning.zero_count_bins(spark).first()["hi"] == INF


def test_noise_follows_sigma_and_weight(spark):
    facts = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("party"), F.lit("x").alias("counter"), F.col("id").cast("int").alias("bin_idx"), F.lit(10**6).cast("decimal(38,0)").alias("count"))
    facts = facts.unionByName(facts.limit(3).withColumn("counter", F.lit("silent"))).unionByName(facts.limit(2).withColumn("party", F.lit("c")))
    sigmas = spark.createDataFrame([("x", 50.0)], "counter string, sigma double")
    own = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "party string, weight double")
    for seed in (None, 5):
        noisy = privacy.noised(facts, sigmas, own, seed)
        first, again = (sorted(map(str, noisy.collect())) for _ in range(2))
        assert first == again and len(first) == 4000  # drawn once; "silent" has no noise, "c" no weight
        pdf = noisy.toPandas()
        for party, sigma in (("a", 50), ("b", 150)):
            drawn = pdf[pdf["party"] == party]["count"].astype(float) - 10**6
            assert abs(drawn.std() / sigma - 1) < 0.1 and abs(drawn.mean()) < 5 * sigma / math.sqrt(2000)
    default = own.unionByName(spark.createDataFrame([("*", 2.0)], "party string, weight double"))
    assert privacy.noised(facts, sigmas, default, 1).where("party = 'c'").count() == 2
    assert privacy.weight_total(default, 3) == 8.0 and privacy.weight_total(own, 3) == 4.0
    with pytest.raises(ValueError):
        privacy.noised(facts, sigmas, default.union(default.where("party = '*'")))


def test_a_round_adds_up_and_zero_count_is_zero(spark):
    counted = round_queries.counted_round(spark, SF)
    bins = round_queries.round_bins(spark)
    sigmas = bins.select("counter", F.when(F.col("counter") == "ZeroCount", 0.0).otherwise(20.0).alias("sigma")).distinct()
    exact = {(r["counter"], r["bin_idx"]): int(r["count"]) for r in QUERIES["round_totals"](spark, SF).collect()}
    noisy = {(r["counter"], r["bin_idx"]): int(r["count"]) for r in rounds.round_totals(counted, bins, sigmas, round_queries.PARTIES, ["sk"]).collect()}
    assert exact["ZeroCount", 0] == noisy["ZeroCount", 0] == 0 and set(exact) == set(noisy)
    far = [noisy[k] - exact[k] for k in exact if k[0] != "ZeroCount"]
    assert any(far) and max(map(abs, far)) < 20 * 2 * 7
    lacking = counted.where("false")
    facts = rounds.facts_of_round(lacking, bins, ["dc0", "dc1"]).where("party = 'dc0' or counter = 'ZeroCount'")
    with pytest.raises(PySparkException):
        binning.tally(facts, strict=True).collect()
    assert {r["counter"] for r in binning.incomplete(facts).collect()} == set(round_queries.ROUND_BINS) - {"ZeroCount"}


def test_counts_by_any_bins(spark):
    """Bins of the caller's, given to a fan-out by what names end with, and by party."""
    rows = [("p", 80, "4", "Hostname", 1, i, 2 * i, float(i)) for i in range(200)] + [("q", 22, "6", "Hostname", 2, 5, 5, 1.0)]
    df = spark.createDataFrame(rows, "party string, port int, ip_version string, host_class string, stream_number int, read_bytes long, write_bytes long, lifetime double")
    bins = {"ByteHistogram": ((0.0, 100.0), (100.0, 250.0), (400.0, INF)), "LifeTime": ((0.0, 50.0), (50.0, INF))}
    got = {(r["party"], r["counter"], r["bin_idx"]): int(r["count"]) for r in fanout.stream_counters(df, bins=bins).collect()}
    total = [3 * i for i in range(1, 200)]
    want = [sum(lo <= t < hi for t in total) for lo, hi in bins["ByteHistogram"]]
    assert [got["p", "ExitWebStreamByteHistogram", i] for i in range(3)] == want
    assert got["p", "ExitStreamLifeTime", 1] == 150 and got["q", "ExitStreamCount", 0] == 1
    assert got["q", "ExitNonWebStreamByteHistogram", 0] == 1 and ("q", "ExitWebStreamCount", 0) not in got


def test_ring_keeps_small_differences(spark):
    rng = np.random.default_rng(1)
    numbers = sorted({int.from_bytes(rng.bytes(20), "big") for _ in range(30)} | {2**150 + i for i in range(5)})
    df = spark.createDataFrame([(f"{x:040X}",) for x in numbers], "fp string")
    got = {r["fp"]: r["spread"] for r in weights.ring_spread(df).collect()}
    for i, x in enumerate(numbers):
        want = ((x - numbers[i - 3]) % 16**40) / 16**40
        assert abs(got[f"{x:040X}"] - want) <= 1e-12 * want + 1e-50
    one = weights.ring_spread(df.limit(3)).collect()
    assert [r["spread"] for r in one] == [1.0] * 3
    means = weights.mean_fractions(spark.createDataFrame([("a", "g", 0.5), ("b", "g", 1.0)], "consensus string, position string, fraction double"))
    assert tuple(means.first()) == ("g", 0.75, 2)

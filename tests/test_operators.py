import math

import pytest
from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import binning, hmm, privacy
from veilcount.plans import catalog
from veilcount.sources import events as ev


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_bins_have_gaps_and_ends(spark):
    bins = ((-math.inf, -10.0), (0.0, 512.0), (4096.0, math.inf))
    v = [-100.0, -math.inf, -5.0, 0.0, 511.0, 512.0, math.inf, math.nan, None]
    assert values(spark, binning.bin_of(F.col("v"), bins), [(x,) for x in v], "v double") == [0, 0, None, 1, 1, None, 2, None, None]


def test_signed_counts(spark):
    q = scalars.MODULUS
    got = values(spark, scalars.signed(F.col("v").cast("decimal(38,0)")), [(str(x),) for x in (0, 5, q // 2 - 1, q // 2, q - 1)], "v string")
    assert [int(x) for x in got] == [0, 5, q // 2 - 1, -(q // 2), -1]


def test_tagged_events(spark):
    lines = ["A=1 B=2", "A=1  B=2", "A=1 A=2", "A=1=2", "A", "=1", "", "A="]
    got = values(spark, ev.tagged(F.split("v", " ")), [(x,) for x in lines], "v string")
    assert got == [{"A": "1", "B": "2"}, {"A": "1", "B": "2"}, {}, {}, {}, {}, {}, {"A": ""}]


def test_rules(spark):
    rule = ev.Rule("x", "int", True, 0, 10)
    got = values(spark, rule.holds(F.create_map(F.lit("x"), "v")), [(x,) for x in ("5", " 5 ", "12.7", "1e3", "-1", "11", None)], "v string")
    assert got == [True, True, False, False, False, False, False]


def test_addresses(spark):
    got = values(spark, scalars.ip_version(F.col("v")), [(x,) for x in ("1.2.3.4", "256.1.1.1", "::1", "2001:db8::1", "1:2:3", "host")], "v string")
    assert got == [4, None, 6, 6, None, None]


def test_networks(spark):
    rows = [("10.0.0.0", 8), ("10.0.0.1", 8), ("10.0.0.1", 32), ("10.0.0.0", 33), ("0.0.0.0", 0), ("2001:db8::", 32), ("2001:db8::1", 32), ("::", 0), ("::1", 128), ("1:2:3:4:5:6:7:8", 125), ("1:2:3:4:5:6:7:8", 124), ("::", 129), ("host", 8), (None, 8), ("10.0.0.0", None)]
    assert values(spark, scalars.is_network(F.col("a"), F.col("p")), rows, "a string, p int") == [True, False, True, False, True, True, False, True, True, True, False, False, False, False, False]
    assert values(spark, scalars.is_network(F.col("a"), F.col("p"), strict=False), rows[1:2], "a string, p int") == [True]


def test_lines_lose_their_prefix(spark, tmp_path):
    (tmp_path / "log").write_text("650 X_CLOSE a b\nCLOSE\n")
    got = {(r.code, *r.fields) for r in ev.read_lines(spark, str(tmp_path / "log"), prefix="X_").collect()}
    assert got == {("CLOSE", "a", "b"), ("CLOSE",)}


def test_periods(spark):
    got = values(spark, scalars.period(F.col("v")), [(x,) for x in (0, 59, 3600, 90061, 999999)], "v long")
    assert got == ["0s", "59s", "1h 0m 0s", "1d 1h 1m 1s", "1w 4d 13h 46m 39s"]


def test_times(spark):
    assert values(spark, scalars.at_time(F.lit(65), "since", F.col("v")), [(1706745599.9,), (0.0,)], "v double") == ["1m 5s (since 2024-01-31 23:59:59 UTC 1706745599)", "1m 5s (since 1970-01-01 00:00:00 UTC 0)"]


def test_allocation_spends_the_budget():
    counters = {"a": (1.0, 100.0), "b": (5.0, 3000.0)}
    found, ratio = privacy.optimal_allocation(0.3, 1e-3, 2.0, counters)
    assert sum(e for e, _ in found.values()) <= 0.3
    assert all(privacy.satisfies_dp(counters[k][0], e + 1e-6, 5e-4, s) for k, (e, s) in found.items())
    assert privacy.sigma_of(2.0, ratio, 100.0) == pytest.approx(found["a"][1])


def test_incomplete_counters_are_left_out(spark):
    facts = spark.createDataFrame([("x", "c", 0, 1), ("y", "c", 0, 2), ("x", "d", 0, 1)], "party string, counter string, bin_idx int, count long")
    assert [(r.counter, int(r["count"])) for r in binning.tally(facts).collect()] == [("c", 3)]


def test_model_update_keeps_sums(spark):
    model = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5)], "src string, dst string, p double")
    tallies = spark.createDataFrame([("a", "b", 30), ("a", "c", -5)], "src string, dst string, n long")
    got = {r.dst: r.p for r in hmm.updated_transitions(model, tallies).collect()}
    assert got == {"b": pytest.approx(0.75), "c": pytest.approx(0.25)}


def test_catalogue():
    assert len(set(catalog.stream_names())) == 29 * 9
    assert catalog.events_for(["ExitWebStreamCount", "ZeroCount"]) == {"STREAM_ENDED"}
    with pytest.raises(KeyError):
        catalog.events_for(["Nonsense"])


def test_streamed_clients_equal_batch(spark, tmp_path):
    from veilcount.streaming.rotation import distinct_clients

    rows = spark.range(2000).select((F.col("id") % 37).alias("ip"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = distinct_clients(stream).writeStream.format("memory").queryName("clients").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.start, r.clients) for r in spark.sql("select * from clients").collect()}
    batch = {(r.w.start, r.n) for r in rows.groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count_distinct("ip").alias("n")).collect()}
    assert got and got <= batch


def test_rules_are_compiled_not_interpreted(spark):
    """What a generator holds, and methods that HotSpot refuses, are interpreted row by row."""
    from veilcount.sources import events as ev

    lines = spark.createDataFrame([("CONNECTION_CLOSE", ["A=1"])], "code string, fields array<string>")
    plan = ev.accepted(lines)._jdf.queryExecution().executedPlan().toString()
    held = [line for line in plan.split("\n") if "Generate" in line]
    assert held and all("explode(array(_one" in line for line in held)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == ev.COMPILED_BYTES


def test_tagged_fields_of_any_form_and_number(spark):
    from veilcount.sources import events as ev

    long = "x" * 200_000
    sound = [[], [""], ["A=1", "", "B="], ["A=" + long, "B=2"], [f"K{i}={i}" for i in range(20_000)]]
    odd = [["A"], ["=1"], ["A=1=2"], ["A=1", "A=2"], ["A=1\x00B=2"], ["A=1 2"], ["A\t=1"], ["A=1\n"], ["A=1", long]]
    rows = [(i, fields) for i, fields in enumerate(sound + odd)]
    df = spark.createDataFrame(rows, "i int, fields array<string>")
    want = [dict(f.split("=") for f in fields if f) for fields in sound] + [{} for _ in odd]
    got = {r["i"]: r["tags"] for r in df.select("i", ev.tagged(F.col("fields")).alias("tags")).collect()}
    assert [got[i] for i in range(len(want))] == want

import pytest
from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import analysis, labels, state
from veilcount.sources import consensus, results

INF = float("inf")
BINS = "counter string, bin_idx int, lo double, hi double"


def test_kinds_of_lists(spark):
    kinds = {
        "ExitDomainExactMatchWebInitialStreamCountList": "domain",
        "EntryConnectionCountryMatchCountList": "country",
        "EntryConnectionASMatchCountList": "as",
        "HSDir2StoreReasonCountList": "hsdir_store",
        "HSDir3FetchReasonCountList": "hsdir_fetch",
        "HSDir2StoreOnionAddressCountList": "onion_address",
        "MidHSDirFailureCircuitReasonCountList": "circuit_failure",
        "EntryConnectionCountryMatchHistogram": None,
        "ExitStreamByteHistogram": None,
    }
    got = spark.createDataFrame([(k,) for k in kinds], "c string").select("c", labels.list_kind(F.col("c")).alias("k"))
    assert {r.c: r.k for r in got.collect()} == kinds


def test_short_labels(spark):
    forms = {"'example.com' (1)": "example.com", "a....z (12)": "a....z (12)", "/d.x/top.1k.txt": "top.1k", "/no_end": "", "": ""}
    got = spark.createDataFrame([(k,) for k in forms], "c string").select("c", labels.short_label(F.col("c")).alias("k"))
    assert {r.c: r.k for r in got.collect()} == forms


def test_labels_must_fit(spark, tmp_path):
    bins = spark.createDataFrame([("xASMatchCountList", i, float(i), INF) for i in range(4)], BINS)
    lists = spark.createDataFrame([("as", 0, "a"), ("as", 1, "b")], "kind string, position int, label string")
    with pytest.raises(Exception, match="another number of bins"):
        labels.bin_labels(bins, lists).collect()
    (tmp_path / "own.txt").write_text("one\n two \nthree of a very long name\nfour\n")
    own = labels.read_labels(spark, str(tmp_path / "own.txt"))
    got = labels.bin_labels(bins, own, F.lit("custom")).orderBy("bin_idx").collect()
    assert [r.label for r in got] == ["one", "two", "three of a very long name", "four"]
    assert got[2].graph_label == "three of a v..." and got[0].range_label == "[0.0,inf)"
    assert labels.bin_labels(bins.limit(0), own, F.lit("custom")).count() == 0


def test_confidence_label():
    assert labels.sigma_label(2.0) == " (2.0 sigma = 95.4% CI)"
    assert labels.sigma_label(3.0) == " (3.0 sigma = 99.73% CI)"


def test_text_file(spark, tmp_path):
    rows = [("e2", "a", 0, -INF, 5.0, -3.0, None, None), ("e1", "b", 0, 0.0, INF, 100.0, 10.0, 2.0)]
    schema = "experiment string, counter string, bin_idx int, lo double, hi double, value double, sigma double, excess double"
    found = analysis.with_errors(spark.createDataFrame(rows, schema))
    labels.write_text(found, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == [
        "Experiment Label: e1 (2.0 sigma = 95.4% CI)",
        "b [     0.0,     inf) =   100 +- 28 (   28.0%) ( visible, positive) bound:   100 [   72,   128] (no change)",
        "Experiment Label: e2",
        "a [    -inf,     5.0) =             -3 ( visible,     zero) bound:              0 (value)",
    ]


def test_summaries(spark):
    def summary(items):
        found = spark.createDataFrame([(x,) for x in items], "x string").agg(scalars.listed(F.col("x")).alias("s"))
        return found.first()["s"]

    assert summary([]) == "'' (0)" and summary(["b", None]) == "'b' (1)"
    assert summary(["b", "c", "a"]) == "'a....c' (3)"
    assert summary(["a" * 60]) == "'" + "a" * 23 + "...." + "a" * 23 + "' (1)"
    short = lambda n, e="...": spark.range(1).select(scalars.shortened(F.lit("abcdefgh"), n, e)).first()[0]
    assert [short(8), short(7), short(4), short(3), short(2), short(0)] == ["abcdefgh", "ab...gh", "a...", "...", "..", ""]


def test_decoding_of_other_texts_is_null(spark):
    got = spark.createDataFrame([("!!",), (None,), ("",)], "t string").select(scalars.decoded(F.col("t"), "k long")["k"])
    assert [r[0] for r in got.collect()] == [None] * 3


def test_outcome_comes_back(spark, tmp_path):
    rows = [("b", 0, -INF, 0.0, 2**62 + 1), ("b", 1, 0.0, INF, -7), ("a", 0, 0.0, INF, 3)]
    given = spark.createDataFrame(rows, "counter string, bin_idx int, lo double, hi double, value long")
    noise = spark.createDataFrame([("a", 2.5), ("b", 0.0)], "counter string, sigma double")
    context = results.context_of(noise, {"excess_noise_ratio": 2.0}, 1.0, 9.0, 9.5, TallyServer={"Status": {"state": "idle"}}, ShareKeeper={})
    assert context["Time"]["CollectEnd"] == 8.5 and context["TallyServer"]["Status"] == {"state": "idle"}
    path = results.write_outcome(given, context, str(tmp_path), 1.4, 9.6)
    assert path.endswith("/outcome.1-10.json")
    got = results.read_results(spark, path).orderBy("counter", "bin_idx").collect()
    assert [(r.counter, r.bin_idx, r.lo, r.hi, int(r.value)) for r in got] == sorted(rows)
    assert [(r.sigma, r.excess) for r in got] == [(2.5, 2.0), (0.0, 2.0), (0.0, 2.0)]


def test_consensus_policies_and_protocols(spark, tmp_path):
    def relay(name, *lines):
        return "\n".join([f"r {name} AAAAAAAAAAAAAAAAAAAAAAAAAAA x 2024-01-01 00:00:00 192.0.2.1 9001 0", *lines]) + "\n"

    text = "vote-status consensus\n" + relay("a", "s Fast", "v Tor 0.3.5.1", "pr Cons=1-2 HSDir=1-2", "p accept 80,443")
    (tmp_path / "c").write_text(text + relay("b", "s Fast", "p reject 1-65535") + relay("c", "s Fast"))
    got = {r.nickname: (r.exits, r.version, r.protocols) for r in consensus.read_relays(spark, str(tmp_path / "c")).collect()}
    assert got == {"a": (True, "0.3.5.1", {"Cons": "1-2", "HSDir": "1-2"}), "b": (False, None, {}), "c": (None, None, {})}


def test_streamed_rotation_equals_batch(spark, tmp_path):
    from veilcount.streaming.rotation import client_windows

    at = 1_700_000_000 + F.col("id") * 7
    rows = spark.range(2000).select(
        (F.col("id") % 37).alias("ip"), (F.col("id") % 3 == 0).alias("active"), F.timestamp_seconds(at).alias("ts"),
        F.timestamp_seconds(at - F.col("id") % 900).alias("created"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sink = client_windows(stream).writeStream.format("memory").queryName("rotated").outputMode("append")
    q = sink.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(int(r.start.timestamp()) // 600, *r[1:]) for r in spark.sql("select * from rotated").collect()}
    seconds = [F.unix_timestamp(c).alias(c) for c in ("ts", "created")]
    batch = {tuple(r) for r in state.rotation(rows.select("ip", "active", *seconds)).collect()}
    assert len(batch) - len(got) <= 4 and got and got <= batch


def test_circuits_leave_with_their_close(spark, tmp_path):
    from veilcount.streaming.rotation import circuits

    # One batch a run: with a TTL, batches go on without new rows, to see what has expired.
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "circuit long, kind int, ts long, bytes long"
    first = [(1, 0, 1, 10), (1, 0, 2, 5), (2, 0, 1, 7)]
    second = [(1, 1, 9, 0), (2, 0, 9, 1), (2, 1, 10, 0), (3, 1, 4, 0)]
    try:
        for rows in (first, second):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            sink = circuits(stream, 3_600_000).writeStream.outputMode("append").trigger(once=True)
            q = sink.option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"), format="parquet")
            assert q.awaitTermination(60), "the stream didn't end"
    finally:
        spark.conf.unset(provider)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 2, 15), (2, 2, 8)]

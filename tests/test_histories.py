"""Histories of rounds, relays' metadata, sketches and families on odd rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from veilcount.operators import fanout, relays, rounds, state
from veilcount.operators.rounds import baseline, next_start
from veilcount.sources import events as ev
from veilcount.sources import families


@pytest.mark.parametrize("always", [False, True])
def test_history_folds_as_round_by_round(spark, always):
    rng = random.Random(6)
    own, noise = [], []
    for k in range(12):
        own.append(("d", k, k * 10.0, k * 10.0 + 5, rng.random() < 0.8))
        for c in "ABC" if rng.random() < 0.8 else "AB":
            noise.append(("d", k, c, 10.0 - rng.choice([0.0, 0.6, 1.2])))
    own.append(("alone", 1, 0.0, 1.0, True))  # a round without counters
    own.append(("fails", 1, 0.0, 1.0, False))
    frame = lambda rows: spark.createDataFrame(rows, "deployment string, round long, counter string, sigma double")
    df = spark.createDataFrame(own, "deployment string, round long, start double, end double, succeeded boolean")
    got = {(r["deployment"], r["round"]): r for r in rounds.history(df, frame(noise), 7.0, 0.5, always, 1.0).collect()}
    before, last_end = None, None
    for _, k, start, end, ok in own[:12]:
        used = frame([n for n in noise if n[1] == k]).select("counter", "sigma")
        want = next_start(before, used, last_end, 7.0, 0.5, always, 1.0)
        assert (got["d", k]["next_start"], got["d", k]["permitted"]) == (want, start >= want)
        before, last_end = baseline(before, used, ok, always, 1.0), end if ok else last_end
    assert got["alone", 1]["baseline"] == 1 and got["fails", 1]["baseline"] is None and len(got) == 14
    assert rounds.history(df.limit(0), frame([]), 7.0).count() == 0


def test_relays_keep_first_last_or_all(spark):
    facts = [
        ("r", 1, "fingerprint", "A" * 39), ("r", 2, "fingerprint", " " + "a" * 40), ("r", 3, "fingerprint", "b" * 40), ("r", 4, "fingerprint", "a" * 40),
        ("r", 1, "nickname", ""), ("r", 2, "nickname", "two words"), ("r", 3, "nickname", "Last\n"), ("r", 4, "nickname", None),
        ("r", 1, "orport", "9001"), ("r", 2, "orport", "[::1]:9002"), ("r", 3, "orport", "9001"), ("r", 4, "orport", "x" * 201),
        ("r", 1, "version", "Tor version  0.1 version 2 "), ("r", 2, "version", "version"), ("r", 1, "hobby", "none"), ("s", 1, "flags", "Exit"), ("s", 1, "flags", "Exit"),
    ]
    got = {(r["relay"], r["field"]): tuple(r)[2:] for r in relays.relay_metadata(spark.createDataFrame(facts, "relay string, seq int, field string, value string")).collect()}
    assert got == {
        ("r", "fingerprint"): ("a" * 40, 3, 1, 1), ("r", "nickname"): ("Last", 2, 1, 1), ("r", "orport"): ("9001, [::1]:9002", 3, 1, 0),
        ("r", "version"): ("0.1 version 2", 1, 1, 0), ("r", "hobby"): (None, 0, 1, 0), ("s", "flags"): ("Exit", 2, 0, 0),
    }


def test_sketches_unite_over_parties_and_windows(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("p"), F.col("id") % 7).alias("party"), (F.col("id") % 20_000).alias("ip"), (F.col("id") % 4 == 0).alias("active"), (F.col("id") % 30 * 100).cast("double").alias("ts"), F.lit(0.0).alias("created"))
    each = state.client_sketches(rows, 1000)
    whole = state.estimated_clients(each).first()
    assert abs(whole["clients"] - 20_000) <= whole["error"] * 20_000 and abs(whole["active_clients"] - 5000) <= whole["error"] * 5000
    again = state.estimated_clients(state.united(each, "w"), "w")  # united twice
    for r in again.collect():
        exact = state.rotation(rows.drop("party"), 1000).where(F.col("w") == r["w"]).first()
        assert abs(r["clients"] - exact["clients"]) <= r["error"] * exact["clients"]


LINES = [
    ("STREAM_ENDED", "1 2 3 80 10 20 1.0 2.0 host.example 192.0.2.1 1", None), ("STREAM_ENDED", "1 2 3 80 10 20 1.0 2.0 host.example 192.0.2.1", "number of fields"),
    ("STREAM_ENDED", "1 2 3 80.5 10 20 1.0 2.0 h a 1", "port"), ("STREAM_ENDED", "1 2 3 80 1e3 20 1.0 2.0 h a 1", "read_bytes"), ("STREAM_ENDED", "1 2 3 80 1 20 now 2.0 h a 1", "start"),
    ("STREAM_ENDED", "-1 2 3 80 -1 20 1.0 2.0 h a 1", None), ("CIRCUIT_ENDED", "1", "number of fields"), ("VITERBI_STREAMS", "ViterbiPathStreams=[] EventTimestamp=1", None),
    ("CONNECTION_CLOSE", "A=1 A=2", "malformed"), ("OTHER", "x", "unknown code"), ("", "", "unknown code"), ("HSDIR_CACHE_STORE", "HiddenServiceVersionNumber=2.5", "HiddenServiceVersionNumber"),
]


def test_every_line_has_its_verdict(spark, tmp_path):
    df = spark.createDataFrame([("p", c, f) for c, f, _ in LINES], "party string, code string, line string").select("party", "code", F.split("line", " ").alias("fields"), "line")
    got = {(r["code"], r["line"]): r["reject_reason"] for r in families.judged(df).collect()}
    assert got == {(c, f): why for c, f, why in LINES}
    assert families.judged(df, model=False).where("reject_reason = 'no traffic model'").count() == 1
    path = families.write_events(families.judged(df.drop("line")), str(tmp_path / "events"))
    kept = families.read_events(spark, path, "STREAM_ENDED")
    assert kept.count() == 2 and families.streams_of(kept).count() == 1  # negative bytes aren't counted
    assert families.rejects(spark, path).agg(F.sum("events")).first()[0] == sum(why is not None for *_, why in LINES)
    scan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "STREAM_ENDED" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_integers_are_whole(spark):
    tags = F.create_map(*[F.lit(x) for x in ("a", "12.7", "b", "1e3", "c", " +7 ", "d", "")])
    got = spark.range(1).select(*[ev.typed(tags, k, "int").alias(k) for k in "abcd"]).first()
    assert (got["a"], got["b"], got["d"]) == (None, None, None) and int(got["c"]) == 7


def test_wanted_counters_leave_out_other_sums(spark):
    streams = spark.range(100).select((F.col("id") % 2 * 363 + 80).cast("int").alias("port"), F.lit("4").alias("ip_version"), F.lit("Hostname").alias("host_class"), F.lit(1).alias("stream_number"), F.col("id").alias("read_bytes"), F.lit(1).cast("long").alias("write_bytes"), F.lit(1.0).alias("lifetime"))
    some = ["ExitWebStreamByteCount", "ExitStreamLifeTime"]
    all_rows = {tuple(r) for r in fanout.stream_counters(streams).where(F.col("counter").isin(*some)).collect()}
    asked = fanout.stream_counters(streams, some)
    assert {tuple(r) for r in asked.collect()} == all_rows and all_rows
    sums = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("count(")
    assert sums(asked) < sums(fanout.stream_counters(streams)) / 2

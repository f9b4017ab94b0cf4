"""Circuits as state: streamed in parts and out of order, against the batch operators."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from veilcount.operators import fanout, matching
from veilcount.plans.samples import streams
from veilcount.streaming import circuits as circ

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def events(spark):
    """lineitem's streams on circuits whose numbers recur, and their closes; ports of all classes, ties of times."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ports = F.element_at(F.array(*[F.lit(p) for p in (80, 22, 6699, 9001, 443)]), (F.col("port") % 5 + 1).cast("int"))
    own = streams(spark, SF).where("l_orderkey < 900").withColumn("port", ports)
    keys = [F.concat(F.lit("dc"), F.col("l_orderkey") % 2).alias("party"), (F.col("l_orderkey") % 7).alias("channel"), (F.col("l_orderkey") % 31).alias("circuit")]
    start = (F.col("l_orderkey") * 10 + F.col("l_linenumber") * 7).cast("double")
    s = own.select(*keys, "port", start.alias("start"), (start + F.pmod("lifetime", F.lit(200)) / 8).alias("end"))
    closes = own.where("l_linenumber = 1 and l_orderkey % 3 > 0").select(*keys, (F.col("l_orderkey") * 10 + 90.5).alias("closed")).distinct()
    s, closes = s.cache(), closes.cache()
    yield s, closes
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, tmp_path, frame, transform, name, parts=3):
    """The frame in files by hash, so out of order, then one row far later that brings all closes due."""
    source = f"{tmp_path}/{name}"
    for i in range(parts):
        frame.where(F.pmod(F.xxhash64(*frame.columns), F.lit(parts)) == i).coalesce(1).write.mode("append").parquet(source)
    last = spark.createDataFrame([("end", 0, 0, 0, 80, 1e9)], "party string, channel long, circuit long, kind int, port int, start double")
    last.select("party", "channel", "circuit", F.timestamp_seconds(F.lit(10_000_000)).alias("at"), "kind", "port", "start").select(*frame.columns).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}-state").start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def counts(df):
    return sorted((r["party"], r["counter"], r["bin_idx"], int(r["count"])) for r in df.collect())


def claimed(s, closes):
    return matching.next_close(s, closes, list(circ.KEYS), "end", "closed").where("closed_at is not null")


def test_counters_equal_the_batch(spark, events, tmp_path):
    s, closes = events
    rows = streamed(spark, tmp_path, circ.marks_of(s, closes), lambda m: circ.closed_circuits(m, "10000000 seconds"), "circuits")
    met = claimed(s, closes)
    assert counts(circ.closed_circuit_counters(rows)) == []  # nothing is due within such a watermark
    rows = streamed(spark, tmp_path, circ.marks_of(s, closes), lambda m: circ.closed_circuits(m, "20000 seconds"), "due")
    assert counts(circ.closed_circuit_counters(rows)) == counts(fanout.exit_circuit_counters(met, met, [*circ.KEYS, "closed_at"]))
    assert rows.where("label = ''").agg(F.sum("streams")).first()[0] == met.count() > 100


def test_each_stream_is_claimed_once(spark, events, tmp_path):
    s, closes = events
    rows = streamed(spark, tmp_path, circ.marks_of(s, closes), lambda m: circ.closed_circuits(m, "20000 seconds", by_stream=True), "claimed")
    show = lambda df, end, closed: sorted((r["party"], r["channel"], r["circuit"], r["port"], r["start"], r[end] if end == "ended_us" else round(r[end] * 1e6), r[closed] if closed == "closed_us" else round(r[closed] * 1e6)) for r in df.collect())
    assert show(rows, "ended_us", "closed_us") == show(claimed(s, closes), "end", "closed_at")


def test_streams_that_no_close_claims_leave(spark, events, tmp_path):
    s, closes = events
    rows = streamed(spark, tmp_path, circ.marks_of(s, closes), lambda m: circ.closed_circuits(m, "20000 seconds", max_age=0.0, by_stream=True), "aged")
    assert 0 <= rows.count() < claimed(s, closes).count()


def test_interval_join(spark, events, tmp_path):
    s, closes = events
    at = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))
    left, right = s.select(*circ.KEYS, "port", at("end").alias("ended")), closes.select(*circ.KEYS, at("closed").alias("closed"))
    left.write.parquet(f"{tmp_path}/left")
    right.write.parquet(f"{tmp_path}/right")
    frames = [spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{n}") for df, n in ((left, "left"), (right, "right"))]
    q = circ.closes_within(*frames, "100 SECONDS").writeStream.format("memory").queryName("within").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = left.join(right, list(circ.KEYS)).where("closed >= ended and closed <= ended + INTERVAL 100 SECONDS")
    show = lambda df: sorted(str([r[c] for c in (*circ.KEYS, "port", "ended", "closed")]) for r in df.collect())
    assert show(spark.table("within")) == show(want) and want.count()

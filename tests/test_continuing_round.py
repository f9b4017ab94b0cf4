"""A continuing round over files that arrive, killed between and within batches, against one batch query."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from veilcount.operators import fanout
from veilcount.operators.rounds import round_of
from veilcount.plans.samples import streams
from veilcount.streaming.rounds import ContinuingRound, by_round

PERIOD, LATENESS = 1000.0, 500.0


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Streams in six files by time, the last with rows that are far too late, and some a little."""
    at = tmp_path_factory.mktemp("arrivals")
    ts = (F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5400)) + 0.5).cast("double")
    rows = streams(spark, SF).withColumn("party", F.concat(F.lit("dc"), F.pmod("l_orderkey", F.lit(3)))).withColumn("ts", ts)
    rows = rows.withColumn("late", (F.col("ts") < 600) & (F.pmod("l_orderkey", F.lit(10)) == 0))
    shift = F.when(F.pmod("l_orderkey", F.lit(7)) == 0, 300).otherwise(0)  # out of order, within the lateness
    part = F.when(F.col("late"), 5).otherwise(F.least(F.floor((F.col("ts") + shift) / 900), F.lit(5)))
    for i in range(6):
        rows.where(part == i).coalesce(1).write.parquet(f"{at}/file{i}")
    return [f"{at}/file{i}" for i in range(6)], rows.schema


def counted(events):
    return fanout.stream_counters(events, ["ExitStreamCount", "ExitWebStreamByteCount", "ExitStreamLifeTime"])


class Killed(Exception):
    pass


def feed(spark, folder, checkpoint, source, schema, kill_at=None, kill_in="add"):
    """Runs the stream over what is there, and kills it in the batch of this number."""
    one = ContinuingRound(spark, folder, by_round(counted), PERIOD, lateness=LATENESS)
    if kill_at is not None:
        inner, real = one.add, one._write

        def add(batch, number):
            if number == kill_at:
                def dies(df, name):
                    if name.startswith("marks" if kill_in == "marks" else "partials"):
                        raise Killed
                    real(df, name)

                if kill_in == "after":
                    inner(batch, number)
                    raise Killed
                one._write = dies
            inner(batch, number)

        one.add = add
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    q = one.run(stream, checkpoint)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return one


def test_killed_and_restarted_equals_the_batch_query(spark, arrivals, tmp_path):
    import os
    import shutil
    import time

    files, schema = arrivals
    source, folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "run"), str(tmp_path / "state")
    os.mkdir(source)
    kills = [(1, "partials"), (2, "marks"), (3, "after"), (None, "")]
    arrived = 0
    for step, (at, where) in enumerate(kills):
        until = 6 if at is None else at + 1
        for i in range(arrived, until):
            shutil.copytree(files[i], f"{source}/f{i}")
            time.sleep(1.1)  # files are taken in the order of their times
        arrived = until
        if at is None:
            one = feed(spark, folder, checkpoint, source, schema)
        else:
            with pytest.raises(Exception, match="Killed"):
                feed(spark, folder, checkpoint, source, schema, at, where)
    marks = {r["batch"]: r for r in one.marks().collect()}
    late = sum(r["late"] for r in marks.values())
    rows = spark.read.schema(schema).parquet(*files)
    expected_late = rows.where("late").count()
    assert len(marks) == 7 and late == expected_late > 0 and sum(r["events"] for r in marks.values()) == rows.count()
    # The closed rounds are published; the last ones only when asked for.
    assert {r["round"] for r in one.totals().select("round").distinct().collect()} == {0, 1, 2, 3}
    assert one.publish() == [] and one.publish(flush_last=True) == [4, 5]
    batch = rows.where("not late").withColumn("round", round_of(F.col("ts"), 0.0, PERIOD))
    want = by_round(counted)(batch).groupBy("round", "counter", "bin_idx").agg(F.sum("count").alias("count"))
    show = lambda df: sorted((r["round"], r["counter"], r["bin_idx"], int(r["count"])) for r in df.collect())
    assert show(one.totals()) == show(want) and show(one.tallied()) == show(want)


def test_rounds_that_end(spark, tmp_path):
    one = ContinuingRound(spark, str(tmp_path), lambda e: e.groupBy("round", "party").agg(F.count("*").cast("decimal(38,0)").alias("count")).select("round", "party", F.lit("C").alias("counter"), F.lit(0).alias("bin_idx"), "count"), 10.0, start=100.0, rounds=2)
    frame = lambda ts: spark.createDataFrame([("a", t) for t in ts], "party string, ts double")
    one.add(frame([99.0, 100.0, 109.9, 110.0, 125.0]), 0)
    assert one.closed() == [0, 1] and one.publish() == [0, 1]
    one.add(frame([105.0]), 1)
    one.add(frame([105.0]), 1)  # again
    assert sorted((r["round"], int(r["count"])) for r in one.tallied().collect()) == [(0, 2), (1, 1)]
    assert one.marks().agg(F.sum("late")).first()[0] == 1 and one.watermark() == 125.0

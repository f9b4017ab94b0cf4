"""The event log source: ranges, filters, and a stream at a pace that is killed and started again."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from veilcount.sources import eventlog
from veilcount.sources import events as ev


@pytest.fixture(scope="module")
def log(tmp_path_factory):
    """Lines of odd lengths in several files, and the lines themselves."""
    rng, at = random.Random(1), tmp_path_factory.mktemp("log")
    lines = []
    for party in ("dc1", "dc2"):
        (at / f"party={party}").mkdir()
        own = [f"650 LOG_{rng.choice(['STREAM_ENDED', 'CONNECTION_CLOSE', 'OTHER'])} n={i}  {'x' * rng.randrange(60)} é" for i in range(500)]
        own += ["", "650 ", "STREAM_ENDED", "650 STREAM_ENDED a b\r", "250 OK"]
        rng.shuffle(own)
        (at / f"party={party}" / "events.log").write_bytes("\n".join(own).encode() + (b"\n" if party == "dc1" else b""))
        lines += [(party, x) for x in own]
    (at / "party=dc3").mkdir()
    (at / "party=dc3" / "old.log.gz").write_bytes(gzip.compress(b"650 LOG_STREAM_ENDED 1 2 3\nSTREAM_ENDED 4\n"))
    (at / "_ignored").write_text("STREAM_ENDED no")
    lines += [("dc3", "650 LOG_STREAM_ENDED 1 2 3"), ("dc3", "STREAM_ENDED 4")]
    want = []
    for party, x in lines:
        x = x.rstrip("\r").removeprefix("650 ").removeprefix("LOG_")
        code, *fields = x.split(" ")
        if code:
            want.append((party, code, fields))
    return str(at), sorted(want)


def rows(df):
    return sorted((r["party"], r["code"], r["fields"]) for r in df.collect())


@pytest.mark.parametrize("split", [7, 100, 5000, 1 << 20])
def test_ranges_give_every_line_once(spark, log, split):
    path, want = log
    if split == 7:  # each range in turn, without Spark
        got = [tuple(r.values()) for p, n in eventlog.files_of(path) for piece in eventlog.pieces_of(p, n, split=7) for b in eventlog.rows_of(piece, "LOG_", None) for r in b.to_pylist()]
        assert sorted(got) == want
    else:
        assert rows(eventlog.read_log(spark, path, "LOG_", splitBytes=split)) == want


def test_lines_cut_by_blocks(monkeypatch):
    text = "\n".join("y" * n for n in range(40)).encode()
    for block in (1, 3, 64):
        monkeypatch.setattr(eventlog, "BLOCK_BYTES", block)
        for split in (1, 5, 17, 1000):
            got = b"\n".join(x for a in range(0, len(text), split) for x in eventlog.whole_lines(io.BytesIO(text), a, min(a + split, len(text))))
            assert [x for x in got.split(b"\n") if x] == [x for x in text.split(b"\n") if x]


def test_filters_reach_the_reader(spark, log):
    path, want = log
    df = eventlog.read_log(spark, path, "LOG_", counters=["ExitStreamCount"])
    assert rows(df) == [r for r in want if r[1] == "STREAM_ENDED"]
    own = df.where("party = 'dc2' and size(fields) > 2")
    assert rows(own) == [r for r in want if r[1] == "STREAM_ENDED" and r[0] == "dc2" and len(r[2]) > 2]
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "code" not in plan.split("Filter")[1].split("\n")[0]  # only the size is left to Spark
    # What the reader is asked for, it alone parses.
    reader = eventlog.LogReader({"path": path, "prefix": "LOG_"})
    left = list(reader.pushFilters([eventlog.In(("code",), ("OTHER", "STREAM_ENDED")), eventlog.EqualTo(("code",), "OTHER"), eventlog.IsNotNull(("code",)), eventlog.IsNotNull(("fields",))]))
    assert left == [eventlog.IsNotNull(("fields",))] and reader.codes == ["OTHER"]
    assert {r["code"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()} == {"OTHER"}
    assert rows(eventlog.read_log(spark, path).where("code = 'x' and code = 'y'")) == []


def test_same_as_spark_text(spark, log):
    path, _ = log
    text = spark.read.option("recursiveFileLookup", True).text(path)
    own = ev.fields_of(text.where("value <> ''"), "LOG_").where("code <> ''")
    mine = eventlog.read_log(spark, path, "LOG_")
    show = lambda df: sorted(str((r["code"], r["fields"])) for r in df.select("code", "fields").collect())
    assert show(own.withColumn("fields", F.transform("fields", lambda f: F.regexp_replace(f, "\r$", "")))) == show(mine)


def test_a_stream_at_a_pace_survives_restarts(spark, tmp_path):
    log, out, state = tmp_path / "log", tmp_path / "out", tmp_path / "state"
    log.mkdir()
    lines = [f"STREAM_ENDED {i} {'z' * (i % 50)}" for i in range(3000)]
    (log / "a.log").write_text("\n".join(lines[:2000]) + "\n")
    batches = []

    def run(most):
        df = eventlog.read_log(spark, str(log), stream=True, bytesPerTrigger=20_000, offered=str(tmp_path / "offered"))

        def keep(batch, number):
            if most is not None and len(batches) >= most:
                raise RuntimeError("killed")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            batches.append(batch.count())

        q = df.writeStream.foreachBatch(keep).option("checkpointLocation", str(state)).start()
        try:
            for _ in range(3):  # after a restart the first offer is the last one made before it
                q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="killed"):
        run(2)
    (log / "b.log").write_text("\n".join(lines[2000:]) + "\n")
    run(None)
    got = sorted(int(r["fields"][0]) for r in spark.read.parquet(str(out)).collect())
    assert got == list(range(3000)) and len(batches) > 5 and max(batches) < 1000


def test_a_compressed_log_holds_the_same_events_in_less_room(spark, tmp_path):
    lines = spark.range(20_000).selectExpr("concat('dc', id % 3) AS party", "concat('650 C_', IF(id % 2 = 0, 'X', 'Y'), ' Key=', id, ' Other=value') AS value")
    read, size = {}, {}
    for how in ("none", "gzip"):
        path = eventlog.write_log(lines, str(tmp_path / how), how)
        read[how] = sorted(map(str, eventlog.read_log(spark, path, "C_").where("code = 'X'").collect()))
        size[how] = sum(f.stat().st_size for f in (tmp_path / how).rglob("part-*"))
    assert len(read["none"]) == 10_000 and read["none"] == read["gzip"] and size["gzip"] * 4 < size["none"]

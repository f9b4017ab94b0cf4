"""Archives and the merged capture index: global order over several runs and ranges, and the query against its SQL."""

import random

import duckdb
import pytest

from veilcount.llm import warc
from veilcount.llm.queries import ORACLE_SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    urls = ["http://www.b.org/x", "https://a.org", "http://a.org/?q=1", "not a url", "", None, "http://é.org/ü", "http://[bad"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(urls), rng.choice(["", None, "é" * 600, "p" * 2000, "q" * 999]), 1, "k") for _ in range(300)]
    rows += [(7, urls[0], "m" * 3_000_000, 1, "k"), rows[0], rows[0]]
    return spark.createDataFrame(rows, "page_id long, url string, html string, archive int, url_key string").repartition(5)


def order(r):
    return r["url_key"].encode(), r["captured"], -1 if r["page_id"] is None else r["page_id"], r["archive"], r["offset"]


@pytest.mark.parametrize("size", [20, 100_000])
def test_captures_are_in_global_order(spark, pages, size):
    settings = {"spark.sql.files.openCostInBytes": str(1 << 27), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in settings.items():  # an archive a task, a run a file
        spark.conf.set(name, value)
    runs = warc.read_archives(warc.write_archives(pages))
    for name in settings:
        spark.conf.unset(name)
    assert runs.select("run").distinct().count() > 1
    got = sorted(warc.ordered_captures(runs, size).collect(), key=lambda r: r["capture_no"])
    assert [r["capture_no"] for r in got] == list(range(pages.count()))
    assert [order(r) for r in got] == sorted(order(r) for r in got)
    parts = [r["order_part"] for r in got]
    assert parts == sorted(parts) and (size > 1000 or len(set(parts)) > 5)


def test_records_come_back(pages):
    got = warc.ordered_captures(warc.read_archives(warc.write_archives(pages))).collect()
    largest = {}
    for r in pages.collect():
        body = (r["html"] or "").encode()
        if len(body) >= 1000 and r["page_id"] is not None:
            largest[len(body)] = max(largest.get(len(body), -1), r["page_id"])
    for r in got:
        first = largest.get(r["payload_bytes"])
        assert r["refers_to"] == (None if first in (None, r["page_id"]) else first)
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    found = con.sql(ORACLE_SQL["op10_warc"])
    got = warc.op10_warc(spark, SF).select(found.columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())

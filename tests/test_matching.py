"""Sorted sweeps: as-of joins, suffixes, prefixes of both versions, and closes, against brute force."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import matching, ordered

INF = float("inf")


def test_last_at(spark):
    rng = random.Random(1)
    marks = {f"{rng.randrange(500):03d}m": i for i in range(80)}
    points = sorted({f"{rng.randrange(500):03d}" + rng.choice("apz") for _ in range(300)} | {"000", "999"})
    left = spark.createDataFrame([(p,) for p in points], "key string")
    right = spark.createDataFrame(list(marks.items()), "key string, value int")
    want = {p: marks[max(m for m in marks if m <= p)] if any(m <= p for m in marks) else None for p in points}
    for ranges in (1, 2, 7, 50):
        assert {r["key"]: r["value"] for r in ordered.last_at(left, right, "key", "value", ranges).collect()} == want
    assert {r["value"] for r in ordered.last_at(left, right.limit(0), "key", "value").collect()} == {None}
    assert ordered.last_at(left.limit(0), right, "key", "value").count() == 0


def test_sweeps_multiply_no_rows(spark):
    left = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    right = left.select("key", F.lit(1).alias("value"))
    plan = ordered.last_at(left, right, "key", "value")._jdf.queryExecution().executedPlan().toString()
    assert "Explode" not in plan and "Generate" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.fixture(params=[0, 128], ids=["swept", "compared"], autouse=True)
def few(request, monkeypatch):
    """Both ways: by sorted sweeps, whatever the size, and by comparisons in place where marks are few."""
    monkeypatch.setattr(ordered, "FEW", request.param)


def listed(name, lists, sep="."):
    """The list of the shortest suffix that ends the name at a label; of equals the first list's."""
    clean = lambda x: x.lower().strip(sep) if sep else x.lower()
    own, best = clean(name), None
    for idx, item in lists:
        i = clean(item)
        if own == i or own.endswith(sep + i):
            best = min(best or (len(i), idx), (len(i), idx))
    return INF if best is None else float(best[1])


@pytest.mark.parametrize("sep", [".", ""])
def test_suffixes(spark, sep):
    rng = random.Random(2)
    labels = ["a", "b", "a-b", "A", "b1", "é", "a_b"]
    name = lambda most: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, most)))
    lists = [(rng.randrange(4), ("." if rng.random() < 0.2 and sep else "") + name(4)) for _ in range(40)]
    lists += [(3, lists[0][1]), (0, lists[5][1].upper())]
    names = [name(6) for _ in range(400)] + [".a.b.", "", "zzz", None]
    df = spark.createDataFrame([(i, n, 1) for i, n in enumerate(names)] + [(0, names[1], 2)], "id int, host string, suffix_key int")
    dim = spark.createDataFrame(lists, "list_idx int, item string")
    got = matching.suffix_match(df, dim, "host", separator=sep)
    assert got.columns == [*df.columns, "list_idx"]
    want = sorted((i, str(n), INF if n is None else listed(n, lists, sep)) for i, n in [*enumerate(names), (0, names[1])])
    assert sorted((r["id"], str(r["host"]), r["list_idx"]) for r in got.collect()) == want
    clean = lambda x: x.lower().strip(".") if sep else x.lower()
    proper = {n for n in names if n is not None and any(clean(n) != clean(i) and clean(n).endswith(sep + clean(i)) for _, i in lists)}
    assert {r["host"] for r in matching.has_listed_suffix(df, dim, "host", sep).collect()} == proper
    problems = {(r["list_idx"], r["item"]) for r in matching.list_problems(dim, suffix=True).collect()} if sep else None
    if sep:
        assert problems == {(k, i.lower()) for k, i in lists if listed(i, lists) != k}


def test_prefixes(spark):
    rng = random.Random(3)
    nets = [ipaddress.ip_network((rng.randrange(2**32) >> (32 - n) << (32 - n) if n else 0, n)) for n in [rng.randrange(0, 33) for _ in range(60)]]
    base = int(ipaddress.ip_address("2001:db8::"))
    nets += [ipaddress.ip_network(((base + rng.randrange(2**90)) >> (128 - n) << (128 - n), n)) for n in [rng.randrange(0, 129) for _ in range(60)]]
    nets += [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "10.0.0.0/9", "10.127.255.0/24", "10.127.255.255/32", "255.0.0.0/8", "::/0", "ffff::/16", "ffff:ffff::/32")]
    nets = list(dict.fromkeys(nets))
    addresses = [ipaddress.ip_address(rng.randrange(2**32)) for _ in range(150)] + [ipaddress.ip_address(base + rng.randrange(2**90)) for _ in range(100)]
    for n in nets:  # their edges
        addresses += [n[0], n[-1]] + ([n[-1] + 1] if int(n[-1]) + 1 < 2**n.max_prefixlen else [])
    texts = [str(a) for a in addresses] + ["not one", None, "::ffff:10.0.0.1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, address string")
    dim = spark.createDataFrame([(str(n[0]), n.prefixlen, i) for i, n in enumerate(nets)], "net string, prefix_len int, asn long").withColumn("digits", scalars.address_digits(F.col("net")))
    got = {r["id"]: r["asn"] for r in matching.with_longest_prefix(df, dim, scalars.address_digits(F.col("address"))).collect()}
    for i, t in enumerate(texts):
        a = ipaddress.ip_address(t) if t and t != "not one" else None
        fit = [(n.prefixlen, k) for k, n in enumerate(nets) if a is not None and a.version == n.version and a in n]
        assert got[i] == (max(fit)[1] if fit else None), t
    assert len(got) == len(texts)
    none = matching.with_longest_prefix(df, dim.limit(0), scalars.address_digits(F.col("address")))
    assert {r["asn"] for r in none.collect()} == {None}


FORMS = ["2001:DB8:0:0:8:800:200C:417A", "FF01::101", "::1", "::", "0:0:0:0:0:0:13.1.68.3", "::13.1.68.3", "::FFFF:129.144.52.38", "1::2:3.4.5.6", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
         "1.2.3.4", "255.255.255.255", "0.0.0.0", "1.2.3", "1.2.3.256", "01.2.3.4", "1:2:3:4:5:6:7", "1::2::3", ":::", "12345::", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3", "1.2.3.4::", "g::", "", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:1.2.3.4", "fe80:", ":1"]


def test_addresses(spark):
    df = spark.createDataFrame([(t,) for t in FORMS], "t string")
    for r in df.select("t", scalars.address_digits(F.col("t")).alias("d"), scalars.ip_version(F.col("t")).alias("v")).collect():
        try:
            a = ipaddress.ip_address(r["t"])
            want = f"{int(a):0{8 if a.version == 4 else 32}x}", a.version
        except ValueError:
            want = None, None
        assert (r["d"], r["v"]) == want, r["t"]


def test_network_digits(spark):
    rng = random.Random(4)
    rows = [(f"{rng.randrange(2**32):08x}", n) for n in range(33)] + [(f"{rng.randrange(2**128):032x}", n) for n in range(129)]
    df = spark.createDataFrame(rows, "d string, n int")
    for r in df.select("d", "n", scalars.network_digits(F.col("d"), F.col("n")).alias("first"), scalars.network_digits(F.col("d"), F.col("n"), last=True).alias("last")).collect():
        width = len(r["d"]) * 4
        net = ipaddress.ip_network((int(r["d"], 16) >> (width - r["n"]) << (width - r["n"]) if r["n"] else 0, r["n"])) if width == 32 else ipaddress.IPv6Network((int(r["d"], 16) >> (width - r["n"]) << (width - r["n"]) if r["n"] else 0, r["n"]))
        assert (int(r["first"], 16), int(r["last"], 16)) == (int(net[0]), int(net[-1]))


def test_closes_of_one_key_of_a_million_rows(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("k"), "id")
    streams, closes = rows.withColumnRenamed("id", "ended"), rows.where("id % 10 = 9").withColumnRenamed("id", "closed")
    began = time.time()
    wrong = matching.next_close(streams, closes, ["k"], "ended", "closed").where("closed_at <> ended + 9 - ended % 10 or closed_at is null")
    assert wrong.count() == 0 and time.time() - began < 60


def test_any_match_keeps_rows_whose_ids_recur(spark):
    lists = spark.createDataFrame([(1, "a"), (0, "B"), (2, "c")], "list_idx int, item string")
    rows = [(1, "A", None), (1, "c", "b"), (1, "A", None), (2, "x", None), (None, "c", "a"), (None, None, None)]
    events = spark.createDataFrame(rows, "id long, k string, m string")
    found = matching.any_match(events, lists, ["id"], [F.col("k"), F.col("m")])
    want = [(1, 1.0), (1, 0.0), (1, 1.0), (2, INF), (None, 1.0), (None, INF)]
    assert found.columns == ["id", "list_idx"] and sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_ipv6_of_long_keys(spark, tmp_path):
    """Keys beyond one group of an address are found too."""
    from veilcount.plans.queries import QUERIES

    keys = [1, 65_535, 65_536, 900_000, 2**33 + 7, 2**62, -1]
    spark.createDataFrame([(k, 4) for k in keys], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(25).select(F.col("id").cast("int").alias("n_nationkey")).write.parquet(str(tmp_path / "nation.parquet"))
    found = QUERIES["m5_longest_prefix_ipv6"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted((k, 4) for k in keys)

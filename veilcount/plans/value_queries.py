"""Queries of single values and small rules: cells, hosts, names, sizes, flags, limits, lists that overlap, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import binning, hmm, matching, weights
from veilcount.plans.registry import query, table
from veilcount.sources import events as ev

S_ORDERS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice AS DOUBLE) AS total, o_orderkey * o_custkey * 37 - 5000 AS n,
  CASE o_orderkey % 3 WHEN 0 THEN md5(o_orderkey || '') WHEN 1 THEN substr(md5(o_custkey || ''), 1, 16) ELSE upper(substr(translate(md5(o_orderkey || ''), '0189', 'abcd'), 1, 16)) END AS name,
  CASE o_orderkey % 5 WHEN 0 THEN '??' WHEN 1 THEN substr(o_orderpriority, 2, 2) WHEN 2 THEN '!!' WHEN 3 THEN 'Us' ELSE 'USA' END AS code FROM orders)"""


@query(
    f"""WITH {S_ORDERS} SELECT k AS o_orderkey, greatest(0, coalesce(CASE WHEN k % 3 = 0 THEN c END, 0), coalesce(CASE WHEN k % 5 > 0 THEN k % 100 END, 0), coalesce(CASE WHEN k % 7 = 0 THEN -5 END, 0)) AS cells,
 CASE WHEN k % 4 = 0 AND c % 300 < 256 THEN 'IPv4Literal' WHEN k % 4 = 1 THEN 'IPv6Literal' ELSE 'Hostname' END AS host,
 regexp_full_match(name, '[a-zA-Z2-7]{{16}}|[0-9a-fA-F]{{32}}') AS onion, regexp_full_match(code, '[a-zA-Z0-9]{{2}}|\\?\\?|!!') AS country,
 CASE WHEN n < 1024 THEN n || '.0 B' WHEN n < 1048576 THEN (n * 20 + 1024) // 20480 || '.' || (n * 20 + 1024) // 2048 % 10 || ' kB'
  WHEN n < 1073741824 THEN (n * 20 + 1048576) // 20971520 || '.' || (n * 20 + 1048576) // 2097152 % 10 || ' MB'
  ELSE (n * 20 + 1073741824) // 21474836480 || '.' || (n * 20 + 1073741824) // 2147483648 % 10 || ' GB' END AS size,
 k % 3 < 2 AS close FROM o"""
)
def f5_f22_values(spark, sf_dir):
    """An order's figures as counts of cells, a host, names, a size and two near totals."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    text = lambda x: F.md5(x.cast("string").cast("binary"))
    requested = (
        F.when(mod(4) == 0, F.concat(F.lit("10."), mod(256), F.lit(".0."), F.pmod(c, F.lit(300))))
        .when(mod(4) == 1, F.concat(F.lit("fe80::"), mod(10_000)))
        .when(mod(4) == 2, F.col("o_orderpriority"))
    )
    upper = F.upper(F.substring(F.translate(text(k), "0189", "abcd"), 1, 16))
    name = F.when(mod(3) == 0, text(k)).when(mod(3) == 1, F.substring(text(c), 1, 16)).otherwise(upper)
    code = F.when(mod(5) == 0, "??").when(mod(5) == 1, F.substring("o_orderpriority", 2, 2)).when(mod(5) == 2, "!!").when(mod(5) == 3, "Us").otherwise("USA")
    total = F.col("o_totalprice").cast("double")
    apart = F.when(mod(3) == 0, 0.0).when(mod(3) == 1, 5e-10).otherwise(2e-9)
    cells = scalars.cell_count(F.when(mod(3) == 0, c), F.when(mod(5) > 0, mod(100)), F.when(mod(7) == 0, F.lit(-5)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        cells.cast("long").alias("cells"),
        scalars.host_class(requested).alias("host"),
        scalars.is_onion(name).alias("onion"),
        scalars.is_country(code).alias("country"),
        scalars.size_text(k * c * 37 - 5000).alias("size"),
        scalars.is_close(total, total * (1 + apart)).alias("close"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN NOT (o_orderkey % 3 = 0 OR (o_orderkey % 7 > 0 AND o_orderkey % 5 = 0)) THEN o_orderkey % 2 = 0 END AS exit_flag FROM orders"""
)
def p7_exit_flags(spark, sf_dir):
    """Orders as circuits; every third is a directory's, every fifth of those that tell it an introduction's."""
    mod = lambda n: F.pmod("o_orderkey", F.lit(n))
    told = F.when(mod(7) > 0, mod(5) == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", ev.clean_exit_flag(mod(2) == 0, mod(3) == 0, told).alias("exit_flag"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3")
def s3_first_events(spark, sf_dir):
    """S3: no more than three events of each circuit."""
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return ev.first_of_each(events, 3, ["l_orderkey"], ["l_linenumber"])


@query(
    """SELECT position, round(avg(fraction), 6) AS fraction, count(DISTINCT consensus) AS consensuses FROM (SELECT s_nationkey AS consensus, 'p' || s_suppkey % 4 AS position,
 sum(CAST(s_acctbal AS DOUBLE) / 10000) AS fraction FROM supplier GROUP BY 1, 2) GROUP BY 1"""
)
def a11_mean_fractions(spark, sf_dir):
    """Nations as consensus documents."""
    position = F.concat(F.lit("p"), F.pmod("s_suppkey", F.lit(4)))
    each = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("consensus"), position.alias("position"))
    found = weights.mean_fractions(each.agg(F.sum(F.col("s_acctbal").cast("double") / 10000).alias("fraction")))
    return found.withColumn("fraction", F.round("fraction", 6))


@query("SELECT count(*) AS bins FROM (SELECT DISTINCT p_brand, p_size FROM part)")
def a5_bins(spark, sf_dir):
    """A5: brands as counters, with a bin for each size of their parts."""
    return binning.count_bins(table(spark, sf_dir, "part").select(F.col("p_brand").alias("counter"), F.col("p_size").alias("bin_idx")).distinct())


S_LISTS = """l AS (SELECT DISTINCT c_nationkey % 4 AS list_idx, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' || c_custkey % 20 || '.' END || 'd' || c_custkey % 50 || '.net' AS item FROM customer),
 s AS (SELECT item, min(list_idx) AS idx FROM l GROUP BY 1),
 f AS (SELECT a.item, arg_min(b.idx, length(b.item)) AS found FROM s a JOIN s b ON a.item = b.item OR ends_with(a.item, '.' || b.item) GROUP BY 1)"""


@query(f"WITH {S_LISTS} SELECT list_idx, item FROM l JOIN f USING (item) WHERE found <> list_idx")
def m7_suffix_problems(spark, sf_dir):
    """M7: customers' domains as four lists of suffixes; names that a suffix of another list takes."""
    c = lambda n: F.pmod("c_custkey", F.lit(n))
    lead = F.when(c(3) == 0, "").otherwise(F.concat(F.lit("X"), c(20), F.lit(".")))
    item = F.concat(lead, F.lit("d"), c(50), F.lit(".net"))
    lists = table(spark, sf_dir, "customer").select(F.pmod("c_nationkey", F.lit(4)).alias("list_idx"), item.alias("item"))
    return matching.list_problems(lists, suffix=True)


#: Regions' states move to nations; the third region's shares miss some, the fourth's name needs none.
S_MOVES = """t AS (SELECT CASE n_regionkey WHEN 0 THEN 'START' WHEN 3 THEN 'sEnd' ELSE 's' || n_regionkey END AS src, n_name AS dst,
 CASE n_regionkey WHEN 2 THEN 0.125 WHEN 3 THEN 0.5 ELSE 1.0 / count(*) OVER (PARTITION BY n_regionkey) END AS p FROM nation)"""


def moves(spark, sf_dir):
    r = F.col("n_regionkey")
    n = table(spark, sf_dir, "nation")
    src = F.when(r == 0, "START").when(r == 3, "sEnd").otherwise(F.concat(F.lit("s"), r))
    held = n.join(n.groupBy("n_regionkey").agg(F.count("*").alias("held")), "n_regionkey")
    p = F.when(r == 2, 0.125).when(r == 3, 0.5).otherwise(1.0 / F.col("held"))
    return held.select(src.alias("src"), F.col("n_name").alias("dst"), p.alias("p"))


@query(f"WITH {S_MOVES} SELECT src, round(sum(p), 6) AS p FROM t WHERE src <> 'sEnd' GROUP BY 1 HAVING abs(sum(p) - 1) > 1e-9")
def h1_model_errors(spark, sf_dir):
    """H1: sources whose moves don't sum to 1."""
    found = moves(spark, sf_dir)
    start = found.where("src = 'START'").select(F.col("dst").alias("state"), "p")
    return hmm.model_errors(start, found.where("src <> 'START'")).select("src", F.round("p", 6).alias("p"))


@query(
    f"""WITH {S_MOVES}, n AS (SELECT *, length(dst) * 1.0 / sum(length(dst)) OVER (PARTITION BY src) AS share FROM t),
 m AS (SELECT *, 0.5 * p + 0.5 * share AS mixed FROM n) SELECT src, dst, round(mixed / sum(mixed) OVER (PARTITION BY src), 9) AS p FROM m"""
)
def h5_updated_model(spark, sf_dir):
    """H5: moves after a round whose tallies are the lengths of nations' names."""
    own = moves(spark, sf_dir)
    sent = spark.createDataFrame([], "state string, obs string, dp double, mu double, sigma double, lam double")
    counters = hmm.model_counters(spark, "M", own, sent)
    tallies = counters.select("counter", F.lit(0).alias("bin_idx"), F.length("b").alias("count"))
    after, _ = hmm.updated_model(counters, own, sent, tallies)
    return after.select("src", "dst", F.round("p", 9).alias("p"))

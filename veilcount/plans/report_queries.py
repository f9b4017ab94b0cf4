"""Queries of reports: labels, lines of text, summaries, encodings, and relays' shares of all positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import analysis, labels, weights
from veilcount.plans.registry import query, table

INF = float("inf")
#: The kinds of counters in turn, and how the lists of each kind name their items.
TAILS = ("CountryMatchCountList", "ASMatchCountList", "Ratio", "ByteHistogram")
S_TAIL = "['" + "', '".join(TAILS) + "'][n_nationkey % 4 + 1]"


@query(
    f"""WITH c AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 'ExitDomain' || n_name || 'MatchCountList'
 ELSE n_name || {S_TAIL} END AS counter FROM nation), b AS (SELECT *, unnest(range(6)) AS i FROM c),
 l AS (SELECT *, CASE WHEN i < 5 THEN (SELECT r_name FROM region WHERE r_regionkey = i) END AS r,
 CASE WHEN k % 5 = 0 THEN 1 WHEN k % 4 = 0 THEN 2 WHEN k % 4 = 1 THEN 3 END AS kind,
 (i - 1) || '.0' AS lo, CASE WHEN i = 5 THEN 'inf' ELSE i || '.0' END AS hi FROM b),
 m AS (SELECT *, '[' || lo || ',' || hi || ')' AS range_label, CASE kind WHEN 3 THEN r || ' and others' ELSE r END AS own FROM l),
 n AS (SELECT *, CASE WHEN kind IS NOT NULL THEN coalesce(own, '(unmatched)') END AS listed FROM m)
 SELECT counter, CAST(i AS INTEGER) AS bin_idx, range_label, coalesce(listed, range_label) AS label,
 coalesce(CASE WHEN length(listed) > 15 THEN left(listed, 12) || '...' ELSE listed END, '[' || CASE WHEN counter LIKE '%Ratio'
 THEN lo ELSE i - 1 || '' END || ',' || CASE WHEN i = 5 THEN '$\\infty$' WHEN counter LIKE '%Ratio' THEN hi ELSE i || '' END || ')')
 AS graph_label FROM n"""
)
def r1_bin_labels(spark, sf_dir):
    """Six bins a nation, under lists that have the five regions' names."""
    k = F.col("n_nationkey")
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), (k % 4 + 1).cast("int"))
    name = F.when(k % 5 == 0, F.concat(F.lit("ExitDomain"), "n_name", F.lit("MatchCountList")))
    counters = table(spark, sf_dir, "nation").select(F.coalesce(name, F.concat("n_name", tail)).alias("counter"))
    bins = counters.select("counter", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("bin_idx"))
    i = F.col("bin_idx").cast("double")
    bins = bins.select("counter", "bin_idx", (i - 1).alias("lo"), F.when(i < 5, i).otherwise(INF).alias("hi"))
    forms = {
        "domain": F.concat(F.lit("/lists/of.old/"), "r_name", F.lit(".txt")),
        "country": F.concat(F.lit("'"), "r_name", F.lit("' (1)")),
        "as": F.concat("r_name", F.lit(" and others")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), f.alias("label")) for n, f in forms.items()]))
    lists = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("position"), each.alias("x"))
    out = labels.bin_labels(bins, lists.select("x.kind", "position", "x.label"))
    return out.drop("lo", "hi")


S_PARTS = """r AS (SELECT p_brand AS counter, CAST(p_size % 5 AS INTEGER) AS bin_idx, p_type AS experiment,
 CAST(sum(CAST(floor(p_retailprice) AS BIGINT) - 900) AS DOUBLE) AS value, CAST(count(*) % 4 * 40 AS DOUBLE) AS sigma FROM part GROUP BY 1, 2, 3)"""


def part_results(spark, sf_dir):
    worth = F.sum(F.floor("p_retailprice").cast("long") - 900).cast("double")
    bin_idx = F.pmod("p_size", F.lit(5)).cast("int")
    found = table(spark, sf_dir, "part").groupBy(
        F.col("p_brand").alias("counter"), bin_idx.alias("bin_idx"), F.col("p_type").alias("experiment")
    )
    out = found.agg(worth.alias("value"), (F.count("*") % 4 * 40).cast("double").alias("sigma"))
    lo, hi = (F.col("bin_idx") - 1).cast("double"), F.when(F.col("bin_idx") < 4, F.col("bin_idx")).otherwise(INF)
    return out.withColumn("lo", lo).withColumn("hi", hi.cast("double")).withColumn("excess", F.lit(2.0))


@query(
    f"""WITH {S_PARTS}, e AS (SELECT *, sigma > 0 AS noisy, CAST(CASE WHEN sigma > 0 THEN round(2 * sqrt(2 * sigma * sigma)) ELSE 0 END AS BIGINT) AS err,
 CAST(value AS BIGINT) AS v FROM r), f AS (SELECT *, CASE WHEN noisy THEN length(err || '') + 3 ELSE 14 END AS wide,
 CASE WHEN v <> 0 THEN err / abs(value) WHEN err > 0 THEN CAST('inf' AS DOUBLE) ELSE 0 END AS p, greatest(v, 0) AS bv,
 format('{{:.1f}}', round_even(p * 100, 1)) AS shown, greatest(v - err, 0) AS low, greatest(v + err, 0) AS high FROM e),
 g AS (SELECT *, concat_ws(', ', CASE WHEN v <> bv THEN 'value' END, CASE WHEN noisy AND bv - low <> err THEN 'error low' END,
 CASE WHEN noisy AND high - bv <> err THEN 'error high' END) AS moved FROM f)
 SELECT experiment, counter, bin_idx, counter || ' [' || lpad(bin_idx - 1 || '.0', 8, ' ') || ',' || lpad(CASE WHEN bin_idx < 4 THEN bin_idx || '.0' ELSE 'inf' END, 8, ' ')
 || ') = ' || lpad(v || '', CAST(greatest(wide, length(v || '')) AS INTEGER), ' ') || CASE WHEN noisy THEN ' +- ' || err || ' (' || lpad(shown, CAST(greatest(7, length(shown)) AS INTEGER), ' ') || '%)' ELSE '' END
 || ' (' || CASE WHEN p >= 1 THEN 'obscured' ELSE ' visible' END || ', ' || CASE WHEN v - err <= 0 THEN '    zero' ELSE 'positive' END || ') bound: '
 || lpad(bv || '', CAST(greatest(wide, length(bv || '')) AS INTEGER), ' ') || CASE WHEN noisy THEN ' [' || lpad(low || '', CAST(greatest(wide, length(low || '')) AS INTEGER), ' ') || ', '
 || lpad(high || '', CAST(greatest(wide, length(high || '')) AS INTEGER), ' ') || ']' ELSE '' END || ' (' || CASE WHEN moved = '' THEN 'no change' ELSE moved END || ')' AS line FROM g"""
)
def k2_text_lines(spark, sf_dir):
    return labels.text_lines(analysis.with_errors(part_results(spark, sf_dir)))


@query("SELECT p_brand AS counter, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS experiments FROM part GROUP BY 1")
def m13_linked_counters(spark, sf_dir):
    found = labels.linked(part_results(spark, sf_dir))
    return found.select("counter", F.array_join("experiments", ",").alias("experiments"))


@query(
    """SELECT lang, '''' || CASE WHEN n > 1 THEN CASE WHEN length(a) + length(b) + 4 <= 104 THEN a || '....' || b
 ELSE left(a || '....' || b, 50) || '....' || right(a || '....' || b, 50) END
 WHEN n = 1 THEN CASE WHEN length(a) <= 50 THEN a ELSE left(a, 23) || '....' || right(a, 23) END ELSE '' END || ''' (' || n || ')' AS texts
 FROM (SELECT lang, min(text) AS a, max(text) AS b, count(text) AS n FROM documents GROUP BY 1)"""
)
def f20_list_summaries(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(scalars.listed(F.col("text")).alias("texts"))


@query("SELECT page_id, CASE WHEN length(html) <= 100 THEN html ELSE left(html, 49) || '...' || right(html, 48) END AS html FROM pages")
def f20_shortened(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.shortened(F.col("html")).alias("html"))


@query(
    """SELECT s_suppkey, '{"k":' || s_suppkey || ',"name":"' || s_name || '","none":null}' AS data,
 to_base64(encode('{"k":' || s_suppkey || ',"name":"' || s_name || '","none":null}')) AS encoded, s_name AS name FROM supplier"""
)
def f23_encoded(spark, sf_dir):
    data = F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(None).cast("int").alias("none"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", data.alias("data"))
    s = s.select("s_suppkey", scalars.json_text(F.col("data")).alias("data"), scalars.encoded(F.col("data")).alias("encoded"))
    return s.withColumn("name", scalars.decoded(F.col("encoded"), "k long, name string")["name"])


@query(
    """SELECT o_orderkey, regexp_full_match(o_orderpriority, '[A-Za-z0-9]+') AS priority, regexp_full_match(o_orderstatus, '[A-Za-z0-9]+') AS status,
 o_custkey % 7 > 0 AS system FROM orders"""
)
def f9_checks(spark, sf_dir):
    asn = F.pmod("o_custkey", F.lit(7)).cast("string")
    reason = lambda c: scalars.is_reason(F.col(c))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", reason("o_orderpriority").alias("priority"), reason("o_orderstatus").alias("status"),
        scalars.is_as_number(asn).alias("system"),
    )


NET_WEIGHTS = {"Wgd": 0.1, "Wgg": 0.6, "Wgm": 0.6, "Wmd": 0.2, "Wmg": 0.4, "Wme": 0.3, "Wmm": 1.0, "Wed": 0.7, "Weg": 0.5, "Wee": 0.9, "Wem": 0.8}


@query(
    """WITH r AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS g, s_suppkey % 3 = 0 AS e, s_suppkey % 5 > 0 AS st, s_suppkey % 7 > 0 AS dir,
 s_acctbal + 1000 AS b, s_nationkey < 5 AS mine FROM supplier),
 m AS (SELECT *, b * CASE WHEN g AND e THEN 0.2 WHEN g THEN 0.4 WHEN e THEN 0.3 ELSE 1.0 END AS mid FROM r),
 w AS (SELECT mine, unnest([
 {'p': 'g', 'w': CASE WHEN g AND st THEN b * CASE WHEN e THEN 0.1 ELSE 0.6 END ELSE 0 END}, {'p': 'm', 'w': mid},
 {'p': 'e', 'w': CASE WHEN k % 11 > 0 AND k % 4 > 0 THEN b * CASE WHEN g AND e THEN 0.7 WHEN g THEN 0.5 WHEN e THEN 0.9 ELSE 0.8 END ELSE 0 END},
 {'p': 'h2', 'w': CASE WHEN dir THEN k / 1024.0 ELSE 0 END}, {'p': 'h3', 'w': CASE WHEN dir AND k % 13 >= 8 AND k % 3 > 0 THEN 1 ELSE 0 END},
 {'p': 'i', 'w': CASE WHEN st THEN mid ELSE 0 END}, {'p': 'r2', 'w': mid}, {'p': 'r3', 'w': CASE WHEN k % 3 > 0 THEN mid ELSE 0 END}]) AS x FROM m),
 s AS (SELECT x.p AS position, sum(x.w) AS total, sum(CASE WHEN mine THEN x.w ELSE 0 END) AS own FROM w GROUP BY 1)
 SELECT position, round(total, 3) AS total, round(own, 3) AS own, round(own / total, 6) AS fraction,
 round(own / total * CASE position WHEN 'h2' THEN 25 / 24.0 WHEN 'h3' THEN 2 ELSE 1 END, 6) AS served_fraction FROM s"""
)
def m11_positions(spark, sf_dir):
    """Suppliers as relays of all kinds; every eleventh is a bad exit, every fourth lets nothing out."""
    k = F.col("s_suppkey")
    names = {"Guard": k % 2 == 0, "Exit": k % 3 == 0, "Stable": k % 5 > 0, "HSDir": k % 7 > 0, "BadExit": k % 11 == 0}
    flags = F.array_compact(F.array(F.lit("Fast"), *[F.when(c, n) for n, c in names.items()]))
    spoken = F.when(k % 3 > 0, "1-2,4").otherwise("1,3-4")
    relays = table(spark, sf_dir, "supplier").select(
        flags.alias("flags"),
        (F.col("s_acctbal") + 1000).alias("bandwidth"),
        (k % 4 > 0).alias("exits"),
        F.concat(F.lit("0.3.0."), k % 13, F.lit("-alpha")).alias("version"),
        F.create_map(F.lit("HSDir"), spoken, F.lit("HSRend"), spoken).alias("protocols"),
        (k / 1024).alias("spread"),
        (F.col("s_nationkey") < 5).alias("is_mine"),
    )
    out = weights.network_fractions(relays, F.col("is_mine"), NET_WEIGHTS)
    places = {"total": 3, "own": 3, "fraction": 6, "served_fraction": 6}
    return out.select("position", *[F.round(c, n).alias(c) for c, n in places.items()])

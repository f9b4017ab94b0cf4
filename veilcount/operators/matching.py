"""List matching: exact, by suffix, by address prefix; sets of counter names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.checkpoints import stored
from veilcount.functions import scalars
from veilcount.operators import ordered

INF = float("inf")


#: What the items of each kind of list must look like.
KINDS = {
    "domain": scalars.is_domain,
    "country": scalars.is_country,
    "as": scalars.is_as_number,
    "reason": lambda c: F.length(c).between(1, 50),
    "onion": scalars.is_onion,
    "any": lambda c: c.isNotNull(),
}


def load_list(lines: DataFrame, value: str = "value", kind: str = "any") -> DataFrame:
    """Items of a list file, without blank lines and comments, trimmed and in lower case.

    A line that isn't of its kind ends the job. Onion addresses may be URLs.
    """
    text = F.trim(value)
    item = scalars.onion_name(text) if kind == "onion" else F.lower(text)
    items = lines.where(~text.rlike(r"^(#|//|;)") & (text != "")).select(item.alias("item"), text.alias("line"))
    said = F.concat(F.lit(f"not a {kind}: "), F.col("line"))
    sound = F.coalesce(KINDS[kind](F.col("item")), F.lit(False))
    return items.select(F.when(sound, F.col("item")).otherwise(F.raise_error(said)).alias("item"))


def load_prefixes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines "prefix/length system" (or with a blank or tab for the slash) as ipver, net, digits, prefix_len, asn.

    net is the number of an IPv4 network; digits are the address in hex: 8 of them for IPv4, 32 for IPv6.
    """
    text = F.trim(value)
    parts = F.split(F.regexp_replace(text, "/", " "), r"\s+")
    rows = lines.where(~text.rlike(r"^(#|//|;)") & (text != "")).select(parts.alias("p"))
    part = lambda i: F.get("p", F.lit(i))
    version = scalars.ip_version(part(0))
    rows = rows.select(
        version.alias("ipver"),
        scalars.ipv4_number(part(0)).alias("net"),
        scalars.address_digits(part(0)).alias("digits"),
        part(1).try_cast("int").alias("prefix_len"),
        part(2).try_cast("long").alias("asn"),
    )
    most = F.when(F.col("ipver") == 4, 32).otherwise(128)
    sound = F.coalesce(F.col("prefix_len").between(0, most) & F.col("asn").isNotNull(), F.lit(False))
    sound = sound & F.col("ipver").isNotNull()
    return rows.withColumn("asn", F.when(sound, F.col("asn")).otherwise(F.raise_error(F.lit("not a prefix and its system"))))


def list_problems(lists: DataFrame, suffix: bool = False, reject_overlapping: bool = True) -> DataFrame:
    """M7: list_idx, item: items that another list takes, so that they never match their own.

    Without reject_overlapping, only those of the first list.
    """
    own = lists.select("list_idx", F.lower("item").alias("item"))
    if suffix:
        names = own.select("item").distinct()
        found = suffix_match(names, lists, "item", "_found")
    else:
        found = exact_match(own.select("item").distinct(), lists, "item", "_found")
    wrong = own.join(found, "item").where(F.col("_found") != F.col("list_idx"))
    wrong = wrong if reject_overlapping else wrong.where("list_idx = 0")
    return wrong.select("list_idx", "item").distinct()


def disjoint(lists: DataFrame) -> DataFrame:
    """M2: (list_idx, item), each item in the first of its lists."""
    return lists.groupBy(F.lower("item").alias("item")).agg(F.min("list_idx").alias("list_idx"))


def exact_match(events: DataFrame, lists: DataFrame, key: str, out: str = "list_idx") -> DataFrame:
    """M1: the item's list, infinity where none has it. Spark broadcasts small lists by their size."""
    named = disjoint(lists).select(F.col("item").alias("_item"), F.col("list_idx").cast("double").alias(out))
    return events.join(named, F.lower(key) == F.col("_item"), "left").drop("_item").withColumn(out, F.coalesce(out, F.lit(INF)))


def any_match(events: DataFrame, lists: DataFrame, id_cols: list[str], keys: list[Column], out: str = "list_idx") -> DataFrame:
    """M3: the first list that holds any of the keys, a row for each event, whether or not its ids recur."""
    names = [f"_key{i}" for i in range(len(keys))]
    found = events.select(*id_cols, *[k.alias(n) for n, k in zip(names, keys, strict=True)])
    for n in names:
        found = exact_match(found, lists, n, f"{n}_list")
    first = F.array_min(F.array(*[F.col(f"{n}_list") for n in names]))
    return found.select(*id_cols, first.alias(out))


def onion_match(events: DataFrame, lists: DataFrame, id_cols: list[str], key: str, out: str = "list_idx") -> DataFrame:
    """M3: the first list that holds an onion name, or its MD5."""
    return any_match(events, lists, id_cols, [F.col(key), scalars.onion_md5(F.col(key))], out)


#: Stands for the separator in reversed names: before all that names hold, so what a suffix covers follows it at once.
_SPLIT = "\x01"


def suffix_key(name: Column, separator: str = ".") -> Column:
    """A name's labels (without a separator, its characters) in lower case, last first.

    Separators at the ends don't count.
    """
    low = F.lower(name)
    if not separator:
        return F.reverse(low)
    ends = rf"^(\Q{separator}\E)+|(\Q{separator}\E)+$"
    return F.array_join(F.reverse(F.split(F.regexp_replace(low, ends, ""), rf"\Q{separator}\E")), _SPLIT)


def top_suffixes(lists: DataFrame, separator: str = ".") -> DataFrame:
    """M4: (suffix_key, list_idx) of the lists' suffixes that no shorter one covers; of equals, the first list's.

    Suffixes sorted by their reversed labels follow the one that covers them, up to its last possible name.
    """
    key = suffix_key(F.col("item"), separator).alias("suffix_key")
    items = lists.select(key, "list_idx").where("suffix_key is not null").groupBy("suffix_key").agg(F.min("list_idx").alias("list_idx"))
    end = F.concat("suffix_key", F.lit("\x02" if separator else "\U0010FFFF"))
    marked = ordered.carried(stored(items.withColumn("_end", end), "items"), "suffix_key", "_end", "_covered", greatest=True)
    return marked.where(F.coalesce(F.col("_covered") < F.col("suffix_key"), F.lit(True))).select("suffix_key", "list_idx")


def prepared_suffixes(lists: DataFrame, separator: str = ".") -> DataFrame:
    """M4: lists made ready once for many matches, as a table in the shared folder; suffix_match() takes it for the lists."""
    top = top_suffixes(lists, separator)
    return stored(top.select("suffix_key", F.struct("suffix_key", "list_idx").alias("hit")), "suffixes")


def _under_suffix(names: DataFrame, lists: DataFrame, separator: str) -> DataFrame:
    """names (suffix_key, distinct) with hit: the struct (suffix_key, list_idx) of the one suffix that can cover each."""
    top = lists if "hit" in lists.columns else prepared_suffixes(lists, separator)
    return ordered.last_at(names, top, "suffix_key", "hit")


def suffix_match(events: DataFrame, lists: DataFrame, key: str, out: str = "list_idx", separator: str = ".") -> DataFrame:
    """M4: the list of the shortest matching suffix, infinity where there is none. Without a separator any ending
    of the name is a suffix (M4b).

    Few suffixes (ordered.FEW) are compared in place. Else distinct names meet the suffixes in one sorted sweep, one row
    a name; events then join their names.
    """
    lead = F.lit(_SPLIT if separator else "")
    named = events.withColumn("_name", suffix_key(F.col(key), separator))
    few = None if "hit" in lists.columns else ordered.few(lists.select(suffix_key(F.col("item"), separator).alias("key"), "list_idx").where("key is not null"))
    if few is not None:  # known to be few, so every name is matched where it is
        tops: dict[str, float] = {}
        for k, i in sorted((r["key"], r["list_idx"]) for r in few):
            if k not in tops and not any(k.startswith(t + (_SPLIT if separator else "")) for t in tops):
                tops[k] = float(i)
        one = [(k, F.struct(F.lit(k).alias("suffix_key"), F.lit(i).alias("list_idx"))) for k, i in ordered.in_order(tops)]
        none = F.lit(None).cast("struct<suffix_key:string,list_idx:double>")
        near = named.withColumn("_hit", F.when(F.col("_name").isNotNull(), ordered.last_of(F.col("_name"), one, none)))
        item = F.col("_hit.suffix_key")
        under = (F.col("_name") == item) | F.startswith("_name", F.concat(item, lead))
        return near.withColumn(out, F.when(under, F.col("_hit.list_idx")).otherwise(INF)).drop("_name", "_hit")
    top = lists if "hit" in lists.columns else prepared_suffixes(lists, separator)
    found = _under_suffix(named.select(F.col("_name").alias("suffix_key")).where("suffix_key is not null").distinct(), top, separator)
    own = F.col("hit.suffix_key")
    is_hit = (F.col("suffix_key") == own) | F.startswith("suffix_key", F.concat(own, lead))
    hits = found.where(is_hit).select(F.col("suffix_key").alias("_key"), F.col("hit.list_idx").cast("double").alias(out))
    met = named.join(hits, F.col("_name") == F.col("_key"), "left").drop("_name", "_key")
    return met.withColumn(out, F.coalesce(out, F.lit(INF)))


def has_listed_suffix(names: DataFrame, lists: DataFrame, key: str, separator: str = ".") -> DataFrame:
    """M6: names with a proper suffix in the lists."""
    lead = F.lit(_SPLIT if separator else "")
    named = names.select(key).distinct().withColumn("suffix_key", suffix_key(F.col(key), separator))
    found = _under_suffix(named.select("suffix_key").where("suffix_key is not null").distinct(), lists.select("item", F.lit(0).alias("list_idx")), separator)
    longer = F.startswith("suffix_key", F.concat("hit.suffix_key", lead)) & (F.col("suffix_key") != F.col("hit.suffix_key"))
    return named.join(found.where(longer).select("suffix_key"), "suffix_key", "left_semi").select(key)


def prefix_marks(prefixes: DataFrame, lengths: list[int]) -> DataFrame:
    """M5: nested prefixes (digits, prefix_len, asn) as the disjoint ranges that they cut addresses into.

    key: an address, then 0 (the range begins there) or 2 (after it); value: the struct of the range's asn, null
    outside all prefixes. At a prefix's end its nearest enclosing one goes on. lengths: those that occur, in order.
    """
    first = scalars.network_digits(F.col("digits"), F.col("prefix_len"))
    own = prefixes.select(first.alias("first"), "prefix_len", "asn").groupBy("first", "prefix_len").agg(F.max("asn").alias("asn"))
    shorter = [F.when(F.col("prefix_len") > n, F.struct(scalars.network_digits(F.col("first"), F.lit(n)).alias("first"), F.lit(n).alias("prefix_len"))) for n in lengths[:-1]]
    if shorter:
        tried = own.select(F.col("first").alias("inner_first"), F.col("prefix_len").alias("inner_len"), F.explode(F.array_compact(F.array(*shorter))).alias("p")).select("inner_first", "inner_len", "p.*")
        parents = tried.join(own, ["first", "prefix_len"]).groupBy("inner_first", "inner_len").agg(F.max_by("asn", "prefix_len").alias("outer"))
        named = parents.select(F.col("inner_first").alias("first"), F.col("inner_len").alias("prefix_len"), "outer")
        own = own.join(named, ["first", "prefix_len"], "left")
    else:
        own = own.withColumn("outer", F.lit(None).cast(own.schema["asn"].dataType))
    last = scalars.network_digits(F.col("first"), F.col("prefix_len"), last=True)
    begin = F.struct(F.concat("first", F.lit("0")).alias("key"), F.col("prefix_len").alias("rank"), F.struct("asn").alias("value"))
    end = F.struct(F.concat(last, F.lit("2")).alias("key"), (-F.col("prefix_len")).alias("rank"), F.struct(F.col("outer").alias("asn")).alias("value"))
    marks = own.select(F.explode(F.array(begin, end)).alias("m")).select("m.*")
    # Of prefixes that begin at one address the longest holds; of those that end there, the shortest tells what goes on.
    return marks.groupBy("key").agg(F.max_by("value", "rank").alias("value"))


def few_ranges(prefixes: list) -> dict[str, int | None]:
    """prefix_marks() of a few prefixes of one version."""
    n = len(prefixes[0]["digits"])
    nets: dict[tuple[int, int], int] = {}
    for r in prefixes:
        host = 4 * n - r["prefix_len"]
        net = int(r["digits"], 16) >> host << host, r["prefix_len"]
        nets[net] = max(nets.get(net, r["asn"]), r["asn"])

    def longest(at: int) -> int | None:
        held = [(length, asn) for (first, length), asn in nets.items() if at >> (4 * n - length) == first >> (4 * n - length)]
        return max(held)[1] if held else None

    out: dict[str, int | None] = {}
    for first, length in nets:
        last = first | ((1 << (4 * n - length)) - 1)
        out[f"{first:0{n}x}0"] = longest(first)
        out[f"{last:0{n}x}2"] = longest(last + 1) if last + 1 < 1 << (4 * n) else None
    return out


def prepared_prefixes(prefixes: DataFrame) -> DataFrame:
    """M5: prefixes made ready once for many matches, as a table in the shared folder; with_longest_prefix() takes it for them."""
    width = F.length("digits")
    seen = prefixes.select(width.alias("width"), "prefix_len").distinct().collect()  # 33 and 129 lengths at most
    kind = prefixes.schema["asn"].dataType.simpleString()
    out = prefixes.sparkSession.createDataFrame([], f"key string, value struct<asn: {kind}>, width int")
    for n in (8, 32):
        lengths = sorted(r["prefix_len"] for r in seen if r["width"] == n)
        if lengths:
            out = out.unionByName(prefix_marks(prefixes.where(width == n).select("digits", "prefix_len", "asn"), lengths).withColumn("width", F.lit(n)))
    return stored(out, "prefixes")


def with_longest_prefix(events: DataFrame, prefixes: DataFrame, digits: Column, out: str = "asn") -> DataFrame:
    """M5: events with the system of their address's longest prefix, null on a miss.

    digits: the address in hex digits (address_digits(), ipv4_digits()); prefixes: (digits, prefix_len, asn), of either
    version. Bits set beyond a prefix's length don't count. Few ranges (ordered.FEW) are compared in place. Else distinct
    addresses meet the prefixes in one sorted sweep a version, one row an address; events then join their addresses.
    """
    few = None if "width" in prefixes.columns else ordered.few(prefixes.select("digits", "prefix_len", "asn"))
    if few is not None:  # known to be few, so every address is matched where it is
        kind = prefixes.schema["asn"].dataType
        none = F.lit(None).cast(kind)
        near, told = events.withColumn("_digits", F.concat(digits, F.lit("1"))), none
        for n in sorted({len(r["digits"]) for r in few}):
            own = [(k, F.lit(v).cast(kind)) for k, v in ordered.in_order(few_ranges([r for r in few if len(r["digits"]) == n]))]
            told = F.when(F.length("_digits") == n + 1, ordered.last_of(F.col("_digits"), own, none)).otherwise(told)
        return near.withColumn(out, told).drop("_digits")
    ready = prefixes if "width" in prefixes.columns else prepared_prefixes(prefixes)
    named = events.withColumn("_digits", digits)
    points = named.select(F.col("_digits").alias("digits")).where("digits is not null").distinct()
    found = None
    for n in sorted(r[0] for r in ready.select("width").distinct().collect()):  # two versions
        marks = ready.where(F.col("width") == n).select("key", "value")
        keys = points.where(F.length("digits") == n).select(F.concat("digits", F.lit("1")).alias("key"))
        own = ordered.last_at(keys, marks, "key", "value").select(F.substring("key", 1, n).alias("_key"), F.col("value.asn").alias(out))
        found = own if found is None else found.unionByName(own)
    if found is None:
        return named.drop("_digits").withColumn(out, F.lit(None).cast(ready.schema["value"].dataType["asn"].dataType))
    return named.join(found, F.col("_digits") == F.col("_key"), "left").drop("_digits", "_key")


def longest_prefix(addresses: DataFrame, prefixes: DataFrame, id_col: str, number: str) -> DataFrame:
    """M5: prefixes (net, prefix_len, asn) of IPv4 addresses, both as integers; id and the longest match's asn, null on a miss."""
    nets = prefixes.select(scalars.ipv4_digits(F.col("net")).alias("digits"), "prefix_len", "asn")
    return with_longest_prefix(addresses.select(id_col, number), nets, scalars.ipv4_digits(F.col(number))).select(id_col, "asn")


def common_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    """P10."""
    return a.select("counter").intersect(b.select("counter"))


def extra_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    """P10."""
    return a.select("counter").distinct().join(b.select("counter"), "counter", "left_anti")


def combine_counters(bins: DataFrame, sigmas: DataFrame) -> DataFrame:
    """Counters that have both; rows without either are gone."""
    return bins.where("lo is not null and hi is not null").join(sigmas.where("sigma is not null"), "counter")


def name_filter(counters: DataFrame, accept: str = "", reject: str | None = None) -> DataFrame:
    """P8."""
    kept = counters.where(F.col("counter").rlike(accept)) if accept else counters
    return kept.where(~F.col("counter").rlike(reject)) if reject else kept


def next_close(streams: DataFrame, circuits: DataFrame, keys: list[str], ended: str, closed: str) -> DataFrame:
    """Each stream with the first close of its circuit at or after its end, as ids recur.

    A union and one window a key: sorted once, no product of streams and closes.
    """
    marks = streams.select(*keys, F.col(ended).alias("_at"), F.lit(0).alias("_kind"), F.struct(*streams.columns).alias("_stream"), F.lit(None).cast(circuits.schema[closed].dataType).alias("_closed")).unionByName(circuits.select(*keys, F.col(closed).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(streams.select(F.struct(*streams.columns).alias("s")).schema["s"].dataType).alias("_stream"), F.col(closed).alias("_closed")))
    # From the last to the first, so that the frame only grows and is never worked out anew.
    onward = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marks.withColumn("closed_at", F.last("_closed", ignorenulls=True).over(onward)).where("_kind = 0").select("_stream.*", "closed_at")

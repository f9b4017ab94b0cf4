"""Events to named counters.

Counters are conjunctions of a few classes, so events are summed once by class, map side, each
histogram by its own bins, as sums under conditions; names join only the few rows that are left. No row of
input is multiplied, and the number of rows that move doesn't grow with the bins' product.

Events with a column `party` (who saw them) are counted by party.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.functions.scalars import encode_ratio, is_active, port_class, web_class
from veilcount.operators.binning import INF, Bins, in_bin, list_bins, modular_sum

BYTE_BINS: Bins = ((-INF, -10.0), (0.0, 512.0), (512.0, 1024.0), (1024.0, 2048.0), (2048.0, 4096.0), (4096.0, INF))
RATIO_BINS: Bins = ((-INF, -1.0), (-1.0, 0.0), (0.0, 1.0), (1.0, INF))
TIME_BINS: Bins = ((0.0, 60.0), (60.0, 3600.0), (3600.0, 86400.0), (86400.0, INF))
COUNT_BINS: Bins = ((0.0, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, 8.0), (8.0, INF))

#: Bins where the caller gives none, by what a counter's name ends with.
DEFAULT_BINS: dict[str, Bins] = {
    "ByteHistogram": BYTE_BINS,
    "CellHistogram": BYTE_BINS,
    "CircuitHistogram": COUNT_BINS,
    "StreamHistogram": COUNT_BINS,
    "OverlapHistogram": COUNT_BINS,
    "IntroPointHistogram": COUNT_BINS,
    "RevisionHistogram": COUNT_BINS,
    "Ratio": RATIO_BINS,
    "LifeTime": TIME_BINS,
    "DelayTime": ((-INF, INF),),
    "CreationTime": TIME_BINS,
}
BinsBySuffix = Mapping[str, Bins]
PARTY = "party"


def bins_for(suffix: str, given: BinsBySuffix | None) -> Bins:
    """The bins of a measure: given by its suffix, else by the longest of what it ends with."""
    if given and suffix in given:
        return given[suffix]
    ends = [e for e in (*(given or ()), *DEFAULT_BINS) if suffix.endswith(e)]
    best = max(ends, key=len)
    return (given or {}).get(best) or DEFAULT_BINS[best]


@dataclass(frozen=True)
class Measure:
    """What a counter's name ends with, its increment, and the value that its bins cut; no value: one bin.

    A null increment (None counts 1) or value leaves the event out.
    """

    suffix: str
    inc: Column | None = None
    value: Column | None = None
    bins: Bins | None = None


def counts_of(parts: Mapping[str, Column], suffix: str = "Count") -> list[Measure]:
    return [Measure(f"{lead}{suffix}", c) for lead, c in parts.items()]


def histograms_of(parts: Mapping[str, Column], suffix: str = "Histogram") -> list[Measure]:
    return [Measure(f"{lead}{suffix}", None, c) for lead, c in parts.items()]


def lists_of(index: Column, lists: int, parts: Mapping[str, Column | None], suffix: str = "CountList") -> list[Measure]:
    """One bin for each list and one for what is in none; index: a list's number, infinity for none."""
    return [Measure(f"{lead}{suffix}", c, index, list_bins(lists)) for lead, c in parts.items()]


def variants(*parts: Column | list[Column]) -> Column:
    """All concatenations of '' or a part, as an array: what GROUPING SETS would count."""
    out = F.array(F.lit(""))
    for part in parts:
        out = F.concat(out, F.filter(_suffixed(out, part), lambda x: x.isNotNull()))
    return out


def _suffixed(names: Column, part: Column) -> Column:
    return F.transform(names, lambda x: F.concat(x, part))


def joined(*parts: Column) -> Column:
    """All concatenations of one element of each array."""
    out = parts[0]
    for part in parts[1:]:
        out = _crossed(out, part)
    return out


def _crossed(heads: Column, tails: Column) -> Column:
    return F.flatten(F.transform(heads, lambda x: F.transform(tails, lambda y: F.concat(x, y))))


def class_cells(
    events: DataFrame, classes: Mapping[str, Column], measures: list[Measure], bins: BinsBySuffix | None = None
) -> DataFrame:
    """The classes' columns and `cells`: (suffix, bin_idx, count) of each class; bins without events are left out."""
    sums, facts = [], []
    for m in measures:
        inc = F.lit(1) if m.inc is None else m.inc
        total = (lambda c: F.count(c).cast("decimal(38,0)")) if m.inc is None else modular_sum
        if m.value is None:
            sums.append(F.when(F.count(inc) > 0, total(inc)))
            facts.append((m.suffix, 0))
            continue
        value = m.value.cast("double")
        for i, (low, high) in enumerate(m.bins or bins_for(m.suffix, bins)):
            hit = F.when(in_bin(value, F.lit(float(low)), F.lit(float(high))), inc)
            sums.append(F.when(F.count(hit) > 0, total(hit)))
            facts.append((m.suffix, i))
    if PARTY in events.columns:
        classes = {PARTY: F.col(PARTY)} | dict(classes)
    named = [c.alias(k) for k, c in classes.items()]
    # Nothing to count leaves the classes alone.
    summed = events.groupBy(*named).agg(*[s.alias(f"_{i}") for i, s in enumerate(sums)] or [F.lit(None).alias("_")])
    cells = [
        F.struct(F.lit(s).alias("suffix"), F.lit(i).alias("bin_idx"), F.col(f"_{k}").alias("count"))
        for k, (s, i) in enumerate(facts)
    ]
    held = F.array(*cells).cast("array<struct<suffix:string,bin_idx:int,count:decimal(38,0)>>")
    return summed.select(*classes, F.filter(held, lambda c: c["count"].isNotNull()).alias("cells"))


def pruned(measures: list[Measure], wanted: list[str] | None) -> list[Measure]:
    """The measures that a wanted counter's name can end with (or a list of them, of `Count`); all, if nothing is said."""
    if wanted is None:
        return measures
    return [m for m in measures if any(w.endswith((m.suffix, f"{m.suffix}List")) for w in wanted)]


def named(*parts: tuple[DataFrame, Column], wanted: list[str] | None = None) -> DataFrame:
    """Cells of classes, each with its names, to (counter, bin_idx, count); a counter is a name and a cell's suffix.

    Parts are summed together, in one shuffle. wanted: the counters that are asked for; others leave here.
    """
    found = []
    for cells, names in parts:
        by = [PARTY] if PARTY in cells.columns else []
        rows = cells.select(*by, F.explode(names).alias("name"), "cells").select(*by, "name", F.explode("cells").alias("c"))
        rows = rows.select(*by, F.concat("name", "c.suffix").alias("counter"), F.col("c.bin_idx").alias("bin_idx"), "c.count")
        found.append(rows if wanted is None else rows.where(F.col("counter").isin(*wanted)))
    return _union(found).groupBy(*by, "counter", "bin_idx").agg(modular_sum(F.col("count")).alias("count"))


STREAM_SIDES = ("", "Outbound", "Inbound")


def _stream_facts(streams: DataFrame) -> tuple[DataFrame, dict[str, Column], list[Measure]]:
    """V9's streams, their bytes by side, and the measures of bytes, ratio and lifetime."""
    total = F.col("read_bytes") + F.col("write_bytes")
    valid = streams.where((F.col("read_bytes") >= 0) & (F.col("write_bytes") >= 0) & (total > 0))
    sides = dict(zip(STREAM_SIDES, (total, F.col("write_bytes"), F.col("read_bytes")), strict=True))
    ratio = encode_ratio(F.col("read_bytes"), F.col("write_bytes"))
    binned = histograms_of(sides, "ByteHistogram")
    return valid, sides, [*binned, Measure("ByteRatio", None, ratio), Measure("LifeTime", None, F.col("lifetime"))]


def _place() -> Column:
    return F.when(F.col("stream_number") == 1, "Initial").otherwise("Subsequent")


def stream_counters(
    streams: DataFrame, wanted: list[str] | None = None, bins: BinsBySuffix | None = None
) -> DataFrame:
    """Streams (port, ip_version, host_class, stream_number, read_bytes, write_bytes, lifetime).

    Streams with negative counts or no bytes at all aren't counted (V9).
    """
    valid, sides, binned = _stream_facts(streams)
    classes = {
        "port_class": port_class(F.col("port")),
        "web": web_class(F.col("port")),
        "ip": F.concat(F.lit("IPv"), "ip_version"),
        "host": F.col("host_class"),
        "place": _place(),
    }
    cells = class_cells(valid, classes, pruned([Measure("Count"), *counts_of(sides, "ByteCount"), *binned], wanted), bins)
    of_host = F.when(F.col("host") == "Hostname", F.concat("host", "web"))
    placed = [F.concat(x, "place") for x in (F.col("ip"), F.col("host"), of_host)]
    alone = F.when(F.col("web") == "NonWeb", F.col("web"))
    subs = F.array_compact(F.array(F.lit(""), "port_class", alone, "ip", "host", "place", of_host, *placed))
    return named((cells, F.transform(subs, lambda s: F.concat(F.lit("Exit"), s, F.lit("Stream")))), wanted=wanted)


def domain_counters(
    streams: DataFrame, lists: int, wanted: list[str] | None = None, bins: BinsBySuffix | None = None
) -> DataFrame:
    """Initial web streams to host names, by the lists that match the name.

    streams as above with exact_list and suffix_list: the number of the first list that matches, infinity for none
    (exact_match() and suffix_match() give them). The suffix is tried whenever the exact match misses. Histograms
    tell the first list from all else; the lists' counters have a bin for each of `lists` lists and one for none.
    """
    to_web = (F.col("host_class") == "Hostname") & (web_class(F.col("port")) == "Web")
    first = streams.where(to_web & (_place() == "Initial"))
    valid, sides, binned = _stream_facts(first)
    suffix = F.when(F.col("exact_list") < INF, F.col("exact_list")).otherwise(F.col("suffix_list"))
    found = []
    for kind, index in (("Exact", F.col("exact_list")), ("Suffix", suffix)):
        cells = class_cells(valid, {"hit": index == 0}, pruned(binned, wanted), bins)
        name = F.when(F.col("hit"), F.lit(f"ExitDomain{kind}MatchWebInitialStream"))
        found.append((cells, F.array(name.otherwise(F.lit(f"ExitDomainNo{kind}MatchWebInitialStream")))))
        listed = lists_of(index, lists, {"": None}) + lists_of(index, lists, sides, "ByteCountList")
        of_list = class_cells(valid, {"one": F.lit(1)}, pruned(listed, wanted))
        found.append((of_list, F.array(F.lit(f"ExitDomain{kind}MatchWebInitialStream"))))
    return named(*found, wanted=wanted)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _circuit_measures(active: Column, reasons: int) -> list[Measure]:
    """The ratio counts active circuits only, reasons failed ones only."""
    cells = {"Inbound": F.col("inbound_cells"), "Outbound": F.col("outbound_cells")}
    ratio = F.when(active, encode_ratio(*cells.values()))
    return [
        Measure("Count"),
        *counts_of(cells, "CellCount"),
        *histograms_of(cells, "CellHistogram"),
        Measure("CellRatio", None, ratio),
        Measure("LifeTime", None, F.col("lifetime")),
        *lists_of(F.when(F.col("failed"), F.col("reason_list")), reasons, {"": None}, "ReasonCountList"),
    ]


NO_ACTIVITY = ("Exit", "Dir", "HSDir")


def _activity() -> Column:
    return F.when(~F.col("position").isin(*NO_ACTIVITY), F.when(F.col("active"), "Active").otherwise("Inactive"))


def _status() -> Column:
    return F.when(F.col("failed"), "Failure").otherwise("Success")


def _with_names_that_exist(counters: DataFrame) -> DataFrame:
    """Ratios are counted under names that tell activity, where the position has any; reasons under Failure."""
    name = F.col("counter")
    ratio = name.rlike(f"^({'|'.join(NO_ACTIVITY)})") | name.rlike("Active")
    reason = F.contains(name, F.lit("Failure"))
    is_ratio, is_reason = (F.endswith(name, F.lit(x)) for x in ("CellRatio", "ReasonCountList"))
    return counters.where((~is_ratio | ratio) & (~is_reason | reason))


def circuit_counters(
    circuits: DataFrame, wanted: list[str] | None = None, bins: BinsBySuffix | None = None, reasons: int = 6
) -> DataFrame:
    """Circuits (position, role, failed, inbound_cells, outbound_cells, lifetime, reason_list).

    Names are position + role + activity + status; exits have no activity. reason_list: the number of the list of
    failure reasons, of so many.
    """
    active = is_active(F.col("inbound_cells"), F.col("outbound_cells"))
    classes = {c: F.col(c) for c in ("position", "role", "failed")} | {"active": active}
    cells = class_cells(circuits, classes, pruned(_circuit_measures(active, reasons), wanted), bins)
    names = joined(F.array("position"), variants(F.col("role"), _activity(), _status()), F.array(F.lit("Circuit")))
    return _with_names_that_exist(named((cells, names), wanted=wanted))


CONNECTION_PARTS = ("", "Inbound", "Outbound")


def connection_counters(
    connections: DataFrame, wanted: list[str] | None = None, bins: BinsBySuffix | None = None, lists: int = 3
) -> DataFrame:
    """Connections (is_client, relays, in_bytes, out_bytes, in_circuits, out_circuits, lifetime, overlap,
    country_list, as_list).

    overlap: connections from the address at once. The lists are numbers of the first list that holds the country
    or the AS of the remote address, infinity for none; each kind has so many. Histograms are kept for all
    connections and for those in the first list and outside it; the lists' counters have a bin a list.
    """
    sides, parts = {}, {"Byte": ("in_bytes", "out_bytes"), "Circuit": ("in_circuits", "out_circuits")}
    for what, (a, b) in parts.items():
        each = (F.col(a) + F.col(b), F.col(a), F.col(b))
        sides |= {f"{lead}{what}": c for lead, c in zip(CONNECTION_PARTS, each, strict=True)}
    binned = [
        *histograms_of(sides),
        Measure("LifeTime", None, F.col("lifetime")),
        Measure("OverlapHistogram", None, F.col("overlap")),
    ]
    both = {"is_client": F.col("is_client"), "relay": F.col("relays") > 0}
    side = F.when(F.col("is_client"), "Entry").otherwise("NonEntry")
    on = F.when(F.col("relay"), "RelayOnAddress").otherwise("NoRelayOnAddress")
    heads = joined(F.array(side), variants(on), F.array(F.lit("Connection")))
    # One pass by all classes; what is counted by country or system is a selection or renaming of its cells.
    by_list = {c: F.least(F.col(c), F.lit(float(lists))).cast("int") for c in ("country_list", "as_list")}
    cells = class_cells(connections, both | by_list, pruned([Measure("Count"), *counts_of(sides), *binned], wanted), bins)
    of_bins = lambda c: c["suffix"].isin(*[m.suffix for m in binned])
    histograms, counts = F.filter("cells", of_bins), F.filter("cells", lambda c: ~of_bins(c))
    found = [(cells, heads)]
    for kind in ("Country", "AS"):
        index = F.col(f"{kind.lower()}_list")
        tail = F.when(index == 0, f"{kind}Match").otherwise(f"{kind}NoMatch")
        found.append((cells.withColumn("cells", histograms), _suffixed(heads, tail)))
        found.append((cells.withColumn("cells", _listed(counts, index)), _suffixed(heads, F.lit(f"{kind}Match"))))
    return named(*found, wanted=wanted)


def _listed(counts: Column, index: Column) -> Column:
    """Counts of a class as counts of the list that it is in."""
    suffix = lambda c: F.concat(c["suffix"], F.lit("List")).alias("suffix")
    return F.transform(counts, lambda c: F.struct(suffix(c), index.alias("bin_idx"), c["count"].alias("count")))


def cache_counters(
    entries: DataFrame,
    kind: str = "Store",
    wanted: list[str] | None = None,
    bins: BinsBySuffix | None = None,
    reasons: int = 3,
    onions: int = 3,
) -> DataFrame:
    """Cache events (version, added, cached, auth, intro_bytes, desc_bytes, reason_list, onion_list,
    intro_points, upload_delay, revision); fetches have no added and no upload_delay.

    Names without a version never tell client authorisation apart; version 2 does where it's known. A missing
    entry counts as uncached. reason_list and onion_list are numbers of lists, infinity for none; a null onion_list,
    count, delay or revision leaves its counter alone.
    """
    sizes = {"Intro": F.col("intro_bytes"), "Descriptor": F.col("desc_bytes")}
    common = [
        Measure("Count"),
        *counts_of(sizes, "ByteCount"),
        *histograms_of(sizes, "ByteHistogram"),
        *lists_of(F.col("reason_list"), reasons, {"": None}, "ReasonCountList"),
    ]
    second = [
        *lists_of(F.col("onion_list"), onions, {"": None}, "OnionAddressCountList"),
        Measure("IntroPointHistogram", None, F.col("intro_points")),
    ]
    store = kind == "Store"
    if store:
        second.append(Measure("UploadDelayTime", None, F.col("upload_delay")))
    third = [Measure("RevisionHistogram", None, F.col("revision"))]
    added = {"added": F.col("added")} if store else {}
    classes = {"version": F.col("version")} | added
    classes |= {"cached": F.coalesce("cached", F.lit(False)), "auth": F.col("auth")}
    first = (F.when(F.col("added"), "Add").when(~F.col("added"), "Reject"),) if store else ()
    cached = F.when(F.col("cached"), "Cached").otherwise("Uncached")
    auth = F.when(F.col("version") == 2, F.when(F.col("auth"), "ClientAuth").when(~F.col("auth"), "NoClientAuth"))
    cells = class_cells(entries, classes, pruned([*common, *second, *third], wanted), bins)
    heads = joined(F.array(F.lit(f"HSDir{kind}")), variants(*first, cached))
    own = F.concat(F.lit("HSDir"), F.col("version").cast("string"), F.lit(kind))
    versioned = joined(F.array(own), variants(*first, cached, auth))
    shared = {m.suffix for m in common}
    own_of = {2: shared | {m.suffix for m in second}, 3: shared | {m.suffix for m in third}}
    of_all = F.filter("cells", lambda c: c["suffix"].isin(*shared))
    of_version = F.filter(
        "cells",
        lambda c: F.when(F.col("version") == 2, c["suffix"].isin(*own_of[2])).otherwise(c["suffix"].isin(*own_of[3])),
    )
    return named((cells.withColumn("cells", of_all), heads), (cells.withColumn("cells", of_version), versioned), wanted=wanted)


#: Positions of onion services; the first that holds counts.
ONION_POSITIONS = (("is_hsdir", "HSDir"), ("is_intro", "Intro"), ("is_rend", "Rend"))
FLAGS = ("is_origin", "is_entry", "is_mid", "is_end", "is_exit", "is_dir", "is_hsdir", "is_intro", "is_rend")


def circuit_positions(circuits: DataFrame) -> DataFrame:
    """One row for each position of a circuit (or class of circuits): position, version, role, hop and active.

    circuits: the flags, is_client, hs_version and busy (whether it had enough cells; where there is no such column,
    inbound_cells and outbound_cells tell); null flags are unset. A single hop is entry and end at once. Exits, directories and service directories are always active; introductions and
    rendezvous whose version nobody knows ("U") never.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    single = flag("is_entry") & flag("is_end")
    unknown = (flag("is_intro") | flag("is_rend")) & F.col("hs_version").isNull()
    always = flag("is_exit") | flag("is_dir") | flag("is_hsdir")
    cells = ("inbound_cells", "outbound_cells")
    busy = F.col("busy") if "busy" in circuits.columns else is_active(*map(F.col, cells))
    active = F.when(unknown, False).when(always, True).otherwise(busy)
    plain = [F.when(flag(f"is_{p.lower()}"), p) for p in ("Origin", "Entry", "Mid", "End")]
    plain += [F.when(single, "SingleHop"), F.when(flag("is_exit"), "Exit"), F.when(flag("is_dir"), "Dir")]
    onion = F.coalesce(*[F.when(flag(c), p) for c, p in ONION_POSITIONS])
    role = F.when(F.col("is_client"), "Client").when(~F.col("is_client"), "Service")
    one_hop = F.when(F.col("is_client"), "Tor2WebClient").when(~F.col("is_client"), "SingleOnionService")
    hop = F.when(~single, F.concat(F.lit("MultiHop"), role)).otherwise(one_hop)
    version = F.coalesce(F.col("hs_version").cast("string"), F.lit("U"))
    rows = circuits.withColumns({"active": active, "_version": version, "_role": role, "_hop": hop})
    rows = rows.withColumn("position", F.explode(F.array_compact(F.array(*plain, onion))))
    of_onion = lambda c: F.when(F.col("position").isin(*[p for _, p in ONION_POSITIONS]), F.col(c))
    own = {"version": of_onion("_version"), "role": of_onion("_role"), "hop": of_onion("_hop")}
    return rows.withColumns(own).drop("_version", "_role", "_hop")


def versioned_circuit_counters(
    circuits: DataFrame, wanted: list[str] | None = None, bins: BinsBySuffix | None = None, reasons: int = 6
) -> DataFrame:
    """Circuits with their flags, is_client, hs_version, failed, inbound_cells, outbound_cells, lifetime and
    reason_list. Circuits are summed by their flags first; positions are spread over these sums. Rows of
    circuit_positions are taken as well.

    Names are position + version + role + activity + status, each part optional; the role comes alone or with its
    hop. HSDir has no unknown version.
    """
    measures = pruned(_circuit_measures(F.lit(True), reasons), wanted)
    busy = is_active(F.col("inbound_cells"), F.col("outbound_cells"))
    plain = {c: F.coalesce(F.col(c), F.lit(False)) for c in FLAGS}
    classes = plain | {c: F.col(c) for c in ("is_client", "hs_version", "failed")} | {"busy": busy}
    # Activity depends on the position's class only, so the ratio is kept and dropped with the name.
    if "position" in circuits.columns:
        of_position = ("position", "version", "role", "hop", "failed", "active")
        cells = class_cells(circuits, {c: F.col(c) for c in of_position}, measures, bins)
    else:
        cells = circuit_positions(class_cells(circuits, classes, measures, bins))
    kept = F.filter("cells", lambda c: F.col("active") | (c["suffix"] != "CellRatio"))
    version = F.when(~((F.col("position") == "HSDir") & (F.col("version") == "U")), F.col("version"))
    roles = F.array_compact(F.array(F.lit(""), F.col("role"), F.col("hop")))
    tails = variants(_activity(), _status())
    names = joined(F.array("position"), variants(version), roles, tails, F.array(F.lit("Circuit")))
    return _with_names_that_exist(named((cells.withColumn("cells", kept), names), wanted=wanted))


def exit_and_rend_counters(circuits: DataFrame) -> DataFrame:
    """Exits count for both sides, version 2 rendezvous for their own; columns as circuit_positions reads them."""
    rend = F.coalesce(F.col("is_rend") & (F.col("hs_version") == 2), F.lit(False))
    held = {"Client": F.col("is_client"), "Service": ~F.col("is_client")}
    exits = F.when(F.col("is_exit"), 1).otherwise(0)
    measures = [
        Measure(f"ExitAndRend2{side}CircuitCount", exits + F.when(rend & own, 1).otherwise(0)) for side, own in held.items()
    ]
    hit = F.coalesce(F.col("is_exit"), F.lit(False)) | (rend & F.col("is_client").isNotNull())
    cells = class_cells(circuits.where(hit), {"one": F.lit(1)}, measures)
    return named((cells, F.array(F.lit("")))).where("count > 0")


STREAM_CLASSES = ("Web", "Interactive", "P2P", "OtherPort")


def exit_circuit_counters(
    streams: DataFrame,
    closes: DataFrame,
    keys: list[str],
    wanted: list[str] | None = None,
    bins: BinsBySuffix | None = None,
) -> DataFrame:
    """Streams (keys, port, start) of closed exit circuits (keys), those that ended before the close.

    Streams by circuit, of all and of each port class, the times between the starts of one circuit's streams, and
    circuits by class. Circuits without streams aren't counted.
    """
    held = streams.join(closes.select(*keys).distinct(), keys, "left_semi")
    start = F.col("start").cast("double").alias("start")
    held = held.select(*keys, port_class(F.col("port")).alias("port_class"), start)
    each = [F.count(F.when(F.col("port_class") == c, 1)).alias(f"n{i}") for i, c in enumerate(STREAM_CLASSES, 1)]
    per = held.groupBy(*keys).agg(F.count("*").alias("n0"), *each)
    labels = ("", *STREAM_CLASSES)
    sizes = [F.when(F.col(f"n{i}") > 0, F.col(f"n{i}")) for i in range(len(labels))]
    measures = [Measure(f"ExitCircuit{c}StreamHistogram", None, n) for c, n in zip(labels, sizes, strict=True)]
    for c, n in zip(labels[1:], sizes[1:], strict=True):
        measures.append(Measure(f"Exit{c}CircuitCount", F.when(n.isNotNull(), 1)))
    found = [(class_cells(per, {"one": F.lit(1)}, pruned(measures, wanted), bins), F.array(F.lit("")))]
    # Windows sort and spill; no circuit's streams are gathered.
    for name, more in ((F.lit("ExitCircuit"), []), (F.concat(F.lit("ExitCircuit"), "port_class"), ["port_class"])):
        before = F.lag("start").over(Window.partitionBy(*keys, *more).orderBy("start"))
        gaps = held.withColumn("gap", F.col("start") - before).where("gap is not null")
        classes = {c: F.col(c) for c in more} or {"one": F.lit(1)}
        cells = class_cells(gaps, classes, [Measure("InterStreamCreationTime", None, F.col("gap"))], bins)
        found.append((cells, F.array(name)))
    return named(*found, wanted=wanted)


def client_counters(clients: DataFrame, wanted: list[str] | None = None, bins: BinsBySuffix | None = None) -> DataFrame:
    """ST2's counters: clients (w, ip, active, active_completed, inactive_completed), one row a client and window."""
    done = {n: F.coalesce(F.col(f"{n.lower()}_completed"), F.lit(0)) for n in ("Active", "Inactive")}
    measures = [Measure(f"EntryClientIP{n}CircuitHistogram", None, c) for n, c in done.items()]
    measures += [
        Measure("EntryClientIPCount"),
        Measure("EntryActiveClientIPCount", F.col("active")),
        Measure("EntryInactiveClientIPCount", 1 - F.col("active")),
    ]
    return named((class_cells(clients, {"one": F.lit(1)}, pruned(measures, wanted), bins), F.array(F.lit(""))), wanted=wanted)


#: The counters that each event of a traffic model increments, whatever its path holds.
MODEL_COUNTERS = {
    "VITERBI_PACKETS": "ExitStreamTrafficModelStreamCount",
    "VITERBI_STREAMS": "ExitCircuitTrafficModelCircuitCount",
}


def model_event_counters(events: DataFrame) -> DataFrame:
    """One for each event (code) of a traffic model."""
    counter = F.element_at(F.create_map(*[F.lit(x) for pair in MODEL_COUNTERS.items() for x in pair]), F.col("code"))
    known = events.where(F.col("code").isin(*MODEL_COUNTERS))
    return named((class_cells(known, {"code": F.col("code")}, [Measure("")]), F.array(counter)))

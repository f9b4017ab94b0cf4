"""A mixed log, judged once and read by family.

`judged` gives every line its verdict in one pass; `write_events` stores what was accepted by code, and the
rest in a partition of its own. A family of counters then reads its code's partition only; one adapter a
family turns fields and tags into the columns that its fan-out takes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.functions import scalars
from veilcount.operators import fanout, hmm, matching, state
from veilcount.operators.binning import modular_sum
from veilcount.plans.catalog import events_for
from veilcount.sources import events as ev

#: P2, fixed values: the fields of positional events. Two of them are legacy: accepted, and counted by nothing.
POSITIONAL = {"STREAM_ENDED": 11, "STREAM_BYTES_TRANSFERRED": 6, "CIRCUIT_ENDED": 12, "CONNECTION_ENDED": 5}
#: Where an ended stream's fields are; the first six and the last are integers, the times floats.
STREAM_FIELDS = ("channel", "circuit", "stream", "port", "read_bytes", "write_bytes", "start", "end", "host", "address", "number")
REJECTED = "rejected"
EVENTS = "party string, fields array<string>, tags map<string,string>, code string, reject_reason string, kind string"


def positional_reason(events: DataFrame) -> Column:
    """Why a positional event is rejected; a stream's integers and times must be such."""
    reason = F.lit(None).cast("string")
    for code, n in POSITIONAL.items():
        reason = F.when((F.col("code") == code) & (F.size("fields") != n), "number of fields").otherwise(reason)
    for i, name in reversed(list(enumerate(STREAM_FIELDS))):
        v = F.get("fields", F.lit(i))
        if name in ("start", "end"):
            bad = v.try_cast("double").isNull()
        elif name in ("host", "address"):
            continue
        else:
            bad = ~v.rlike(r"^\s*[+-]?\d{1,18}\s*$")
        reason = F.when((F.col("code") == "STREAM_ENDED") & (F.size("fields") == len(STREAM_FIELDS)) & bad, name).otherwise(reason)
    return reason


def judged(events: DataFrame, model: bool = True) -> DataFrame:
    """Events (code, fields, other columns) with tags and reject_reason, null where they are accepted.

    Positional and tagged events share the pass; unknown codes, and a model's events without a model, are
    rejected. No row is lost.
    """
    positional = F.col("code").isin(*POSITIONAL)
    tagged = ev.accepted(events.withColumn("_own", F.col("fields")).withColumn("fields", F.when(positional, F.array().cast("array<string>")).otherwise(F.col("fields"))), model=model)
    tagged = tagged.withColumn("fields", F.col("_own"))
    reason = F.when(positional, positional_reason(tagged)).otherwise(F.col("reject_reason"))
    return tagged.withColumn("reject_reason", reason).drop("valid", "_own")


def write_events(events: DataFrame, path: str) -> str:
    """Judged events by code, the rejected ones apart; tags of positional events and fields of tagged ones aren't stored."""
    kind = F.when(F.col("reject_reason").isNull(), F.col("code")).otherwise(F.lit(REJECTED))
    party = F.col("party") if "party" in events.columns else F.lit(None).cast("string")
    fields = F.when(F.col("code").isin(*POSITIONAL) | F.col("reject_reason").isNotNull(), F.col("fields"))
    tags = F.when(F.size(F.map_keys("tags")) > 0, F.col("tags"))
    out = events.select(party.alias("party"), fields.alias("fields"), tags.alias("tags"), "code", "reject_reason", kind.alias("kind"))
    out.write.partitionBy("kind").parquet(path)
    return path


def read_events(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """Stored events of these codes: only their partitions are read."""
    return spark.read.schema(EVENTS).parquet(path).where(F.col("kind").isin(*kinds))


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """code, reject_reason, events."""
    return read_events(spark, path, REJECTED).groupBy("code", "reject_reason").agg(F.count("*").alias("events"))


# Adapters: stored events to the columns of the fan-outs.


def _number(name: str, default=None) -> Column:
    return ev.typed(F.col("tags"), name, "int", default).cast("long")


def _time(name: str) -> Column:
    return ev.typed(F.col("tags"), name, "float")


def _flag(name: str, default=None) -> Column:
    return ev.typed(F.col("tags"), name, "flag", default)


def _text(name: str) -> Column:
    return F.col("tags")[name]


def streams_of(events: DataFrame) -> DataFrame:
    """V9: ended streams that moved bytes, with their circuit's key."""
    at = {n: F.get("fields", F.lit(i)) for i, n in enumerate(STREAM_FIELDS)}
    whole = lambda n: F.trim(at[n]).cast("long")
    time = lambda n: at[n].cast("double")
    found = events.select(
        "party", whole("channel").alias("channel"), whole("circuit").alias("circuit"), whole("port").cast("int").alias("port"),
        scalars.ip_version(at["address"]).cast("string").alias("ip_version"), scalars.host_class(at["host"]).alias("host_class"),
        at["host"].alias("host"), whole("number").cast("int").alias("stream_number"), whole("read_bytes").alias("read_bytes"),
        whole("write_bytes").alias("write_bytes"), time("start").alias("start"), time("end").alias("end"), (time("end") - time("start")).alias("lifetime"),
    )
    return found.where("read_bytes >= 0 and write_bytes >= 0 and read_bytes + write_bytes > 0")


def circuits_of(events: DataFrame, reasons: DataFrame) -> DataFrame:
    """Closed circuits with flags, cells, lifetime and the list of their failure's reason."""
    internal = {c: _flag(f"Is{n}Flag", False) for c, n in (("is_dir", "Dir"), ("is_hsdir", "HSDir"), ("is_intro", "Intro"), ("is_rend", "Rend"))}
    plain = {f"is_{n.lower()}": _flag(f"Is{n}Flag", False) for n in ("Origin", "Entry", "Mid", "End")}
    exit_flag = F.coalesce(ev.clean_exit_flag(_flag("IsExitFlag"), *internal.values()), F.lit(False))
    cells = {f"{side.lower()}_cells": scalars.cell_count(*[_number(f"{side}{what}CellCount") for what in ("Received", "Sent", "Exit")]) for side in ("Inbound", "Outbound")}
    columns = plain | internal | {"is_exit": exit_flag} | cells
    columns |= {"is_client": _flag("IsHSClientSideFlag"), "hs_version": _number("HiddenServiceVersionNumber").cast("int"), "failed": _text("FailureReasonString").isNotNull(), "failure": _text("FailureReasonString")}
    columns |= {"created": _time("CreatedTimestamp"), "closed": _time("EventTimestamp"), "lifetime": _time("EventTimestamp") - _time("CreatedTimestamp")}
    columns |= {"is_legacy": _flag("IsLegacyCircuitEndEventFlag"), "channel": _number("PreviousChannelId"), "circuit": _number("PreviousCircuitId"), "ip": F.coalesce(_text("PreviousNodeIPAddress"), F.lit("0.0.0.0"))}
    # What the legacy counters need besides; without any of it the close is nothing to them.
    needed = [_text(n) for n in ("PreviousChannelId", "PreviousCircuitId", "InboundExitByteCount", "OutboundExitByteCount")]
    whole = F.lit(True)
    for c in needed:
        whole = whole & c.isNotNull()
    columns |= {"has_legacy": _flag("IsLegacyCircuitEndEventFlag") & whole}
    return matching.exact_match(events.select("party", *[c.alias(n) for n, c in columns.items()]), reasons, "failure", "reason_list")


def connections_of(events: DataFrame, countries: DataFrame, systems: DataFrame, prefixes: DataFrame) -> DataFrame:
    """V5: closed connections with the lists of their country and, by prefix, their system. prefixes: IPv4 and IPv6."""
    sides = {"in_bytes": "InboundByteCount", "out_bytes": "OutboundByteCount", "in_circuits": "InboundCircuitCount", "out_circuits": "OutboundCircuitCount"}
    found = events.select(
        "party", _flag("RemoteIsClientFlag").alias("is_client"), _number("PeerIPAddressConsensusRelayCount").alias("relays"),
        *[_number(n, 0).alias(c) for c, n in sides.items()], _number("RemoteIPAddressConnectionCount").alias("overlap"),
        (_time("EventTimestamp") - _time("CreatedTimestamp")).alias("lifetime"),
        ev.typed(F.col("tags"), "RemoteCountryCode", "string", "!!").alias("country"), _text("RemoteIPAddress").alias("address"),
    )
    nets = prefixes.withColumn("digits", scalars.address_digits(F.col("net")))
    named = matching.with_longest_prefix(found, nets, scalars.address_digits(F.col("address"))).withColumn("asn", F.col("asn").cast("string"))
    return matching.exact_match(matching.exact_match(named, countries, "country", "country_list"), systems, "asn", "as_list")


def caches_of(events: DataFrame, kind: str, reasons: DataFrame, onions: DataFrame) -> DataFrame:
    """V6-V8: stored or fetched descriptors. An onion address is matched plain or as its MD5, first list first."""
    has = "HasExistingCacheEntryFlag" if kind == "Store" else "HasCacheEntryFlag"
    found = events.select(
        "party", _number("HiddenServiceVersionNumber").cast("int").alias("version"), _flag(has).alias("cached"), _flag("RequiresClientAuthFlag").alias("auth"),
        _flag("WasAddedToCacheFlag").alias("added"), _number("EncodedIntroPointByteCount").alias("intro_bytes"),
        _number("EncodedDescriptorByteCount").alias("desc_bytes"), _number("IntroPointCount").alias("intro_points"), _number("RevisionNumber").alias("revision"),
        (_time("EventTimestamp") - _time("DescriptorCreationTime")).alias("upload_delay"), _text("CacheReasonString").alias("reason"), _text("OnionAddress").alias("onion"),
        scalars.onion_md5(_text("OnionAddress")).alias("onion_md5"),
    )
    found = matching.exact_match(found, reasons, "reason", "reason_list")
    plain = matching.exact_match(found, onions, "onion", "plain_list")
    both = matching.exact_match(plain, onions, "onion_md5", "md5_list")
    return both.withColumn("onion_list", F.when(F.col("onion").isNotNull(), F.least("plain_list", "md5_list")))


def paths_of(events: DataFrame, tag: str) -> DataFrame:
    """Paths of a traffic model."""
    return events.select("party", "code", _text(tag).alias("path"))


@dataclass(frozen=True)
class Lists:
    """What events are matched against: (list_idx, item) each, and prefixes (net, prefix_len, asn) with net as text."""

    domains: DataFrame
    suffixes: DataFrame
    countries: DataFrame
    systems: DataFrame
    prefixes: DataFrame
    failures: DataFrame
    stores: DataFrame
    fetches: DataFrame
    onions: DataFrame
    #: How many lists there are of each kind.
    sizes: Mapping[str, int]


MODELS = {"VITERBI_PACKETS": ("ViterbiPathPackets", "ExitStreamTrafficModel"), "VITERBI_STREAMS": ("ViterbiPathStreams", "ExitCircuitTrafficModel")}


def stream_families(spark: SparkSession, path: str, lists: Lists, wanted=None, bins=None) -> list[DataFrame]:
    """X1-X4."""
    streams = streams_of(read_events(spark, path, "STREAM_ENDED"))
    to_web = streams.where((F.col("host_class") == "Hostname") & (F.col("stream_number") == 1) & (scalars.web_class(F.col("port")) == "Web"))
    named = matching.exact_match(matching.suffix_match(to_web, lists.suffixes, "host", "suffix_list"), lists.domains, "host", "exact_list")
    n = max(lists.sizes["domains"], lists.sizes["suffixes"])
    return [fanout.stream_counters(streams, wanted, bins), fanout.domain_counters(named, n, wanted, bins)]


def circuit_families(spark: SparkSession, path: str, lists: Lists, wanted=None, bins=None, period: int = 600) -> list[DataFrame]:
    """X5-X8, ST2, and with the streams that ended on them X15, M12."""
    circuits = circuits_of(read_events(spark, path, "CIRCUIT_CLOSE"), lists.failures)
    legacy = circuits.where("has_legacy")
    entries = legacy.where("is_entry").select("party", "ip", F.col("closed").alias("ts"), "created", scalars.is_active(F.col("inbound_cells"), F.col("outbound_cells")).alias("active"))
    exits = legacy.where("is_exit and not is_entry").select("party", "channel", "circuit", "closed")
    keys = ["party", "channel", "circuit"]
    # A channel's circuit numbers recur: a stream belongs to the first close at or after its end.
    streams = streams_of(read_events(spark, path, "STREAM_ENDED")).select(*keys, "port", "start", "end")
    met = matching.next_close(streams, exits, keys, "end", "closed").where("closed_at is not null")
    by = [*keys, "closed_at"]
    return [
        fanout.versioned_circuit_counters(circuits, wanted, bins, lists.sizes["failures"]),
        fanout.exit_and_rend_counters(circuits),
        fanout.client_counters(state.client_windows(entries, period), wanted, bins),
        fanout.exit_circuit_counters(met, met, by, wanted, bins),
    ]


def connection_families(spark: SparkSession, path: str, lists: Lists, wanted=None, bins=None) -> list[DataFrame]:
    """X9-X11."""
    connections = connections_of(read_events(spark, path, "CONNECTION_CLOSE"), lists.countries, lists.systems, lists.prefixes)
    return [fanout.connection_counters(connections, wanted, bins, max(lists.sizes["countries"], lists.sizes["systems"]))]


def cache_families(spark: SparkSession, path: str, lists: Lists, wanted=None, bins=None) -> list[DataFrame]:
    """X12-X14."""
    out = []
    for kind, reasons in (("Store", "stores"), ("Fetch", "fetches")):
        entries = caches_of(read_events(spark, path, f"HSDIR_CACHE_{kind.upper()}"), kind, getattr(lists, reasons), lists.onions)
        out.append(fanout.cache_counters(entries, kind, wanted, bins, lists.sizes[reasons], lists.sizes["onions"]))
    return out


def model_families(spark: SparkSession, path: str) -> list[DataFrame]:
    """X16, X17."""
    out = [fanout.model_event_counters(read_events(spark, path, *MODELS))]
    for code, (tag, prefix) in MODELS.items():
        counted = hmm.path_counters(paths_of(read_events(spark, path, code), tag), "path", prefix, by=["party"])
        out.append(counted.select("party", "counter", F.lit(0).alias("bin_idx"), F.col("count").cast("decimal(38,0)").alias("count")))
    return out


def all_counters(spark: SparkSession, path: str, lists: Lists, wanted: list[str] | None = None, bins=None, period: int = 600) -> DataFrame:
    """party, counter, bin_idx, count of every family over stored events; with `wanted`, only of those that it needs."""
    needed = set(ev.TAGGED) | set(POSITIONAL) if wanted is None else events_for(wanted)
    parts = []
    if "STREAM_ENDED" in needed:
        parts += stream_families(spark, path, lists, wanted, bins)
    if "CIRCUIT_CLOSE" in needed:
        parts += circuit_families(spark, path, lists, wanted, bins, period)
    if "CONNECTION_CLOSE" in needed:
        parts += connection_families(spark, path, lists, wanted, bins)
    if needed & {"HSDIR_CACHE_STORE", "HSDIR_CACHE_FETCH"}:
        parts += cache_families(spark, path, lists, wanted, bins)
    if needed & set(MODELS):
        parts += model_families(spark, path)
    found = fanout._union(parts)
    return found if wanted is None else found.where(F.col("counter").isin(*wanted))


def totals(counted: DataFrame) -> DataFrame:
    """A4: counter, bin_idx, count over all parties."""
    return counted.groupBy("counter", "bin_idx").agg(modular_sum(F.col("count")).alias("count"))

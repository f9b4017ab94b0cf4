"""The counter catalogue: names by grammar, and the events that each needs."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STREAM_SUFFIXES = ("Count", "ByteCount", "OutboundByteCount", "InboundByteCount", "ByteHistogram", "OutboundByteHistogram", "InboundByteHistogram", "ByteRatio", "LifeTime")
CIRCUIT_SUFFIXES = ("Count", "InboundCellCount", "OutboundCellCount", "InboundCellHistogram", "OutboundCellHistogram", "CellRatio", "LifeTime", "ReasonCountList")
POSITIONS = ("Origin", "Entry", "Mid", "End", "SingleHop", "Exit", "Dir", "HSDir", "Intro", "Rend")
ROLES = ("", "Client", "Service", "Tor2WebClient", "MultiHopClient", "SingleOnionService", "MultiHopService")
NO_ACTIVITY = ("Exit", "Dir", "HSDir")
PLACES = ("", "Initial", "Subsequent")


def stream_names() -> list[str]:
    ports = ["", "Web", "Interactive", "P2P", "OtherPort", "NonWeb"]
    versions = ["".join(x) for x in product(("IPv4", "IPv6"), PLACES)]
    hosts = ["".join(x) for x in product(("IPv4Literal", "IPv6Literal", "Hostname"), PLACES)]
    webs = ["".join(x) for x in product(("HostnameWeb", "HostnameNonWeb"), PLACES)]
    return [f"Exit{s}Stream{x}" for s in [*ports, *versions, *hosts, *PLACES[1:], *webs] for x in STREAM_SUFFIXES]


def circuit_names() -> list[str]:
    out = []
    for position in POSITIONS:
        versions = {"HSDir": ("", "2", "3"), "Intro": ("", "U", "2", "3"), "Rend": ("", "U", "2", "3")}.get(position, ("",))
        roles = ROLES if position in ("HSDir", "Intro", "Rend") else ("",)
        activities = ("",) if position in NO_ACTIVITY else ("", "Active", "Inactive")
        for v, r, a, s, x in product(versions, roles, activities, ("", "Success", "Failure"), CIRCUIT_SUFFIXES):
            ratio = a == "Active" or position in NO_ACTIVITY
            if (x != "ReasonCountList" or s == "Failure") and (x != "CellRatio" or ratio):
                out.append(f"{position}{v}{r}{a}{s}Circuit{x}")
    return out


CLASSES = ("Web", "Interactive", "P2P", "OtherPort")
SIDES = ("", "Inbound", "Outbound")
KINDS = tuple("".join(x) for x in product(SIDES, ("Byte", "Circuit")))
CONNECTION_HISTOGRAMS = (*(f"{k}Histogram" for k in KINDS), "LifeTime", "OverlapHistogram")
CACHE_SUFFIXES = ("Count", "IntroByteCount", "IntroByteHistogram", "DescriptorByteCount", "DescriptorByteHistogram", "ReasonCountList")
CACHE_SECOND, CACHE_THIRD = ("OnionAddressCountList", "IntroPointHistogram"), ("RevisionHistogram",)


def domain_names() -> list[str]:
    """X3, X4."""
    binned = [x for x in STREAM_SUFFIXES if not x.endswith("Count")]
    lists = [f"{x}CountList" for x in ("", "Byte", "OutboundByte", "InboundByte")]
    hits = [f"ExitDomain{no}{k}MatchWebInitialStream{x}" for k, no, x in product(("Exact", "Suffix"), ("", "No"), binned)]
    return hits + [f"ExitDomain{k}MatchWebInitialStream{x}" for k, x in product(("Exact", "Suffix"), lists)]


def connection_names() -> list[str]:
    """X9-X11."""
    plain = ["Count", *(f"{k}Count" for k in KINDS), *CONNECTION_HISTOGRAMS]
    matched = [f"{m}{hit}{x}" for m, hit, x in product(("Country", "AS"), ("Match", "NoMatch"), CONNECTION_HISTOGRAMS)]
    lists = [f"{m}Match{k}CountList" for m, k in product(("Country", "AS"), ("", *KINDS))]
    heads = product(("Entry", "NonEntry"), ("", "RelayOnAddress", "NoRelayOnAddress"), (*plain, *matched, *lists))
    return [f"{side}{on}Connection{x}" for side, on, x in heads]


def cache_names(kind: str) -> list[str]:
    """X12-X14; kind: Store or Fetch."""
    added = ("", "Add", "Reject") if kind == "Store" else ("",)
    second = (*CACHE_SECOND, "UploadDelayTime") if kind == "Store" else CACHE_SECOND
    out = []
    for version, auths, more in (("", ("",), ()), ("2", ("", "ClientAuth", "NoClientAuth"), second), ("3", ("",), CACHE_THIRD)):
        for a, c, z, x in product(added, ("", "Cached", "Uncached"), auths, (*CACHE_SUFFIXES, *more)):
            out.append(f"HSDir{version}{kind}{a}{c}{z}{x}")
    return out


def exit_circuit_names() -> list[str]:
    """X15."""
    each = [f"ExitCircuit{c}{x}" for c, x in product(("", *CLASSES), ("StreamHistogram", "InterStreamCreationTime"))]
    return each + [f"Exit{c}CircuitCount" for c in CLASSES]


def client_names() -> list[str]:
    """ST2's."""
    counts = [f"Entry{c}ClientIPCount" for c in ("", "Active", "Inactive")]
    return counts + [f"EntryClientIP{c}CircuitHistogram" for c in ("Active", "Inactive")]


def model_names() -> dict[str, str]:
    """The counters of every traffic model, with their event."""
    shared = ("EmissionCount", "TransitionCount", "DelayTime", "LogDelayTime", "SquaredLogDelayTime")
    kinds = (("Stream", "VITERBI_PACKETS"), ("Circuit", "VITERBI_STREAMS"))
    return {f"Exit{k}TrafficModel{x}": e for k, e in kinds for x in (f"{k}Count", *shared)}


def all_names() -> dict[str, frozenset[str]]:
    """Every counter with the events that it needs; ZeroCount needs none."""
    families = (
        (stream_names() + domain_names(), {"STREAM_ENDED"}),
        (circuit_names() + client_names() + [f"ExitAndRend2{s}CircuitCount" for s in ROLES[1:3]], {"CIRCUIT_CLOSE"}),
        (connection_names(), {"CONNECTION_CLOSE"}),
        (cache_names("Store"), {"HSDIR_CACHE_STORE"}),
        (cache_names("Fetch"), {"HSDIR_CACHE_FETCH"}),
        (exit_circuit_names(), {"STREAM_ENDED", "CIRCUIT_CLOSE"}),
    )
    out = {n: frozenset(e) for names, e in families for n in names}
    return out | {n: frozenset({e}) for n, e in model_names().items()} | {"ZeroCount": frozenset()}


_KNOWN = all_names()
#: Events that a circuit's sample rate thins out.
SAMPLED = {"CIRCUIT_CELL", "STREAM_BYTES_TRANSFERRED", "STREAM_ENDED", "CIRCUIT_CLOSE", "DNS_RESOLVED", "CIRCUIT_ENDED"}


def registered(names: dict[str, set[str]], more: dict[str, set[str]] | None = None) -> dict[str, set[str]]:
    """More counters with their events, besides those of `more`; events that nobody sends are left out."""
    known = set().union(*_KNOWN.values()) | SAMPLED
    return (more or {}) | {n: {e for e in events if e in known} for n, events in names.items()}


def events_for(counters: list[str], more: dict[str, set[str]] | None = None) -> set[str]:
    """The union of the counters' events; a name that nobody knows raises KeyError."""
    out: set[str] = set()
    for name in counters:
        if name not in _KNOWN and name not in (more or {}):
            raise KeyError(name)
        out |= (more or {}).get(name, set()) | _KNOWN.get(name, set())
    return out


def is_sampled(counter: str, more: dict[str, set[str]] | None = None) -> bool:
    """Whether a circuit's sample rate bears on the counter."""
    return bool(events_for([counter], more) & SAMPLED)


#: How counters begin whose events a relay sends regularly only with a flag.
FLAGGED = (("Entry", "Guard"), ("Exit", "Exit"), ("HSDir2", "HSDir"), ("HSDir3", "HSDir3"))


def are_events_expected(counters: list[str], flags: set[str]) -> bool:
    """P13."""
    return any(flag in flags for lead, flag in FLAGGED if any(c.startswith(lead) for c in counters))


def events_expected(counters: list[str], flags: Column) -> Column:
    """P13 for a column of relays' flags; without flags, no events are expected."""
    wanted = [flag for lead, flag in FLAGGED if any(c.startswith(lead) for c in counters)]
    held = F.arrays_overlap(flags, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
    return F.coalesce(held, F.lit(False))


def catalogue(spark: SparkSession, more: dict[str, set[str]] | None = None) -> DataFrame:
    """counter, events (in order), sampled: all names, and those of `more`, which registered() gives."""
    rows = [(n, sorted(e), bool(e & SAMPLED)) for n, e in (_KNOWN | (more or {})).items()]
    return spark.createDataFrame(rows, "counter string, events array<string>, sampled boolean")


def needed_events(asked: DataFrame, by: list[str], more: dict[str, set[str]] | None = None) -> DataFrame:
    """Asked (by, counter) to the events that each group of counters needs, in order, whether sampling bears on
    any, and the names that nobody knows.

    Names are told apart before they meet the catalogue, which is broadcast: its size doesn't depend on the data.
    """
    known = F.broadcast(catalogue(asked.sparkSession, more))
    met = asked.select(*by, "counter").distinct().join(known, "counter", "left")
    unknown = F.when(F.col("events").isNull(), F.col("counter"))
    return met.groupBy(*by).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("events")))).alias("events"),
        F.coalesce(F.max("sampled"), F.lit(False)).alias("sampled"),
        F.array_sort(F.collect_set(unknown)).alias("unknown"),
    )

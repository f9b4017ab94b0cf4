"""Event lines: tagged and positional parsing, declared rules, replay and sampling."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilcount.plans.catalog import events_for


def read_lines(
    spark: SparkSession, path: str, stream: bool = False, prefix: str = "", counters: list[str] | None = None
) -> DataFrame:
    """Lines of a log as code and fields. With counters, only the events that they need."""
    lines = spark.readStream.text(path) if stream else spark.read.text(path)
    found = fields_of(lines, prefix)
    return found if counters is None else enabled(found, sorted(events_for(counters)))


def fields_of(lines: DataFrame, prefix: str = "", value: str = "value") -> DataFrame:
    """Lines split off from an optional status code and the codes' prefix; code, the rest as fields, other columns."""
    fields = F.split(F.regexp_replace(value, rf"^650 (\Q{prefix}\E)?", ""), " ")
    rest = F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))
    others = [c for c in lines.columns if c != value]
    return lines.select(*others, F.get(fields, F.lit(0)).alias("code"), rest.alias("fields"))


def enabled(events: DataFrame, codes: list[str]) -> DataFrame:
    """Only the wanted codes, so that the filter reaches the scan."""
    return events.where(F.col("code").isin(*codes))


#: Key=Value fields, joined by NUL. Possessive, so Java's matcher loops over any number of them and doesn't recurse.
SOUND = r"^\x00*+(?:[^=\s\x00]++=[^=\s\x00]*+(?:\x00++|\z))*+\z"


def tagged(fields: Column) -> Column:
    """Key=Value fields as a map; any malformed or repeated field empties the event."""
    text = F.array_join(fields, "\x00")
    own = F.size(F.split(text, "\x00")) == F.greatest(F.size(fields), F.lit(1))  # no field holds a NUL of its own
    keys = F.regexp_extract_all(text, F.lit(r"(?:^|\x00)([^=\x00]++)="), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"=([^\x00]*)"), F.lit(1))
    unique = F.size(F.array_distinct(keys)) == F.size(keys)
    none = F.array().cast("array<string>")
    return F.when(text.rlike(SOUND) & own & unique, F.map_from_arrays(keys, values)).otherwise(F.map_from_arrays(none, none))


#: HotSpot compiles no method whose bytecode is larger.
COMPILED_BYTES = 8000


def small_methods(spark: SparkSession) -> None:
    """Rules of many fields make methods that HotSpot would only interpret: then Spark is to cut them into smaller ones."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(COMPILED_BYTES))


#: Integers that fit 64 bits, which are much cheaper than decimals.
SHORT = r"^\s*[+-]?\d{1,18}\s*$"


def integer(v: Column) -> Column:
    """An integer's text as a number, null for any other text: 12.7 and 1e3 aren't integers."""
    return F.when(v.rlike(SHORT), v.try_cast("long").cast("decimal(38,0)")).when(v.rlike(r"^\s*[+-]?\d+\s*$"), v.try_cast("decimal(38,0)"))


@dataclass(frozen=True)
class Rule:
    """One field's rule. kind: string, list, int, flag, float or ip; bounds are inclusive."""

    field: str
    kind: str
    mandatory: bool = False
    low: float | None = None
    high: float | None = None

    def holds(self, tags: Column) -> Column:
        """A missing optional field is valid."""
        v = tags[self.field]
        if self.kind == "string":
            ok = self._within(F.length(v))
        elif self.kind == "list":
            ok = self._within(F.size(F.filter(F.split(v, ","), lambda x: x != "")))
        elif self.kind == "int":
            ok = F.when(v.rlike(SHORT), self._within(v.try_cast("long"))).otherwise(self._within(integer(v)))
        elif self.kind == "flag":
            ok = v.isin("0", "1")
        elif self.kind == "float":
            ok = v.try_cast("double").isNotNull() & self._within(v.try_cast("double"))
        else:
            from veilcount.functions.scalars import ip_version

            ok = ip_version(v).isNotNull()
        return F.when(v.isNull(), F.lit(not self.mandatory)).otherwise(F.coalesce(ok, F.lit(False)))

    def _within(self, x: Column) -> Column:
        ok = x.isNotNull()
        if self.low is not None:
            ok = ok & (x >= self.low)
        if self.high is not None:
            ok = ok & (x <= self.high)
        return ok


def flags(*names: str) -> tuple[Rule, ...]:
    return tuple(Rule(n, "flag") for n in names)


def counts(*names: str) -> tuple[Rule, ...]:
    return tuple(Rule(n, "int", low=0) for n in names)


@dataclass(frozen=True)
class Given:
    """A rule between fields, by name: a version that a field belongs to, or a bound that is another field."""

    field: str
    version: int | None = None
    most_field: str | None = None
    most_by_version: tuple[tuple[int, int], ...] = ()

    def holds(self, tags: Column) -> Column:
        v, number = tags[self.field], integer(tags[self.field])
        version = integer(tags["HiddenServiceVersionNumber"])
        ok = F.lit(True)
        if self.version is not None:
            ok = ok & (version == self.version)
        if self.most_field is not None:
            ok = ok & F.coalesce(number <= integer(tags[self.most_field]), F.lit(True))
        for at, most in self.most_by_version:
            ok = ok & ((version != at) | (number <= most))
        return v.isNull() | F.coalesce(ok, F.lit(False))


def renamed(rules: tuple[Rule, ...], prefix: str) -> tuple[Rule, ...]:
    """The same rules for fields with a prefix, none of them mandatory."""
    return tuple(replace(r, field=prefix + r.field, mandatory=False) for r in rules)


def named_strings(*names: str, mandatory: bool = False) -> tuple[Rule, ...]:
    return tuple(Rule(n, "string", mandatory, 1, 50) for n in names)


#: V3: a neighbour of a circuit's relay.
NODE = (
    Rule("NodeIPAddress", "ip"),
    Rule("NodeFingerprint", "string", low=40, high=40),
    Rule("NodeRelayFlagList", "list", low=1, high=20),
)
NEIGHBOURS = (*renamed(NODE, "Previous"), *renamed(NODE, "Next"))
#: V1: what circuit events have in common; of the circuits that they are joined to, all is optional.
CIRCUIT = (
    Rule("EventTimestamp", "float", True, 0),
    *counts("NextChannelId", "NextCircuitId", "PreviousChannelId", "PreviousCircuitId"),
    *flags("IsOriginFlag", "IsEntryFlag", "IsMidFlag", "IsEndFlag", "IsExitFlag", "IsDirFlag", "IsHSDirFlag"),
    *flags("IsIntroFlag", "IsClientIntroLegacyFlag", "IsRendFlag", "IsHSClientSideFlag", "IsMarkedForCloseFlag"),
    Rule("HiddenServiceVersionNumber", "int", low=2, high=3),
    *flags("HasReceivedCreateCellFlag"),
    Rule("OnionHandshakeType", "int", low=0, high=2),
    *named_strings("FailureReasonString"),
    Rule("ExitStreamCount", "int", low=1),
)
#: V2: circuit cells; a cell circuit of 0 is no circuit's.
CIRCUIT_CELL = (
    *CIRCUIT,
    Rule("IsSentFlag", "flag", True),
    Rule("CellCircuitId", "int", True, 0),
    *named_strings("CellCommandString", mandatory=True),
    *flags("IsOutboundFlag", "IsRecognizedFlag", "WasRelayCryptSuccessfulFlag"),
    *counts("RelayCellPayloadByteCount", "RelayCellStreamId"),
    *named_strings("RelayCellCommandString"),
)
#: V4: circuit closes.
CIRCUIT_CLOSE = (
    *CIRCUIT,
    Rule("CreatedTimestamp", "float", True, 0),
    Rule("IsLegacyCircuitEndEventFlag", "flag", True),
    *named_strings("StateString", mandatory=True),
    Rule("PurposeCode", "int", True, 1, 20),
    *named_strings("PurposeString", "HSStateString"),
    *NEIGHBOURS,
    *renamed(CIRCUIT, "IntroClientSink"),
    *renamed(CIRCUIT, "RendSplice"),
    *counts("InboundSentCellCount", "InboundReceivedCellCount", "OutboundSentCellCount", "OutboundReceivedCellCount"),
    *counts("InboundExitCellCount", "OutboundExitCellCount", "InboundExitByteCount", "OutboundExitByteCount"),
    *counts("InboundDirByteCount", "OutboundDirByteCount"),
)
#: V5: connection closes.
CONNECTION_CLOSE = (
    Rule("EventTimestamp", "float", True, 0),
    Rule("CreatedTimestamp", "float", True, 0),
    Rule("ChannelId", "int", True, 0),
    Rule("RemoteIsClientFlag", "flag", True),
    Rule("RemoteIPAddress", "ip", True),
    Rule("RemoteIPAddressConnectionCount", "int", True, 0, 2**17),
    Rule("PeerIPAddressConsensusRelayCount", "int", True, 0, 100),
    Rule("PeerIPAddress", "ip"),
    *counts("InboundByteCount", "OutboundByteCount", "InboundCircuitCount", "OutboundCircuitCount"),
    Rule("RemoteCountryCode", "string", low=2, high=2),
)
#: The most bytes of a descriptor, by version.
DESCRIPTOR_BYTES = ((2, 40_960), (3, 1 << 20))
#: V6: what caches of service descriptors have in common.
CACHE = (
    Rule("HiddenServiceVersionNumber", "int", True, 2, 3),
    Rule("EventTimestamp", "float", True, 0),
    *named_strings("CacheReasonString", mandatory=True),
    *flags("HasExistingCacheEntryFlag", "RequiresClientAuthFlag"),
    *counts("EncodedIntroPointByteCount", "EncodedDescriptorByteCount", "RevisionNumber"),
    Given("EncodedIntroPointByteCount", most_field="EncodedDescriptorByteCount", most_by_version=DESCRIPTOR_BYTES),
    Given("EncodedDescriptorByteCount", most_by_version=DESCRIPTOR_BYTES),
    Rule("IntroPointCount", "int", low=0, high=10),
    Rule("DescriptorCreationTime", "float", low=0),
    Rule("DescriptorIdBase32String", "string", low=32),
    Rule("OnionAddress", "string", low=16, high=16),
    Rule("BlindedEd25519PublicKeyBase64String", "string", low=43, high=43),
    *(
        Given(n, version=2)
        for n in ("IntroPointCount", "RequiresClientAuthFlag", "DescriptorCreationTime", "OnionAddress")
        + ("SupportedProtocolBitfield", "IntroPointFingerprintList")
    ),
    *(Given(n, version=3) for n in ("RevisionNumber", "DescriptorLifetime", "BlindedEd25519PublicKeyBase64String")),
)
#: V7, V8: cache stores and fetches.
CACHE_STORE = (*CACHE, Rule("WasAddedToCacheFlag", "flag", True))
CACHE_FETCH = (
    *CACHE,
    Rule("CacheQueryByteCount", "int", True, 0),
    *flags("HasCacheEntryFlag"),
    *counts("CacheLastServedTime", "CacheCreatedTime"),
    Given("CacheLastServedTime", version=2),
    Given("CacheCreatedTime", version=3),
)
#: Paths of traffic models.
VITERBI_PACKETS = (Rule("ViterbiPathPackets", "string", True, 1), Rule("EventTimestamp", "float", True, 0))
VITERBI_STREAMS = (Rule("ViterbiPathStreams", "string", True, 1), Rule("EventTimestamp", "float", True, 0))

#: The tagged events that there are, with their rules; P2: the fields of positional ones.
TAGGED = {
    "CIRCUIT_CELL": CIRCUIT_CELL,
    "CIRCUIT_CLOSE": CIRCUIT_CLOSE,
    "CONNECTION_CLOSE": CONNECTION_CLOSE,
    "HSDIR_CACHE_STORE": CACHE_STORE,
    "HSDIR_CACHE_FETCH": CACHE_FETCH,
    "VITERBI_PACKETS": VITERBI_PACKETS,
    "VITERBI_STREAMS": VITERBI_STREAMS,
}


def settled(events: DataFrame, name: str, value: Column) -> DataFrame:
    """events with a value that is worked out once.

    Exploding one value keeps filters above from taking the whole expression in for every field that they name; the
    expression itself stays below, in a projection, which Spark compiles (what a generator holds may be interpreted).
    """
    return events.withColumn("_one", value).withColumn(name, F.explode(F.array("_one"))).drop("_one")


def accepted(events: DataFrame, rules: dict[str, tuple] | None = None, model: bool = True) -> DataFrame:
    """Events (code, fields) with tags, reject_reason and valid, by the rules of each one's code.

    Unknown codes, malformed fields and, without a traffic model, its events are rejected; no row is lost.
    """
    known = TAGGED if rules is None else rules
    small_methods(events.sparkSession)
    parsed = settled(events, "tags", tagged(F.col("fields")))
    reason = F.when(~F.col("code").isin(*known), "unknown code")
    if not model:
        reason = reason.when(F.col("code").startswith("VITERBI_"), "no traffic model")
    reason = reason.when(F.size(F.map_keys("tags")) == 0, "malformed")
    for code, own in known.items():
        first = F.coalesce(*[F.when(~r.holds(F.col("tags")), r.field) for r in own])
        reason = reason.when(F.col("code") == code, first)
    judged = settled(parsed, "reject_reason", reason)
    return judged.withColumn("valid", F.col("reject_reason").isNull())


def with_arity(events: DataFrame, arity: dict[str, int]) -> DataFrame:
    """Positional events (code, fields) that have as many fields as their code asks for; others are rejected."""
    reason = F.when(~F.col("code").isin(*arity), "unknown code")
    for code, n in arity.items():
        reason = reason.when((F.col("code") == code) & (F.size("fields") != n), "number of fields")
    return events.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def typed(tags: Column, field: str, kind: str, default=None) -> Column:
    """P5: a field's value, or the default where it is missing; an empty list is no items."""
    v = tags[field]
    if kind == "list":
        items = F.filter(F.split(v, ","), lambda x: x != "")
        return F.coalesce(items, F.array(*[F.lit(x) for x in default or ()]).cast("array<string>"))
    value = {
        "string": v,
        "ip": v,
        "int": integer(v),
        "float": v.try_cast("double"),
        "flag": F.when(v.isin("0", "1"), v == "1"),
    }[kind]
    return value if default is None else F.coalesce(value, F.lit(default))


def validate(events: DataFrame, rules: tuple[Rule, ...], tags: str = "tags") -> DataFrame:
    """Valid, and the first field that fails as reject_reason; no row is lost."""
    reason = F.coalesce(*[F.when(~r.holds(F.col(tags)), r.field) for r in rules])
    return events.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def clean_exit_flag(exit_flag: Column, *internal: Column) -> Column:
    """Internal circuits aren't exits, whatever the flag says."""
    any_of = F.lit(False)
    for c in internal:
        any_of = any_of | F.coalesce(c, F.lit(False))
    return F.when(~any_of, exit_flag)


def replay(events: DataFrame, after: Column, before: Column, end: str = "end_ts") -> DataFrame:
    """Events that ended within the bounds, both inclusive."""
    return events.where(F.col(end).between(after, before))


#: Where each event's start and end lie, by code: tags, or places among positional fields.
TIMES = {
    "STREAM_ENDED": (6, 7),
    "STREAM_BYTES_TRANSFERRED": (None, 5),
    "CIRCUIT_CLOSE": ("CreatedTimestamp", "EventTimestamp"),
    "CONNECTION_CLOSE": ("CreatedTimestamp", "EventTimestamp"),
}


def with_times(events: DataFrame, times: dict | None = None) -> DataFrame:
    """Events (code, fields, tags) with start_ts and end_ts; an event without a start began when it ended.

    times: by code, the start's and the end's tag or place; other codes have EventTimestamp.
    """

    def at(where: str | int | None) -> Column:
        if where is None:
            return F.lit(None).cast("double")
        v = F.col("tags")[where] if isinstance(where, str) else F.get("fields", F.lit(where))
        return v.try_cast("double")

    start, end = F.lit(None).cast("double"), at("EventTimestamp")
    for code, (first, last) in (TIMES if times is None else times).items():
        start = F.when(F.col("code") == code, at(first)).otherwise(start)
        end = F.when(F.col("code") == code, at(last)).otherwise(end)
    return events.withColumn("end_ts", end).withColumn("start_ts", F.coalesce(start, end))


def begun_after(events: DataFrame, enabled_at: Column, start: str = "start_ts") -> DataFrame:
    """ST6: what began before collection was enabled is left out."""
    return events.where(F.col(start) >= enabled_at)


def moved_to(events: DataFrame, now: Column, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """The same durations, ending now."""
    return events.withColumn(start, now - (F.col(end) - F.col(start))).withColumn(end, now)


def sampled(events: DataFrame, rate: float, *keys: str) -> DataFrame:
    """S3: whole circuits, by a hash of their key, so that all executors agree."""
    return events.where(F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(rate * 1_000_000))


def first_of_each(events: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """S3: no more than n events of each circuit, in order."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")

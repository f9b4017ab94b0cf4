"""The clients of a tally server: what each has said of itself, and how many are in each state.

Clients send statuses: client, seq (the order in which they came), alive (when, in seconds), kind, state and any further
fields. A field that a status leaves out (null) stays as it was; a fingerprint stays what it was first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.checkpoints import stored

COLLECTOR, KEEPER = "DataCollector", "ShareKeeper"
STATES = ("idle", "active")
#: Fixed values, in seconds: how long the relay's handshake may take, and how long events may stay away.
CONTROL_SECONDS, EVENT_SECONDS = 10.0, 3600.0
#: Fixed values, in seconds: a client's round trip where it has told none, and what is added to any.
ROUND_TRIP, JITTER = 2.0, 1.0
#: Checkins that a client may miss before it counts as late, and as dead.
LATE, DEAD = 3, 7
#: Fields that keep their first value.
FIRST = ("fingerprint",)


def registry(statuses: DataFrame, first: tuple[str, ...] = FIRST) -> DataFrame:
    """One row a client: its fields, seq and alive of its last status, and since (alive of the status that brought its state).

    Statuses are aggregated map side. When the state came is looked up in a second pass that meets a written table of
    clients, so that Spark can split a client with very many statuses. Statuses without a client are left out; of
    equal seq, the larger value counts.
    """
    said = statuses.where("client is not null")
    fields = [c for c in said.columns if c not in ("client", "seq", "alive")]
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct("seq", c))
    value = {c: F.min_by(c, order(c)) if c in first else F.max_by(c, order(c)) for c in fields}
    # By state first: the last status of any other state ends before the present state began.
    by_state = said.groupBy("client", F.col("state").alias("_state")).agg(
        F.max("seq").alias("_seq"), F.max_by("alive", F.struct("seq", "alive")).alias("_alive"),
        *[F.struct(F.max(order(c)).alias("last"), F.min(order(c)).alias("first")).alias(c) for c in value],
    )
    held = lambda c: F.min(f"{c}.first")[c] if c in first else F.max(f"{c}.last")[c]
    ends = F.array_sort(F.collect_list(F.when(F.col("_state").isNotNull(), F.struct("_seq", "_state"))))  # as many as there are states
    clients = by_state.groupBy("client").agg(
        F.max("_seq").alias("seq"), F.max_by("_alive", F.struct("_seq", "_alive")).alias("alive"),
        *[held(c).alias(c) for c in fields], ends.alias("_ends"),
    )
    others = F.filter("_ends", lambda e: e["_state"] != F.col("state"))
    clients = stored(clients.withColumn("_before", F.array_max(F.transform(others, lambda e: e["_seq"]))).drop("_ends"), "clients")
    bounds = clients.select(F.col("client").alias("_client"), "_before")
    later = F.col("_before").isNull() | (F.col("seq") > F.col("_before"))
    began = said.where("state is not null").join(bounds, F.col("client") == F.col("_client")).where(later)
    began = began.groupBy("client").agg(F.min_by("alive", F.struct("seq", "alive")).alias("since"))
    return clients.drop("_before").join(began, "client", "left")


def matching_clients(clients: DataFrame, kind: str, state: str, key: str | None = None) -> DataFrame:
    """Clients of a kind in a state, and, with a key, those that have told that field."""
    chosen = (F.col("kind") == kind) & (F.col("state") == state)
    return clients.where(chosen if key is None else chosen & F.col(key).isNotNull())


def with_health(
    clients: DataFrame, now: Column | float, checkin: float, start: Column | float | None = None, padding: float = 0.0
) -> DataFrame:
    """Adds control_ok, event_recent, late and dead at `now`, for a collection that started at `start` (None: none has).

    clients need version (of the relay's control protocol), last_event and rtt, in seconds.
    """
    at = now if isinstance(now, Column) else F.lit(float(now))
    began = start if isinstance(start, Column) else F.lit(start).cast("double")
    trip = F.coalesce(F.col("rtt"), F.lit(ROUND_TRIP)) + JITTER
    exempt = ~F.coalesce(F.col("kind") == COLLECTOR, F.lit(False)) | began.isNull()
    control = F.col("version").isNotNull() | (at - (began + padding) <= CONTROL_SECONDS + checkin + trip)
    event = at - F.coalesce(F.col("last_event"), began + padding) <= EVENT_SECONDS + 2 * checkin + trip
    silent = lambda periods: at - F.col("alive") > periods * checkin + trip
    return clients.select(
        "*", (exempt | control).alias("control_ok"), (exempt | event).alias("event_recent"),
        silent(LATE).alias("late"), silent(DEAD).alias("dead"),
    )


def state_counts(clients: DataFrame) -> DataFrame:
    """kind, state, clients: one row for each that occurs."""
    return clients.groupBy("kind", "state").agg(F.count("*").alias("clients"))


def round_counts(clients: DataFrame, *by: str) -> DataFrame:
    """What a server asks before it starts or stops a round, in one pass: idle and active collectors and keepers, active
    collectors that control a relay, and those of them that had an event of late (with_health)."""
    is_a = lambda kind, state: (F.col("kind") == kind) & (F.col("state") == state)
    control = is_a(COLLECTOR, "active") & F.col("version").isNotNull()
    counts = {f"{n}_{s}": is_a(k, s) for n, k in (("collectors", COLLECTOR), ("keepers", KEEPER)) for s in STATES}
    counts |= {"collectors_control": control, "collectors_event": control & F.col("event_recent")}
    return clients.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])

"""Clients of a tally server against a loop over their statuses; contexts; names that a model brings along."""

import random

from pyspark.sql import functions as F

from veilcount.operators import clients
from veilcount.plans import catalog
from veilcount.sources import config, results

SCHEMA = "client string, seq long, alive double, kind string, state string, version string, last_event double, rtt double, fingerprint string"


def replayed(rows):
    """The registry as a server keeps it: one status after the other."""
    held = {}
    for client, seq, alive, *said in sorted((r for r in rows if r[0] is not None), key=lambda r: r[1]):
        own = held.setdefault(client, {"since": None})
        for name, value in zip(SCHEMA.replace(",", "").split()[6::2], said, strict=True):
            old = own.get(name)
            if value is not None and not (name == "fingerprint" and old is not None):
                own[name] = value
            else:
                own.setdefault(name, None)
            if name == "state" and value is not None and value != old:
                own["since"] = alive
        own |= {"seq": seq, "alive": alive}
    return held


def test_registry_is_what_a_server_keeps(spark):
    rng = random.Random(5)
    maybe = lambda x: rng.choice([None, x])
    rows = []
    for seq in range(900):
        client = rng.choice(["a", "a", "a", "b", "c", "d", None])
        kind = maybe("ShareKeeper" if client == "d" else "DataCollector")
        state = None if client == "c" else maybe(rng.choice(["idle", "active", "active"]))
        rows.append((client, seq, seq * 2.0, kind, state, maybe(f"v{seq}"), maybe(seq * 1.5), maybe(0.5), maybe(f"f{seq}")))
    rng.shuffle(rows)
    found = clients.registry(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert {r["client"]: {k: v for k, v in r.asDict().items() if k != "client"} for r in found} == replayed(rows)
    assert clients.registry(spark.createDataFrame([], SCHEMA)).count() == 0


def test_health_and_counts(spark):
    rows = [
        ("new", 1, 100.0, "DataCollector", "active", None, None, None, None),  # no relay, no events
        ("well", 2, 9990.0, "DataCollector", "active", "1", 9000.0, None, None),
        ("slow", 3, 9993.0, "DataCollector", "active", "1", None, 5000.0, None),
        ("idle", 4, 9962.0, "DataCollector", "idle", None, None, None, None),
        ("keeper", 5, 9990.0, "ShareKeeper", "active", None, None, None, None),
        ("none", 6, 9990.0, None, None, None, None, None, None),
    ]
    held = spark.createDataFrame(rows, SCHEMA)
    at = clients.with_health(held, 10_000.0, 10.0, 0.0, 1.0)
    found = {r["client"]: (r["control_ok"], r["event_recent"], r["late"], r["dead"]) for r in at.collect()}
    assert found == {
        "new": (False, False, True, True),
        "well": (True, True, False, False),
        "slow": (True, False, False, False),
        "idle": (False, False, True, False),
        "keeper": (True, True, False, False),
        "none": (True, True, False, False),
    }
    assert clients.round_counts(at).first().asDict() == {
        "collectors_idle": 1, "collectors_active": 3, "keepers_idle": 0, "keepers_active": 1, "collectors_control": 2, "collectors_event": 1,
    }
    before = clients.with_health(held, 10_000.0, 10.0)
    assert before.where("control_ok and event_recent").count() == len(rows)
    assert {r["client"] for r in clients.matching_clients(held, "DataCollector", "active", "version").collect()} == {"well", "slow"}
    assert {(r["kind"], r["state"]): r["clients"] for r in clients.state_counts(held).collect()}[("DataCollector", "active")] == 3


def test_contexts_tell_no_paths_and_keys():
    start = {"counters": {"A": 1}, "noise": {"counters": {"A": 2}, "privacy": 3}, "sharekeepers": {"x": "long", "y": "long"}}
    context = {
        "Time": {"Start": 1},
        "DataCollector": {"d": {"Status": {"public_key": "kept"}, "Config": {"state": "/s", "secret_handshake": "/h", "key": "kept", "Start": start}}, "bare": {}},
        "ShareKeeper": {"k": {"Status": {"public_key": "long"}, "Config": {"key": "/k", "Start": "none"}}},
        "TallyServer": {"Config": {"cert": "/c", "counters": {"A": 1}, "noise": {"counters": {"A": 1}}, "results": "/r"}},
    }
    before = repr(context)
    got = results.cleaned(context)
    assert repr(context) == before
    assert got["DataCollector"]["d"] == {
        "Status": {"public_key": "kept"},
        "Config": {
            "state": "(state path)", "secret_handshake": "(secret_handshake path)", "key": "kept",
            "Start": {
                "counters": "(counter bins, no counts)", "noise": {"counters": "(counter sigmas, no counts)", "privacy": 3},
                "sharekeepers": {"x": "(public key)", "y": "(public key)"},
            },
        },
    }
    assert got["DataCollector"]["bare"] == {} and got["Time"] == {"Start": 1}
    assert got["ShareKeeper"]["k"] == {"Status": {"public_key": "(public key)"}, "Config": {"key": "(key path)", "Start": "none"}}
    noise = {"counters": {"A": 1}}
    assert got["TallyServer"]["Config"] == {"cert": "(cert path)", "counters": "(counter bins, no counts)", "noise": noise, "results": "(results path)"}


def test_one_tolerance_for_models():
    shares = lambda x: {"S": x}
    model = {"state_space": ["S"], "observation_space": ["$", "F"], "start_probability": shares(1.0), "transition_probability": {"S": shares(1.0)}, "emission_probability": {"S": {"F": [1.0]}}}
    assert config.model_problems(model, "stream_model") == []
    assert config.model_problems(model | {"start_probability": shares(1 + 5e-10)}, "stream_model") == []
    assert config.model_problems(model | {"start_probability": shares(1 + 1e-7)}, "stream_model") == ["start doesn't sum to 1"]


def test_events_are_expected_by_flags(spark):
    flags = spark.createDataFrame([(["Guard"],), (["Exit"],), ([],), (None,)], "flags array<string>")
    for asked in (["EntryConnectionCount"], ["ExitStreamCount", "HSDir2StoreCount"], ["ZeroCount"], []):
        got = [r[0] for r in flags.select(catalog.events_expected(asked, F.col("flags"))).collect()]
        assert got == [catalog.are_events_expected(asked, set(f)) for f in (["Guard"], ["Exit"], [], [])]

import base64
import json

import pytest

from veilcount.operators import analysis, fanout, rounds
from veilcount.plans import catalog
from veilcount.sources import config, consensus

MODEL = {
    "state_space": ["aBlank", "bEnd"], "observation_space": ["+", "-", "F"], "start_probability": {"aBlank": 1.0},
    "transition_probability": {"aBlank": {"aBlank": 0.25, "bEnd": 0.75}, "bEnd": {}},
    "emission_probability": {"aBlank": {"+": [0.5, 1.0, 2.0, 3.0], "-": [0.5, 1.0, 2.0, 3.0]}, "bEnd": {"F": [1.0]}},
}


def written(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_noise_comes_from_the_first_source(spark, tmp_path):
    bins = written(tmp_path / "bins", {"counters": {"A": {"bins": [[0, 5], [5, float("inf")]]}}})
    sigmas = written(tmp_path / "sigmas", {"counters": {"A": {"sigma": 2}}})
    noise = written(tmp_path / "noise", {"privacy": {"epsilon": 0.3}, "counters": {"A": {"sensitivity": 7, "estimated_value": 1}}})
    inline = {"A": {"sigma": 9, "bins": [[0, 1]]}}

    def read(whole):
        b, n, privacy = config.read_config(spark, written(tmp_path / "config", whole))
        return [tuple(r) for r in b.orderBy("bin_idx").collect()], [tuple(r) for r in n.collect()], privacy

    inf = float("inf")
    assert read({"tally_server": {"counters": bins, "noise": noise, "sigmas": sigmas}, "privacy": {}, "counters": inline}) == ([("A", 0, 0.0, 5.0), ("A", 1, 5.0, inf)], [("A", None, 7.0, 1.0)], {"epsilon": 0.3})
    assert read({"tally_server": {"sigmas": sigmas}, "privacy": {"delta": 1}, "counters": inline}) == ([("A", 0, 0.0, 1.0)], [("A", 9.0, None, None)], {"delta": 1})
    assert read({"tally_server": {"sigmas": sigmas, "counters": bins}})[1:] == ([("A", 2.0, None, None)], {})
    assert read({"counters": inline}) == ([("A", 0, 0.0, 1.0)], [("A", 9.0, None, None)], {})
    assert read({}) == ([], [], {})


def test_allocations_come_back_as_noise(spark, tmp_path):
    given = spark.createDataFrame([("B", 4.0), ("A", 2.5)], "counter string, sigma double")
    config.write_allocation(given, {"epsilon": 0.3}, f"file://{tmp_path}/allocation")
    path = written(tmp_path / "config", {"tally_server": {"noise": f"file://{tmp_path}/allocation"}})
    _, noise, privacy = config.read_config(spark, path)
    assert {r.counter: r.sigma for r in noise.collect()} == {"A": 2.5, "B": 4.0} and privacy == {"epsilon": 0.3}


def test_models_are_read_and_checked(spark, tmp_path):
    moves, sent = config.read_model(spark, written(tmp_path / "m", {"packet_model": MODEL}))["packet_model"]
    assert {tuple(r) for r in moves.collect()} == {("START", "aBlank", 1.0), ("aBlank", "aBlank", 0.25), ("aBlank", "bEnd", 0.75)}
    assert ("bEnd", "F", 1.0, 0.0, 0.0, 0.0) in {tuple(r) for r in sent.collect()} and sent.count() == 3
    for change, problem in (({"start_probability": {"x": 1.0}}, "unknown state x"), ({"start_probability": {"aBlank": 0.5}}, "start doesn't sum"), ({"observation_space": ["+", "F"]}, "no observation -"), ({"emission_probability": {"aBlank": {"+": [1.0]}}}, "has 1 parts")):
        with pytest.raises(ValueError, match=problem):
            config.read_model(spark, written(tmp_path / "m", {"packet_model": MODEL | change}))
    with pytest.raises(ValueError, match="no model"):
        config.read_model(spark, written(tmp_path / "m", {}))


def test_latest_valid_model(spark, tmp_path):
    written(tmp_path / "x.traffic.model.5-30.json", {"packet_model": MODEL | {"start_probability": {}}})
    for end in (9, 20):
        written(tmp_path / f"x.traffic.model.5-{end}.json", {"packet_model": MODEL})
    assert config.latest_model(spark, str(tmp_path)).endswith("x.traffic.model.5-20.json")


def test_consensus(spark, tmp_path):
    fp = bytes(range(20))
    head = "network-status-version 3\nvote-status consensus\n"
    one = f"r s {base64.b64encode(fp).decode()[:27]} AAAA 2030-01-01 00:00:00 192.0.2.1 9001 0\ns Exit Fast\nv X\nw Bandwidth=1200 Unmeasured=1\n"
    two = f"r w {base64.b64encode(fp[::-1]).decode()[:27]} AAAA 2030-01-01 00:00:00 192.0.2.2 9001 0\ns\n"
    foot = "directory-footer\nbandwidth-weights Wed=2500 Wgg=10000\n"
    (tmp_path / "1-consensus").write_text(head + one + two + foot)
    (tmp_path / "other").write_text(head + one)
    got = {r.nickname: (r.fp, r.address, r.flags, r.bandwidth) for r in consensus.read_relays(spark, f"{tmp_path}/*consensus").collect()}
    assert got == {"s": (fp.hex().upper(), "192.0.2.1", ["Exit", "Fast"], 1200), "w": (fp[::-1].hex().upper(), "192.0.2.2", [], None)}
    assert [r.weights for r in consensus.read_weights(spark, str(tmp_path)).collect()] == [{"Wed": 0.25, "Wgg": 1.0}]


CIRCUIT = "is_origin boolean, is_entry boolean, is_mid boolean, is_end boolean, is_exit boolean, is_dir boolean, is_hsdir boolean, is_intro boolean, is_rend boolean, is_client boolean, hs_version int, inbound_cells long, outbound_cells long, failed boolean, lifetime double, reason_list int"


def test_circuit_names_follow_the_grammar(spark):
    flags = lambda *on: [i in on for i in range(9)]
    rows = [(*flags(1, 3, 8), True, 2, 9, 9, False, 5.0, None), (*flags(6), False, None, 0, 0, True, 5.0, 1), (*flags(7), None, None, 9, 9, True, 5.0, 1), (*[None] * 9, None, None, 1, 1, True, 1.0, 0)]
    positions = fanout.circuit_positions(spark.createDataFrame(rows, CIRCUIT))
    assert {r.position: (r.version, r.role, r.hop, r.active) for r in positions.collect()} == {"Entry": (None, None, None, True), "End": (None, None, None, True), "SingleHop": (None, None, None, True), "Rend": ("2", "Client", "Tor2WebClient", True), "HSDir": ("U", "Service", "MultiHopService", True), "Intro": ("U", None, None, False)}
    got = {r.counter for r in fanout.versioned_circuit_counters(positions).collect()}
    assert got <= set(catalog.circuit_names())
    assert {"Rend2Tor2WebClientActiveSuccessCircuitCount", "IntroUInactiveCircuitCount", "HSDirMultiHopServiceFailureCircuitReasonCountList", "HSDirCircuitCellRatio"} <= got
    assert not [n for n in got if n.startswith("HSDirU") or "IntroUActive" in n]


def test_rounds_need_their_parties(spark):
    facts = [(0, p, p == "sk", c, 0, n, 60.0) for p, n in (("a", 5), ("b", 6), ("sk", -4)) for c in ("x", "y") if (p, c) != ("b", "y")]
    facts += [(1, "a", False, "x", 0, 5, 60.0), (1, "sk", True, "x", 0, 5, 60.0)]
    facts += [(2, p, p == "sk", "x", b, 1, 30.0) for p in ("a", "b", "sk") for b in (0, 1)]
    table = spark.createDataFrame(facts, "round long, party string, is_keeper boolean, counter string, bin_idx int, count long, seconds double")
    got = sorted((r["round"], r["counter"], r["bin_idx"], int(r["count"]), r["early"]) for r in rounds.round_tallies(table, 2, 1, 60.0).collect())
    assert got == [(0, "x", 0, 7, False), (2, "x", 0, 3, True), (2, "x", 1, 3, True)]


def test_plotted_has_a_column_for_each_experiment(spark):
    rows = [("c", 0, "a", 5.0, 3.0, 8.0), ("c", 0, "b", 7.0, 7.0, 9.0), ("c", 1, "a", 0.0, 0.0, 2.0)]
    table = spark.createDataFrame(rows, "counter string, bin_idx int, experiment string, bound_value double, error_low double, error_high double")
    got = {r.bin_idx: (r.a_value, r.a_below, r.a_above, r.b_value, r.b_above) for r in analysis.plotted(table, ["a", "b"]).collect()}
    assert got == {0: (5.0, 2.0, 3.0, 7.0, 2.0), 1: (0.0, 0.0, 2.0, None, None)}

import pytest

from veilcount.operators import hmm, rounds
from veilcount.sources import results


def allocation(spark, **sigmas):
    return spark.createDataFrame(list(sigmas.items()), "counter string, sigma double")


def test_rounds_wait_for_less_noise(spark):
    first = allocation(spark, a=10.0, b=5.0)
    assert rounds.next_start(None, first, None, 60) == 0
    assert rounds.next_start(first, allocation(spark, a=11.0, b=5.0), 100.0, 60) == 100
    assert rounds.next_start(first, allocation(spark, a=9.0, b=5.0), 100.0, 60, 2.0) == 162
    assert rounds.next_start(first, allocation(spark, a=9.0, b=5.0), 100.0, 60, tolerance=1.0) == 100
    assert rounds.next_start(first, allocation(spark, a=10.0), 100.0, 60) == 160
    assert rounds.next_start(first, allocation(spark, a=10.0, b=None), 100.0, 60) == 160
    assert rounds.next_start(first, first, 100.0, 60, always=True) == 160


def test_baseline_stays_the_first_of_equals(spark):
    first, near, less = allocation(spark, a=10.0), allocation(spark, a=9.5), allocation(spark, a=8.0)
    assert rounds.baseline(None, first) is first
    assert rounds.baseline(first, near, tolerance=1.0) is first
    assert rounds.baseline(first, less, tolerance=1.0) is less
    assert rounds.baseline(first, less, succeeded=False) is first


@pytest.mark.parametrize("versions, lists, problems", [([], 0, []), ([4, 6], 1, []), ([4], 1, ["one version only"]), ([4, 6], 0, ["maps without lists"]), ([], 1, ["lists without maps"]), ([4, 6, 5], 1, ["unknown version"])])
def test_prefix_maps(spark, versions, lists, problems):
    maps = spark.createDataFrame([(v,) for v in versions], "ipver int")
    listed = spark.createDataFrame([(i,) for i in range(lists)], "asn int")
    assert [r.problem for r in rounds.prefix_map_problems(maps, listed).collect()] == problems


def test_results_come_back(spark, tmp_path):
    rows = [("b", 0, float("-inf"), 0.0, 2**62 + 1), ("b", 1, 0.0, float("inf"), -7), ("a", 0, 0.0, float("inf"), 3)]
    given = spark.createDataFrame(rows, "counter string, bin_idx int, lo double, hi double, value long")
    path = results.write_results(given, str(tmp_path), 1.4, 9.6)
    assert path.endswith("/tallies.1-10.json")
    got = results.read_results(spark, path).orderBy("counter", "bin_idx").collect()
    assert [(r.counter, r.bin_idx, r.lo, r.hi, int(r.value)) for r in got] == sorted(rows)


def test_outcomes_bring_their_noise(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"Tally": {"x": {"bins": [[-Infinity, 5.0, 4], [5.0, Infinity, 6]]}}, "Context": {"TallyServer": {"Config": {"noise": {"privacy": {"excess_noise_ratio": 2.0, "epsilon": 0.3}, "counters": {"x": {"sigma": 12.5}}}}}}}')
    (tmp_path / "t.json").write_text('{"x": {"bins": [[0.0, Infinity, 9]], "sigma": 3.0}}')
    got = {(r.experiment, r.bin_idx): (r.lo, r.hi, int(r.value), r.sigma, r.excess) for r in results.read_results(spark, str(tmp_path)).collect()}
    inf = float("inf")
    assert got == {("o.json", 0): (-inf, 5.0, 4, 12.5, 2.0), ("o.json", 1): (5.0, inf, 6, 12.5, 2.0), ("t.json", 0): (0.0, inf, 9, 3.0, None)}


@pytest.fixture(scope="module")
def model(spark):
    moves = spark.createDataFrame([("START", "sActive", 1.0), ("sActive", "sDwell", 1.0), ("sActive", "sEnd", 0.0), ("sDwell", "sEnd", 1.0)], "src string, dst string, p double")
    sent = spark.createDataFrame([("sActive", "$", 1.0, 0.0, 0.0, 0.5), ("sDwell", "$", 1.0, 2.0, 1.0, 0.0), ("sEnd", "F", 1.0, 0.0, 0.0, 0.0)], "state string, obs string, dp double, mu double, sigma double, lam double")
    return moves, sent, hmm.model_counters(spark, "M", moves, sent)


def test_model_counters(spark, model):
    got = {r.counter: r.template for r in model[2].where("a is not null").collect()}
    cell = "_<STATE>_<OBS>"
    assert got == {"MTransitionCount_START_sActive": "MTransitionCount_START_<STATE>", "MTransitionCount_sActive_sDwell": "MTransitionCount_<SRCSTATE>_<DSTSTATE>", "MTransitionCount_sDwell_sEnd": "MTransitionCount_<SRCSTATE>_<DSTSTATE>", "MEmissionCount_sActive_$": "MEmissionCount" + cell, "MDelayTime_sActive_$": "MDelayTime" + cell, "MEmissionCount_sDwell_$": "MEmissionCount" + cell, "MLogDelayTime_sDwell_$": "MLogDelayTime" + cell, "MSquaredLogDelayTime_sDwell_$": "MSquaredLogDelayTime" + cell, "MEmissionCount_sEnd_F": "MEmissionCount" + cell}
    noise = spark.createDataFrame([("MEmissionCount" + cell, 2.0), ("MDelayTime", 1.0)], "template string, sensitivity double")
    assert hmm.unknown_templates(model[2], noise).isEmpty()
    assert hmm.expanded(model[2], noise).count() == 4


def test_updated_models(spark, model):
    moves, sent, counters = model
    assert hmm.updated_model(counters, moves, sent, spark.createDataFrame([], "counter string, bin_idx int, count long")) is None
    tallies = counters.selectExpr("counter", "0 as bin_idx", "case when kind = 'DelayTime' then 40 else 10 end as count")
    new_moves, new_sent = hmm.updated_model(counters, moves, sent, tallies)
    assert {(r.src, r.dst): r.p for r in new_moves.collect()} == {("START", "sActive"): 1.0, ("sActive", "sDwell"): 1.0, ("sActive", "sEnd"): 0.0, ("sDwell", "sEnd"): 1.0}
    got = {r.state: r for r in new_sent.collect()}
    assert got["sActive"].lam == pytest.approx(1 / (0.5 / 0.5 + 0.5 / 0.25))
    assert got["sDwell"].mu == pytest.approx(0.5 * 2 + 0.5 * 1)

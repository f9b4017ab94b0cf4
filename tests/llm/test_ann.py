"""Nearest neighbours against brute force where a query reads a small share of many lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilcount.llm import ann


@pytest.fixture(scope="module")
def vectors():
    """9,000 vectors around 300 centres, a third of them in one region."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, 24))
    x = centres[rng.integers(0, 300, 9000)] + 0.35 * rng.normal(size=(9000, 24))
    x[:3000] = centres[0] + 0.5 * rng.normal(size=(3000, 24))
    return x


def test_ratios_decide_what_is_read(spark, vectors):
    rows = [(i, [float(v) for v in row], i, "q", 0.5) for i, row in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list int, class string, score double")
    figures = {}
    got = ann.search(df, df.vec_id % 20 == 0, figures=figures).collect()
    assert figures["lists"] >= 100 and figures["classes"] == len(rows)
    assert figures["reads"] < 0.5 * figures["lists"] * figures["queries"] and figures["postings"] > figures["classes"]
    found = {}
    for r in got:
        assert r["query_id"] != r["vec_id"] and abs(r["score"] - vectors[r["query_id"]] @ vectors[r["vec_id"]]) < 1e-9
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hit = 0
    for q, ranked in found.items():
        score = vectors @ vectors[q]
        score[q] = -np.inf
        assert [score[ranked[k]] for k in range(1, 21)] == sorted((score[v] for v in ranked.values()), reverse=True)
        hit += len(set(np.argsort(-score)[:20].tolist()) & set(ranked.values()))
    assert len(found) == 450 and hit >= 0.95 * 20 * 450


def test_beams_widen_until_the_ratio_is_passed():
    rng = np.random.default_rng(2)
    at = rng.normal(size=(400, 8)).astype(np.float32)
    graph = ann.CentroidGraph(at, beam=16)
    x = rng.normal(size=(30, 8))
    for ratio in (1.0, 1.5, 3.0, 50.0):
        missed = wanted = 0
        for row, lists in graph.within(x, ratio):
            far = np.sqrt(((at - x[row].astype(np.float32)) ** 2).sum(axis=1))
            want = set(np.flatnonzero(far <= ratio * far.min() * (1 - 1e-4)).tolist())
            missed, wanted = missed + len(want - set(lists)), wanted + len(want)
        assert missed <= 0.02 * wanted  # a graph search may miss a list


def test_lists_hold_a_floor_of_candidates():
    rng = np.random.default_rng(3)
    graph = ann.CentroidGraph(rng.normal(size=(200, 8)), beam=8)
    sizes = rng.integers(0, 5, 200)
    for _, lists in graph.within(rng.normal(size=(20, 8)), 1.0, sizes, 100):
        assert sizes[lists].sum() >= 100
    assert all(len(lists) == 200 for _, lists in graph.within(rng.normal(size=(3, 8)), 1.0, sizes, 10**6))


def test_two_levels_of_centroids_follow_the_vectors():
    rng = np.random.default_rng(5)
    sample = np.vstack([rng.normal(size=(4000, 6)), 20 + 0.1 * rng.normal(size=(4000, 6))]).astype(np.float32)
    at = ann.fit_centroids(sample, 800)
    assert 700 <= len(at) <= 900 and 0.3 < (at[:, 0] > 10).mean() < 0.7


def test_a_query_goes_once_to_a_shelf(spark, vectors):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(vectors[:4000])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    figures = {}
    got = ann.search(df, F.col("vec_id") % 20 == 0, read_ratio=1.5, figures=figures)
    assert got.count() == 20 * 200
    assert figures["shelves_read"] <= ann.LEAST_SHELVES * figures["queries"] and figures["shelves_read"] < 0.6 * figures["reads"]


def test_wide_beams_meet_all_centroids_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    graph, beams = ann.CentroidGraph(rng.normal(size=(400, 8)), beam=8), []
    search = graph.search
    monkeypatch.setattr(graph, "search", lambda x, beam=None: beams.append(beam) or search(x, beam))
    assert all(len(lists) == 400 for _, lists in graph.within(rng.normal(size=(30, 8)), 50.0))
    assert beams == [8, 16, 400]


def test_products_meet_list_by_list(monkeypatch):
    """Small whole components give many ties, which go to the smaller name."""
    monkeypatch.setattr(ann, "HELD_BLOCK", 16)
    monkeypatch.setattr(ann, "READ_BLOCK", 4)
    rng = np.random.default_rng(6)
    x, y = rng.integers(-3, 4, (25, 5)).astype(float), rng.integers(-3, 4, (300, 5)).astype(float)
    queries, names = 1000 + np.arange(25), np.sort(rng.choice(5000, 300, replace=False))
    reads, holds = rng.random((25, 9)) < 0.5, rng.random((300, 9)) < 0.3
    given = [(np.nonzero(of)[1], np.nonzero(of)[0]) for of in (reads, holds)]
    for least in (-np.inf, 4.0):
        got = ann.best_in_lists(x, queries, given[0], y, names, given[1], 6, np.full(25, least))
        for i, q in enumerate(queries):
            met = np.flatnonzero((reads[i] & holds).any(axis=1))
            best = sorted((-float(x[i] @ y[m]), int(names[m])) for m in met)[:6]
            found = [(-s, c) for s, c in zip(got["score"][got["query"] == q], got["class"][got["query"] == q], strict=True)]
            assert [f for f in found if -f[0] >= least] == [b for b in best if -b[0] >= least]


def test_zeros_are_equal_whatever_their_sign(spark):
    rows = [(0, [0.0, 1.0]), (1, [-0.0, 1.0]), (2, [-0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (4, []), (5, [float("-inf"), 1.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") < 2).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (1, 3, 3, 0.5)]

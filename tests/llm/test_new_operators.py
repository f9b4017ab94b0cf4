"""Decontamination, hard negatives and ball k-means against brute force, on nulls, ties, repeated and very long rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from veilcount.llm import balls, decontamination, negatives
from veilcount.llm.decontamination import contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def hits(text, items):
    """(words, hit words, items, spans) by looking at every window at every place."""
    own, spots = words(text), [m.span() for m in WORD.finditer(lower(text))]
    hit, found = set(), set()
    for item, body in items:
        w = words(body)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1) if w else ():
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found |= {str(item)} if item is not None else set()
    runs = [(i, next(j for j in range(i, len(own) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
    return len(own), len(hit), sorted(found), [(spots[a][0], spots[b - 1][1]) for a, b in runs]


def text_of(rng, n):
    return " ".join(rng.choice("abcde") + rng.choice(["", "é", "1", "漢"]) for _ in range(n))


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(3)
    items = [(i, text_of(rng, rng.randrange(12, 40))) for i in range(12)]
    items += [(20, "Short one, here!"), (21, "here"), (3, "another text of an item that has one already, it is"), (None, text_of(rng, 15)), (22, None), (23, " -- \x00 "), (24, items[0][1])]
    docs = [(i, text_of(rng, rng.randrange(0, 60))) for i in range(60)]
    for i, (_, body) in enumerate(items):
        w = words(body)
        docs.append((100 + i, f"🙂 Before, {'; '.join(w[2:14]).upper()} -- after. " + text_of(rng, 5)))
        docs.append((200 + i, f"{text_of(rng, 3)} {body or ''}{body or ''}"))
    docs += [(300, None), (300, ""), (None, items[1][1]), docs[70], docs[70], (301, "\x00here\x00"), (302, "a" * 50_000 + " here")]
    return docs, items


def test_contamination(spark, leaks):
    docs, items = leaks
    own = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, found string, row int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    want = sorted(str((i, *hits(t, items))) for i, t in docs)
    show = lambda df: sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]])) for r in df.collect())
    assert show(contamination(own, bench)) == want
    assert sum(hits(t, items)[1] > 0 for _, t in docs) > 15
    # Many small automata, pieces of few words, and texts in small bites give the same.
    kept = decontamination.AUTOMATON_WORDS
    try:
        decontamination.AUTOMATON_WORDS = 100
        assert show(contamination(own, bench)) == want
    finally:
        decontamination.AUTOMATON_WORDS = kept
    assert contamination(own.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in contamination(own, bench.limit(0)).collect()} == {0}


def test_scan_in_bites(leaks, monkeypatch):
    docs, items = leaks
    pieces = [(None if i is None else str(i), p) for i, t in items for p in decontamination.pieces_of(decontamination.normal(t or "").split(), 10, 3)]
    automaton = decontamination.Windows(pieces)
    monkeypatch.setattr(decontamination, "SCAN_BYTES", 16)
    for _, t in docs:
        n, runs, found = automaton.hits(decontamination.normal(t or ""))
        assert (n, sum(b - a + 1 for a, b in runs), sorted(found)) == hits(t, items)[:3]


def test_very_long_text(spark, leaks):
    _, items = leaks
    text = "plain words " * 2_000_000 + items[0][1] + " and more" * 1_000_000
    row = contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).first()
    n = len(words(items[0][1]))
    assert (row["n_words"], row["n_hit"]) == (6_000_000 + n, n)
    assert [tuple(s) for s in row["spans"]] == [(24_000_000, 24_000_000 + len(items[0][1]))]


def test_decontaminate_cuts_and_drops(spark, leaks):
    docs, items = leaks
    own = spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, row long")
    got = decontaminate(own, spark.createDataFrame(items, "item_id long, text string"), most_hit=0.5)
    want = []
    for i, t in docs:
        n, hit, _, spans = hits(t, items)
        if hit <= n * 0.5:
            parts, at = [], 0
            for a, b in spans:
                parts, at = [*parts, t[at:a]], b
            want.append((i, t if t is None else "".join(parts) + t[at:], i))
    assert got.columns == own.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert any(len(t or "") != len(dict(docs).get(i) or "") for i, t, _ in want)


def whole(v):
    return [math.floor(256 * float(x)) for x in v]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(700, 64)) / 8
    v[300:400] = v[300] + rng.normal(size=(100, 64)) / 200  # a dense region
    v[100:130] = v[100]  # ties
    rows = [(i, [float(x) for x in e], int(rng.integers(0, 10)) if i % 3 else 1) for i, e in enumerate(v)]
    rows += [rows[5], rows[5], (9000, None, 1), (9001, [], 1), (9002, [0.5] * 63, 1), (9003, [0.1] * 63 + [None], 1), (9004, [0.1] * 63 + [float("nan")], 1),
             (9005, [0.1] * 63 + [float("inf")], 1), (9006, rows[6][1], None), (9007, [0.0] * 64, 2), (9100, [-x for x in rows[7][1]], 3)]
    return rows, spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, v string, score int")


def sound(v):
    return v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)


def test_hard_negatives(vectors):
    rows, df = vectors
    kept = {(i, lab): np.array(whole(v)) for i, v, lab in rows if sound(v) and lab is not None}
    want = []
    for (a, lab), q in kept.items():
        if a % 100:
            continue
        scores = sorted((-int(q @ v), i, other) for (i, other), v in kept.items() if i != a)
        for s, pos, _ in [x for x in scores if x[2] == lab][:5]:
            fit = [(n, i) for n, i, other in scores if other != lab and 30 * -s <= 100 * -n <= 90 * -s][:10]
            want += [(a, pos, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    from pyspark.sql import functions as F

    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 200
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_products_drop_most_candidates_before_the_last_plane():
    rng = np.random.default_rng(2)
    rows, anchors = (np.floor(rng.normal(size=(n, 64)) * 32).astype(np.int64) for n in (4000, 20))
    seen = []

    def rule(i):
        def one(least, most):
            seen.append(len(least))
            assert (least <= most).all()
            return negatives.best(5)(least, most)

        return one

    for i, at, x in negatives.products(anchors, rows, lambda i: np.arange(4000), rule):
        exact = rows @ anchors[i]
        assert (exact[at] == x).all() and set(np.lexsort((np.arange(4000), -exact))[:5]) <= set(at.tolist())
        assert len(at) < 10
    assert min(seen) < 20 and max(seen) == 4000
    for big in (1 << 12, 1 << 22):  # wider numbers, by doubles and by longs
        r, q = rng.integers(-big, big, (50, 64)), rng.integers(-big, big, (3, 64))
        for i, at, x in negatives.products(q, r, lambda i: np.arange(50), lambda i: negatives.best_within([(0, 1 << 62)], 3)):
            exact = r @ q[i]
            assert (exact[at] == x).all() and set(np.argsort(-exact)[:3][np.sort(-exact)[:3] <= 0].tolist()) <= set(at.tolist())


def lloyd(rows, k, rounds):
    kept = [(i, whole(v)) for i, v, _ in rows if sound(v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in start[:k]]
    x = np.array([v for _, v in kept])
    for step in range(rounds + 1):
        d = ((x[:, None, :] - np.array(c)[None, :, :]) ** 2).sum(axis=2)
        best = d.argmin(axis=1)
        if step < rounds:
            for j in set(best.tolist()):
                own = x[best == j]
                c[j] = [int(s) // len(own) for s in own.sum(axis=0)]
    own = d[np.arange(len(x)), best]
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted((kept[i][0], int(best[i]), int(own[i]), int(own[best == best[i]].sum()), int(own.sum()), sha[best[i]]) for i in range(len(x)))


def test_ball_k_means(vectors):
    rows, df = vectors
    assert sorted(map(tuple, balls.ball_k_means(df).collect())) == lloyd(rows, 40, 5)
    few = df.where("vec_id < 7")
    assert sorted(map(tuple, balls.ball_k_means(few).collect())) == lloyd([r for r in rows if r[0] < 7], 40, 5)
    assert balls.ball_k_means(df.limit(0)).count() == 0


def test_balls_save_distances():
    """On separated clusters most members lie in the stable core."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (40, 64))
    x = centres[rng.integers(0, 40, 5000)] + rng.integers(-20, 20, (5000, 64))
    was, _ = balls.nearest(x, centres)
    shifted = centres + rng.integers(-3, 3, centres.shape)
    cluster, d, worked = balls.moved(x, was, shifted, balls.squared(shifted, shifted))
    best, least = balls.nearest(x, shifted)
    assert (cluster == best).all() and (d == least).all() and worked < 1.05 * len(x)
    mixed = rng.integers(0, 40, 5000)  # any last cluster gives the nearest
    cluster, d, _ = balls.moved(x, mixed, shifted, balls.squared(shifted, shifted))
    assert (cluster == best).all() and (d == least).all()
    big = rng.integers(-(1 << 25), 1 << 25, (6, 64))
    assert balls.squared(big, big)[0, 1] == sum((int(a) - int(b)) ** 2 for a, b in zip(big[0], big[1], strict=True))

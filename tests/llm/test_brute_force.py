"""Quality, mixing and the pipeline's stages against plain Python and numpy."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilcount.llm import lookup, mixing, neardup, packing, quality, secrets, suffixes
from veilcount.llm._shared import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def densities(x, rows, toward, identity, pooled, scale):
    """Log-density of a normal, up to a constant, by the inverse and determinant outright."""
    mean, n, d = rows.mean(axis=0), len(rows), rows.shape[1]
    own = np.cov(rows.T, bias=True)
    share = min(1.0, toward + d / (n + d))
    cov = (1 - identity) * ((1 - share) * own + share * pooled) + identity * scale
    far = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    return -0.5 * (far + np.linalg.slogdet(cov)[1])


def test_quality_is_the_discriminant(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    pdf = docs.select("doc_id", "text").toPandas()
    x = np.array([quality.statistics(t or "") for t in pdf["text"]])
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in pdf["doc_id"]])
    marks = dict(labels.select("doc_id", "quality").collect())
    label = np.array([marks.get(i, -1) for i in pdf["doc_id"]])
    classes = [x[~held & (label == k)] for k in (0, 1)]
    pooled = sum(len(c) * np.cov(c.T, bias=True) for c in classes) / sum(map(len, classes))
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    low, high = (densities(x, c, quality.TO_POOLED, quality.TO_IDENTITY, pooled, scale) for c in classes)
    odds = math.log(len(classes[1]) / len(classes[0])) + (high - low) / quality.TEMPERATURE
    want = dict(zip(pdf["doc_id"].tolist(), 1 / (1 + np.exp(-np.clip(odds, -40, 40))), strict=True))
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(want) and all(abs(r["score"] - want[r["doc_id"]]) < 1e-6 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert {r["doc_id"] for r in got if r["held_out"]} == set(pdf["doc_id"][held])
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["predicted"])


def water_filled(sizes, weights, share, most):
    """Targets by resharing the excess until no source is above its most."""
    left, target, open_ = share * sum(sizes.values()), {}, dict(zip(sizes, weights, strict=True))
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > most * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def seats_by_listing(claims, seats):
    """Sainte-Lague: seats to the highest claim / (2 j - 1), one after another."""
    won = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max(claims, key=lambda k: (claims[k] / (2 * won[k] + 1), claims[k], -k))
        won[best] += 1
    return won


def test_apportionment_lists_the_same_seats(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g in range(25):
        claims = {k: float(c) for k, c in enumerate(rng.choice([0, 1, 2, 3, 50, 1000, 12345], int(rng.integers(1, 9))))}
        seats = int(rng.choice([0, 1, 5, 100, 333]))
        rows += [(g, k, c, seats) for k, c in claims.items()]
        if sum(claims.values()):
            want |= {(g, k): n for k, n in seats_by_listing(claims, seats).items()}
    df = spark.createDataFrame(rows, "g int, k int, claim double, seats long")
    got = {(r["g"], r["k"]): r["quota"] for r in mixing.apportion(df, ["g"], ["k"], "claim", "seats").collect()}
    assert {k: got[k] for k in want} == want


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def mixed_outright(rows, seed, block_words, shard_words):
    """taken by row number. rows: (source, size, place)."""
    sizes = {}
    for source, size, _ in rows:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
    target = water_filled({s: sizes[s] for s in names}, weights, mixing.SHARE, mixing.MOST_COPIES)
    least = min(t for t in target.values() if t > 0)
    block = max(min(math.floor(least / mixing.LEAST_BLOCKS), block_words), 1)
    seats = seats_by_listing({i: target[s] for i, s in enumerate(names)}, math.floor(sum(target.values()) / block + 0.5))
    return names, sizes, target, block, seats


def test_mixing_is_targets_quotas_and_runs(spark, documents):
    docs = documents.union(documents.limit(0)).select(*COLUMNS)
    extra = [(9000, None, "en", "web", 0), (9001, "a b\x1cc d", "en", None, 3), (9001, "a b\x1cc d", "en", None, 3), (None, "x y z", "en", "s", 5), (9002, "w " * 700_000, "en", "books", 1)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    shard_words = 30_000
    got = mixing.mix(docs, shard_words=shard_words).collect()
    assert len(got) == docs.count()
    rows = [(r["source"], len(words(r["text"])), 0) for r in docs.collect()]
    names, sizes, target, block, seats = mixed_outright(rows, mixing.SEED, mixing.BLOCK_WORDS, shard_words)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["block"] == block
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
        by[r["source"]] = by.get(r["source"], 0) + r["taken"]
    for i, s in enumerate(names):
        shards = math.ceil(max(sizes[s], 1) / shard_words)
        full = min(seats[i] * block, mixing.MOST_COPIES * sizes[s])  # the seats that whole passes can't give are lost
        assert abs(by[s] - full) <= block * (shards + 1)
        assert abs(by[s] - target[s]) <= block * (shards + 2)


def test_copies_follow_what_the_mix_takes(spark):
    text = lambda n, k: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(i % 40, text(1 + 7 * (i % 13), i), "en", f"s{i % 2}", i) for i in range(300)]
    rows += [(1, text(50, "same"), "en", "s0", 1)] * 2 + [(1, None, "en", "s1", 0), (None, text(9, "n"), "en", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    key = lambda i, s, t: (i, s, hash(t or ""))
    taken, size = {}, {}
    hashes = {r["k"]: r["text"] for r in docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text").collect()}
    for r in mixing.mix(docs).collect():
        k = key(r["doc_id"], r["source"], hashes[r["text_key"]])
        taken[k], size[k] = taken.get(k, 0) + r["taken"], size.get(k, 0) + r["size"]
    want = {k: math.floor(taken[k] / size[k] + 0.5) if size[k] else 1 for k in taken}
    got, held = {}, {}
    for i, t, _, s, _ in rows:
        held[key(i, s, t)] = held.get(key(i, s, t), 0) + 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        k = key(r["doc_id"], r["source"], r["text"])
        got[k] = got.get(k, 0) + 1
    assert got == {k: n * held[k] for k, n in want.items() if n} and len(set(want.values())) > 1


def test_hot_anchors_are_split(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000).alias("anchor"), F.col("id").alias("doc_id"), F.lit(0).alias("position"))
    kept = materialize(rows.repartition(8), "anchors")
    low = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        df = suffixes.repeated_anchors(kept)
        n = len(df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == 60_000 and "skew=true" in plan


@pytest.fixture(scope="module")
def stages(spark, documents):
    """What each stage makes of what the one before left."""
    out, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_stages_keep_columns_and_decide_on_all_rows(spark, stages):
    docs, good, distinct, clean, mix, packed = stages
    assert [s.columns for s in stages[:5]] == [docs.columns] * 5
    scores = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(r["doc_id"] for r in scores if r["predicted"])
    sets = {r["doc_id"]: set(neardup.shingle_set(neardup.words_of(r["text"])).tolist()) for r in good.collect()}
    root = {i: i for i in sets}
    find = lambda i: i if root[i] == i else find(root[i])
    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in distinct.collect()) == sorted(i for i in sets if find(i) == i)
    texts = {r["doc_id"]: r["text"] for r in distinct.collect()}
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["found"]] for r in secrets.scan(distinct).collect()}
    assert clean.count() == distinct.count() and any(spans.values())
    for r in clean.collect():
        rest = texts[r["doc_id"]] or ""
        for start, end in reversed(spans[r["doc_id"]]):
            rest = rest[:start] + "\0" * (end - start) + rest[end:]
        pieces = [p for p in rest.split("\0") if p]
        assert r["text"].replace("[SECRET]", "") == "".join(pieces).replace("[SECRET]", "")
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(clean).collect() if r["size"]}
    times = {}
    for r in mix.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert all(times.get(i, 0) == math.floor(x + 0.5) for i, x in taken.items())
    lengths = {}
    for r in packed.collect():
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= packing.CAPACITY
    assert packed.where("start = 0").count() == mix.count()


def test_stages_of_nothing(spark, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "nothing")
        assert docs.count() == 0


def test_asked_rows_grow_with_keys_not_with_their_square():
    """A chunk asks only slices that hold its keys, however many there are; twice the corpus asks about twice."""
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 2**64 - 1, 500, dtype=np.uint64)) for _ in range(8)]
    asked = lambda n, slices: sum(len(lookup.ask(i, k, np.ones((2, len(k)), np.int64), slices)) for i, k in enumerate(keys[:n]))
    assert asked(8, 1_000_000) <= 8 * 500 and asked(4, 1_000_000) <= 4 * 500 and asked(8, 4) == 8 * 4
    rows = lookup.ask(0, keys[0], np.vstack([np.arange(len(keys[0]))] * 2), 1000)
    back = np.concatenate([np.cumsum(lookup.unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]])
    assert (back == keys[0]).all() and (np.diff(rows["slice"]) > 0).all()

"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

Texts become sets of distinct five-word shingles. Exact copies (equal word sequences) collapse to
classes first. Each class has a SuperMinHash signature: every element spreads one random
permutation of ranks over the slots, round by round, until no slot can improve. Bands of the
signature deal classes to buckets; members of a bucket are verified on their full sets against the
bucket's most central member (the one whose buckets are largest). In buckets that this leaves in
several components, the members outside the largest one meet all members, block against block
inside tasks, which return a forest of links and no pairs. So a group of near copies costs rows in
proportion to its size, and no candidate is dropped.

Texts without words have an empty set and link with nothing, not even with each other. A null text
is empty. Rows with a null id form no links: their component is null and they are kept. Repeated
rows count as one document. Columns other than the two named are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table, text_of
from veilcount.llm.components import components

WORDS = 5
#: Links have 100 * intersection >= SIMILAR * union.
SIMILAR = 75
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Classes and shingles on one side of a block comparison, about.
BLOCK_CLASSES, BLOCK_SHINGLES = 512, 400_000

_PHI = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case. On bytes, lower() and split() know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    take = min(width, len(words))
    n = len(words) - take + 1
    out = np.full(n, take, np.uint64)
    for i in range(take):
        out = mix(out * _PHI + hashes[i : i + n])
    return np.unique(out)


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: in round j every element offers rank j + r to the j-th slot of its own permutation."""
    best = np.full(slots, float(slots))
    n = len(elements)
    perm, rows, swapped = None, None, None
    for j in range(slots):
        if best.max() <= j:
            break  # every later rank is larger
        z = mix(elements + np.uint64((j + 1) * int(_PHI) & 0xFFFFFFFFFFFFFFFF))
        rank = j + (z >> np.uint64(11)) * 2.0**-53
        pick = (j + mix(z ^ _PHI) % np.uint64(slots - j)).astype(np.intp)
        if j == 0:
            slot = swapped = pick
        else:
            if perm is None:
                perm, rows = np.empty((n, slots), np.uint8 if slots <= 256 else np.uint16), np.arange(n)
                perm[:] = np.arange(slots)
                perm[rows, swapped] = 0
                perm[:, 0] = swapped
            slot = perm[rows, pick].astype(np.intp)
            perm[rows, pick] = perm[:, j]
        np.minimum.at(best, slot, rank)
    return best


def bands_of(signed: np.ndarray, bands: int = BANDS) -> list[int]:
    z = signed.view(np.uint64).reshape(bands, -1)
    out = np.arange(1, bands + 1).astype(np.uint64)
    for i in range(z.shape[1]):
        out = mix(out * _PHI + z[:, i])
    return out.view(np.int64).tolist()


def sketches(docs: DataFrame, width: int = WORDS, bands: int = BANDS, slots: int = SLOTS) -> DataFrame:
    """doc_id, copy_key (equal for equal word sequences), n_shingles, bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                words = words_of(text)
                found = shingle_set(words, width)
                out.append((doc_id, blake2b(b" ".join(words), digest_size=16).digest(), len(found), bands_of(signature(found, slots), bands) if len(found) else []))
            yield pd.DataFrame(out, columns=["doc_id", "copy_key", "n_shingles", "bands"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, "doc_id long, copy_key binary, n_shingles long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. a: the side that recurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def set_of(key: int, text: str) -> np.ndarray:
            if key in recent:
                recent.move_to_end(key)
            else:
                recent[key] = shingle_set(words_of(text), width)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[key]

        for batch in batches:
            linked = []
            for a, b, text_a, text_b in batch[["a", "b", "text_a", "text_b"]].itertuples(index=False, name=None):
                x, y = set_of(a, text_a), set_of(b, text_b)
                if 100 * min(len(x), len(y)) >= similar * max(len(x), len(y)):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * shared >= similar * (len(x) + len(y) - shared):
                        linked.append((a, b))
            yield pd.DataFrame(linked, columns=["a", "b"], dtype="int64")

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    with_both = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return with_both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def block_links(rest: DataFrame, width: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """Links between minors and all members of (bucket, minor_block, all_block), as a forest.

    rest: these keys, class, root, minor (whether the row stands on that side) and text. Classes
    with one root are linked already.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        minors, everyone = group[group["minor"]], group[~group["minor"]]
        sets = [shingle_set(words_of(t), width) for t in everyone["text"].array]
        sizes = np.array([len(x) for x in sets])
        if not len(minors) or not len(sets):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        owner = np.repeat(np.arange(len(sets)), sizes)
        known, place = np.unique(np.concatenate(sets), return_inverse=True)
        names, roots = everyone["class"].to_numpy(), everyone["root"].to_numpy()
        parent = {int(r): int(r) for r in [*roots, *minors["root"]]}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for name, root, text in minors[["class", "root", "text"]].itertuples(index=False, name=None):
            x = shingle_set(words_of(text), width)
            held = np.zeros(len(known), bool)
            at = np.searchsorted(known, x)
            at[at == len(known)] = 0
            held[at[known[at] == x]] = True
            shared = np.bincount(owner[held[place]], minlength=len(sets))
            for i in np.flatnonzero(100 * shared >= similar * (len(x) + sizes - shared)).tolist():
                p, q = find(int(root)), find(int(roots[i]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((name, int(names[i])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rest.groupBy("bucket", "minor_block", "all_block").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, similar: int = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sketched = materialize(sketches(own, width, bands, bands * rows), "sketches")
    classes = materialize(sketched.where("doc_id is not null and n_shingles > 0").groupBy("copy_key").agg(F.min("doc_id").alias("class"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")), "classes")

    dealt = classes.select("class", "n_shingles", F.explode(F.array_distinct("bands")).alias("bucket"))
    # Aggregates are written before they are joined with what they count, so that Spark can split hot buckets:
    # a join that shares its side's shuffle isn't split.
    shared = materialize(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = materialize(dealt.join(shared, "bucket"), "members")
    central = members.groupBy("class").agg(F.sum("n").alias("met"))
    largest = F.max(F.struct("met", F.xxhash64("class"), "class"))["class"].alias("centre")
    centre = materialize(members.join(central, "class").groupBy("bucket").agg(largest), "centre")
    members = materialize(members.join(centre, "bucket"), "members")
    texts = materialize(own.join(members.select(F.col("class").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    pairs = members.where("class <> centre").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
    star = components(materialize(verified(pairs, texts, width, similar), "links"))

    # Buckets of three or more that are in several components yet; equal ones count once.
    named = members.where("n > 2").join(star.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    split = named.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("who")).where("low <> high").groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket")
    rest = materialize(named.join(split, "bucket").select("bucket", "class", "root", "n_shingles"), "rest")
    largest = rest.groupBy("bucket", "root").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max(F.struct("k", "root"))["root"].alias("largest"))
    rest = rest.join(largest, "bucket").withColumn("minor", F.col("root") != F.col("largest"))
    parts = lambda where: F.greatest(F.ceil(F.greatest(F.sum(where.cast("int")) / BLOCK_CLASSES, F.sum(F.when(where, F.col("n_shingles"))) / BLOCK_SHINGLES)), F.lit(1)).cast("int")
    blocks = rest.groupBy("bucket").agg(parts(F.col("minor")).alias("minor_blocks"), parts(F.col("class").isNotNull()).alias("all_blocks"))
    rest = rest.join(blocks, "bucket")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    everyone = rest.select("bucket", "class", "root", F.lit(False).alias("minor"), one("all_blocks").alias("all_block"), each("minor_blocks").alias("minor_block"))
    minors = rest.where("minor").select("bucket", "class", "root", "minor", each("all_blocks").alias("all_block"), one("minor_blocks").alias("minor_block"))
    facing = everyone.unionByName(minors).join(texts.withColumnRenamed("doc_id", "class"), "class")
    more = block_links(facing, width, similar)
    links = components(star.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    grouped = classes.select("copy_key", "class").join(links.select(F.col("node").alias("class"), "root"), "class", "left").select("copy_key", F.coalesce("root", "class").alias("component"))
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("copy_key")).alias("copy_key")).join(grouped, "copy_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of which near_duplicates keeps one a group, with all their columns.

    Of rows with one id and one text, one stays: that with the smallest hash of its columns (maps aside), so reruns agree.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    plain = [F.col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    # The other columns travel by number in one struct, so that no column's name clashes.
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"), F.xxhash64(*plain).alias("place"), rest.alias("rest"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    once = rows.groupBy("own_id", "own_text").agg(F.min_by("rest", "place").alias("rest"))
    back = {id_col: F.col("own_id"), text_col: F.col("own_text")} | {c: F.col(f"rest.c{i}") for i, c in enumerate(others)}
    return once.select(*[back[c].alias(c) for c in docs.columns])


def op7_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))

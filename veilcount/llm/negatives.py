"""Hard negatives by bit-sliced integer products.

Scores are inner products of integer vectors. Components are taken apart into bit-planes, in two's
complement: the planes read so far give a partial product, and what the others can still add lies
between known bounds, (2 ** p - 1) times the sums of the anchor's negative and of its positive
components. Planes are read most significant first: those that can decide nothing yet as one slice,
then two at a time while much is left, then one at a time for the candidates that are left. After
each step a candidate whose interval can't reach the k best any more, or no score window, is dropped.
Scores of those that stay to the last plane are exact.

Anchors meet all rows in blocks of bounded size, dealt by hash: first for their positives, then, with
the positives' windows, for the negatives. A block gives no more rows an anchor than k a window, and
windows of rows by score put the blocks' answers together.

Rows take part that have an id, a label and a vector of the commonest length (of several, the
longest) with no component null, NaN, infinite or of 32,768 and more in size. Rows that repeat count
once. Rows with an anchor's id are neither its positives nor its negatives, and anchors with one id and
other labels or vectors are mined each by itself. An anchor without positives, or without negatives
in a window, has no rows. An empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table
from veilcount.llm.integers import whole

POSITIVES, NEGATIVES = 5, 10
#: Shares of a positive's score, in hundredths, between which negatives lie.
LOW, HIGH = 30, 90
MOST = 1 << 23
#: The least number of row blocks; rows in a block and anchors in a block, at most (about: they are dealt by hash).
LEAST_BLOCKS, ROW_BLOCK, ANCHOR_BLOCK = 16, 131_072, 8192
#: Anchors whose products with a block are in memory at once.
CHUNK = 64
#: Planes left after each slice, and the share of candidates below which planes are read one at a time.
SLICES, FEW = (4, 2, 0), 0.1

#: (least, greatest) that candidates' scores can be, and which of them can still qualify.
Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]


def best(k: int) -> Rule:
    """Those that may be among the k largest."""

    def rule(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(least) <= k:
            return np.ones(len(least), bool)
        return most >= np.partition(least, len(least) - k)[len(least) - k]

    return rule


def best_within(windows: list[tuple[int, int]], k: int) -> Rule:
    """Those that may be among the k largest of a window of scores, ends included."""

    def rule(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.zeros(len(least), bool)
        for low, high in windows:
            may = (most >= low) & (least <= high)
            sure = least[(least >= low) & (most <= high)]
            if len(sure) > k:
                may &= most >= np.partition(sure, len(sure) - k)[len(sure) - k]
            out |= may
        return out

    return rule


def products(anchors: np.ndarray, rows: np.ndarray, others: Callable[[int], np.ndarray], rule: Callable[[int], Rule]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor, rows that stay, their exact products). others(i): the rows that anchor i may have; rule(i): its rule."""
    if not len(rows) or not len(anchors):
        return
    size = rows.shape[1] * int(np.abs(anchors).max(initial=0)) * (int(np.abs(rows).max(initial=0)) + 1)
    kind = np.float32 if size < 1 << 24 else np.float64 if size < 1 << 53 else np.int64
    planes = int(max(rows.max(initial=0), -rows.min(initial=0))).bit_length()
    left = [p for p in SLICES if p < planes] or [0]
    slices = [(rows >> left[0]) << left[0]]  # the sign's plane and all above left[0]
    slices += [((rows >> p) - ((rows >> q) << (q - p))) << p for q, p in zip(left, left[1:], strict=False)]
    slices = [np.ascontiguousarray(s.T.astype(kind)) for s in slices]
    below, above = np.minimum(anchors, 0).sum(axis=1), np.maximum(anchors, 0).sum(axis=1)
    for start in range(0, len(anchors), CHUNK):
        some = range(start, min(start + CHUNK, len(anchors)))
        q = anchors[start : start + CHUNK].astype(kind)
        kept = [others(i) for i in some]
        most = sum(map(len, kept))
        part = np.zeros((len(q), len(rows)), kind)
        p = planes
        for p, of_slice in zip(left, slices, strict=True):
            part += q @ of_slice
            for j, i in enumerate(some):
                x = part[j, kept[j]]
                kept[j] = kept[j][rule(i)(x + below[i] * (2**p - 1), x + above[i] * (2**p - 1))]
            if sum(map(len, kept)) <= FEW * most:
                break
        for j, i in enumerate(some):
            at, x = kept[j], part[j, kept[j]].astype(np.int64)
            for plane in range(p - 1, -1, -1):
                x = x + ((((rows[at] >> plane) & 1) @ anchors[i]) << plane)
                stays = rule(i)(x + below[i] * (2**plane - 1), x + above[i] * (2**plane - 1))
                at, x = at[stays], x[stays]
            yield i, at, x


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties by smaller id."""
    return np.lexsort((ids, -scores))[:k]


def positives_in(rows: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each anchor's label within a block."""
    out = []
    for label, own in anchors.groupby("label"):
        same = rows[rows["label"] == label]
        if same.empty:
            continue
        ids, v = same["vec_id"].to_numpy(), np.vstack(same["v"].to_list()).astype(np.int64)
        names, keys = own["vec_id"].to_numpy(), own["anchor_key"].to_numpy()
        q = np.vstack(own["v"].to_list()).astype(np.int64)
        for i, at, x in products(q, v, lambda i, ids=ids, names=names: np.flatnonzero(ids != names[i]), lambda i: best(k)):
            for j in first(ids[at], x, k).tolist():
                out.append((names[i], keys[i], ids[at[j]], x[j]))
    return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "vec_id", "score"], dtype="int64")


def bounds(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The scores x with low * score <= 100 * x <= high * score."""
    return -(-low * score // 100), high * score // 100


def negatives_in(rows: pd.DataFrame, anchors: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """The k best rows of other labels within a block, for each window of an anchor."""
    out = []
    if rows.empty or anchors.empty:
        return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "vec_id", "score"], dtype="int64")
    ids, labels, v = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), np.vstack(rows["v"].to_list()).astype(np.int64)
    names, keys, own = (anchors[c].to_numpy() for c in ("vec_id", "anchor_key", "label"))
    windows = [[bounds(s, low, high) for s in dict.fromkeys(map(int, p))] for p in anchors["scores"]]
    q = np.vstack(anchors["v"].to_list()).astype(np.int64)
    others = lambda i: np.flatnonzero((labels != own[i]) & (ids != names[i]))
    for i, at, x in products(q, v, others, lambda i: best_within(windows[i], k)):
        taken = set()
        for a, b in windows[i]:
            inside = np.flatnonzero((x >= a) & (x <= b))
            taken.update(inside[first(ids[at[inside]], x[inside], k)].tolist())
        out += [(names[i], keys[i], ids[at[j]], x[j]) for j in taken]
    return pd.DataFrame(out, columns=["anchor_id", "anchor_key", "vec_id", "score"], dtype="int64")


FOUND = "anchor_id long, anchor_key long, vec_id long, score long"


def in_blocks(rows: DataFrame, anchors: DataFrame, sizes: tuple[int, int], run: Callable) -> DataFrame:
    """run(rows, anchors) for each block of rows and block of anchors. sizes: how many blocks of each."""
    row_blocks, anchor_blocks = sizes
    block = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", block(row_blocks).alias("row_block"), each(anchor_blocks).alias("anchor_block"))
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns of their own, not those of rows
    right = own.select("*", block(anchor_blocks).alias("anchor_block"), each(row_blocks).alias("row_block"))
    keys = ["row_block", "anchor_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, FOUND)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. is_anchor: of vec_id."""
    sound, v = whole(vector_col, 1, MOST)
    own = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    own = own.where("vec_id is not null and label is not null")
    rows = materialize(own.dropDuplicates(["vec_id", "label", "v"]), "labelled")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.count(F.when(is_anchor, 1)).alias("anchors"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = rows.where(F.size("v") == common["n"])
    sizes = max(LEAST_BLOCKS, -(-common["rows"] // ROW_BLOCK)), max(1, -(-common["anchors"] // ANCHOR_BLOCK))
    anchors = rows.where(is_anchor).withColumn("anchor_key", F.xxhash64("label", "v"))
    anchor = ["anchor_id", "anchor_key"]

    near = in_blocks(rows, anchors, sizes, lambda r, a: positives_in(r, a, positives))
    place = F.row_number().over(Window.partitionBy(*anchor).orderBy(F.desc("score"), "vec_id"))
    near = materialize(near.withColumn("place", place).where(F.col("place") <= positives), "positives")
    scores = near.groupBy(*anchor).agg(F.collect_list("score").alias("scores"))  # as many as positives
    waiting = anchors.withColumnRenamed("vec_id", "anchor_id").join(scores, anchor).withColumnRenamed("anchor_id", "vec_id")

    far = in_blocks(rows, waiting, sizes, lambda r, a: negatives_in(r, a, negatives, low, high))
    far = far.select(*anchor, F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = far.join(near.select(*anchor, "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), anchor)
    n, p = F.col("negative_score") * 100, F.col("positive_score")
    rank = F.row_number().over(Window.partitionBy(*anchor, "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = pairs.where((p * low <= n) & (n <= p * high)).withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)

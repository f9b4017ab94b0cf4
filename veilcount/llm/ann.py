"""Approximate nearest neighbours by balanced posting lists.

Vectors are dealt to lists around centroids that a balanced two-level k-means fits on a bounded
sample. A vector near a boundary goes to every list within a ratio of its nearest one's distance. The
centroids are searched through an in-memory neighbour graph, and a query reads the lists within a
ratio of the distance at which its nearest lists hold some candidates. No number of lists is fixed: a
beam that lies within the ratio to its end widens. Scores are inner products of the original vectors in
double precision.

Adjacent lists stand on one shelf. A vector goes once to each shelf that holds one of its lists, and a query
once to each from which it reads; there they meet list by list, in blocks of bounded size, however large a
list is. Queries first meet the shelf of their nearest list. Its best scores are a bound on what the other
shelves return.

The read ratio is calibrated in every run: a bounded number of queries, chosen by hash, meets all
vectors outright, and the ratio is the one at which their lists hold the wanted share of their true
neighbours. So recall is measured against brute force on the table itself.

Nearness is the largest inner product: vectors get one more component that makes all lengths equal,
so the nearest in the routing space is the largest product. Equal vectors count as one class whose
smallest ids stand for it, so copies cost no comparisons.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those of
another than the commonest length, or with a null id. Repeated rows count once. A query with fewer
candidates gets all that are found. An empty table gives no rows. Columns other than the two named
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table

#: Lists are this many times the square root of the vectors, so that their number and size grow alike.
LISTS_PER_ROOT = 1.75
#: Centroids go to every task, and the sample (so many vectors a list, or the least) to the driver:
#: beyond 87 million vectors lists grow in proportion to the table.
MOST_LISTS, SAMPLED, LEAST_SAMPLE = 16_384, 16, 20_000
#: A vector is copied to lists within this ratio of its nearest distance.
COPY_RATIO = 1.02
#: A query's ratio refers to the distance at which its nearest lists hold so many times k vectors.
FLOOR = 32
#: Queries that calibrate the read ratio, and the share of their true neighbours that their lists hold.
CALIBRATING, WANTED_RECALL = 128, 0.97
#: A shelf's lists hold about so many vectors without their copies; shelves number so many at least.
SHELF_ROWS, LEAST_SHELVES = 8192, 48
#: Vectors of a shelf, and queries, that meet in one task; and of a list, in one matrix product.
HELD_ROWS, READ_ROWS, HELD_BLOCK, READ_BLOCK = 32_768, 16_384, 4096, 512
#: A centroid's neighbours, a beam's width, and how many of a beam ask for their neighbours at once.
NEIGHBOURS, BEAM, ASKED = 24, 64, 8


Lists = Iterator[tuple[int, list[int]]]


class CentroidGraph:
    """Centroids with a neighbour graph; searched best-first from spread entry points, many vectors at once."""

    def __init__(self, centroids: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BEAM):
        self.at = centroids.astype(np.float32)
        self.norm = (self.at**2).sum(axis=1)
        k = len(centroids)
        self.beam = min(beam, k)
        r = min(neighbours, k - 1)
        self.links = np.zeros((k, max(r, 0)), np.int32)
        for s in range(0, k if r else 0, 1024):
            d = self.norm[None, :] - 2 * self.at[s : s + 1024] @ self.at.T
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            near = np.argpartition(d, r - 1, axis=1)[:, :r]
            self.links[s : s + 1024] = near
        if r > 2:  # long links from a fixed shuffle keep the graph connected
            self.links[:, -2] = np.roll(np.arange(k), 1)
            self.links[:, -1] = np.roll(np.arange(k), max(1, k // 2))
        self.entries = np.unique(np.linspace(0, k - 1, min(k, self.beam)).astype(np.int32))

    def search(self, x: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the beam of each row of x, nearest first."""
        beam = beam or self.beam
        x = x.astype(np.float32)
        own = (x**2).sum(axis=1)[:, None]
        if beam >= len(self.at):  # as wide as the graph: outright
            dist = own + self.norm[None, :] - 2 * x @ self.at.T
            order = np.argsort(dist, axis=1, kind="stable")
            return order.astype(np.int32), np.maximum(np.take_along_axis(dist, order, 1), 0)
        n, k = len(x), len(self.at)
        found, found_at = np.zeros((n, beam), np.int32), np.full((n, beam), np.inf, np.float32)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        dist = own + self.norm[ids] - 2 * x @ self.at[self.entries].T
        done, seen, live = np.zeros(ids.shape, bool), np.zeros((n, k), bool), np.arange(n)
        seen[:, self.entries] = True
        while len(live):
            rows, w = np.arange(len(live))[:, None], ids.shape[1]
            waiting = np.where(done, np.inf, dist)
            best = np.argpartition(waiting, min(ASKED, w) - 1, axis=1)[:, : min(ASKED, w)]
            over = np.isinf(waiting[rows, best]).all(axis=1) | (not self.links.shape[1])
            if over.any():  # all of the beam is searched
                found[live[over], : min(w, beam)], found_at[live[over], : min(w, beam)] = ids[over][:, :beam], dist[over][:, :beam]
                live, ids, dist, done, best = live[~over], ids[~over], dist[~over], done[~over], best[~over]
                rows = np.arange(len(live))[:, None]
                if not len(live):
                    break
            done[rows, best] = True
            near = self.links[ids[rows, best]].reshape(len(live), -1)
            row, col = np.nonzero(~seen[live[:, None], near])
            keys = np.sort(row * k + near[row, col])
            row, new = np.divmod(keys[np.diff(keys, prepend=-1) > 0], k)  # each once
            seen[live[row], new] = True
            at = np.arange(len(row)) - np.searchsorted(row, row)
            more = (len(live), int(at.max(initial=-1)) + 1)
            new_ids, new_dist = np.zeros(more, np.int32), np.full(more, np.inf, np.float32)
            new_ids[row, at] = new
            new_dist[row, at] = own[live[row], 0] + self.norm[new] - 2 * np.einsum("nd,nd->n", x[live[row]], self.at[new])
            ids, dist = np.hstack([ids, new_ids]), np.hstack([dist, new_dist])
            done = np.hstack([done, np.isinf(new_dist)])
            if dist.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
        order = np.argsort(found_at, axis=1, kind="stable")
        return np.take_along_axis(found, order, 1), np.maximum(np.take_along_axis(found_at, order, 1), 0)

    def within(self, x: np.ndarray, ratio: float, sizes: np.ndarray | None = None, floor: int = 0) -> Lists:
        """(row, its lists within the ratio), nearest first. The ratio is to the nearest list's distance or,
        with sizes, to that of the list at which the nearest lists hold `floor` vectors."""
        waiting, beam = np.arange(len(x)), self.beam
        while len(waiting):
            lists, far = self.search(x[waiting], beam)
            base, reached = self.base(lists, far, sizes, floor)
            line = ratio**2 * base[:, None] + 1e-9
            # A beam that is within to its end may have left out others: it widens.
            wider = ((far[:, -1:] <= line)[:, 0] | ~reached) & (lists.shape[1] < len(self.at))
            ends = (far <= line).sum(axis=1)
            for i in np.flatnonzero(~wider).tolist():
                yield int(waiting[i]), lists[i, : ends[i]].tolist()
            # A walk meets about as many centroids as its beam has neighbours: with all of them it is no shorter way.
            waiting, beam = waiting[wider], 2 * beam if 2 * beam * self.links.shape[1] < len(self.at) else len(self.at)

    @staticmethod
    def base(lists: np.ndarray, far: np.ndarray, sizes: np.ndarray | None, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The squared distance that ratios refer to, by row, and whether the lists reach the floor."""
        if sizes is None:
            return far[:, 0], np.ones(len(far), bool)
        held = np.cumsum(sizes[lists], axis=1) >= floor
        reached = held[:, -1]
        at = np.where(reached, held.argmax(axis=1), far.shape[1] - 1)
        return far[np.arange(len(far)), at], reached


def _k_means(sample: np.ndarray, lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced: a list's distance grows with what it holds already, so hot regions get more lists."""
    lists = max(1, min(lists, len(sample)))
    at = sample[rng.choice(len(sample), lists, replace=False)].copy()
    fair = len(sample) / lists
    size = np.full(lists, fair)
    for _ in range(rounds):
        own, scale = np.empty(len(sample), np.int64), 0.0
        for s in range(0, len(sample), 4096):
            d = (at**2).sum(axis=1)[None, :] - 2 * sample[s : s + 4096] @ at.T
            scale = scale or float(d.std())
            own[s : s + 4096] = np.argmin(d + 0.1 * scale * (size / fair - 1), axis=1)
        size = np.bincount(own, minlength=lists).astype(float)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(size > 0)
        starts = (np.cumsum(size) - size).astype(np.int64)[full]
        at[full] = np.add.reduceat(sample[order], starts, axis=0) / size[full, None]
        empty = np.flatnonzero(size == 0)
        at[empty] = sample[rng.choice(len(sample), len(empty))]
    return at


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Two levels beyond 512 lists: regions first, then the lists of each in proportion to what it holds."""
    rng = np.random.default_rng(seed)
    if lists <= 512:
        return _k_means(sample, lists, rounds, rng)
    top = _k_means(sample, round(math.sqrt(lists)), rounds, rng)
    own = np.concatenate(
        [np.argmin((top**2).sum(axis=1)[None, :] - 2 * sample[s : s + 4096] @ top.T, axis=1) for s in range(0, len(sample), 4096)]
    )
    each = np.bincount(own, minlength=len(top))
    parts = [_k_means(sample[own == i], max(1, round(lists * n / len(sample))), rounds, rng) for i, n in enumerate(each) if n]
    return np.concatenate(parts)


def shelved(centroids: np.ndarray, shelves: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """A shelf for each list: near centroids share one."""
    at = _k_means(centroids, shelves, rounds, np.random.default_rng(seed))
    near = [
        np.argmin((at**2).sum(axis=1)[None, :] - 2 * centroids[s : s + 4096] @ at.T, axis=1) for s in range(0, len(centroids), 4096)
    ]
    return np.concatenate(near)


def _matrix(column: pd.Series) -> np.ndarray:
    """Vectors as doubles, a row each, from their bytes."""
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def best_products(x: np.ndarray, queries: np.ndarray, y: np.ndarray, names: np.ndarray, keep: int) -> pd.DataFrame:
    """Each query's best candidates, by exact products; equal scores by the smaller name. names: ascending."""
    reads, holds = ((np.zeros(n, np.int64), np.arange(n)) for n in (len(x), len(y)))
    return best_in_lists(x, queries, reads, y, names, holds, keep)


def best_in_lists(
    x: np.ndarray, queries: np.ndarray, reads: tuple[np.ndarray, np.ndarray],
    y: np.ndarray, names: np.ndarray, holds: tuple[np.ndarray, np.ndarray], keep: int, bounds: np.ndarray | None = None,
) -> pd.DataFrame:
    """Each query's best candidates in the lists that it reads, by exact products; equal scores by the smaller name.

    reads, holds: (list, row of x or of y) of what a list is read by and holds. names: ascending. bounds: scores
    below which a query's candidates aren't wanted.
    """
    bound = np.full(len(x), -np.inf) if bounds is None else bounds.copy()
    # A product's rounding, twice over, whatever the order of its sum.
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x**2).sum(axis=1)) * np.sqrt((y**2).sum(axis=1).max())
    parts, waiting = [], 0

    def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of what was found so far, each once; a full set raises its query's bound."""
        row, col, exact = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((col, -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1])  # a pair has one score, so it stands side by side
        row, col, exact = row[once], col[once], exact[once]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == keep - 1
        bound[row[last]] = np.maximum(bound[row[last]], exact[last])
        best = place < keep
        return row[best], col[best], exact[best]

    def by_list(lists: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
        names, sizes = np.unique(lists, return_counts=True)
        each = np.split(rows[np.argsort(lists, kind="stable")], np.cumsum(sizes)[:-1])
        return dict(zip(names.tolist(), each, strict=True))

    members = by_list(*holds)
    for at, readers in by_list(*reads).items():
        held = members.get(at, ())
        for h in range(0, len(held), HELD_BLOCK):
            those = held[h : h + HELD_BLOCK]
            block = y[those].T
            for s in range(0, len(readers), READ_BLOCK):
                asking = readers[s : s + READ_BLOCK]
                rough = x[asking] @ block
                new = np.flatnonzero(np.isneginf(bound[asking]))
                if len(new) and len(those) >= keep:
                    line = np.partition(rough[new], len(those) - keep, axis=1)[:, len(those) - keep]
                    bound[asking[new]] = line - slack[asking[new]]
                row, col = np.nonzero(rough >= (bound[asking] - slack[asking])[:, None])
                row, col = asking[row], those[col]
                parts.append((row, col, (x[row] * y[col]).sum(axis=1)))
                waiting += len(row)
                if waiting > max(4 * keep * len(x), 1 << 20):
                    parts = [settled()]
                    waiting = 0
    row, col, exact = settled() if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pd.DataFrame({"query": queries[row], "class": names[col], "score": exact})


class Router:
    """The graph with the space that it works in: all stored vectors get the length of the longest."""

    def __init__(self, centroids: np.ndarray, longest: float, shelves: int = 1):
        self.graph, self.longest, self.sizes, self.floor = CentroidGraph(centroids), longest, None, 0
        self.shelf = shelved(centroids, min(shelves, len(centroids))).tolist()

    @staticmethod
    def routed(x: np.ndarray, longest: float) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(longest - (x**2).sum(axis=1, keepdims=True), 0))])

    def homes(self, x: np.ndarray, ratio: float) -> Lists:
        return self.graph.within(self.routed(x, self.longest), ratio)

    def asked(self, x: np.ndarray) -> np.ndarray:
        unit = x * (np.sqrt(self.longest) / np.sqrt((x**2).sum(axis=1, keepdims=True)))
        return np.hstack([unit, np.zeros((len(x), 1))])

    def reads(self, x: np.ndarray, ratio: float) -> Lists:
        return self.graph.within(self.asked(x), ratio, self.sizes, self.floor)

    def by_shelf(self, lists: list[int]) -> list[list[int]]:
        """For each shelf of these lists, in their order: itself, then the lists that stand on it."""
        shelves: dict[int, list[int]] = {}
        for at in lists:
            shelves.setdefault(self.shelf[at], [self.shelf[at]]).append(at)
        return list(shelves.values())

    def needed(self, x: np.ndarray, neighbours: np.ndarray, owner: np.ndarray, copy_ratio: float) -> np.ndarray:
        """For each neighbour of x[owner]: the ratio at which the query reads one of its lists."""
        lists, far = self.graph.search(self.asked(x), len(self.graph.at))
        base, _ = self.graph.base(lists, far, self.sizes, self.floor)
        ratios = np.empty_like(far)
        np.put_along_axis(ratios, lists.astype(np.int64), np.sqrt((far + 1e-12) / (base[:, None] + 1e-12)), 1)
        out = np.empty(len(neighbours))
        for row, homes in self.homes(neighbours, copy_ratio):
            out[row] = ratios[owner[row], homes].min()
        return out


def valid_vectors(vectors: DataFrame, is_query, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows that take part and those of them that ask; None where there are none.

    vec_id, v (the bytes of its doubles, zeros without a sign), norm (squared).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["v"].str.len() > 0]
            if not len(batch):
                continue
            size = batch["v"].str.len().to_numpy(np.int64)
            flat, starts = np.concatenate(batch["v"].to_list()).astype(np.float64) + 0.0, np.cumsum(size) - size
            # A null component arrives as NaN.
            ok = np.logical_and.reduceat(np.isfinite(flat), starts) & np.logical_or.reduceat(flat != 0, starts)
            norm = np.add.reduceat(np.square(flat, where=np.isfinite(flat), out=np.zeros_like(flat)), starts)
            v = [flat[s : s + n].tobytes() for s, n in zip(starts.tolist(), size.tolist(), strict=True)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": v, "norm": norm, "d": size})[ok]

    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and v is not null")
    kind = "vec_id long, v binary, norm double, d long"
    valid = materialize(v.mapInPandas(run, kind), "vectors")
    length = valid.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not length:
        return None
    return tuple(df.where(F.col("d") == length[0]["d"]).drop("d") for df in (valid, v.where(is_query).mapInPandas(run, kind)))


def classes_of(v: DataFrame, k: int) -> DataFrame:
    """Classes of equal vectors, each with its k + 1 smallest ids (a query's own may be among them)."""
    salted = Window.partitionBy("v", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    whole = Window.partitionBy("v").orderBy("vec_id")
    few = v.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).where(F.col("n") <= k + 1)
    ids = F.array_sort(F.collect_list("vec_id")).alias("ids")
    return materialize(few.groupBy("v").agg(F.min("vec_id").alias("class"), ids, F.max("norm").alias("norm")), "classes")


def true_neighbours(classes: DataFrame, asking: pd.DataFrame, k: int) -> pd.DataFrame:
    """query, class, v: the k best classes of a few queries (class, v), which meet all classes outright."""
    x, names = _matrix(asking["v"]), asking["class"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"query": [], "class": [], "score": []}).astype({"query": "int64", "class": "int64"})
        held = {}
        for batch in batches:
            if len(batch):
                batch = batch.sort_values("class", kind="stable")
                found = best_products(x, names, _matrix(batch["v"]), batch["class"].to_numpy(), k + 1)
                found = found[found["query"] != found["class"]]
                best = pd.concat([best, found]).sort_values(["query", "score", "class"], ascending=[True, False, True])
                best = best.groupby("query").head(k)
                held |= dict(zip(batch["class"].to_list(), batch["v"].to_list(), strict=True))
                held = {c: held[c] for c in best["class"].unique().tolist()}
        yield best.assign(v=best["class"].map(held))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    found = classes.select("class", "v").mapInPandas(run, "query long, class long, score double, v binary")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    return found.select("query", "class", "v").toPandas()  # k rows a query


def calibrated_ratio(router: Router, classes: DataFrame, asking: DataFrame, k: int, calibrating: int, wanted: float) -> float:
    """The read ratio at which some queries' lists hold the wanted share of their true neighbours."""
    chosen = asking.orderBy(F.xxhash64("class"), "class").limit(calibrating).toPandas()  # a fixed number of rows
    if not len(chosen):
        return 1.0
    true = true_neighbours(classes, chosen, k)
    if not len(true):
        return 1.0
    # Names are unique, so each neighbour finds its query's row.
    owner = pd.Index(chosen["class"]).get_indexer(true["query"])
    ratios = router.needed(_matrix(chosen["v"]), _matrix(true["v"]), owner, COPY_RATIO)
    return max(1.0, float(np.quantile(ratios, wanted, method="higher")) * (1 + 1e-6))


def search(
    vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    read_ratio: float | None = None, wanted_recall: float = WANTED_RECALL, figures: dict | None = None,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds, against all rows.

    read_ratio: calibrated if None. figures, if given, gets the numbers of lists, copies and reads.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, is_query, id_col, vector_col)
    if valid is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    v, asked = valid
    classes = classes_of(v, k)
    n, longest = classes.agg(F.count("*"), F.max("norm")).first()

    # Fit on a bounded sample, spread by hash; all of it if there is no more.
    n_lists = min(MOST_LISTS, math.ceil(LISTS_PER_ROOT * math.sqrt(n)))
    few = classes.orderBy(F.xxhash64("class")).limit(max(LEAST_SAMPLE, SAMPLED * n_lists))
    sample = Router.routed(_matrix(few.select("v").toPandas()["v"]), longest).astype(np.float32)
    shelves = max(LEAST_SHELVES, math.ceil(n / SHELF_ROWS))
    router = Router(fit_centroids(sample, n_lists), longest, shelves)

    asked = asked.select(F.col("vec_id").alias("query_id"), "v").distinct()
    queries = materialize(asked.join(classes.select("v", "class"), "v").select("query_id", "class"), "queries")
    asking = classes.join(queries.select("class").distinct(), "class", "left_semi").select("class", "v")

    def deal(rows: DataFrame, ratio: float, query: bool) -> DataFrame:
        """Each vector with the lists that hold it, or that a query reads, by shelf; the nearest list's shelf first."""
        sent = spark.sparkContext.broadcast(router)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            route = sent.value.reads if query else sent.value.homes
            for batch in batches:
                for s in range(0, len(batch), 512):
                    part = batch.iloc[s : s + 512]
                    found = dict(route(_matrix(part["v"]), ratio))
                    yield part.assign(shelves=[sent.value.by_shelf(found[i]) for i in range(len(part))])

        return rows.select("class", "v").mapInPandas(run, "class long, v binary, shelves array<array<int>>")

    def on_shelves(dealt: DataFrame, *more: str) -> DataFrame:
        """A row for each vector and shelf."""
        rows = dealt.select("class", "v", *more, F.explode("shelves").alias("at"))
        return rows.select(F.col("at")[0].alias("shelf"), F.expr("slice(at, 2, size(at) - 1)").alias("lists"), "class", "v", *more)

    def lists_of(dealt: DataFrame) -> DataFrame:
        return on_shelves(dealt).select(F.explode("lists").alias("list"))

    held = materialize(deal(classes, COPY_RATIO, False), "postings")
    router.sizes, router.floor = np.zeros(len(router.graph.at), np.int64), FLOOR * k
    for r in lists_of(held).groupBy("list").count().collect():  # as many rows as lists
        router.sizes[r["list"]] = r["count"]
    if read_ratio is None:
        read_ratio = calibrated_ratio(router, classes, asking, k, CALIBRATING, wanted_recall)
    reads = materialize(deal(asking, read_ratio, True), "reads")
    if figures is not None:
        figures |= {"classes": n, "lists": len(router.graph.at), "read_ratio": read_ratio}
        figures |= {"postings": lists_of(held).count(), "queries": asking.count(), "reads": lists_of(reads).count()}
        figures |= {"shelves_read": on_shelves(reads).count()}

    # A shelf's blocks and its queries' blocks; the counts are as many as shelves.
    def parts(dealt: DataFrame, rows: int, name: str) -> DataFrame:
        return on_shelves(dealt).groupBy("shelf").agg(F.ceil(F.count("*") / rows).alias(name))

    def spread(df: DataFrame, blocks: DataFrame, own: str, other: str, seed: int) -> DataFrame:
        placed = F.pmod(F.xxhash64(F.lit(seed), "class"), F.col(own + "s")).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.col(other + "s").cast("int") - 1))
        return df.join(blocks, "shelf").withColumn(own, placed).withColumn(other, met).drop("held_blocks", "read_blocks")

    def lists_in(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(list, row) of each list of each row."""
        return np.concatenate(column.to_list()), np.repeat(np.arange(len(column)), column.str.len())

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """Each query's best candidates of one block."""
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "class": [], "score": []}).astype({"query": "int64", "class": "int64"})
        c = c.sort_values("class", kind="stable")
        asks = _matrix(q["v"]), q["class"].to_numpy(), lists_in(q["lists"])
        has = _matrix(c["v"]), c["class"].to_numpy(), lists_in(c["lists"])
        return best_in_lists(*asks, *has, k + 1, q["bound"].to_numpy(np.float64))

    def meet(reading: DataFrame) -> DataFrame:
        """What queries find on shelves; reading: class, v, shelves, bound."""
        blocks = F.broadcast(parts(held, HELD_ROWS, "held_blocks").join(parts(reading, READ_ROWS, "read_blocks"), "shelf"))
        keys = ["shelf", "held_block", "read_block"]
        left = spread(on_shelves(reading, "bound"), blocks, "read_block", "held_block", 1).groupBy(*keys)
        right = spread(on_shelves(held), blocks, "held_block", "read_block", 2).groupBy(*keys)
        return left.cogroup(right).applyInPandas(score, "query long, class long, score double")

    nearest = reads.withColumns({"shelves": F.slice("shelves", 1, 1), "bound": F.lit(-math.inf)})
    first = materialize(meet(nearest), "nearest")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    bounds = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1)
    others = reads.where(F.size("shelves") > 1).join(bounds.select(F.col("query").alias("class"), "score"), "class", "left")
    rest, bound = F.expr("slice(shelves, 2, size(shelves) - 1)"), F.coalesce("score", F.lit(-math.inf))
    others = materialize(others.withColumns({"shelves": rest, "bound": bound}).drop("score"), "others")
    found = first.unionByName(meet(others))
    near = found.groupBy("query", "class").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(by_score))
    near = near.where(F.col("n") <= k + 1).drop("n")
    expanded = near.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = expanded.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).drop("n")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.join(ranked, F.col("class") == F.col("query")).where("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

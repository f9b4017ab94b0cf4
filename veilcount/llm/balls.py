"""Ball k-means on integer vectors.

A cluster is a ball: its centroid and the distance to its farthest member. Only clusters whose
centroid is nearer than twice that radius are neighbours. A member within half the distance to the
nearest neighbour is in the stable core and stays, without a comparison; the others lie in annuli
between half the distances to one neighbour and the next, and each annulus is compared exactly with
the neighbours up to its own. The triangle inequality makes this exact: results are those of Lloyd's
algorithm with the same start, in integer arithmetic throughout.

Balls are drawn around the members of a cluster within a batch of a task, which makes them smaller
than those of whole clusters, so a round is one pass without a shuffle of vectors: each task reads
vectors with the cluster that they were in, writes them with the one that they are in now, and one
row a cluster with sums. The driver sees k x components sums. Rounds are tables in the shared folder,
so lost executors cost a task each.

Vectors take part if they have the wanted number of components, none null, NaN, infinite or of
262,144 and more in size (squared distances stay within a long). Repeated rows and null ids take
part each by itself; the decimal of a null id is "null". Fewer vectors than k start as many
clusters. A centroid without members stays where it is. An empty table gives no rows. Columns other
than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table
from veilcount.llm.integers import whole

CLUSTERS, ROUNDS, COMPONENTS, SEED = 40, 5, 64, "2"
MOST = 1 << 26
ROUND = "vec_id long, v array<int>, cluster int, distance long, n long, sums array<long>"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    size = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    kind = np.float64 if 4 * x.shape[1] * int(size) ** 2 < 1 << 53 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, ties to the smaller number."""
    d = squared(x, centroids)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def moved(x: np.ndarray, was: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """nearest(), knowing each row's last cluster; and how many distances were worked out. between: squared, of centroids."""
    gap = x - centroids[was]
    own = np.einsum("nd,nd->n", gap, gap)
    cluster, distance, worked = was.copy(), own.copy(), len(x)
    for i in np.unique(was).tolist():
        rows = np.flatnonzero(was == i)
        reach = 4 * own[rows]
        order = np.argsort(between[i], kind="stable")
        order = order[order != i]
        neighbours = order[between[i][order] <= reach.max()]  # half the way there is within the ball
        edges = between[i][neighbours]
        ring = np.searchsorted(edges, reach, side="right")  # 0: the stable core
        for m in np.unique(ring[ring > 0]).tolist():
            annulus = rows[ring == m]
            against = np.sort(np.append(neighbours[:m], i))
            best, d = nearest(x[annulus], centroids[against])
            cluster[annulus], distance[annulus] = against[best], d
            worked += m * len(annulus)
    return cluster, distance, worked


def assigned(vectors: DataFrame, centroids: np.ndarray, first: bool) -> DataFrame:
    """ROUND: each vector with its cluster; and of each task and cluster, a row with the number and sum of its vectors."""
    between = squared(centroids, centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.empty:
                continue
            x = np.vstack(batch["v"].to_list()).astype(np.int64)
            if first:
                cluster, distance = nearest(x, centroids)
            else:
                cluster, distance, _ = moved(x, batch["cluster"].to_numpy(np.int64), centroids, between)
            for i in np.unique(cluster).tolist():
                rows = x[cluster == i]
                sums[i] += rows.sum(axis=0)
                n[i] += len(rows)
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": batch["v"], "cluster": cluster, "distance": distance, "n": None, "sums": None})
        held = np.flatnonzero(n)
        yield pd.DataFrame({"vec_id": None, "v": None, "cluster": held, "distance": None, "n": n[held], "sums": list(sums[held])})

    return vectors.mapInPandas(run, ROUND)


def updated(done: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors as their floored mean; k x components sums reach the driver."""
    parts = done.where("sums is not null").select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(total("n"), total("part")).collect():
        out[r["cluster"], r["at"]] = int(r["part"]) // int(r["n"])
    return out


def ball_k_means(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, seed: str = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """OUT: each vector that takes part with its cluster, its squared distance, and its cluster's figures."""
    sound, v = whole(vector_col, components, MOST)
    kept = vectors.where(sound & (F.size(vector_col) == components))
    kept = materialize(kept.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")), "vectors")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    start = kept.orderBy(place, "v").limit(k).collect()  # k rows
    spark = vectors.sparkSession
    if not start:
        return spark.createDataFrame([], OUT)
    centroids = np.array([r["v"] for r in start], np.int64)
    done = kept
    for i in range(rounds):
        done = materialize(assigned(done.where("v is not null"), centroids, i == 0), "round")
        centroids = updated(done, centroids)
    last = materialize(assigned(done.where("v is not null"), centroids, rounds == 0).where("v is not null").select("vec_id", "cluster", "distance"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    figures = [(i, d, sum(inertia.values()), sha[i]) for i, d in inertia.items()]
    of_cluster = F.broadcast(spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return last.join(of_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_balls(spark, sf_dir):
    return ball_k_means(table(spark, sf_dir, "embeddings"))

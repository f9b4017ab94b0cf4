"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize


def local_forest(links: DataFrame) -> DataFrame:
    """Union-find over the links of each task: the same components with one link a node at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = up
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
            if len(parent) > 1_000_000:  # bounded memory: what is known leaves as links
                yield pd.DataFrame([(x, r) for x in list(parent) if (r := find(x)) != x], columns=["a", "b"], dtype="int64")
                parent.clear()
        yield pd.DataFrame([(x, r) for x in list(parent) if (r := find(x)) != x], columns=["a", "b"], dtype="int64")

    return links.select("a", "b").mapInPandas(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """node, root: each linked node with the smallest node that it reaches.

    Alternates the large-star and small-star steps; the longest path shrinks geometrically. Rounds
    are written to the shared folder; only a count and a checksum come to the driver.
    """
    edges = materialize(local_forest(links).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "forest")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b")
        edges = materialize(small.distinct(), "star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

"""Figures of the whole corpus for the keys that each chunk of it holds.

A chunk of documents sends each of its distinct keys (64-bit hashes) once, with its own figures, in
sorted slices of the key space, those that hold any of its keys. Each slice combines the figures of all chunks and answers every
chunk, whose documents (its body, cut once more from the same shuffle, as that is less to store than
to carry) meet the answers. So a key travels once a chunk, however often it occurs, nothing is
gathered on the driver, and what a task holds is bounded by the chunk's and the slice's size: there
are more of both in a larger corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text for one slice of the key space and for a partition of documents, and the most words in a chunk.
SLICE_BYTES, PART_BYTES, CHUNK_WORDS = 8 << 20, 14 << 20, 4_000_000

ASKED = "chunk long, slice int, keys binary, figures binary"
ANSWERED = "chunk long, slice int, figures binary, body binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pack(a: np.ndarray) -> bytes:
    """Compressed, first bytes of all numbers first: sorted and small numbers leave few."""
    a = np.ascontiguousarray(a)
    return zlib.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(data: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def named(seed: int, body: bytes) -> int:
    """A chunk's name. It tells the content, so one that is cut otherwise when its task runs again is found out."""
    return xxhash.xxh64_intdigest(body, seed) >> 1


def ask(chunk: int, keys: np.ndarray, figures: np.ndarray, slices: int) -> pd.DataFrame:
    """A chunk's sorted keys with a column of figures each, by slice: a row for each slice that holds any."""
    of = (keys >> np.uint64(40)) * np.uint64(slices) >> np.uint64(24)
    held, starts = np.unique(of, return_index=True)
    ends = np.append(starts[1:], len(keys))
    steps = lambda k: np.diff(k, prepend=np.uint64(0))
    return pd.DataFrame([(chunk, s, pack(steps(keys[a:b])), pack(figures[:, a:b].ravel())) for s, a, b in zip(held.astype(np.int64).tolist(), starts, ends, strict=True)], columns=["chunk", "slice", "keys", "figures"])


def _distinct(rows: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a slice's distinct keys, each figure's key number, figures, where each row's figures end)."""
    keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    figures = np.hstack([unpack(f).reshape(width, -1) for f in rows["figures"]])
    return distinct, number, figures, np.cumsum([0, *map(len, keys)])


def answer(asked: DataFrame, width: int, combine: Callable) -> DataFrame:
    """combine(distinct keys, each figure's key number, figures) gives figures for the distinct keys."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        distinct, number, figures, ends = _distinct(rows, width)
        found = combine(distinct, number, figures)
        out = [pack(found[:, number[a:b]].ravel()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "slice": rows["slice"].to_numpy(), "figures": out, "body": None})

    return asked.groupBy("slice").applyInPandas(run, ANSWERED)


def totals(asked: DataFrame, width: int, count: Callable, names: list[str]) -> Column:
    """The sums over all slices of count(distinct keys, each figure's key number, figures), as a struct of longs.

    It reads the same shuffle as answer() does within one query.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        distinct, number, figures, _ = _distinct(rows, width)
        return pd.DataFrame([count(distinct, number, figures)], columns=names)

    each = asked.groupBy("slice").applyInPandas(run, ", ".join(f"{n} long" for n in names))
    return each.agg(F.struct(*[F.sum(n).alias(n) for n in names]).alias("totals")).scalar()


def meet(answered: DataFrame, bodies: DataFrame, width: int, finish: Callable, schema: str, extra: Column | None = None) -> DataFrame:
    """finish(body, figures of the chunk's sorted keys, totals) for each chunk. bodies: chunk, body; extra: totals.

    A chunk's body knows how many keys it has; finish must refuse other than as many figures: the chunk was cut
    otherwise when its task ran again.
    """
    kept = F.lit(None).cast("struct<none:long>") if extra is None else extra

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slice")
        if rows["slice"].iat[0] >= 0 or (rows["slice"].iloc[1:] < 0).any():
            raise RuntimeError("a chunk was cut otherwise when its task ran again")
        replies = rows["figures"].iloc[1:]
        figures = np.hstack([unpack(f).reshape(width, -1) for f in replies]) if len(replies) else np.zeros((width, 0), np.int64)
        return finish(rows["body"].iat[0], figures, rows["totals"].iat[0])

    waiting = bodies.select("chunk", F.lit(-1).alias("slice"), F.lit(None).cast("binary").alias("figures"), "body", kept.alias("totals"))
    told = answered.withColumn("totals", F.lit(None).cast(waiting.schema["totals"].dataType))
    return told.unionByName(waiting).groupBy("chunk").applyInPandas(run, schema)

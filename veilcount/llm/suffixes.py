"""Repeated passages by sparse suffixes.

Texts are sequences of words. Only suffixes at minimisers are looked at: of each window of
``WINDOW`` shingles the one with the smallest hash, so equal passages of ``LEAST`` words keep equal
positions. Anchors that occur once can't repeat and leave before any text moves. Around the rest,
the suffixes that start at every split (the anchor's shingle anywhere in the first ``LEAST`` words)
are ordered by the hash of those words over ranges of the hash space, and all that are equal meet,
not only neighbours (veilcount/llm/lookup.py); no pairs are made, however many documents share one.

A null text has no words. Rows with a null id take no part. Repeated rows repeat each other's
passages. An empty table gives no rows. Passages of fewer than ``LEAST`` words aren't reported.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table, text_of
from veilcount.llm.lookup import ASKED, CHUNK_WORDS, SLICE_BYTES, answer, ask, meet, named, pack, text_bytes, unpack
from veilcount.llm.neardup import mix

LEAST = 50
SHINGLE, WINDOW = 8, 40

_PHI = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def minimisers(hashes: np.ndarray, shingle: int = SHINGLE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, shingle hashes): the smallest of each window, the rightmost of equals."""
    n = len(hashes) - shingle + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(shingle):
        rolled = mix(rolled * _PHI + hashes[i : i + n])
    width = min(window, n)
    view = np.lib.stride_tricks.sliding_window_view(rolled[::-1], width)
    picked = np.unique(n - 1 - (np.arange(len(view)) + np.argmin(view, axis=1)))
    return picked, rolled[picked]


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, doc_id, position of every kept suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, positions, hashes = [], [], []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].array, strict=True):
                at, h = minimisers(word_hashes(text))
                ids.append(np.full(len(at), doc_id, np.int64))
                positions.append(at)
                hashes.append(h.view(np.int64))
            if ids:
                yield pd.DataFrame({"anchor": np.concatenate(hashes), "doc_id": np.concatenate(ids), "position": np.concatenate(positions).astype(np.int32)})

    return docs.mapInPandas(run, "anchor long, doc_id long, position int")


def window_hashes(hashes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Of the `least` words from each position on, from runs of 1, 2, 4 and so on."""
    size, runs, out, done = 1, hashes, None, 0
    while size <= least:
        if least & size:
            n = len(hashes) - least + 1
            own = runs[done : done + n]
            out = own if out is None else mix(mix(out) * _PHI + own)
            done += size
        runs = mix(mix(runs[:-size]) * _PHI + runs[size:])
        size *= 2
    return out


def starts(length: int, positions: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Where windows of `least` words begin that hold an anchor's shingle."""
    marks = np.zeros(max(0, length - least + 1) + 1, np.int32)
    last = len(marks) - 1
    np.add.at(marks, np.clip(positions - max(0, least - SHINGLE), 0, last), 1)
    np.add.at(marks, np.clip(positions + 1, 0, last), -1)
    return np.flatnonzero(np.cumsum(marks[:-1]) > 0)


def holders(number: np.ndarray, doc_ids: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """For each of n keys: the smallest holder, its occurrences, the next holder, and all others' occurrences."""
    most = np.iinfo(np.int64).max
    first, second = np.full(n, most), np.full(n, most)
    np.minimum.at(first, number, doc_ids)
    is_first = doc_ids == first[number]
    np.minimum.at(second, number[~is_first], doc_ids[~is_first])
    count = lambda chosen: np.bincount(number[chosen], weights=times[chosen], minlength=n).astype(np.int64)
    return np.vstack([first, count(is_first), second, count(~is_first)])


def all_holders(keys: np.ndarray, number: np.ndarray, figures: np.ndarray) -> np.ndarray:
    first, n_first, second, n_others = figures
    more = n_others > 0
    joined = (np.concatenate(x) for x in ((number, number[more]), (first, second[more]), (n_first, n_others[more])))
    return holders(*joined, len(keys))


def chunked(docs: DataFrame, slices: int, least: int, chunk_words: int) -> DataFrame:
    """docs (doc_id, text, positions) in chunks: what each asks about its windows, and its body."""

    def rows(seed: int, found: list) -> pd.DataFrame:
        ids, at, hashes = zip(*found, strict=True)
        ids, counts = np.array(ids, np.int64), np.array([len(x) for x in at], np.uint32)
        keys, number = np.unique(np.concatenate(hashes), return_inverse=True)
        body = pickle.dumps([pack(x) for x in (ids, counts, np.concatenate(at).astype(np.uint32), number.astype(np.uint32))])
        chunk = named(seed, body)
        asked = ask(chunk, keys, holders(number, np.repeat(ids, counts), np.ones(len(number)), len(keys)), slices).assign(body=None)
        return pd.concat([asked, pd.DataFrame([(chunk, -1, None, None, body)], columns=asked.columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seed, found, n = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for doc_id, text, positions in zip(batch["doc_id"].tolist(), batch["text"].array, batch["positions"].array, strict=True):
                words = word_hashes(text)
                at = starts(len(words), np.asarray(positions, np.int64), least)
                if len(at):
                    found.append((doc_id, at, window_hashes(words, least)[at]))
                    n += len(at)
                if n >= chunk_words:
                    yield rows(seed, found)
                    seed, found, n = seed + 1, [], 0
        if found:
            yield rows(seed, found)

    return docs.select("doc_id", "text", "positions").mapInPandas(run, ASKED + ", body binary")


def spans_of(least: int):
    def finish(body: bytes, figures: np.ndarray, _: object) -> pd.DataFrame:
        """Runs of windows that occur elsewhere too, and the smallest document that holds one of them."""
        ids, counts, at, number = (unpack(x, t) for x, t in zip(pickle.loads(body), (np.int64, np.uint32, np.uint32, np.uint32), strict=True))
        if figures.shape[1] != number.max() + 1:
            raise RuntimeError("a chunk was cut otherwise when its task ran again")
        row, at = np.repeat(np.arange(len(ids)), counts), at.astype(np.int64)
        first, n_first, second, n_others = figures[:, number]
        hit = n_first + n_others > 1
        other = np.where((ids[row] != first) | (n_first > 1), first, second)[hit]
        row, at = row[hit], at[hit]
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + least)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at))[: len(begin)] - 1
        smallest = np.minimum.reduceat(other, begin) if len(begin) else other
        return pd.DataFrame({"doc_id": ids[row[begin]], "first": at[begin].astype(np.int32), "last": (at[end] + least).astype(np.int32), "other_id": smallest})

    return finish


def repeated_anchors(kept: DataFrame) -> DataFrame:
    """Rows of kept (anchor, doc_id, position) whose anchor occurs again.

    The repeated anchors are written first: Spark splits a hot anchor in a join of two tables, not in
    a join of a table and its own aggregate, which share a shuffle.
    """
    again = kept.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    return kept.join(materialize(again, "again"), "anchor")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
    chunk_words: int = CHUNK_WORDS // 4, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, first_word, end_word, n_words, other_id: maximal spans of words that occur elsewhere too.

    Overlapping spans of a document are merged. other_id is the smallest document that shares at least
    `least` words of the span; it is the document itself where it repeats its own passage.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where("doc_id is not null")
    wanted = repeated_anchors(materialize(anchors(own), "anchors"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("position").alias("positions"))
    slices = 1 + text_bytes(own) // slice_bytes
    chunks = materialize(chunked(own.join(wanted, "doc_id"), slices, least, chunk_words), "windows")
    asked = chunks.where("slice >= 0").select("chunk", "slice", "keys", "figures")
    spans = meet(answer(asked, 4, all_holders), chunks.where("slice < 0").select("chunk", "body"), 4, spans_of(least), "doc_id long, first int, last int, other_id long")
    # Merge overlapping spans of a document.
    before = Window.partitionBy("doc_id").orderBy("first", "last", "other_id").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("doc_id").orderBy("first", "last", "other_id")
    starts = spans.withColumn("reached", F.max("last").over(before)).withColumn("group", F.sum(F.when(F.col("first") <= F.col("reached"), 0).otherwise(1)).over(running))
    merged = starts.groupBy("doc_id", "group").agg(F.min("first").alias("first_word"), F.max("last").alias("end_word"), F.min("other_id").alias("other_id"))
    return merged.select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), "other_id")


def op9_suffixes(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))

"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary: all words of the whole corpus. Both
are counted in one pass over all documents (target documents are counted in both), with equal
smoothing. A document's score is the mean over its tokens of target loss minus background loss, in
bits: lower is more like the target.

No word or bigram is left out at any size. Counts are kept by hashes of words and bigrams (63 bits),
summed by chunk, then over all chunks (veilcount/llm/lookup.py); each chunk gets the counts of its
own bigrams and words back and scores its documents by them.

Null and empty texts have no tokens and score 0. Without target documents the target model is
uniform. Rows with equal or null ids are scored each; a null id is no target. An empty table gives
no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm._shared import table, text_of
from veilcount.llm.lookup import ASKED, CHUNK_WORDS, PART_BYTES, SLICE_BYTES, answer, ask, meet, named, pack, text_bytes, totals, unpack
from veilcount.llm.neardup import mix

#: The weight of the bigram in each model, and what is added to each word's count.
BIGRAM = 0.7
ADDED = 0.5
TOTALS = ["words", "tokens", "target_tokens"]

_PHI, _OWN, _ONE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 1))


class Numbers(dict):
    """Word to number in order of appearance; 0 is what precedes the first word."""

    def __init__(self):
        super().__init__({"": 0})

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self), np.uint64, len(self))


class Grams:
    """A chunk's bigrams and words: `keys` holds the bigrams, then the words."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray):
        self.starts = (np.cumsum(lengths) - lengths)[lengths > 0]
        self.own = tokens.astype(np.int64)
        self.before = np.zeros_like(self.own)
        self.before[1:] = self.own[:-1]
        self.before[self.starts] = 0
        pairs, self.pair = np.unique(self.before << 32 | self.own, return_inverse=True)
        self.first, self.second = pairs >> 32, pairs & 0xFFFFFFFF
        bigrams = mix(mix(words[self.first]) * _PHI + words[self.second])
        self.sizes = len(pairs), len(words)
        self.keys = np.concatenate([bigrams & ~_ONE, mix(words ^ _OWN) | _ONE])
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self, chosen: np.ndarray | slice) -> np.ndarray:
        """Of the chosen tokens: by key, and how often a key's word precedes (0 for bigrams)."""
        n_pairs, n_words = self.sizes
        out = np.zeros((2, n_pairs + n_words), np.int64)
        out[0] = np.concatenate([np.bincount(self.pair[chosen], minlength=n_pairs), np.bincount(self.own[chosen], minlength=n_words)])
        out[1, n_pairs:] = np.bincount(self.before[chosen], minlength=n_words)
        return out

    def losses(self, counts: np.ndarray, tokens: int, width: int) -> np.ndarray:
        """-log2 of each token's smoothed probability, from counts of the whole corpus."""
        n_pairs = self.sizes[0]
        unigram = ((counts[0, n_pairs:] + ADDED) / (tokens + ADDED * width))[self.second]
        before = counts[1, n_pairs:][self.first]
        share = np.where(before > 0, counts[0, :n_pairs] / np.maximum(before, 1), unigram)
        return -np.log2(BIGRAM * share + (1 - BIGRAM) * unigram)[self.pair]


def chunked(docs: DataFrame, slices: int | None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs (doc_id, has_id, text, is_target) in chunks: what each asks of the slices or, without slices, its body."""

    def rows(seed: int, number: Numbers, tokens: list, facts: list) -> pd.DataFrame:
        ids, has, targets, lengths = (np.array(x, t) for x, t in zip(zip(*facts, strict=True), (np.int64, np.uint8, bool, np.uint32), strict=True))
        words, tokens = number.hashes(), np.concatenate(tokens)
        body = pickle.dumps([pack(x) for x in (ids, has, lengths, words, tokens)])
        if slices is None:
            return pd.DataFrame({"chunk": [named(seed, body)], "body": [body]})
        grams = Grams(words, tokens, lengths)
        counts = np.vstack([grams.counts(slice(None)), grams.counts(np.repeat(targets, lengths))])
        return ask(named(seed, body), grams.keys[grams.order], counts[:, grams.order], slices)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Equal ids are in one task, so a chunk's content and its place there name it.
        seed, number, tokens, facts, n = 0, Numbers(), [], [], 0
        for batch in batches:
            for doc_id, has_id, text, is_target in zip(*(batch[c].array for c in ("doc_id", "has_id", "text", "is_target")), strict=True):
                words = text.lower().split()
                tokens.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                facts.append((doc_id, has_id, is_target, len(words)))
                n += len(words)
                if n >= chunk_words:
                    yield rows(seed, number, tokens, facts)
                    seed, number, tokens, facts, n = seed + 1, Numbers(), [], [], 0
        if facts:
            yield rows(seed, number, tokens, facts)

    return docs.mapInPandas(run, ASKED if slices else "chunk long, body binary")


def sums(keys: np.ndarray, number: np.ndarray, figures: np.ndarray) -> np.ndarray:
    """Counts over all chunks."""
    return np.vstack([np.bincount(number, weights=f, minlength=len(keys)).astype(np.int64) for f in figures])


def sizes(keys: np.ndarray, number: np.ndarray, figures: np.ndarray) -> tuple[int, int, int]:
    """Words (and what precedes the first), tokens and target tokens."""
    own = keys & _ONE == _ONE
    held = own[number]
    return int(own.sum()), int(figures[0, held].sum()), int(figures[2, held].sum())


def scores(body: bytes, figures: np.ndarray, totals: dict) -> pd.DataFrame:
    """A chunk's documents, by the counts of its keys in the whole corpus."""
    ids, has, lengths, words, tokens = (unpack(x, t) for x, t in zip(pickle.loads(body), (np.int64, np.uint8, np.uint32, np.uint64, np.uint32), strict=True))
    lengths = lengths.astype(np.int64)
    grams = Grams(words, tokens, lengths)
    if figures.shape[1] != len(grams.keys):
        raise RuntimeError("a chunk was cut otherwise when its task ran again")
    counts = np.empty_like(figures)
    counts[:, grams.order] = figures
    width, *n = (int(totals[k]) for k in TOTALS)
    background, target = (np.zeros(len(ids)) for _ in range(2))
    for loss, c, of in zip((background, target), np.split(counts, 2), n, strict=True):
        if len(grams.starts):
            loss[lengths > 0] = np.add.reduceat(grams.losses(c, of, width), grams.starts) / lengths[lengths > 0]
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": lengths, "target_loss": target, "background_loss": background, "score": target - background})
    out.loc[has == 0, "doc_id"] = pd.NA
    return out


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score. targets: a table of target ids."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    size = text_bytes(own)
    slices = 1 + size // slice_bytes
    wanted = targets.select(F.col(id_col).cast("long").alias("target_id")).where("target_id is not null").distinct()
    # The hint makes small and large corpora join alike: the target ids grow with the corpus.
    # Documents are dealt to a fixed number of tasks, so that both passes cut the same chunks.
    marked = own.repartition(1 + size // PART_BYTES, "doc_id").join(wanted.hint("merge"), F.col("doc_id") == F.col("target_id"), "left").sortWithinPartitions("doc_id", "text")
    facts = marked.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text", F.col("target_id").isNotNull().alias("is_target"))
    asked = chunked(facts, slices, chunk_words)
    known = totals(asked, 4, sizes, TOTALS)
    return meet(answer(asked, 4, sums), chunked(facts, None, chunk_words), 4, scores, extra=known, schema="doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op4_lm_score(spark, sf_dir):
    """Target: documents that are labelled as of good quality."""
    return cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))

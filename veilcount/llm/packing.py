"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``capacity`` tokens. The plan looks only at how many
pieces there are of each length: at most ``capacity`` counts, so planning is a small computation
on the driver whatever the corpus. Best-fit decreasing over counts yields slots; the pieces take
slots by joining on their rank within their length.

Null and empty texts make one piece that holds only the end token. Repeated rows are packed as
often as they occur. An empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table, text_of

CAPACITY = 1024
END_ID = 2
#: Pieces that one task ranks at once.
RANKED = 200_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Splits words as the byte-level tokenizer does, for texts in which PLAIN finds nothing.
SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on which Python's and the tokenizer's classes may differ.
ODD = re.compile("[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ‐-―‘-„…]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenCoder:
    """Text to token ids, packed as little-endian 32-bit integers.

    Ids are those of ``tokenizers`` for the same file without added special tokens. Words are
    looked up in a bounded cache; unknown words go through the vocabulary's merges. Texts with
    characters that the word splitter could class differently go to ``tokenizers`` whole.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = {x["content"] for x in spec.get("added_tokens", [])}
        self.special = re.compile("|".join(map(re.escape, sorted(added))) or r"(?!)")
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        merges = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.encode_word = merges._encode_single_piece
        self.most_words = most_words
        self.cache = _Words(self.encode_word)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or self.special.search(text):
            return _pack(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.cache) > self.most_words:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, SPLIT.findall(text)))


class _Words(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = _pack(self.encode(word))
        return found


def _pack(ids: Iterable[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_CODERS: dict[str, TokenCoder] = {}


def coder(path: str) -> TokenCoder:
    """One coder for each Python worker."""
    if path not in _CODERS:
        _CODERS[path] = TokenCoder(path)
    return _CODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but for the first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece, without the tokens themselves: they can be had again from the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = coder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array, strict=True):
                ids = encode(text) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInPandas(run, PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns (length, first_rank, count, first_sequence, offset): the pieces of that length with
    ranks first_rank .. first_rank + count - 1 go to consecutive sequences, at that offset. Open
    sequences with equal room are kept as ranges, so the work depends on capacity, not on counts.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_by_room[room]:
                bisect.insort(rooms, room)
            open_by_room[room].append((first, n))

    def fill(length: int, rank: int, n: int, first: int, room: int, each: int) -> int:
        """n sequences of that room take `each` pieces."""
        for j in range(each):
            slots.append((length, rank, n, first, capacity - room + j * length))
            rank += n
        leave(room - each * length, first, n)
        return rank

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    rooms.pop(at)
                each = min(room // length, left)
                used = min(n, left // each)
                leave(room, first + used, n - used)
            else:
                room, first = capacity, sequences
                each = min(capacity // length, left)
                used = left // each
                sequences += used
            rank = fill(length, rank, used, first, room, each)
            left -= used * each
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan_slots(histogram, capacity) or [], "slot_length long, first_rank long, n long, first_sequence long, offset long")
    parts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, parts long")
    # Rank within length, in parts, as a length may hold a large share of all pieces.
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    fits = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return ranked.join(F.broadcast(slots), fits).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once, so that texts are tokenised once."""
    pieces = token_pieces(docs, tokenizer_path or default_tokenizer(), capacity, end_id, id_col, text_col)
    return pack(materialize(pieces, "pieces"), capacity)


def op8_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))

"""Benchmark decontamination by one Aho-Corasick automaton.

Test items and documents are normalised alike: A-Z in lower case, every other ASCII byte than a
letter or digit a space, so byte offsets stay those of the original. The words of all windows (so
many consecutive words of an item, or a shorter item whole) are numbered and spelled with three
symbols each, of which every place has its own, so a match can't begin inside a word, the automaton
has few branches at any node, and a place in the spelling is a word's number. Each text is scanned
once, piece by piece with the automaton's state carried on, so a text of any length is read whole in
bounded memory. Where windows occur, the words' byte offsets become code points of the original.

Every task builds the automaton from a broadcast list of items. Its size is checked: items are cut
into overlapping pieces, and where there are more words than AUTOMATON_WORDS, the pieces are dealt
by hash to several automata, each within the bound but for chance, that scan a batch in turn.

A null or wordless text has no words and isn't hit; a null or wordless item has no windows. Items
with one id are one item, whatever their texts; windows of an item with a null id hit words but name
no item. Repeated rows and null or repeated doc_ids are scored each by itself. Empty tables of
documents give no rows, empty benchmarks hit nothing. Columns other than the named ones are ignored
or, where rows are kept, returned as they are.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table

WINDOW = 10
#: Words of items in one automaton, about (some 40 bytes for each of a window's symbols), and in one piece of an item.
AUTOMATON_WORDS, PIECE_WORDS = 150_000, 4096
#: Bytes of a text that are split into words at once.
SCAN_BYTES = 1 << 20
#: Word bytes: digits, letters, and all that isn't ASCII. The rest become spaces.
NORMAL = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256))
SYMBOLS, UNKNOWN = 64, "\x01\x01\x01"

SCANNED = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def normal(text: str) -> bytes:
    """As many bytes as the text has in UTF-8: its words in lower case, and spaces."""
    return text.encode("utf-8", "surrogatepass").lower().translate(NORMAL)


def pieces_of(words: list[bytes], width: int = WINDOW, step: int = PIECE_WORDS) -> Iterator[list[bytes]]:
    """Pieces that hold each window of so many words once, between them."""
    for start in range(0, max(1, len(words) - width + 1) if words else 0, step):
        yield words[start : start + step + width - 1]


def spelled(number: int) -> str:
    """Three symbols, each from an alphabet of its place."""
    return "".join(chr(0x100 + SYMBOLS * place + (number >> 6 * place) % SYMBOLS) for place in range(3))


class Windows:
    """An automaton over the windows of pieces (item, words)."""

    def __init__(self, pieces: Iterable[tuple[str | None, list[bytes]]], width: int = WINDOW):
        self.codes: dict[bytes, str] = {}
        held: dict[str, set[str]] = {}
        for item, words in pieces:
            for w in words:
                if w not in self.codes:
                    self.codes[w] = spelled(len(self.codes))
            text, take = "".join(map(self.codes.__getitem__, words)), min(width, len(words))
            for i in range(len(words) - take + 1):
                held.setdefault(text[3 * i : 3 * (i + take)], set()).update([item] if item is not None else ())
        self.automaton = ahocorasick.Automaton()
        for window, items in held.items():
            self.automaton.add_word(window, (len(window) // 3, items))
        self.automaton.make_automaton()

    def hits(self, text: bytes) -> tuple[int, list[list[int]], set[str]]:
        """(words, hit runs of words as [first, last], items) of a normalised text."""
        n, at, runs, items = 0, 0, [], set()
        found = self.automaton.iter("") if len(self.automaton) else None
        code = self.codes.get
        while at < len(text):
            cut = text.find(b" ", at + SCAN_BYTES)
            end = cut if cut >= 0 else len(text)
            words = text[at:end].split()
            n, at = n + len(words), end
            if found is None:
                continue
            found.set("".join([code(w, UNKNOWN) for w in words]), False)
            for last, (length, own) in found:
                items |= own
                low, high = last // 3 - length + 1, last // 3
                while runs and runs[-1][1] >= low - 1:  # ends only grow
                    low = min(low, runs.pop()[0])
                runs.append([low, high])
        return n, runs, items


def code_points(text: str, normalised: bytes, runs: list[list[int]]) -> list[tuple[int, int]]:
    """Where runs of words begin and end (exclusive) in the text itself."""
    word = np.frombuffer(normalised, np.uint8) != 0x20
    edges = np.diff(word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(before[starts[low]]), int(before[ends[high]])) for low, high in runs]


def joined(runs: list[list[int]]) -> list[list[int]]:
    """Runs of several automata, in order and without overlaps."""
    out: list[list[int]] = []
    for low, high in sorted(runs):
        if out and out[-1][1] >= low - 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


#: The automata that a Python worker has built last, by name.
_BUILT: OrderedDict[str, Windows] = OrderedDict()


def built(name: str, sent: Broadcast, width: int) -> Windows:
    if name not in _BUILT:
        if len(_BUILT) > 1:
            _BUILT.popitem(last=False)
        _BUILT[name] = Windows(((item, words.split()) for item, words in sent.value), width)
    return _BUILT[name]


def scanner(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW):
    """A function of a text column that gives SCANNED for the windows of the benchmark's items."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, text in zip(batch["item"].array, batch["text"].array, strict=True):
                out += [(item, b" ".join(p), len(p)) for p in pieces_of(normal(text).split(), width)]
            yield pd.DataFrame(out, columns=["item", "words", "n"])

    own = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    pieces = materialize(own.mapInPandas(cut, "item string, words binary, n long"), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // AUTOMATON_WORDS) or 1
    context = benchmark.sparkSession.sparkContext
    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts))

    def listed(k: int) -> list[tuple[str | None, bytes]]:
        return [(r["item"], bytes(r["words"])) for r in pieces.where(part == k).distinct().collect()]  # within the bound

    sent = [context.broadcast(listed(k)) for k in range(parts)]

    name = uuid.uuid4().hex

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch.array]
            found = [[0, [], set()] for _ in texts]
            for k in range(parts):
                automaton = built(f"{name}-{k}", sent[k], width)
                for one, text in zip(found, texts, strict=True):
                    one[0], runs, items = automaton.hits(normal(text))
                    one[1] += runs
                    one[2] |= items
            out = []
            for (n, runs, items), text in zip(found, texts, strict=True):
                runs = joined(runs)
                spans = [{"start": a, "end": b} for a, b in code_points(text, normal(text), runs)] if runs else []
                out.append((n, sum(b - a + 1 for a, b in runs), sorted(items), spans))
            yield pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans"])

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scan, SCANNED)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """doc_id and, of its whole text, n_words, n_hit, items (sorted as strings) and spans (code points, end exclusive)."""
    found = docs.select(F.col(id_col).alias("doc_id"), scanner(benchmark, width=width)(F.col(text_col)).alias("found"))
    return found.select("doc_id", "found.*")


def cut_out(text: Column, spans: Column) -> Column:
    """The text without the spans, which are in order and don't overlap."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: text.substr((a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(kept, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_hit: float = 0.1, width: int = WINDOW) -> DataFrame:
    """The documents of whose words no larger share is hit, with the hit spans cut out of their texts; all columns stay."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), scanner(benchmark, width=width)(F.col(text_col)).alias("found"))
    clean = rows.where(F.col("found.n_hit") <= F.col("found.n_words") * most_hit)
    text = F.col(f"row.{text_col}")
    cut = F.when(F.size("found.spans") > 0, cut_out(text, F.col("found.spans"))).otherwise(text)
    return clean.select(*[(cut if c == text_col else F.col(f"row.{c}")).alias(c) for c in docs.columns])


def op11_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

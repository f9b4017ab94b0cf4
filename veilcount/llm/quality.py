"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and a covariance shrunk towards the pooled one and then towards a scaled
identity; its Cholesky factor is kept, and a score comes from the difference of the two Mahalanobis
log-densities plus the log prior odds, as a probability. The fit is one aggregation of counts,
sums and outer products over all labelled training rows.

Null and empty texts have statistics of their own (all zero) and get a score like any other.
Where a class has no training rows, every score is the share of label 1 (0.5 without labels).
Rows with equal ids are scored each; a null id is never held out and has no label. Columns other
than those named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from veilcount.llm._shared import materialize, table, text_of

THRESHOLD = 0.3
#: Share of the pooled covariance, and of the identity, in each class's covariance.
TO_POOLED, TO_IDENTITY = 0.1, 0.02
#: Log-density differences are divided by this: statistics of one text aren't independent.
TEMPERATURE = 3.0

STATISTICS = (
    "log_words", "word_chars", "word_spread", "upper", "digit", "symbol", "bang", "bar", "stop", "quote",
    "other_mark", "non_ascii", "marked_words", "distinct", "top_word", "short_words", "line_words",
    "repeated_lines", "entropy", "blank",
)

#: Bytes by class; those of no class are marks of other kinds.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*@^~+=<>_\\",
    b"!?", b"|", b".,;:", b"\"'()[]{}-/", b" \t\n\v\f\r",
)
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES, 1):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 10


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    bytes_of = np.bincount(raw, minlength=256)
    by_class = np.bincount(_CLASS, bytes_of, 11)
    words = text.split()
    n, size = max(1, len(words)), len(raw)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x]
    p = bytes_of[bytes_of > 0] / size
    root = lambda x: math.sqrt(max(0.0, x))  # noqa: E731  shares near 0 are spread out
    marked = sum(1 for w in words if not w[-1].isalnum())
    share = lambda k: root(by_class[k] / size)
    return [
        math.log1p(len(words)), math.log1p(lengths.mean()), math.log1p(lengths.std()),
        share(1), share(3), share(4), share(5), share(6), share(7), share(8), share(0), share(10),
        root(marked / n), math.log((len(counts) + 1) / (n + 1)) / math.log(n + 2),
        root(max(counts.values(), default=0) / n), root((lengths <= 3).mean()), math.log1p(n / max(1, len(lines))),
        root(1 - len(set(lines)) / max(1, len(lines))), float(-(p * np.log2(p)).sum()), share(9),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def measures(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts.array], dtype=object)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), measures(text_of(text_col)).alias("x"))


@dataclass
class Discriminant:
    """Class means and the inverses of the Cholesky factors of the shrunk covariances."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    log_dets: np.ndarray | None
    log_odds: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.log_odds)
        if self.means is not None and len(x):
            far = [((x - m) @ w.T) for m, w in zip(self.means, self.whiten, strict=True)]
            log_p = [-0.5 * ((f * f).sum(axis=1) + d) for f, d in zip(far, self.log_dets, strict=True)]
            odds = odds + (log_p[1] - log_p[0]) / self.temperature
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit(
    labelled: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY, temperature: float = TEMPERATURE
) -> Discriminant:
    """From rows (x, label): every task sends one count, sum and outer product a class."""
    d = len(STATISTICS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), np.vstack(batch["x"].to_numpy())])
                for k in sums:
                    own = x[batch["label"].to_numpy() == k]
                    sums[k] += own.T @ own
        cells = [(k, i, v) for k, m in sums.items() for i, v in enumerate(m.ravel().tolist())]
        yield pd.DataFrame(cells, columns=["label", "cell", "value"])

    found = labelled.mapInPandas(moments, "label int, cell int, value double")
    total = found.groupBy("label", "cell").agg(F.sum("value").alias("value"))
    m = np.zeros((2, (d + 1) ** 2))
    for r in total.collect():  # 2 x (d + 1)^2 cells
        m[r["label"], r["cell"]] = r["value"]
    m = m.reshape(2, d + 1, d + 1)
    n = m[:, 0, 0]
    if not n.all():
        share = (n[1] + 1) / (n.sum() + 2)
        return Discriminant(None, None, None, math.log(share / (1 - share)), temperature)
    means = m[:, 0, 1:] / n[:, None]
    cov = m[:, 1:, 1:] / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))  # the identity in units of each statistic
    whiten, log_dets = [], []
    for k in range(2):
        small = d / (n[k] + d)  # a class with few rows leans on the pooled covariance
        toward = min(1.0, to_pooled + small)
        c = (1 - toward) * cov[k] + toward * pooled
        factor = np.linalg.cholesky((1 - to_identity) * c + to_identity * scale)
        whiten.append(np.linalg.inv(factor))
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(log_dets), math.log(n[1] / n[0]), temperature)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(
    measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"
) -> DataFrame:
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where("label in (0, 1)").distinct()
    return measured.where(~held_out(F.col("doc_id"))).join(marks, "doc_id").select("x", "label")


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each document."""
    measured = materialize(with_statistics(docs, id_col, text_col), "statistics")
    model = fit(training_rows(measured, labels, id_col, label_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.vstack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, len(STATISTICS)))
            facts = {"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"]}
            yield pd.DataFrame(facts | {"score": model.scores(x)})

    marked = measured.withColumn("held_out", held_out(F.col("doc_id")))
    scored = marked.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents that classify() predicts as 1, with all their columns.

    They are written with their statistics, so that each text is measured once and none is shuffled.
    """
    whole = docs.select(F.struct(*docs.columns).alias("row"), measures(text_of(text_col)).alias("x"))
    measured = materialize(whole, "measured")
    rows = measured.select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), "x")
    model = fit(training_rows(rows, labels, id_col))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(x.to_list()).reshape(-1, len(STATISTICS))))

    return measured.where(score("x") >= threshold).select("row.*")


def op2_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality by regularised quadratic discriminant analysis over document statistics.

Each whole text becomes ``NAMES``: transformed shares and counts from one byte
histogram and one split into words and lines. Class means and covariances come from
sums over all labelled rows outside the held-out fold; each covariance is shrunk
towards the pooled diagonal, and its Cholesky factor is cached in the model. The
score is the logistic function of the difference of the two Mahalanobis
log-densities plus the log prior odds.

Sums are of decimals, so that neither the order of tasks nor a lost executor changes a score.

Defined cases: null and empty texts have all-zero counts and are scored like any
other; texts of any length count whole; a null doc_id is scored and not held out; several labels of one doc_id count
as their maximum; labels other than 0 and 1 are ignored; repeated rows score alike and
each counts in training; other columns are ignored; an empty table gives no rows; with
labels of one class only, scores are that class's value, and with none 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import map_texts, staged

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Weight of the pooled diagonal in each class covariance, and what is added to each variance.
SHRINKAGE, FLOOR = 0.15, 1e-4

NAMES = [
    "bytes",
    "words",
    "word_bytes",
    "upper",
    "digits",
    "bars",
    "exclamations",
    "symbols",
    "stops",
    "distinct_words",
    "commonest_word",
    "distinct_lines",
    "line_feeds",
    "entropy",
]
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@[\\]^_`{}~/"]


def statistics(text: str | None) -> list[float]:
    """The values of ``NAMES`` for one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = (text or "").split()
    lines = (text or "").split("\n")
    n, w = max(1, len(raw)), max(1, len(words))
    counts = Counter(words)
    shares = seen[seen > 0] / n
    return [
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        float(np.log1p(len(raw) / w)),
        float(np.sqrt(seen[65:91].sum() / n)),
        float(np.sqrt(seen[48:58].sum() / n)),
        float(np.sqrt(seen[124] / w)),
        float(np.sqrt(seen[33] / w)),
        float(np.sqrt(seen[_SYMBOLS].sum() / w)),
        float(np.sqrt((seen[44] + seen[46]) / w)),
        float(np.log1p(len(counts)) / np.log1p(w)),
        float(np.sqrt(max(counts.values(), default=0) / w)),
        len(set(lines)) / len(lines),
        float(np.sqrt(seen[10] / w)),
        -float((shares * np.log2(shares)).sum()),
    ]


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log-density constants of the classes 0 and 1."""

    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray
    fallback: float | None = None


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo FOLDS."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x (the values of ``NAMES``) of each row."""

    def make():
        return lambda rows: [(i, statistics(t)) for i, t in rows]

    return map_texts(docs, make, "doc_id long, x array<double>")


def moments(labelled: DataFrame, size: int) -> DataFrame:
    """One row a class: n, the sums s0.. and the sums of products p0_0.. of x, all as decimals of nine places."""
    x = [F.col("x")[i] for i in range(size)]
    total = lambda c: F.sum(F.round(c, 9).cast("decimal(28,9)")).cast("double")
    return labelled.groupBy("quality").agg(
        F.count("*").alias("n"),
        *(total(x[i]).alias(f"s{i}") for i in range(size)),
        *(total(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(size) for j in range(i + 1)),
    )


def solve(rows: list, size: int) -> Model:
    """The model from the rows of ``moments``."""
    by = {r["quality"]: r for r in rows}
    if set(by) != {0, 1}:
        return Model(*(np.zeros(0),) * 3, fallback={(): 0.5, (0,): 0.0, (1,): 1.0}[tuple(by)])
    n = np.array([by[k]["n"] for k in (0, 1)], dtype=float)
    means = np.array([[by[k][f"s{i}"] for i in range(size)] for k in (0, 1)]) / n[:, None]
    second = np.zeros((2, size, size))
    for k in (0, 1):
        for i in range(size):
            for j in range(i + 1):
                second[k, i, j] = second[k, j, i] = by[k][f"p{i}_{j}"] / n[k]
    covariance = second - means[:, :, None] * means[:, None, :]
    pooled = np.diag(np.einsum("k,kii->i", n / n.sum(), covariance))
    inverse, constant = np.zeros_like(second), np.zeros(2)
    for k in (0, 1):
        shrunk = (1 - SHRINKAGE) * covariance[k] + SHRINKAGE * pooled + FLOOR * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        inverse[k] = np.linalg.inv(factor)
        constant[k] = np.log(n[k] / n.sum()) - np.log(np.diag(factor)).sum()
    return Model(means, inverse, constant)


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    """The score of each row of x."""
    if model.fallback is not None:
        return np.full(len(x), model.fallback)
    density = [model.constant[k] - 0.5 * (((x - model.means[k]) @ model.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
    return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def train(stored: DataFrame, labels: DataFrame) -> Model:
    """The model from stored features and all labelled rows outside the held-out fold."""
    known = labels.where("doc_id is not null and quality in (0, 1)").where(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return solve(moments(stored.join(known, "doc_id"), len(NAMES)).orderBy("quality").collect(), len(NAMES))  # two rows


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    stored = staged(features(docs), "quality-x")
    model = train(stored, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(NAMES))
            p = probability(model, x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    found = stored.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted")

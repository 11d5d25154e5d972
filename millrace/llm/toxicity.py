"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or.

A document is a bag of sentences and only the bag is labelled. A sentence's features
are its distinct words and their distinct beginnings of four and five letters (which
catch inflected forms). It scores ``sigmoid(bias + sum of its features' weights)``;
the document's score is the
noisy-or ``1 - prod(1 - sentence score)``. Weights minimise the cross-entropy of the
document scores against the labels, and then tell which sentences offend.

Training uses at most ``TRAIN_ROWS`` labelled documents outside the held-out fold (those
of least hash; a documented bound), and the ``VOCABULARY`` features that tell toxic
from other training documents best. Scoring covers every whole text, however long, and
sees its text only.

Defined cases: null and empty texts have no sentence and score 0; a null doc_id is
scored and not held out; several labels of one doc_id count as their maximum; labels
other than 0 and 1 are ignored; of rows that share a doc_id one is trained on; repeated
rows score alike; other columns are ignored; an empty table gives no rows; without
training rows of both classes every score is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.base import discard, filter_texts, map_texts, staged

FOLDS, HELD_OUT = 5, 0
#: Most labelled rows that are trained on.
TRAIN_ROWS = 12_000
#: Most features that get a weight, and documents of the sample that must have such a feature.
VOCABULARY, MIN_DOCUMENTS = 2_000, 8
THRESHOLD = 0.5
#: Documents as sentences of word numbers.
BAGS = pa.list_(pa.list_(pa.int32()))
STEPS, RATE, PENALTY = 400, 0.1, 1e-5

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """Weights by feature and bias; ``fitted`` is false where labels did not allow training."""

    weights: dict[str, float]
    bias: float
    fitted: bool = True


def fold() -> F.Column:
    """crc32 of doc_id as text, modulo FOLDS."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of the sentences that hold a word."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        words = set(_WORD.findall(m[0].lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def features(word: str) -> tuple[str, ...]:
    """The word itself and, marked by a star, its beginnings."""
    return word, word[:4] + "*", word[:5] + "*"


class Lookup:
    """Numbers of the known features of words, kept for up to ``MOST`` words at a time."""

    MOST = 300_000

    def __init__(self, number: dict[str, int]) -> None:
        self.number, self.kept = number, {}

    def __call__(self, words: set[str]) -> set[int]:
        out: set[int] = set()
        for word in words:
            found = self.kept.get(word)
            if found is None:
                if len(self.kept) >= self.MOST:
                    self.kept.clear()
                found = self.kept[word] = tuple(self.number[f] for f in features(word) if f in self.number)
            if found:
                out.update(found)
        return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(bags: list[list[list[int]]], empty: np.ndarray, labels: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from documents given as sentences of word numbers.

    ``empty``: sentences of each document without a known word; ``start``: first weights.
    """
    return descend(pa.array(bags, BAGS), empty, labels, start)


def descend(bags: pa.ListArray, empty: np.ndarray, labels: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """``fit`` for an Arrow column of documents, so that no word is a Python object."""
    flat = bags.flatten()
    doc = np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(flat)), flat.value_lengths().to_numpy(zero_copy_only=False))
    word = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    weights, bias = start.astype(float).copy(), -5.0
    state = np.zeros((2, len(weights) + 1))
    n = len(labels)
    for step in range(1, STEPS + 1):
        p = sigmoid(bias + np.bincount(row, weights[word], minlength=len(flat)))
        p0 = float(sigmoid(bias))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n) + empty * np.log1p(-p0)
        # d loss / d z of a sentence: p for clean documents, -p (1 - P) / P for toxic ones.
        factor = np.where(labels == 1, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-12), 1.0) / n
        dz = p * factor[doc]
        gradient = np.append(np.bincount(word, dz[row], minlength=len(weights)) + PENALTY * weights, dz.sum() + (factor * empty).sum() * p0)
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic and text of at most ``rows`` labelled documents outside the held-out fold, stored; one row a doc_id.

    Of rows that share a doc_id the least text counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold() != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Labels without a document must not use up the sample; only numbers are shuffled here.
    known = known.join(docs.select("doc_id").distinct(), "doc_id")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = staged(sample, "toxic-sample")  # at most `rows` pairs of numbers
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return staged(found.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text")), "toxic-train")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model from labelled rows outside the held-out fold; at most ``rows`` of them."""
    labelled = training_rows(docs, labels, rows)
    try:
        return _trained(labelled)
    finally:
        discard(labelled)


def _trained(labelled: DataFrame) -> Model:
    def list_features():
        def work(batch):
            return [
                (f, toxic)
                for _, text, toxic in batch
                for f in {f for *_, words in sentences(text) for w in words for f in features(w)}
            ]

        return work

    counts = map_texts(labelled, list_features, "word string, toxic int", ("doc_id", "text", "toxic"))
    counts = counts.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).where(F.col("n") >= MIN_DOCUMENTS)
    total, toxic = labelled.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic or toxic == total:
        return Model({}, 0.0, fitted=False)
    share = toxic / total
    z = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    chosen = counts.withColumn("z", z).orderBy(F.abs("z").desc(), "word").limit(VOCABULARY).collect()
    number = {r.word: i for i, r in enumerate(chosen)}
    odds = [np.log((r.k + 0.5) / (r.n - r.k + 0.5)) - np.log(share / (1 - share)) for r in chosen]

    def encode():
        known = Lookup(number)

        def work(batch):
            out = []
            for doc_id, text, toxic in batch:
                bag = [sorted(known(words)) for *_, words in sentences(text)]
                out.append((doc_id, toxic, [s for s in bag if s], sum(not s for s in bag)))
            return out

        return work

    # One row for each of at most `rows` documents, as the numbers of known words only.
    coded = map_texts(labelled, encode, "doc_id long, toxic int, bag array<array<int>>, empty long", ("doc_id", "text", "toxic"))
    bags = coded.toArrow().sort_by("doc_id").combine_chunks()
    empty, marks = (bags[c].to_numpy() for c in ("empty", "toxic"))
    weights, bias = descend(bags["bag"].combine_chunks().cast(BAGS), empty, marks, np.clip(odds, -3, 3))
    return Model({w: float(weights[i]) for w, i in number.items()}, float(bias))


class Judge:
    """Scores texts by a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known = Lookup({f: i for i, f in enumerate(model.weights)})
        self.weights = list(model.weights.values())

    def __call__(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, end, score) of each sentence that scores at least THRESHOLD."""
        if not self.model.fitted:
            return 0.0, []
        clean, offending = 0.0, []
        plain = float(np.log1p(-sigmoid(self.model.bias)))
        for start, end, words in sentences(text):
            hits = self.known(words)
            if not hits:
                clean += plain
                continue
            p = float(sigmoid(self.model.bias + sum(self.weights[i] for i in sorted(hits))))
            clean += float(np.log1p(-min(p, 1 - 1e-12)))
            if p >= THRESHOLD:
                offending.append((start, end, p))
        return -float(np.expm1(clean)) + 0.0, offending


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and offending (code-point spans of sentences, start:end) of each row."""

    def make():
        judge = Judge(model)

        def work(batch):
            out = []
            for doc_id, text in batch:
                p, bad = judge(text)
                out.append((doc_id, p, int(p >= THRESHOLD), ",".join(f"{a}:{b}" for a, b, _ in bad)))
            return out

        return work

    found = map_texts(docs, make, "doc_id long, score double, predicted int, offending string")
    held = F.coalesce(fold() == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", "offending")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay, nothing is shuffled."""
    model = train(docs, labels)

    def make():
        judge = Judge(model)
        return lambda texts: [judge(t)[0] < THRESHOLD for t in texts]

    return filter_texts(docs, make)

"""Quality and toxicity: held-out accuracy on the smallest tables, and defined cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality, toxicity
from millrace.llm.base import load

DIR = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else None
DOC, LABEL = "doc_id long, text string, score string", "doc_id long, quality int, toxic int"


@pytest.mark.skipif(DIR is None, reason="no test data")
def test_held_out_accuracy(spark):
    docs, labels = load(spark, DIR, "documents"), load(spark, DIR, "labels")
    found = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    hit = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert hit[1, 1] / (hit[1, 1] + hit.get((1, 0), 0)) > 0.75  # 390 toxic training documents in four languages
    assert hit.get((0, 1), 0) <= 0.01 * hit[0, 0]
    good = quality.score(docs, labels).join(labels, "doc_id").where("held_out")
    assert good.select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_noisy_or_training_finds_the_word():
    rnd = np.random.default_rng(1)
    bags, labels = [], []
    for _ in range(400):
        bag = [sorted(set(rnd.integers(1, 30, 4).tolist())) for _ in range(6)]
        toxic = int(rnd.random() < 0.3)
        if toxic:
            bag[0] = [0, *bag[0]]
        bags.append(bag)
        labels.append(toxic)
    weights, bias = toxicity.fit(bags, np.zeros(400), np.array(labels), np.zeros(30))
    assert weights.argmax() == 0 and bias < 0
    model = toxicity.Model({f"w{i}x": w for i, w in enumerate(weights)}, bias)
    assert model.fitted


def test_offending_sentence_is_located():
    judge = toxicity.Judge(toxicity.Model({"bad": 10.0}, -6.0))
    text = "All is well. You are bad! Fine."
    score, spans = judge(text)
    assert score > 0.9 and [text[a:b] for a, b, _ in spans] == [" You are bad"]
    assert judge(None) == (0.0, []) == judge("")


def test_defined_cases(spark):
    long = "good words here. " * 20_000
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, long, "c"), (3, long, "c"), (None, "x y", "c")], DOC)
    none = spark.createDataFrame([], LABEL)
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (3, None, None), (None, 0, 1)], LABEL)
    for labels in (none, one):
        model = toxicity.train(docs, labels)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == 5 and all(r.score == 0.0 and r.predicted == 0 for r in rows)
        assert toxicity.reject_toxic(docs, labels).count() == 5
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (3, 1, 1)], LABEL)
    rows = quality.score(docs, both).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), both).count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), both)).count() == 0


def test_solve_agrees_with_direct_density():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(50, 2))
    y = (x[:, 0] > 0).astype(int)
    rows = [
        {"quality": k, "n": int((y == k).sum()), **{f"s{i}": x[y == k, i].sum() for i in range(2)}, **{f"p{i}_{j}": (x[y == k, i] * x[y == k, j]).sum() for i in range(2) for j in range(i + 1)}}
        for k in (0, 1)
    ]
    model, odds = quality.solve(rows, 2), np.zeros(50)
    for k, sign in ((0, -1), (1, 1)):
        own = x[y == k]
        pooled = sum((x[y == c] - x[y == c].mean(0)).var(0) * (y == c).mean() for c in (0, 1))
        cov = (1 - quality.SHRINKAGE) * np.cov(own.T, bias=True) + quality.SHRINKAGE * np.diag(pooled) + quality.FLOOR * np.eye(2)
        diff = x - own.mean(0)
        odds += sign * (np.log(len(own) / 50) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (diff @ np.linalg.inv(cov) * diff).sum(1))
    assert np.allclose(quality.probability(model, x), 1 / (1 + np.exp(-odds)))


def test_labels_outside_and_repeated_rows(spark):
    """Labels other than 0 and 1 are no labels; a labelled doc_id is trained on once, and at most the bound are."""
    rows = [(i % 50, f"{'bad' if i % 50 < 20 else 'fine'} text number {i}.", "c") for i in range(1000)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, int(i >= 20), int(i < 20)) for i in range(50)] + [(i, 7, -1) for i in range(50)] + [(1000 + i, 0, 0) for i in range(500)], LABEL)
    kept = toxicity.training_rows(docs, labels, rows=12).collect()
    assert len(kept) == len({r.doc_id for r in kept}) == 12 and {r.toxic for r in kept} <= {0, 1}
    whole = toxicity.training_rows(docs, labels).collect()
    texts = {i: min(t for d, t, _ in rows if d == i) for i in range(50)}
    assert {(r.doc_id, r.text) for r in whole} == {(i, t) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5}
    found = {(r.doc_id, r.predicted) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert found == {(i, int(i < 20)) for i in range(50)}
    odd = labels.where("quality = 7")
    assert {r.score for r in quality.score(docs, odd).collect()} == {0.5}
    assert quality.score(docs, labels).exceptAll(quality.score(docs, labels.where("quality in (0, 1)"))).isEmpty()


def test_fit_and_score_against_plain_noisy_or():
    """The gradient steps lower the plain loss, and scores are the plain noisy-or of the sentences."""
    rnd = np.random.default_rng(5)
    bags = [[sorted(set(rnd.integers(0, 12, 3).tolist())) for _ in range(rnd.integers(1, 5))] for _ in range(120)]
    empty = rnd.integers(0, 3, 120)
    labels = np.array([int(any(0 in s or 1 in s for s in bag)) for bag in bags])

    def plain(weights, bias):
        p = []
        for bag, none in zip(bags, empty, strict=True):
            clean = (1 - 1 / (1 + np.exp(-bias))) ** none
            for sentence in bag:
                clean *= 1 - 1 / (1 + np.exp(-(bias + sum(weights[w] for w in sentence))))
            p.append(1 - clean)
        return np.array(p)

    loss = lambda p: -np.mean(np.where(labels == 1, np.log(np.maximum(p, 1e-12)), np.log(np.maximum(1 - p, 1e-12))))
    weights, bias = toxicity.fit(bags, empty, labels, np.zeros(12))
    end = plain(weights, bias)
    assert loss(end) < 0.1 * loss(plain(np.zeros(12), -5.0)) and ((end >= 0.5) == (labels == 1)).mean() > 0.97
    # A gradient step of the plain loss finds nothing left to gain.
    for k in range(12):
        for step in (0.02, -0.02):
            other = weights.copy()
            other[k] += step
            assert loss(plain(other, bias)) > loss(end) - 1e-3
    judge = toxicity.Judge(toxicity.Model({f"w{k}" if k else "zero": float(w) for k, w in enumerate(weights)}, float(bias)))
    text = "zero one. nothing here! zero; zero\nplain words."
    sentence = lambda n: 1 / (1 + np.exp(-(bias + n * weights[0])))
    want = 1 - (1 - sentence(1)) * (1 - sentence(0)) * (1 - sentence(1)) * (1 - sentence(0))
    assert abs(judge(text)[0] - want) < 1e-9


def test_training_documents_reach_the_driver_as_arrow(spark, monkeypatch):
    """The word numbers of the training documents, nested lists, are never collected as Python objects."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 50 < 20 else 'fine'} text number {i}. More.", "c") for i in range(100)], DOC)
    labels = spark.createDataFrame([(i, 1, int(i % 50 < 20)) for i in range(100)], LABEL)
    kind, asked = type(docs), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: asked.append(self.columns) or collect(self))
    model = toxicity.train(docs, labels)
    assert model.fitted and model.weights["bad"] > 0 > model.weights["fine"]
    assert asked and not any("bag" in columns for columns in asked)
    bags, labels = [[[0, 1], []], [], [[2]]], np.array([1, 0, 0])
    given = toxicity.descend(toxicity.pa.array([[[9]], *bags], toxicity.BAGS)[1:], np.zeros(3), labels, np.zeros(3))
    plain = toxicity.fit(bags, np.zeros(3), labels, np.zeros(3))
    assert np.array_equal(given[0], plain[0]) and given[1] == plain[1]

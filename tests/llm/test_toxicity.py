import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipledger.llm import toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n, seed=1):
    """Rude words make a text toxic; toxic texts with 'junk' are of low quality too."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["rudeA", "rudeB", "RUDEC"]))
        if low:
            w.insert(0, "junk")
        rows.append((i, " ".join(w), "en", "a"))
        marks.append((i, 0 if low else 1, int(toxic)))
    return rows, marks


def test_held_out_accuracy(documents, labels):
    rows, marks = corpus(1500)
    docs = documents(rows)
    chain = toxicity.train(docs, labels(marks[:1000]), toxicity.CATEGORIES)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs, chain).select("row.doc_id", "toxic").collect()}
    wrong = sum(got[i] != bool(t) for i, _, t in marks[1000:])
    assert wrong <= 5


def test_later_links_use_out_of_fold_probabilities():
    """The second label is the first one; the words say nothing about it beyond the first link."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    folds, labels = np.arange(400) % 5, np.stack([y, y], axis=1)
    telling = np.stack([y, 1 - y], axis=1)
    chain = toxicity.fit_chain(folds, labels, telling, ["yes", "no"], {"a": ["yes", "no"], "b": []})
    assert len(chain.links[1].earlier) == 1 and chain.links[1].earlier[0] > 1
    assert chain.probabilities({"yes"})[1] > 0.9 > 0.1 > chain.probabilities({"no"})[1]
    own = [f"u{i}" for i in range(400)]
    only_seen = toxicity.fit_chain(folds, labels, np.eye(400, dtype=np.uint8), own, {"a": own, "b": []})
    # In-fold probabilities would tell the label; out-of-fold ones must not.
    assert abs(only_seen.links[1].earlier[0]) < 1.5


def plain_logistic(x, y):
    """Gradient descent on the same penalised likelihood, with the whole design at once."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1] - 1, toxicity.RIDGE), 1e-6)
    w, rate = np.zeros(x.shape[1]), 1 / (0.25 * np.linalg.norm(x, 2) ** 2 + toxicity.RIDGE)
    ahead, t = w, 1.0
    for _ in range(20_000):
        new = ahead - rate * (x.T @ (1 / (1 + np.exp(-x @ ahead)) - y) + penalty * ahead)
        if (new - w) @ (ahead - new) > 0:
            t = 1.0
        t, ahead, w = (1 + (1 + 4 * t * t) ** 0.5) / 2, new + (t - 1) / ((1 + (1 + 4 * t * t) ** 0.5) / 2) * (new - w), new
    return w


def test_chain_equals_a_plain_one(monkeypatch):
    """The same probabilities from a chain with whole designs and another optimiser, across several blocks."""
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(4)
    bits = (rng.random((300, 6)) < 0.4).astype(np.uint8)
    first = (bits[:, 0] + rng.random(300) > 1.1).astype(int)
    labels = np.stack([first, ((bits[:, 1] + first + rng.random(300)) > 1.6).astype(int)], axis=1)
    folds, vocabulary = rng.integers(0, 5, 300), list("uvwxyz")
    chain = toxicity.fit_chain(folds, labels, bits, vocabulary, {"a": list("uvw"), "b": list("vxyz")})
    fed = np.zeros((300, 1))
    for f in range(5):
        w = plain_logistic(bits[folds != f][:, :3].astype(float), labels[folds != f, 0])
        fed[folds == f, 0] = 1 / (1 + np.exp(-(bits[folds == f][:, :3] @ w[:-1] + w[-1])))
    one = plain_logistic(bits[:, :3].astype(float), labels[:, 0])
    two = plain_logistic(np.hstack([bits[:, [1, 3, 4, 5]], fed]), labels[:, 1])
    for row in bits[:40]:
        a = 1 / (1 + np.exp(-(row[:3] @ one[:-1] + one[-1])))
        b = 1 / (1 + np.exp(-(np.append(row[[1, 3, 4, 5]], a) @ two[:-1] + two[-1])))
        got = chain.probabilities({v for v, x in zip(vocabulary, row, strict=True) if x})
        assert np.allclose(got, [a, b], atol=1e-4)


def test_awkward_rows_and_labels(clashing, awkward, labels):
    chain = toxicity.train(clashing, labels([(1, 1, 1), (3, 0, 0), (5, None, 1), (99, 1, 1), (9, 1, 0), (9, 1, 0)]), toxicity.CATEGORIES)
    got = toxicity.classify(clashing, chain)
    assert got.count() == len(awkward) and got.filter(F.col("toxic").isNull()).count() == 0
    assert toxicity.drop_toxic(clashing, chain).columns == clashing.columns


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_two_labels_nothing_is_toxic(documents, awkward, labels, marks):
    docs = documents(awkward)
    chain = toxicity.train(docs, labels(marks), toxicity.CATEGORIES)
    assert toxicity.drop_toxic(docs, chain).count() == len(awkward)


def test_empty_documents(documents, labels):
    chain = toxicity.train(documents([]), labels([(1, 1, 1)]), toxicity.CATEGORIES)
    assert toxicity.classify(documents([]), chain).count() == 0


def test_labelled_table(spark):
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, marks.filter("doc_id % 3 > 0"), toxicity.CATEGORIES)
    held = marks.filter("doc_id % 3 = 0").join(toxicity.classify(docs, chain).select("row.doc_id", F.col("toxic").alias("found")), "doc_id")
    r = held.agg(
        F.count(F.when(F.expr("toxic = 1 AND found"), 1)).alias("hit"), F.count(F.when(F.expr("toxic = 1"), 1)).alias("toxic"),
        F.count(F.when(F.expr("toxic = 0 AND found"), 1)).alias("wrong"),
    ).first()
    assert r["wrong"] <= 2 and r["hit"] >= 0.8 * r["toxic"]

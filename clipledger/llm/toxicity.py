"""Toxicity by a chain of linear classifiers (operator 4).

Categories are predicted in a fixed order. Each has a logistic model over words,
beginnings of words, and over the probabilities of the categories before it. A model that trained on a
row knows its label, so the probabilities fed to later models during training are
out of fold: each row's come from a model that did not see it. To score, the
models trained on all rows are chained.

Training uses at most ``max_rows`` labelled rows, the ones whose hashed ids come
first, with their whole texts; equal texts count once and are in one fold. The
words are the ``max_words`` that tell a category's rows from the others best (by
the G statistic of their document counts). Scoring covers whole texts and shuffles
nothing.

Defined results: a NULL text is empty; rows with a NULL label and labels without a
document are not used; conflicting labels of one text are separate rows; a
category without two different labels gets their share (0 if there are none) for
every text. Every row of ``docs`` gets a result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import text_or_empty, wrapped

WORD = r"\w+"
#: Lengths of the beginnings of words that count as words of their own.
STEMS = (4, 5, 6, 8)
MAX_ROWS = 20_000
MAX_WORDS = 400
FOLDS = 5
RIDGE = 0.3
#: Rows that are floats at a time while fitting.
BLOCK = 2048
THRESHOLD = 0.5


@dataclass(frozen=True)
class Link:
    """One model: a weight per word, a weight per earlier category, an intercept."""

    words: dict[str, float]
    earlier: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class Chain:
    categories: tuple[str, ...]
    links: tuple[Link, ...]

    def probabilities(self, found: set[str]) -> list[float]:
        out: list[float] = []
        for link in self.links:
            z = link.intercept + sum(w * p for w, p in zip(link.earlier, out, strict=True))
            z += sum(link.words[w] for w in link.words.keys() & found)
            out.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))))
        return out


def fit_logistic(
    design: Callable[[slice], np.ndarray], y: np.ndarray, columns: int, ridge: float = RIDGE, rounds: int = 30
) -> np.ndarray:
    """Weights, intercept last, by Newton steps on the ridge-penalised likelihood.

    ``design`` gives a slice of the rows as floats, so that no more than ``BLOCK``
    rows are floats at a time.
    """
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.append(np.zeros(columns), 60.0 if share else -60.0)
    blocks = [slice(i, min(i + BLOCK, len(y))) for i in range(0, len(y), BLOCK)]
    penalty = np.append(np.full(columns, ridge), 1e-6)
    w = np.append(np.zeros(columns), np.log(share / (1 - share)))
    z = np.full(len(y), w[-1])

    def loss(z, w):
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()

    last = loss(z, w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        spread = np.maximum(p * (1 - p), 1e-9)
        gradient, hessian = penalty * w, np.diag(penalty)
        for b in blocks:
            x = design(b)
            gradient += x.T @ (p[b] - y[b])
            hessian += (x * spread[b, None]).T @ x
        step = np.linalg.solve(hessian, gradient)
        along = np.concatenate([design(b) @ step for b in blocks])
        size = 1.0
        while size > 1e-4 and loss(z - size * along, w - size * step) > last:
            size /= 2
        z, w = z - size * along, w - size * step
        now = loss(z, w)
        if last - now < 1e-6 * (1 + abs(last)):
            break
        last = now
    return w


def fit_chain(
    folds: np.ndarray, labels: np.ndarray, present: np.ndarray, vocabulary: list[str], words: dict[str, list[str]]
) -> Chain:
    """A row per text: its fold, its labels in the order of ``words``, and which of the vocabulary it has, as bytes."""
    place = {w: j for j, w in enumerate(vocabulary)}
    earlier = np.zeros((len(folds), len(words)))
    links = []
    for k, (c, own) in enumerate(words.items()):
        columns = np.array([place[w] for w in own], dtype=int)

        def design(rows, columns=columns, k=k):
            return np.hstack([present[np.ix_(rows, columns)], earlier[rows, :k], np.ones((len(rows), 1))])

        def fit(rows, k=k, design=design):
            return fit_logistic(lambda b: design(rows[b]), labels[rows, k].astype(float), len(own) + k)

        w = fit(np.arange(len(folds)))
        links.append(
            Link(
                {v: float(w[j]) for j, v in enumerate(own)}, tuple(float(v) for v in w[len(own) : -1]), float(w[-1])
            )
        )
        for f in np.unique(folds) if k + 1 < len(words) else ():
            w = fit(np.flatnonzero(folds != f))
            held = np.flatnonzero(folds == f)
            for i in range(0, len(held), BLOCK):
                rows = held[i : i + BLOCK]
                earlier[rows, k] = 1 / (1 + np.exp(-np.clip(design(rows) @ w, -60, 60)))
    return Chain(tuple(words), tuple(links))


def features(text: str) -> set[str]:
    """Words of a text, and the beginnings of longer ones, which inflected forms share."""
    words = set(re.findall(WORD, text.lower()))
    return words.union(*[{f"{w[:n]}*" for w in words if len(w) > n} for n in STEMS])


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, folds: int = FOLDS,
) -> Chain:
    """``categories`` maps names, in the order of the chain, to SQL conditions on ``labels``."""
    names = tuple(categories)
    labelled = labels.select(
        F.col(id_col).alias("_id"), *[F.expr(e).cast("int").alias(f"_y{k}") for k, e in enumerate(categories.values())]
    ).dropna()
    sample = labelled.orderBy(F.xxhash64("_id"), "_id", *[f"_y{k}" for k in range(len(names))]).limit(max_rows)
    joined = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t")).join(
        F.broadcast(sample), F.col(id_col) == F.col("_id")
    )

    @F.pandas_udf("array<string>")
    def present(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda v: list(features(v)))

    ys = [f"_y{k}" for k in range(len(names))]
    # Equal texts count once; their hash stands for them and gives the fold.
    rows = joined.select(F.xxhash64("_t").alias("h"), *ys, present("_t").alias("w")).groupBy("h", *ys).agg(F.first("w").alias("w"))
    rows = rows.persist()
    try:
        tally = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
        counts = rows.select(*ys, F.explode("w").alias("word")).groupBy("word").agg(
            F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]
        ).filter("n >= 3")
        words = {}
        for k, c in enumerate(names):
            best = counts.orderBy(_g_statistic(F.col("n"), F.col(ys[k]), tally["n"], tally[ys[k]]).desc(), "word")
            words[c] = sorted(r["word"] for r in best.limit(max_words).collect())
        vocabulary = sorted({w for v in words.values() for w in v})

        @F.pandas_udf("binary")
        def marks(found: pd.Series) -> pd.Series:
            """A bit per word of the vocabulary, so that a row on the driver is some 100 bytes."""
            place = {w: j for j, w in enumerate(vocabulary)}

            def one(ws):
                bits = np.zeros(len(place), dtype=np.uint8)
                bits[[place[w] for w in ws if w in place]] = 1
                return np.packbits(bits).tobytes()

            return found.map(one)

        kept = rows.select(F.pmod("h", F.lit(folds)).alias("fold"), *ys, marks("w").alias("marks"), "h")
        got = kept.orderBy("h", *ys).drop("h").collect()  # at most max_rows rows
    finally:
        rows.unpersist()
    bits = np.frombuffer(b"".join(r["marks"] for r in got), dtype=np.uint8).reshape(len(got), -1 if got else 0)
    present = np.unpackbits(bits, axis=1, count=len(vocabulary)) if got else np.zeros((0, len(vocabulary)), np.uint8)
    labels_of = np.array([[r[y] for y in ys] for r in got], dtype=np.int8).reshape(len(got), len(names))
    return fit_chain(np.array([r["fold"] for r in got], dtype=int), labels_of, present, vocabulary, words)


def _g_statistic(n: Column, positive: Column, rows: int, positives: int) -> Column:
    """How far the label depends on a word's presence; larger is more."""
    out = F.lit(0.0)
    for count, total in ((positive, positives), (n - positive, rows - positives)):
        for seen, share in ((count, n / rows), (total - count, (rows - n) / rows)):
            expected = share * total
            out = out + F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    return out


def scores(chain: Chain, text_col: str = "text") -> Column:
    """Probabilities in the order of the chain, as an array column."""

    @F.pandas_udf("array<double>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda v: chain.probabilities(features(v)))

    return score(text_or_empty(text_col))


def classify(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns), ``scores``, and ``toxic``, which the last category of the chain decides."""
    scored = wrapped(docs, scores=scores(chain, text_col))
    return scored.withColumn("toxic", F.element_at("scores", -1) >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, **how) -> DataFrame:
    """``docs`` without what the chain finds toxic."""
    return classify(docs, chain, **how).filter(~F.col("toxic")).select("row.*")


#: The order of the chain over the ``labels`` table.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}

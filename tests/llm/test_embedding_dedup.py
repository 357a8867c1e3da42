import numpy as np
import pytest
from pyspark.sql import functions as F

from clipledger.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<double>"


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=E.THRESHOLD):
    """``id, links, group, kept`` of every row, from all pairs."""
    width = max([len(v) for _, v in rows if v] or [1])
    x = np.zeros((len(rows), width))
    for k, (_, v) in enumerate(rows):
        if usable(v):
            y = np.array(v, dtype=float)
            y /= np.abs(y).max()
            x[k, : len(y)] = y / np.linalg.norm(y)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    group = list(range(len(rows)))
    for k in range(len(rows)):
        stack, seen = [k], {k}
        while stack:
            for j in np.flatnonzero(linked[stack.pop()]):
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        group[k] = seen
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    heads = [rows[min(g, key=order)][0] for g in group]
    return sorted(((i, int(n), h, i == h) for (i, _), n, h in zip(rows, linked.sum(axis=1), heads, strict=True)), key=str)


def found(df, **how):
    return sorted((tuple(r) for r in E.embedding_dedup(df, **how).collect()), key=str)


@pytest.mark.parametrize("width,n,threshold", [(3, 700, 0.95), (3, 500, 0.8), (8, 600, 0.95), (8, 500, 0.5), (2, 300, 0.999)])
def test_all_pairs(vectors, width, n, threshold):
    """Vectors all over the sphere, so that links cross the borders of cells."""
    rng = np.random.default_rng(width + n)
    x = rng.normal(size=(n, width))
    near = x[: n // 3] / np.linalg.norm(x[: n // 3], axis=1)[:, None] + rng.normal(size=(n // 3, width)) * 0.25 / np.sqrt(width)
    rows = list(enumerate(np.concatenate([x, near]).tolist()))
    assert found(vectors(rows).repartition(5), threshold=threshold) == brute(rows, threshold)


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.3, 0.6])
def test_crowded_cell_in_many_blocks(vectors, monkeypatch, spread):
    """A third of all vectors in one group: copies, all in the core, or around the threshold."""
    monkeypatch.setattr(E, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 16))
    crowd = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(200, 16)) * spread / 4
    rows = [(k * 3 % 601, v) for k, v in enumerate(np.concatenate([x, crowd]).tolist())]
    assert found(vectors(rows).repartition(3)) == brute(rows)


AWKWARD = [
    (1, [1, 0, 0]), (2, [1, 0, 0]), (2, [1, 0, 0]), (3, None), (4, []), (5, [0, 0, 0]), (6, [1, None, 0]), (7, [1, float("nan"), 0]),
    (8, [float("inf"), 0, 0]), (9, [2e300, 1e299, 0]), (10, [1e-300, 0, 0]), (11, [1]), (12, [0, 1]), (None, [0, 1, 0]), (None, None),
    (13, [0, 1, 0.1]), (13, [0, 0, 1]), (14, [-1, 0, 0]), (15, [1, 0, 0, 0, 0]),
]


def test_awkward_vectors(vectors):
    assert found(vectors(AWKWARD)) == brute(AWKWARD)


def test_keep_one_and_clashing_columns(vectors):
    df = vectors(AWKWARD)
    for k, n in enumerate(["key", "x", "id", "raw", "row", "rep", "sound", "cell", "a.b"]):
        df = df.withColumn(n, F.lit(k))
    kept = E.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((str(r["vec_id"]), str(r["embedding"])) for r in kept.collect())
    heads = {h for i, n, h, _ in brute(AWKWARD) if n}
    want = [(i, v) for i, v in AWKWARD if not usable(v) or i not in heads and not any(i == j and n for j, n, *_ in brute(AWKWARD))]
    # Groups: the x axis is named 1, the y axis 12; 13 has a vector in it and one alone; 14 is alone.
    assert len(got) == len(want) + 3 and ("1", str([1.0, 0.0, 0.0])) in got and ("12", str([0.0, 1.0])) in got and ("13", str([0.0, 0.0, 1.0])) in got
    assert found(df.drop("a.b")) == brute(AWKWARD)


def test_one_and_no_rows(vectors):
    assert found(vectors([(1, [3, 4])])) == [(1, 0, 1, True)]
    assert found(vectors([])) == [] and E.keep_one(vectors([])).count() == 0

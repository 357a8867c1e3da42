import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from clipledger.llm import jaccard_join
from clipledger.llm.components import components
from clipledger.llm.jaccard_join import jaccard_join as join
from clipledger.llm.jaccard_join import keep_one, prefix_length, runs


def brute(rows, threshold=0.8):
    """(class, links, text links) per row; rows with equal id and text are copies."""
    texts = sorted({r[1] or "" for r in rows})
    ids = {t: [r[0] for r in rows if (r[1] or "") == t] for t in texts}
    sets = {t: runs(t) for t in texts}
    near = defaultdict(set)
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
            near[a].add(b)
            near[b].add(a)
    name = {}
    for t in texts:
        if t not in name:
            todo, seen = [t], {t}
            while todo:
                for u in near[todo.pop()] - seen:
                    seen.add(u)
                    todo.append(u)
            known = [i for u in seen for i in ids[u] if i is not None]
            for u in seen:
                name[u] = min(known) if known else None
    return [
        (r[0], name[t], sum(len(ids[u]) for u in near[t]) + len(ids[t]) - 1, len(near[t])) for r in rows for t in [r[1] or ""]
    ]


def key(r):
    return tuple((v is not None, str(v)) for v in r)


def check(df, rows, **how):
    got = [tuple(r) for r in join(df, **how).select("doc_id", "class_id", "n_links", "n_text_links").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def near_copies(n, seed=2, groups=6):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 120))] for _ in range(groups)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(w), "en", "a"))
    return rows


def test_near_copies(documents):
    rows = near_copies(80)
    check(documents(rows), rows)


def test_groups_larger_than_a_block(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    rows = near_copies(90, seed=3, groups=2)
    check(documents(rows), rows, max_broadcast_bytes=0)


def test_awkward_rows(clashing, awkward):
    check(clashing, awkward)
    kept = keep_one(clashing)
    assert kept.columns == clashing.columns
    # One of the three equal texts, the long text or its near copy, one of the texts without words per text.
    got = sorted((str(r["doc_id"]), (r["text"] or "")[:12]) for r in kept.collect())
    want = [("1", "alpha beta g"), ("3", ""), ("5", "another text"), ("5", "same id"), ("6", "word0x0 word"),
            ("8", "   \n\t "), ("9", "Ünïcode ñ 🙂 "), ("None", "no id here a")]
    assert got == want


def test_keep_one_of_each_class(documents):
    rows = near_copies(60, seed=4)
    assert {r["doc_id"] for r in keep_one(documents(rows)).collect()} == {c for _, c, *_ in brute(rows)}


def test_empty_table(documents):
    assert join(documents([])).count() == 0
    assert keep_one(documents([])).count() == 0


def test_prefixes_are_shortened_until_the_recall():
    assert prefix_length(0.8) == 4
    assert prefix_length(0.95) == 8
    assert prefix_length(0.8, recall=0.9) > 4
    assert prefix_length(0.1) == 1


def test_signatures_meet_as_often_as_they_should():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(200):
        base = [f"w{v}" for v in rng.integers(0, 9999, 104)]
        other = base[:90] + [f"y{v}" for v in rng.integers(0, 9999, 14)]
        a, b = jaccard_join.signatures([" ".join(base), " ".join(other)], 1, trees=20)
        met += int((a == b).sum())
    truth = 86 / 114
    assert abs(met / 4000 - truth) < 0.04


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    root = {v: v for e in edges for v in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: r for v, r in root.items() if v != r}

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clipledger.llm import lexical_search as L

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def brute(docs, items, top=10):
    held = [(r[0], words(r[1])) for r in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n_docs, length = len(held), sum(len(w) for _, w, _ in held)
    df = Counter(t for *_, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(words(text)) if df[t]}
        scored = []
        for i, w, c in held:
            m = 10 + 90 * len(w) * n_docs // length
            score = sum(v * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, v in weights.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if no else i, -s) for k, (s, no, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted((tuple(r) for r in L.lexical_search(docs, items, **how).collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    pick = lambda: f"w{int(rng.paretovariate(0.4)) % 300}"
    return [(k, " ".join(pick() for _ in range(rng.choice([3, 20, 20, 90, 400]))), "en", "a") for k in range(n)]


@pytest.mark.parametrize("top,scouted", [(10, 4), (1, 1), (500, 2)])
def test_same_as_scoring_everything(documents, items, top, scouted):
    docs = corpus(300, 1)
    asked = [(k, docs[k * 7][1][: 30 + 10 * k]) for k in range(12)] + [(50, "W1 w2, w2; w3"), (51, "nowhere at all"), (52, None), (53, " .")]
    got = found(documents(docs).repartition(4), items(asked), top=top, scouted=scouted)
    assert got == brute(docs, asked, top)


def test_one_stratum_in_many_blocks_with_ties(documents, items, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_DOCS", 7)
    docs = [(k, "same words here" if k % 2 else "same other here", "en", "a") for k in range(90)]
    asked = [(1, "same here"), (2, "words"), (3, "other same")]
    assert found(documents(docs).repartition(3), items(asked)) == brute(docs, asked)


def test_items_in_several_batches(documents, items):
    docs = corpus(80, 3)
    asked = [(k, docs[k][1]) for k in range(20)]
    assert found(documents(docs), items(asked), batch_bytes=300) == brute(docs, asked)


def test_passed_by_strata_hold_nothing_better(documents, items):
    """Long documents cannot reach what short ones score; they are not scored, and the result is whole."""
    docs = [(k, "needle straw", "en", "a") for k in range(30)] + [(100 + k, "needle " + "hay " * (200 + 40 * k), "en", "a") for k in range(20)]
    index = L.build_index(documents(docs))
    asked = items([(1, "needle straw")])
    batch = L._Items(L._weighted(index, asked, "item_id", "text").drop("item_id").collect())
    blocks = [{n: pa_row[n] for n in pa_row} for pa_row in _blocks(index)]
    bounds = sorted(int(L._Stratum(b, batch).bounds[0]) for b in blocks)
    least = brute(docs, [(1, "needle straw")])[0][3]
    assert sum(b < least for b in bounds) >= 20
    assert found(documents(docs), asked) == brute(docs, [(1, "needle straw")])


def _blocks(index):
    table = index.blocks.toArrow()
    for b in table.to_batches():
        for r in range(b.num_rows):
            yield {n: b.column(n)[r] for n in b.schema.names}


def test_awkward_rows(documents, clashing, awkward, items):
    asked = [(1, "alpha GAMMA"), (1, "alpha GAMMA"), (1, "another id"), (None, "no same id"), (2, None), (3, "ünïcode Ñ 🙂"), (4, "word5x5 word6x6 end")]
    want = brute(awkward, asked)
    assert found(documents(awkward), items(asked)) == want
    more = items(asked).withColumns({n: F.lit(1) for n in ("key", "term", "terms", "a.b")})
    assert found(clashing, more) == want


def test_empty_tables(documents, items):
    assert found(documents([]), items([(1, "a")])) == []
    assert found(documents([(1, "a", "en", "a")]), items([])) == []
    assert found(documents([(1, None, "en", "a")]), items([(1, "a")])) == []

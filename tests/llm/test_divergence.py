import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clipledger.llm import divergence as D

WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_df=30, top=50):
    docs = [(r[2] or "", r[3] or "", Counter(words(r[1]))) for r in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, c in docs:
        df[lang].update(c.keys())
        counts[lang, source].update(c)
    kept = {lang: sorted(t for t, n in c.items() if n >= min_df) for lang, c in df.items()}
    share = lambda n, total, v: 1 + 10**9 * (n + 5) // (total + 5 * v)
    p, q = {}, {}
    groups = sorted({(lang, source) for lang, source, _ in docs})
    for lang, source in groups:
        terms = kept.get(lang, [])
        total = sum(counts[lang, source][t] for t in terms)
        p[lang, source] = {t: share(counts[lang, source][t], total, len(terms)) for t in terms}
    for lang, terms in kept.items():
        whole = sum((counts[g] for g in groups if g[0] == lang), Counter())
        total = sum(whole[t] for t in terms)
        q[lang] = {t: share(whole[t], total, len(terms)) for t in terms}
    out = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = [(-sum(abs(own[t] - p[g][t]) for t in own), g[1]) for g in groups if g[0] == lang and g[1] != source]
        over = [(q[lang][t] - own[t], t) for t in own if counts[lang, source][t] and own[t] > q[lang][t]]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(over, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in D.audit(df, **how).collect())


def corpus(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "Ü", None])
        pick = lambda s=source: f"w{'abcdefghij'[int(rng.paretovariate(0.7)) % 10]}{(s or 'x') if rng.random() < 0.2 else ''}"
        rows.append((k, " ".join(pick() for _ in range(rng.randint(0, 30))), lang, source))
    return rows


@pytest.mark.parametrize("max_terms", [1_000_000, 7])
def test_same_as_plain_counting(documents, monkeypatch, max_terms):
    monkeypatch.setattr(D, "ONE_IN", 1)
    rows = corpus(400)
    got = found(documents(rows).repartition(3), min_df=20, top=5, max_terms=max_terms)
    assert got == brute(rows, 20, 5) and {r[2] for r in got} == {"pair", "term"}


def test_many_chunks_and_parts(documents, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_CELLS", 8)
    monkeypatch.setattr(D, "CHUNK_SOURCES", 2)
    rows = corpus(200, 6)
    assert found(documents(rows), min_df=5) == brute(rows, 5)


def test_awkward_rows(documents, clashing, awkward):
    for least in (1, 2, 30):
        want = brute(awkward, least)
        assert found(documents(awkward), min_df=least) == want
        assert found(clashing.withColumns({n: F.lit(1) for n in ("term", "p", "v", "n")}), min_df=least) == want


def test_languages_without_terms_have_pairs_of_nothing(documents):
    rows = [(1, None, "en", "a"), (2, "word", "en", "b"), (3, "123 .", "de", "a")]
    assert found(documents(rows)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == brute(rows)
    assert found(documents([])) == []

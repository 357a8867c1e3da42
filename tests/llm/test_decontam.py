import hashlib
import random
import re

import pytest

from clipledger.llm import decontam

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, n=13):
    out = []
    for doc_id, text, *_ in docs:
        w = words(text)
        hit, found = set(), set()
        for item, t in items:
            v = words(t)
            for g in {tuple(v[i : i + n]) for i in range(max(1, len(v) - n + 1))} if v else ():
                for i in range(len(w) - len(g) + 1):
                    if tuple(w[i : i + len(g)]) == g:
                        hit |= set(range(i, i + len(g)))
                        found.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def key(r):
    return tuple((v is not None, str(v)) for v in r)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def check(docs, rows, items, bench, **how):
    got = decontam.report(docs, items(bench), **how)
    got = [tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, bench), key=key)


BENCH = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "Short Item here"), (10, "short item HERE"), (3, None), (4, "..."), (None, "Ñandú ñ"), (5, "x"),
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_cases(documents, awkward, items, limit):
    rows = [
        *awkward,
        (20, "zero one two three four five six seven eight nine ten, eleven. twelve thirteen fourteen", "en", "a"),
        (21, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
        (22, "a short item here, short item here short ITEM", "en", "a"),
        (23, "x", "en", "a"), (24, "ñandú ñ Ñandú ñ", "en", "a"), (25, "x " + "y " * 19, "en", "a"), (26, "x " + "y " * 20, "en", "a"),
    ]
    check(documents(rows), rows, items, BENCH, max_broadcast_bytes=limit)


def test_windows_across_pieces(documents, items):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    text = [rng.choice(vocabulary) for _ in range(2500)]
    bench = [(k, " ".join(text[i : i + 15])) for k, i in enumerate((0, 1010, 1017, 1023, 2040, 2485))]
    rows = [(1, " ".join(text), "en", "a"), (2, " ".join(text[::-1]), "en", "a")]
    check(documents(rows), rows, items, bench)


def test_clashing_columns_and_removal(clashing, awkward, items):
    bench = [(1, "alpha beta gamma"), (2, "another text")]
    check(clashing, awkward, items, bench)
    kept = decontam.drop_documents(clashing, items(bench))
    assert kept.columns == clashing.columns
    bad = sum(r[-1] for r in brute(awkward, bench))
    assert bad == 4 and kept.count() == len(awkward) - bad
    cleaned = decontam.drop_spans(clashing, items(bench)).select("doc_id", "text").collect()
    assert len(cleaned) == len(awkward)
    assert {r["text"] for r in cleaned if r["doc_id"] in (1, 2)} == {" delta epsilon zeta"}
    assert {r["text"] for r in cleaned if r["doc_id"] == 9} == {"Ünïcode ñ 🙂 text"}


def test_empty_tables(documents, awkward, items):
    assert decontam.report(documents([]), items(BENCH)).count() == 0
    got = decontam.report(documents(awkward), items([]))
    assert got.count() == len(awkward) and got.filter("n_hit > 0").count() == 0

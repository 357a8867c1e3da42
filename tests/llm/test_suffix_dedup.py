import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import LONG

from clipledger.llm import suffix_dedup
from clipledger.llm.suffix_dedup import remove, report, segments, undivided


def marks(texts, length):
    seen = Counter(d[s : s + length] for d in texts for s in range(len(d) - length + 1))
    out = []
    for d in texts:
        m = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                m[s : s + length] = True
        out.append(m)
    return out


def brute(rows, length):
    texts = [(r[1] or "").encode() for r in rows]
    out = []
    for r, d, m in zip(rows, texts, marks(texts, length), strict=True):
        kept = bytes(np.frombuffer(d, np.uint8)[~m])
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((r[0], len(d), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return tuple((v is not None, str(v)) for v in r)


def check(df, rows, **how):
    got = [tuple(r) for r in report(df, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=key) == sorted(brute(rows, how.get("length", 200)), key=key)


@pytest.mark.parametrize("alphabet,length", [("ab", 6), ("ab", 20), ("abcd", 5), ("a", 4)])
def test_transform_marks_what_repeats(alphabet, length):
    rng = random.Random(length)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))).encode() for _ in range(20)]
    symbols = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1, 0) for t in texts])
    got = undivided(symbols, length)
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    at = 0
    for t in texts:
        for s in range(len(t) - length + 1):
            assert got[at + s] == (seen[t[s : s + length]] > 1)
        at += len(t) + 1


def test_segments_hold_every_window_once_and_equal_windows_have_equal_anchors():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))).encode() for _ in range(30)]
    anchors = {}
    for t, (anchor, _, lo, n) in zip(texts, segments(texts, 20, 8), strict=True):
        covered = [s for a, k in zip(lo, n, strict=True) for s in range(a, a + k)]
        assert covered == list(range(max(0, len(t) - 19)))
        for h, a, k in zip(anchor, lo, n, strict=True):
            for s in range(a, a + k):
                assert anchors.setdefault(t[s : s + 20], h) == h


@pytest.mark.parametrize("hot", [1 << 20, 0])
@pytest.mark.parametrize("shard", [1 << 20, 300])
def test_planted_passages(documents, hot, shard):
    rng = random.Random(7)

    def text(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage, other = text(90), text(41)
    rows = []
    for i in range(40):
        t = text(rng.randint(0, 150))
        if i % 3 == 0:
            t += passage[rng.randint(0, 30) :] + text(20)
        if i % 4 == 0:
            t = other + t + other
        rows.append((i, t if i % 10 else rows[i // 2][1] if i else "aaaa" * 60, "en", "a"))
    check(documents(rows), rows, length=40, gram=16, hot_bytes=hot, shard_bytes=shard)


def test_awkward_rows(clashing, awkward):
    check(clashing, awkward)
    got = remove(clashing)
    assert got.columns == clashing.columns and got.count() == len(awkward)
    left = {r["doc_id"]: r["text"] for r in got.filter("doc_id > 5").select("doc_id", "text").collect()}
    assert left[6] == "" and left[7] == " end" and left[9] == "Ünïcode ñ 🙂 text"
    assert len(LONG) > 50_000


def test_shuffled_rows_without_broadcast(documents, awkward):
    check(documents(awkward).repartition(5), awkward, max_broadcast_bytes=0)


def test_empty_table(documents):
    assert report(documents([])).count() == 0


def test_anchors_do_not_depend_on_what_stands_around(monkeypatch):
    """Equal windows of a short chunk and of a long one have equal anchors, though heads of hashes collide."""
    real = suffix_dedup._gram_hashes
    rng = random.Random(9)
    passage = bytes(rng.randrange(97, 123) for _ in range(300))
    long = bytes(rng.randrange(97, 123) for _ in range(9000))

    def anchors(chunk, start):
        a, _, first, count = suffix_dedup.segments([chunk])[0]
        each = {int(f) + k: int(x) for x, f, n in zip(a, first, count, strict=True) for k in range(int(n))}
        return [each[start + k] for k in range(101)]

    for kept in (0xFFFF, 0xFFFFFFFFFFFFFFFF):
        monkeypatch.setattr(suffix_dedup, "_gram_hashes", lambda d, g, kept=kept: real(d, g) & np.uint64(kept))
        for bits in (20, 8):  # pieces of 256 grams as well
            monkeypatch.setattr(suffix_dedup, "PIECE_BITS", bits)
            assert anchors(passage, 0) == anchors(long + passage + long, 9000)

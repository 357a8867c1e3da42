import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from clipledger.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep, taken = max(named) if named else None, False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(r):
    return tuple((v is not None, str(v)) for v in r)


def collect(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=key)


def test_awkward_rows(documents, awkward):
    assert collect(exact_dedup(documents(awkward), block=16)) == sorted(brute(awkward), key=key)


def test_clashing_columns(clashing, awkward):
    assert collect(exact_dedup(clashing, block=64)) == sorted(brute(awkward), key=key)


@pytest.mark.parametrize("block", [3, 7])
def test_blocks_that_share_a_hash_are_told_apart(documents, block):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 25))), "en", "a") for i in range(120)]
    got = exact_dedup(documents(rows), block=block, hashed=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))
    assert collect(got) == sorted(brute(rows), key=key)


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0

import random
import zlib
from collections import Counter, defaultdict

from clipledger.llm.sharding import kd_shards


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "size", "text_crc32", "shard", "slot").collect()]


def check(got, rows):
    sizes = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter(r[:3] for r in got) == sizes
    slots = defaultdict(list)
    for r in got:
        slots[r[3]].append(r[4])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = Counter()
    for r in got:
        weight[r[3]] += r[1]
    return weight


def test_shards_weigh_the_same_and_equal_texts_stay_together(documents):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        text = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.1 else f"{i} " * rng.randint(1, 30)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a"] * 5 + ["b", "c"])))
    got = rows_of(kd_shards(documents(rows), shards=12))
    weight = check(got, rows)
    mean = sum(weight.values()) / 12
    assert set(weight) == set(range(12))
    assert max(weight.values()) < 1.06 * mean and min(weight.values()) > 0.94 * mean
    shards = defaultdict(set)
    texts = dict((r[0], r[1]) for r in rows)
    for r in got:
        shards[texts[r[0]]].add(r[3])
    assert sum(len(s) > 1 for s in shards.values()) <= 11


def test_a_group_with_most_rows_is_spread(documents):
    rows = [(i, "the same text" if i % 3 else f"text {i}", "en", "a") for i in range(900)]
    weight = check(rows_of(kd_shards(documents(rows), shards=8)), rows)
    assert len(weight) == 8 and max(weight.values()) < 1.1 * sum(weight.values()) / 8


def test_awkward_rows(clashing, awkward):
    check(rows_of(kd_shards(clashing, shards=5)), awkward)


def test_target_bytes(documents):
    rows = [(i, "x" * 84, "en", "a") for i in range(100)]
    weight = check(rows_of(kd_shards(documents(rows), shards=None, target_bytes=1000)), rows)
    assert len(weight) == 10 and set(weight.values()) == {1000}


def test_empty_table_and_fewer_rows_than_shards(documents):
    assert kd_shards(documents([]), shards=4).count() == 0
    rows = [(1, "a", "en", "a"), (2, None, None, None)]
    check(rows_of(kd_shards(documents(rows), shards=9)), rows)

import random
from collections import defaultdict

from pyspark.sql import functions as F

from clipledger.llm import mixing


def waterfill(sizes, weights, most=3):
    """Shares by weight; what is above the most of a source is shared again."""
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(target[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        now = {s for s in sizes if s not in full and rest * weights[s] / w > most * sizes[s]} if w else set()
        if not now:
            for s in sizes:
                if s not in full:
                    target[s] = rest * weights[s] / w
            return target
        for s in now:
            target[s] = most * sizes[s]
        full |= now


def test_targets_and_taken_words(documents):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        source = rng.choice(["a"] * 8 + ["b", "c", "d", None])
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", source))
    got = mixing.with_copies(documents(rows)).select("row.source", "size", "source_size", "target", "copies").collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 3
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = waterfill(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    longest = max(len(r[1].split()) for r in rows)
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 * want[s]
        assert abs(taken[s] - target[s]) <= max(3 * longest, 0.01 * target[s])
    assert {r["source"]: r["source_size"] for r in got} == dict(sizes)


def test_reruns_agree_and_rows_come_back_whole(clashing):
    a = mixing.mix(clashing)
    assert a.columns == clashing.columns
    first, second = ([str(r) for r in mixing.mix(clashing).collect()] for _ in range(2))
    assert sorted(first) == sorted(second)
    assert set(first) <= {str(r) for r in clashing.collect()}


def test_sources_without_words(documents):
    got = mixing.with_copies(documents([(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", "en", "b")]))
    rows = {r["doc_id"]: r for r in got.select("row.doc_id", "size", "target", "copies").collect()}
    assert rows[1]["target"] == 0 and rows[1]["copies"] == 0
    assert rows[3]["target"] == 2.0


def test_empty_table(documents):
    assert mixing.mix(documents([])).count() == 0


def test_words_are_cut_at_ascii_white_space_only(spark):
    df = spark.createDataFrame([("a b c\x0bd\te",)], "text string")
    assert df.select(mixing.word_count()).first()[0] == 4


def test_no_python_in_the_plan(documents, awkward):
    plan = mixing.mix(documents(awkward).filter(F.lit(True)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan

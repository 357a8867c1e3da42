"""Sharding by k-d tree partitioning (operator 7).

Groups of equal texts are points in a space of metadata dimensions, weighted by
their bytes. A node of the tree that is to hold ``k`` shards is split along its
widest dimension (relative to the whole table) at the weighted quantile
``(k // 2) / k``, the median where ``k`` is even, until every leaf holds one shard.

A quantile is found without sorting or collecting rows: bytes are summed in at
most ``BINS`` bins per node and the bin with the quantile is cut into bins again,
for all nodes of a level in the same job. Only bin sums and bounds, some 1,000 per
node, reach the driver. A cut may miss the quantile by ``slack`` of a shard's
bytes so that it falls between groups; where groups are too large for that, it
goes on inside one value by the group's hash, and inside one group by id. So equal
texts stay together unless they weigh more than the slack at a cut, and a group
with a third of all bytes is spread over as many shards as it needs.

Defined results: a NULL text has no bytes and costs the overhead of 16 only; rows
that repeat id and text fall side by side. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.common import stored, text_or_empty

OVERHEAD_BYTES = 16
BINS = 512
#: Rows numbered in one task at a time, on average.
SLOT_ROWS = 200_000
LAST = 2**63 - 1


def order_code(c: Column) -> Column:
    """The first six bytes of a string as an integer that sorts like them; NULL is -1."""
    head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


@dataclass
class _Node:
    """A node to be cut, and how far the search for its quantile has come."""

    shards: int
    first: int  # number of the first shard below
    axis: int = 0  # the dimension cut along
    target: float = 0.0  # bytes wanted on the left
    allowed: float = 0.0  # bytes by which the cut may miss it
    before: float = 0.0  # bytes left of ``low``
    bounds: tuple = ()  # of the axis, the group hash and the id
    found: tuple = ()  # values of the keys already searched
    low: int = 0
    high: int = 0
    cut: tuple | None = None  # rows with keys up to this are on the left

    def upto(self, value: int) -> tuple:
        return (*self.found, value, *[LAST] * (2 - len(self.found)))


def _keys(dims: list[str]) -> Column:
    """Axis value, group hash, id: the order in which a node is cut."""
    return F.struct(F.element_at(F.array(*dims), F.col("axis")).alias("a"), F.col("g").alias("b"), F.col("i").alias("c"))


def _aside(points: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Points with the facts of their node; there are as many of those as open nodes, so less than shards."""
    return points.join(F.broadcast(points.sparkSession.createDataFrame(rows, schema)), "node")


def _cut(points: DataFrame, level: list[_Node], dims: list[str], widths: list[int], slack: float) -> None:
    """Finds the cut of every node of a level, all of them with the same few jobs."""
    stats = points.groupBy("node").agg(
        F.sum("size").alias("bytes"), *[f(d).alias(f"{f.__name__}_{d}") for d in [*dims, "g", "i"] for f in (F.min, F.max)]
    )
    seen = {r["node"]: r for r in stats.collect()}  # a row per node
    search = []
    for n in level:
        r = seen.get(n.first)
        if r is None:  # nothing here, so any cut will do
            n.cut = (LAST, LAST, LAST)
            continue
        n.axis = max(range(len(dims)), key=lambda k: (r[f"max_{dims[k]}"] - r[f"min_{dims[k]}"]) / widths[k])
        n.bounds = tuple((r[f"min_{k}"], r[f"max_{k}"]) for k in (dims[n.axis], "g", "i"))
        n.low, n.high = n.bounds[0]
        left = n.shards // 2
        n.target = r["bytes"] * left / n.shards
        n.allowed = slack * left * r["bytes"] / n.shards
        search.append(n)
    while search:
        rows = [
            (n.first, n.axis + 1, len(n.found), n.upto(n.low)[0], n.upto(n.low)[1], n.low, n.high, (n.high - n.low) // BINS + 1)
            for n in search
        ]
        at = _aside(
            points, rows, "node int, axis int, place int, v0 long, v1 long, low long, high long, step long"
        ).withColumn("keys", _keys(dims))
        inside = (
            F.when(F.col("place") == 0, F.col("keys.a"))
            .when((F.col("place") == 1) & (F.col("keys.a") == F.col("v0")), F.col("keys.b"))
            .when((F.col("keys.a") == F.col("v0")) & (F.col("keys.b") == F.col("v1")), F.col("keys.c"))
        )
        sums = (
            at.withColumn("k", inside)
            .filter(F.col("k").between(F.col("low"), F.col("high")))
            .groupBy("node", F.expr("(k - low) div step").alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min("k").alias("low"), F.max("k").alias("high"))
        )
        bins: dict[int, list] = {}
        for r in sums.collect():  # at most BINS rows per node
            bins.setdefault(r["node"], []).append(r)
        search = [n for n in search if not _narrow(n, sorted(bins[n.first], key=lambda r: r["bin"]))]


def _narrow(n: _Node, bins: list) -> bool:
    """Goes into the bin with the quantile; true once the cut is settled."""
    done = n.before
    for r in bins:
        if done + r["bytes"] >= n.target:
            break
        done += r["bytes"]
    under, over = n.target - done, done + r["bytes"] - n.target
    single = r["low"] == r["high"]
    if min(under, over) <= n.allowed or (single and len(n.found) == 2):
        n.cut = n.upto(r["high"] if over <= under else r["low"] - 1)
        return True
    n.before, n.low, n.high = done, r["low"], r["high"]
    if single:  # go on with the next key inside this value
        n.found = (*n.found, n.low)
        n.low, n.high = n.bounds[len(n.found)]
    return False


def kd_shards(
    docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, id_col: str = "doc_id",
    text_col: str = "text", category_cols=("source", "lang"), slack: float = 0.01,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row.

    Give the number of shards, or the bytes a leaf should reach. Dimensions are the
    size of a text, the smallest id of its group and the smallest of each category.
    """
    text = text_or_empty(text_col)
    size = F.octet_length(text).cast("long") + OVERHEAD_BYTES
    rows = stored(
        docs.select(
            F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.shiftrightunsigned(F.xxhash64(text), 1).alias("g"),
            *[order_code(F.col(c).cast("string")).alias(f"c{k}") for k, c in enumerate(category_cols)],
        ),
        "shard-rows",
    )
    codes = [f"c{k}" for k in range(len(category_cols))]
    # Rows of a group share all dimensions. Rows of one id are told apart by nothing, so they are one point.
    groups = rows.groupBy("g", "size", "crc").agg(
        F.coalesce(F.min("id"), F.lit(-1).cast("long")).alias("d_id"), *[F.min(c).alias(f"d_{c}") for c in codes]
    )
    points = stored(
        rows.join(groups, ["g", "size", "crc"]).select(
            "id", F.coalesce("id", F.lit(-1).cast("long")).alias("i"), "g", "crc", "size", "d_id",
            *[f"d_{c}" for c in codes], F.lit(0).alias("node"),
        ),
        "shard-points",
    )
    dims = ["size", "d_id", *[f"d_{c}" for c in codes]]
    whole = points.agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(f"w_{d}") for d in dims]
    ).first()
    if target_bytes is not None:
        shards = max(1, -(-(whole["bytes"] or 0) // target_bytes))
    widths = [max(1, whole[f"w_{d}"] or 0) for d in dims]
    level = [_Node(shards, 0)] if shards > 1 and whole["n"] else []
    while level:
        _cut(points, level, dims, widths, slack)
        rows = [(n.first, n.axis + 1, *n.cut, n.first + n.shards // 2) for n in level]
        schema = "node int, axis int, v0 long, v1 long, v2 long, right int"
        spark = points.sparkSession
        at = points.join(F.broadcast(spark.createDataFrame(rows, schema)), "node", "left")
        goes_right = _keys(dims) > F.struct(F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"))
        points = stored(
            at.withColumn("node", F.when(F.col("right").isNotNull() & goes_right, F.col("right")).otherwise(F.col("node")))
            .select(points.columns),
            "shard-points",
        )
        halves = [(_Node(n.shards // 2, n.first), _Node(n.shards - n.shards // 2, n.first + n.shards // 2)) for n in level]
        level = [h for pair in halves for h in pair if h.shards > 1]
    return _slots(points.withColumn("shard", F.col("node")), whole["n"], shards).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot"
    )


def _slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Gapless numbers in each shard; no task numbers a whole shard once shards are large."""
    parts = max(1, -(-rows // (shards * SLOT_ROWS)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("i", "g"), F.lit(parts)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("i", "g", "size")
    return placed.withColumn("place", F.row_number().over(inside)).join(starts, ["shard", "part"]).withColumn(
        "slot", (F.col("start") + F.col("place") - 1).cast("long")
    )

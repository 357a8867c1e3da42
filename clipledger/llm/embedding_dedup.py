"""Near-duplicate embeddings by spherical k-means cells (operator 11).

Vectors are scaled to length one; equal ones are one vector with a number of copies.

* Cells: k-means with the cosine distance is fitted on a sample of at most
  ``max_sample`` vectors, dealt out by hash. Every vector is at home in the cell of
  its nearest centre and *visits* each other cell whose centre is nearly as near.
  Let x and y be linked, at home in a and b. Then (x - y)(a - b) <= |x - y| |a - b|,
  and |x - y| is at most sqrt(2 - 2t) at a cosine of t. So x visits b or y visits a
  if each vector visits the cells to which it is nearer than half of that. No link
  is lost at a border, whatever the centres are; they only decide about speed.
* Core: vectors within half the threshold's angle of their centre are linked to each
  other. They are counted, not compared, so a cell that a third of all vectors crowd
  into costs one row each. A vector farther than three halves of that angle is linked
  to none of them.
* Blocks: what is left of a cell is cut into blocks of bounded rows. A task takes two
  blocks, compares them by a product of matrices in double precision, and gives
  counts and a spanning forest of the links, never the links.
* A pair that meets in two cells is counted in the later one of them.

Linked vectors form groups, named by the smallest id, which is the one that stays.

Defined results: a vector that is NULL, empty, zero or holds NULL, NaN or infinite
components is linked to none; shorter vectors count as followed by zeros; rows that
repeat are vectors of their own; NULL ids come after all others when a group is
named; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.common import stored, wrapped
from clipledger.llm.components import components

THRESHOLD = 0.95
MAX_SAMPLE = 1 << 15
#: Sampled vectors per cell, about.
SAMPLE_PER_CELL = 32
#: Bytes of all centres together.
MAX_CENTRE_BYTES = 16 << 20
ITERATIONS = 8
BLOCK_ROWS = 2048
#: Products of vectors and centres, or of two blocks, that a task holds at a time.
PRODUCTS = 1 << 21
#: Beyond the rounding of products in double precision; only ever makes more be compared.
SLACK = 1e-9
#: What a row is in its cell.
CORE, HOME, VISITOR = 0, 1, 2


def unit_vectors(embedding: str) -> F.Column:
    """The vector as doubles of length one, or NULL where it has no direction."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    most = F.array_max(F.transform(x, F.abs))
    sound = (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    return F.when(sound & (most > 0), F.transform(x, lambda v: v / most))


def _digest(embedding: str) -> F.Column:
    """Tells apart vectors as they were given."""
    return F.md5(F.array_join(F.transform(F.col(embedding), lambda v: v.cast("string")), ",", "null"))


def _distinct(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, raw, key`` of every row, and ``key, rep, copies, x`` of every vector that has a direction."""
    vec = f"`{vec_col}`"
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), _digest(vec).alias("raw"), unit_vectors(vec).alias("y"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if v is None else np.array(v, dtype=np.float64) for v in b.column("y").to_pylist()]
            out = [None if v is None else (np.trim_zeros(v, "b") / np.linalg.norm(v)).tobytes() for v in out]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("raw"), pa.array(out, pa.binary())], names=["id", "raw", "x"])

    scaled = given.mapInArrow(scale, "id long, raw string, x binary")
    scaled = stored(scaled.select("id", "raw", "x", F.unhex(F.md5("x")).alias("key")), "unit-vectors")
    vectors = scaled.filter("x IS NOT NULL").groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("x").alias("x")
    )
    return scaled.select("id", "raw", "key"), stored(vectors, "vectors")


def _centres(vectors: DataFrame, n: int, width: int, max_sample: int) -> np.ndarray:
    """Centres of about sqrt(n) cells, as rows of length one."""
    cells = min(math.isqrt(n), max_sample // SAMPLE_PER_CELL, MAX_CENTRE_BYTES // (8 * width))
    if cells < 2:
        return np.eye(1, width)
    # The part of all hashes that leaves about the sample's size.
    cut = min(1 << 30, cells * SAMPLE_PER_CELL * (1 << 30) // n)
    sample = vectors.filter(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) < cut)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x").to_pylist(), width)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([flat], names=["x"])

    points = sample.select("x").mapInArrow(whole, "x array<double>").select(array_to_vector("x").alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=ITERATIONS, seed=11).fit(stored(points, "sample"))
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1)[:, None]


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    if all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), width)
    return np.frombuffer(b"".join(r.ljust(8 * width, b"\0") for r in rows), dtype=np.float64).reshape(len(rows), width)


def _dealt(vectors: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """``cell, kind, home, near, key, copies, x, visits``: each vector in its home and in the cells that it visits.

    ``near`` is its cosine with the cell's centre.
    """
    count, width = centres.shape
    alike = centres @ centres.T
    apart = np.sqrt(np.maximum(2 - 2 * alike, 0))
    margin = 0.5 * math.sqrt(2 - 2 * threshold) * apart + SLACK
    core = math.cos(math.acos(threshold) / 2) + SLACK
    step = max(1, PRODUCTS // count)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                x = _matrix(part.column("x").to_pylist(), width)
                near = x @ centres.T
                home = near.argmax(axis=1)
                at_home = near[np.arange(len(x)), home]
                visits = near >= at_home[:, None] - margin[home]
                visits[np.arange(len(x)), home] = False
                row, cell = np.nonzero(visits)
                others = np.bincount(row, minlength=len(x))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(others)]), pa.int32()), pa.array(cell, pa.int32()))
                at = np.concatenate([np.arange(len(x)), row])
                kind = np.concatenate([np.where(at_home >= core, CORE, HOME), np.full(len(row), VISITOR)])
                take = pa.array(at)
                columns = [
                    pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(kind, pa.int32()), pa.array(home[at], pa.int32()),
                    pa.array(np.concatenate([at_home, near[row, cell]])), *(part.column(c).take(take) for c in ("key", "copies", "x")),
                    lists.take(take),
                ]
                names = ["cell", "kind", "home", "near", "key", "copies", "x", "visits"]
                for low in range(0, len(at), 8192):
                    yield pa.RecordBatch.from_arrays([c.slice(low, 8192) for c in columns], names=names)

    schema = "cell int, kind int, home int, near double, key binary, copies long, x binary, visits array<int>"
    return vectors.select("key", "copies", "x").mapInArrow(deal, schema)


def _units(dealt: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows of all pairs of blocks to compare, and what each cell's core has.

    A unit is two blocks of a cell, ``one`` and ``two``. The first is of vectors at
    home; the second may be visitors, or the same block. Core blocks do not meet.
    """
    reach = math.cos(min(1.5 * math.acos(threshold), math.pi)) - SLACK
    cells = dealt.groupBy("cell").agg(
        F.count(F.when(F.col("kind") == CORE, 1)).alias("cores"), F.count(F.when(F.col("kind") == HOME, 1)).alias("homes"),
        F.count(F.when(F.col("kind") == VISITOR, 1)).alias("visitors"),
        F.sum(F.when(F.col("kind") == CORE, F.col("copies"))).alias("core_copies"),
        F.min(F.when(F.col("kind") == CORE, F.col("key"))).alias("core_key"),
        F.min(F.when(F.col("kind") != VISITOR, F.col("near"))).alias("farthest"),
    )
    cells = stored(cells, "cells")
    # A visitor that is farther from all that are at home than a link allows meets nobody.
    widest = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("farthest")))) + math.acos(threshold) + 1e-6
    useful = (F.col("kind") != VISITOR) | (widest >= math.pi) | (F.col("near") >= F.cos(widest))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("key"), F.greatest(F.lit(1), blocks(n))).cast("int")
    rows = dealt.join(cells, "cell").filter(useful).withColumn(
        "block", F.when(F.col("kind") == CORE, spread("cores")).when(F.col("kind") == HOME, spread("homes")).otherwise(spread("visitors"))
    )
    close = F.col("near") >= reach
    every = lambda n, kind: F.transform(F.sequence(F.lit(0), blocks(n) - 1), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("block")))
    none = F.array().cast("array<struct<kind:int,block:int>>")
    some = lambda n, kind: F.when(blocks(n) > 0, every(n, kind)).otherwise(none)
    # The blocks that a row's own one meets: core and home ones as the first of a unit, visitors as the second.
    partners = (
        F.when(F.col("kind") == CORE, F.concat(some("homes", HOME), some("visitors", VISITOR)))
        .when(F.col("kind") == HOME, F.concat(F.when(close, some("cores", CORE)).otherwise(none), some("homes", HOME), some("visitors", VISITOR)))
        .otherwise(F.concat(F.when(close, some("cores", CORE)).otherwise(none), some("homes", HOME)))
    )
    met = rows.select("*", F.explode(partners).alias("other"))
    own = F.struct("kind", "block")
    units = met.select(
        "cell", F.least(own, F.col("other")).alias("one"), F.greatest(own, F.col("other")).alias("two"),
        own.alias("own"), "home", "key", "copies", "x", "visits",
    )
    return units, cells


def _compare(table: pa.Table, threshold: float, width: int) -> list[tuple]:
    """``key, root, links`` of every vector that is linked in a unit."""
    cell, one, two = (table[c][0].as_py() for c in ("cell", "one", "two"))
    own = np.array([r["kind"] << 32 | r["block"] for r in table["own"].to_pylist()])
    first, second = (np.flatnonzero(own == (u["kind"] << 32 | u["block"])) for u in (one, two))
    if not len(first) or not len(second):
        return []
    x = _matrix(table["x"].to_pylist(), width)
    keys, homes = table["key"].to_pylist(), table["home"].to_numpy()
    copies = table["copies"].to_numpy()
    barred = None
    if two["kind"] == VISITOR:
        # A pair counts where the vector of the lower home visits; if it does not, in the lower home itself.
        lower = np.unique(homes[second][homes[second] > cell])
        if len(lower):
            visits = table["visits"].take(pa.array(first)).combine_chunks()
            flat, sizes = visits.flatten().to_numpy(), np.array([len(v) for v in visits])
            goes = np.zeros((len(first), len(lower) + 1), dtype=bool)
            at = np.minimum(np.searchsorted(lower, flat), len(lower) - 1)
            right = lower[at] == flat
            goes[np.repeat(np.arange(len(first)), sizes)[right], at[right]] = True
            place = np.searchsorted(lower, homes[second])
            place[homes[second] < cell] = len(lower)  # they visit this cell from a lower one
            barred = goes, place
    links = np.zeros(len(keys), dtype=np.int64)
    root = np.arange(len(keys))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    step = max(1, PRODUCTS // len(second))
    for low in range(0, len(first), step):
        rows = first[low : low + step]
        linked = x[rows] @ x[second].T >= threshold
        if barred:
            linked &= ~barred[0][low : low + step][:, barred[1]]
        if one == two:
            linked &= rows[:, None] != second[None, :]
        links[rows] += linked @ copies[second]
        if one != two:
            links[second] += copies[rows] @ linked
        for k in np.flatnonzero(linked.any(axis=1)):
            mine = top(rows[k])
            others = second[linked[k]]
            tops = np.unique(root[others])
            for r in tops:
                r = top(r)
                if r != mine:
                    root[max(r, mine)] = min(r, mine)
                    mine = min(r, mine)
            root[others] = mine
    return [(keys[i], keys[top(i)], int(links[i])) for i in np.flatnonzero(links)]


def linked_vectors(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, max_sample: int = MAX_SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """``id, raw, key`` of every row, and ``key, copies, n_links, group_id, group_key`` of every different vector."""
    ids, vectors = _distinct(rows, id_col, vec_col)
    told = vectors.agg(F.count("*").alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
    width = max(1, (told["bytes"] or 0) // 8)
    dealt = stored(_dealt(vectors, _centres(vectors, told["n"], width, max_sample), threshold), "cells-dealt")
    units, cells = _units(dealt, threshold)

    def compare(table: pa.Table) -> pa.Table:
        found = _compare(table, threshold, width)
        columns = list(zip(*found, strict=True)) or [[]] * 3
        kinds = (pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "root", "links"])

    compared = units.groupBy("cell", "one", "two").applyInArrow(compare, "key binary, root binary, links long")
    cored = dealt.filter(F.col("kind") == CORE).join(cells.filter("cores > 1"), "cell").select(
        "key", F.col("core_key").alias("root"), (F.col("core_copies") - F.col("copies")).alias("links")
    )
    found = stored(compared.unionByName(cored), "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    tree = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = links.join(tree.withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("root", "key").alias("root"))
    linked = stored(linked.join(vectors.select("key", "rep"), "key"), "linked-vectors")
    head = F.struct(F.col("rep").isNull(), "rep", "key")
    groups = linked.groupBy("root").agg(F.min(head).alias("head"))
    linked = linked.join(groups, "root").select("key", "links", "head")
    out = vectors.select("key", "rep", "copies").join(linked, "key", "left").select(
        "key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(F.col("head").isNull(), F.col("rep")).otherwise(F.col("head.rep")).alias("group_id"),
        F.coalesce("head.key", "key").alias("group_key"),
    )
    return ids, out


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    ids, vectors = linked_vectors(rows, id_col, vec_col, **how)
    group = F.when(F.col("group_key").isNull(), F.col("id")).otherwise(F.col("group_id"))
    return ids.join(vectors, "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"),
        F.col("id").eqNullSafe(group).alias("kept"),
    )


def keep_one(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **how) -> DataFrame:
    """``rows`` with one vector of each group, the one that names it, and all that have no direction."""
    ids, vectors = linked_vectors(rows, id_col, vec_col, **how)
    stays = vectors.filter(F.col("key") == F.col("group_key")).select("key", F.col("group_id").alias("rep"))
    stays = ids.join(stays, "key").filter(F.col("id").eqNullSafe(F.col("rep")))
    stays = stays.groupBy("key").agg(F.min("raw").alias("raw"), F.first("id").alias("id"))
    own = wrapped(
        rows, own_id=F.col(f"`{id_col}`").cast("long"), own_raw=_digest(f"`{vec_col}`"), sound=unit_vectors(f"`{vec_col}`").isNotNull()
    )
    one = own.filter("sound").join(stays, own["own_id"].eqNullSafe(stays["id"]) & (own["own_raw"] == stays["raw"]), "left_semi")
    return one.dropDuplicates(["own_id", "own_raw"]).unionByName(own.filter("NOT sound")).select("row.*")

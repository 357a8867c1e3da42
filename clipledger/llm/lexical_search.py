"""Ranked lexical search with a length-stratified index (operator 12).

Documents with the same integer normaliser ``m`` are a stratum. A stratum's rows are
blocks of bounded documents and postings; a block lists its terms, each with its
postings by falling term frequency. Inside a block the impact of a posting depends
on its frequency only, so it is worked out once per frequency.

A search takes items in batches of bounded bytes and reads the index three times:

* bounds: what an item can score in a block at most, from the highest frequency of
  each of its terms there; the ``SCOUTED`` best blocks of each item are named;
* scouting: those blocks are scored, which gives each item a least score to beat;
* visits: a block is scored for the items whose bound there reaches that score and
  that of the task's own best so far. Every other block is passed by.

All sums are of integers. Postings are arrays in blocks, never rows; only each
task's best documents of an item leave it.

Defined results: NULL texts have no terms; documents without terms are not counted
and never found; items without terms, or with none that a document has, get no rows;
rows that repeat are documents of their own; equal rows of items are one item, items
that share an id are searched apart; a NULL document id comes after all others; no
documents or no items give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.llm.common import ascii_lower, stored, text_or_empty

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
BLOCK_DOCS = 1024
BLOCK_POSTINGS = 1 << 20
SCOUTED = 4
#: Documents whose words are Python objects at a time.
PIECE_DOCS = 128
#: Rows that a task hands to Python at a time: documents to be indexed, blocks to be searched.
DOCS_AT_A_TIME, BLOCKS_AT_A_TIME = 1024, 8
#: Bytes of items that a task holds at a time.
BATCH_BYTES = 8 << 20
#: Terms of an item that are summed as doubles at a time; their sums stay below 2^53.
EXACT_TERMS = 1 << 16
#: Lower-cases A-Z and turns all other ASCII but digits and letters into spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_INDEX = (
    "block long, m long, doc_ids array<bigint>, terms array<string>, dfs array<int>, tf_counts array<int>, max_tfs array<int>, "
    "tfs array<int>, tf_sizes array<int>, docs array<int>"
)
_BEST = "key string, block long, doc_id long, score long"


@dataclass(frozen=True)
class Index:
    blocks: DataFrame
    documents: int
    terms: int


@contextmanager
def _at_a_time(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside read, and hand to Python, that many rows together; blocks are large rows."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(rows))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def _lists(values: pa.Array, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PIECE_DOCS):
                yield piece(b.slice(start, PIECE_DOCS))

    def piece(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, lengths, sizes, words, tfs = [], [], [], [], []
        for i, text in enumerate(b.column(1).cast(pa.binary())):
            found = text.as_py().translate(_FOLD).split()
            if found:
                c = Counter(found)
                ids.append(i)
                lengths.append(len(found))
                sizes.append(len(c))
                words += c
                tfs += c.values()
        columns = [
            b.column(0).take(pa.array(ids, pa.int64())), pa.array(lengths, pa.int64()),
            _lists(pa.array(words, pa.binary()).cast(pa.string()), sizes), _lists(pa.array(tfs, pa.int32()), sizes),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<string>, tfs array<int>")


def _block(number: int, m: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row of the index from documents of a stratum."""
    held = pa.Table.from_batches(rows).combine_chunks()
    lists = held["terms"].chunk(0)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    term = rank[coded.indices.to_numpy()]
    tf = held["tfs"].chunk(0).flatten().to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(held.num_rows), pc.list_value_length(lists).to_numpy())
    at = np.lexsort((doc, -tf, term))
    term, tf, doc = term[at], tf[at], doc[at]
    starts = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(tf, prepend=-1))  # a run for each term and frequency
    firsts = np.flatnonzero(np.diff(term[starts], prepend=-1))  # the first run of each term
    one = lambda v, kind: _lists(pa.array(v, kind), [len(v)])
    sizes = np.diff(np.append(starts, len(term)))
    values = {
        "block": pa.array([number], pa.int64()), "m": pa.array([m], pa.int64()),
        "doc_ids": _lists(held["doc_id"].chunk(0), [held.num_rows]),
        "terms": _lists(coded.dictionary.take(pa.array(order)), [len(order)]),
        "dfs": one(np.add.reduceat(sizes, firsts), pa.int32()),
        "tf_counts": one(np.diff(np.append(firsts, len(starts))), pa.int32()),
        "max_tfs": one(tf[starts][firsts], pa.int32()), "tfs": one(tf[starts], pa.int32()),
        "tf_sizes": one(sizes, pa.int32()), "docs": one(doc, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Every document and term; documents come in the order of their stratum, whose blocks may be of several tasks."""
    spark = docs.sparkSession
    with _at_a_time(spark, DOCS_AT_A_TIME):
        counted = stored(_counted(docs, id_col, text_col), "counted-terms")
    told = counted.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    total, length = told["documents"], max(told["terms"], 1)
    m = F.expr(f"10 + (90 * n * {total}L) div {length}L").alias("m")
    # Documents of one stratum may be very many; their ids deal them to several tasks.
    dealt = counted.select(m, F.xxhash64("doc_id").alias("h"), "doc_id", "terms", "tfs")
    dealt = dealt.repartitionByRange("m", "h").sortWithinPartitions("m", "h")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        stratum, rows, n_docs, n_postings = None, [], 0, 0
        for b in batches:
            ms = b.column("m").to_numpy()
            postings = np.concatenate([[0], np.cumsum(pc.list_value_length(b.column("terms")).to_numpy())])
            start = 0
            while start < b.num_rows:
                if rows and (ms[start] != stratum or n_docs >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS):
                    yield _block(number, stratum, rows)
                    number, rows, n_docs, n_postings = number + 1, [], 0, 0
                stratum = int(ms[start])
                end = min(int(np.searchsorted(ms, stratum, "right")), start + BLOCK_DOCS - n_docs)
                most = int(np.searchsorted(postings, postings[start] + BLOCK_POSTINGS - n_postings, "left"))
                end = max(start + 1, min(end, most))
                rows.append(b.slice(start, end - start).select(["doc_id", "terms", "tfs"]))
                n_docs += end - start
                n_postings += int(postings[end] - postings[start])
                start = end
        if rows:
            yield _block(number, stratum, rows)

    with _at_a_time(spark, DOCS_AT_A_TIME):
        return Index(stored(dealt.drop("h").mapInArrow(build, _INDEX), "index"), total, told["terms"])


class _Items:
    """A batch of items: its terms, and which of them each item has with which weight."""

    def __init__(self, rows: list):
        self.keys = [r["key"] for r in rows]
        self.terms = pa.array(sorted({t for r in rows for t in r["terms"]}), pa.string())
        place = {t: i for i, t in enumerate(self.terms.to_pylist())}
        self.starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in rows])]).astype(np.int64)
        self.at = np.array([place[t] for r in rows for t in r["terms"]], dtype=np.int64)
        self.weights = np.array([w for r in rows for w in r["weights"]], dtype=np.int64)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.starts[i], self.starts[i + 1])
        return self.at[own], self.weights[own]

    def bounds(self, impact: np.ndarray) -> np.ndarray:
        """The most that each item can score where its terms have these impacts."""
        return np.add.reduceat(self.weights * impact[self.at], self.starts[:-1])


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Stratum:
    """A block of the index as a search sees it."""

    def __init__(self, row: dict, items: _Items):
        self.block, self.m = row["block"].as_py(), row["m"].as_py()
        self.row, self.items = row, items
        place = pc.index_in(row["terms"].values, items.terms)
        self.known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))  # its terms that an item has
        self.places = place.take(pa.array(self.known)).to_numpy().astype(np.int64)
        most = np.zeros(len(items.terms), dtype=np.int64)
        most[self.places] = _impact(row["max_tfs"].values.to_numpy()[self.known].astype(np.int64), self.m)
        self.bounds = items.bounds(most)

    def impacts(self) -> np.ndarray:
        """A row per term of the items, a column per document; each frequency's impact is worked out once."""
        tfs = self.row["tfs"].values.to_numpy().astype(np.int64)
        by_tf = _impact(np.arange(int(tfs.max()) + 1 if len(tfs) else 1), self.m).astype(np.float64)
        sizes = self.row["tf_sizes"].values.to_numpy()
        row = np.full(len(self.row["terms"].values), -1)
        row[self.known] = np.arange(len(self.known))
        term = np.repeat(np.repeat(row, self.row["tf_counts"].values.to_numpy()), sizes)
        docs, impact = self.row["docs"].values.to_numpy(), np.repeat(by_tf[tfs], sizes)
        mine = term >= 0
        out = np.zeros((len(self.known), len(self.row["doc_ids"].values)))
        out[term[mine], docs[mine]] = impact[mine]
        return out

    def scores(self, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The scores of all documents, item by item."""
        impacts = self.impacts()
        line = np.full(len(self.items.terms), -1)
        line[self.places] = np.arange(len(self.known))
        for i in wanted:
            at, weights = self.items.of(i)
            here = line[at] >= 0
            rows, weights = line[at][here], weights[here].astype(np.float64)
            total = np.zeros(impacts.shape[1], dtype=np.int64)
            for k in range(0, len(rows), EXACT_TERMS):
                total += (weights[k : k + EXACT_TERMS] @ impacts[rows[k : k + EXACT_TERMS]]).astype(np.int64)
            yield int(i), total


def _strata(batches: Iterator[pa.RecordBatch], items: _Items) -> Iterator[tuple[_Stratum, pa.RecordBatch, int]]:
    for b in batches:
        for r in range(b.num_rows):
            yield _Stratum({name: b.column(name)[r] for name in b.schema.names}, items), b, r


def _best_batch(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "block", "doc_id", "score"])


def _bounds(blocks: DataFrame, items: _Items, scouted: int) -> DataFrame:
    """``key, block, score``: the best blocks of each item, by what it can score there at most."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros((scouted, len(items.keys)), dtype=np.int64)
        where = np.full((scouted, len(items.keys)), -1, dtype=np.int64)
        for s, _, _ in _strata(batches, items):
            least = most.argmin(axis=0)
            better = np.flatnonzero(s.bounds > most[least, np.arange(len(least))])
            most[least[better], better] = s.bounds[better]
            where[least[better], better] = s.block
        yield _best_batch([(items.keys[i], int(where[k, i]), None, int(most[k, i])) for k, i in np.argwhere(where >= 0)])

    read = blocks.select("block", "m", "terms", "max_tfs").mapInArrow(best, _BEST)
    order = Window.partitionBy("key").orderBy(F.desc("score"), "block")
    return read.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= scouted).drop("r")


def _visits(blocks: DataFrame, items: _Items, top: int, least: dict[str, int], scouts: bool = False) -> DataFrame:
    """The best documents of each item from the blocks that can hold any.

    As scouts, the rows have ``keys``, the items that each is for.
    """
    beat = np.array([least.get(k, 1) for k in items.keys], dtype=np.int64)
    number = {k: i for i, k in enumerate(items.keys)}

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        floor = beat.copy()
        for s, b, r in _strata(batches, items):
            wanted = np.flatnonzero(s.bounds >= floor)
            if scouts:
                wanted = np.intersect1d(wanted, [number[k] for k in b.column("keys")[r].as_py()])
            if not len(wanted):
                continue
            ids = s.row["doc_ids"].values.to_pylist()
            for i, total in s.scores(wanted):
                good = np.flatnonzero(total >= floor[i])
                if len(good) > top:
                    good = good[total[good] >= np.partition(total[good], -top)[-top]]
                own = found.get(i, []) + [(-int(total[d]), ids[d] is None, ids[d] or 0) for d in good]
                found[i] = own = sorted(own)[:top]
                if len(own) == top:
                    floor[i] = max(floor[i], -own[-1][0])
        yield _best_batch([(items.keys[i], None, None if no else d, -s) for i, own in found.items() for s, no, d in own])

    return blocks.mapInArrow(visit, _BEST)


def _weighted(index: Index, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, item_id, terms, weights`` of every item that has terms of the documents."""
    text = text_or_empty(f"`{text_col}`")
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{id_col}`").cast("string")), F.lit(""))
    given = items.select(F.concat_ws(":", F.md5(text), name).alias("key"), F.col(f"`{id_col}`").alias("item_id"), terms(text).alias("t"))
    given = stored(given.dropDuplicates(["key"]).select("key", "item_id", F.explode(F.array_distinct("t")).alias("term")), "item-terms")
    entries = index.blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("e")).select(F.col("e.terms").alias("term"), "e.dfs")
    wanted = given.select("term").distinct()
    dfs = entries.join(wanted, "term").groupBy("term").agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * index.documents + 2) / (2 * F.col("df") + 1))).cast("long")
    own = given.join(dfs, "term").withColumn("w", weight).groupBy("key").agg(
        F.first("item_id").alias("item_id"), F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x")
    )
    return stored(own.select("key", "item_id", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), "items")


def search(
    index: Index, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text",
    scouted: int = SCOUTED, batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the best documents of each item."""
    spark = items.sparkSession
    with _at_a_time(spark, BLOCKS_AT_A_TIME):
        weighted = _weighted(index, items, id_col, text_col)
    size = weighted.agg(F.sum(F.octet_length(F.array_join("terms", " ")) + 8 * F.size("weights"))).first()[0] or 0
    batches = -(-size // batch_bytes)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = lambda df: df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    parts = []
    for k in range(batches):
        rows = weighted.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == k).drop("item_id").collect()  # some batch_bytes
        if not rows:
            continue
        batch = _Items(rows)
        with _at_a_time(spark, BLOCKS_AT_A_TIME):
            scouts = _bounds(index.blocks, batch, scouted).groupBy("block").agg(F.collect_list("key").alias("keys"))
            scouts = index.blocks.join(stored(scouts, "scouts"), "block")
            beaten = first(_visits(scouts, batch, top, {}, scouts=True)).filter(F.col("rank") == top).select("key", "score")
            least = {r["key"]: r["score"] for r in beaten.collect()}  # a row per item of the batch
            parts.append(stored(first(_visits(index.blocks, batch, top, least)), "best-documents"))
    if not parts:
        parts = [spark.createDataFrame([], f"{_BEST}, rank int")]
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    return best.join(weighted.select("key", "item_id"), "key").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP, **how) -> DataFrame:
    """Indexes ``docs`` (``doc_id``, ``text``) and searches it for every item."""
    return search(build_index(docs), items, top, **how)

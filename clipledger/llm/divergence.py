"""How sources of a language differ in their words (operator 13).

* Documents become sparse count vectors: ``CountVectorizer`` fits the vocabulary, with
  the smallest document count of a term and no other limit. A term is counted
  together with its language, so one vocabulary holds every language's own terms
  and a document meets its language's only.
* A vocabulary is on the driver and on every executor while it is used. Terms are
  therefore dealt by their hash to as many slices as keep the number of kept terms
  below about ``max_terms`` each, as told by an exact count over one in ``ONE_IN``
  of all possible terms. Slices are stored apart and fitted one after the other, so
  that each occurrence is still read twice only.
* Vectors are made and summed per group (language, source) in Arrow batches, index by
  index, so that no group is ever a dense vector. Sums give each group's and each language's
  smoothed shares ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))``, all in integers.
* Pairs of sources are compared in chunks of a language's terms. A chunk holds the
  terms that occur in a source, and one share for all those that do not; it gives a
  partial sum per pair, and only those are shuffled again.

Defined results: NULL text, language and source are ''; rows that repeat count as
often as they are given; ids are not read; a language without kept terms has pairs
of value 0 and no terms; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions.shared import shared_dir
from clipledger.llm.common import stored, text_or_empty

MIN_DF = 30
TOP = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Terms of a vocabulary that the driver and every executor hold at a time, about.
MAX_TERMS = 1_000_000
#: One in so many of all possible terms is counted beforehand.
ONE_IN = 64
#: Documents whose words are Python objects at a time.
PIECE_DOCS = 128
#: Shares of a chunk that are held at a time: its terms times the sources of its language.
CHUNK_CELLS = 1 << 17
#: Sources of a language that one chunk compares with all others.
CHUNK_SOURCES = 256
_ALL_TERMS = 2**31 - 1
#: Stands after a term and before its language; no term holds it.
_MARK = "\0"


#: Lower-cases A-Z and turns all other ASCII but letters into spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _marked(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """``lang, source, terms`` of every document; terms carry their language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, PIECE_DOCS):
                yield piece(b.slice(start, PIECE_DOCS))

    def piece(b: pa.RecordBatch) -> pa.RecordBatch:
        words, ends = [], [0]
        for lang, text in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            mark = _MARK.encode() + lang
            words += [w + mark for w in text.as_py().translate(_FOLD).split()]
            ends.append(len(words))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.binary()).cast(pa.string()))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["lang", "source", "terms"])

    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), text_or_empty(f"`{text_col}`").alias("t"))
    return rows.mapInArrow(cut, "lang string, source string, terms array<string>")


def _vocabulary(rows: DataFrame, min_df: int) -> list[str]:
    """The kept terms of ``rows``, marked with their language."""
    # A vocabulary must not be empty; no document has this term.
    spare = rows.sparkSession.range(min_df).select(F.array(F.lit(_MARK)).alias("terms"))
    counter = CountVectorizer(inputCol="terms", outputCol="v", minDF=float(min_df), vocabSize=_ALL_TERMS)
    return counter.fit(rows.select("terms").unionByName(spare)).vocabulary


def _sums(rows: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``lang, source, i, n``: the documents' count vectors, summed per group as they are made."""
    shared = rows.sparkSession.sparkContext.broadcast(pa.array(vocabulary, pa.string()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        width = len(known)
        for b in batches:
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            place = {g: k for k, g in enumerate(dict.fromkeys(pairs))}
            group = np.array([place[g] for g in pairs], dtype=np.int64)
            index = pc.index_in(b.column(2).flatten(), known)
            kept = index.is_valid().to_numpy(zero_copy_only=False)
            entries = np.repeat(group, pc.list_value_length(b.column(2)).to_numpy())[kept] * width
            entries, counts = np.unique(entries + index.drop_null().to_numpy(), return_counts=True)
            own = pa.array(entries // width)
            columns = [pa.array([g[j] for g in place], pa.string()).take(own) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(entries % width, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "source", "i", "n"]
            )

    partial = rows.select("lang", "source", "terms").mapInArrow(add, "lang string, source string, i int, n long")
    return partial.groupBy("lang", "source", "i").agg(F.sum("n").alias("n"))


def _kept_terms(rows: DataFrame, min_df: int) -> int:
    """About how many terms are kept, from all documents and one in ``ONE_IN`` of all terms."""
    told = rows.select(F.monotonically_increasing_id().alias("row"), F.explode("terms").alias("t"))
    told = told.filter(F.pmod(F.xxhash64("t"), F.lit(ONE_IN)) == 0).distinct()
    return ONE_IN * told.groupBy("t").count().filter(F.col("count") >= min_df).count()


def _slice(slices: int, k: int) -> Column:
    return F.filter("terms", lambda t: F.pmod(F.xxhash64(t, F.lit(slices)), F.lit(slices)) == k)


def group_counts(rows: DataFrame, min_df: int = MIN_DF, max_terms: int = MAX_TERMS) -> tuple[DataFrame, DataFrame]:
    """``lang, source, tid, term, n`` with the occurrences of kept terms, and ``lang, tid`` of all kept ones.

    ``rows`` has ``lang, source, terms``, a row per document.
    """
    slices = -(-_kept_terms(rows, min_df) // max_terms) or 1
    parts = [rows]
    if slices > 1:
        every = F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), _slice(slices, k).alias("terms")) for k in range(slices)]))
        cut = rows.select("lang", "source", every.alias("x")).select("x.slice", "lang", "source", "x.terms")
        place = shared_dir(rows.sparkSession, "slices")
        cut.write.partitionBy("slice").parquet(place)
        schema = "lang string, source string, terms array<string>"
        parts = [rows.sparkSession.read.schema(schema).parquet(f"{place}/slice={k}") for k in range(slices)]
    counts, kept = [], []
    for k, part in enumerate(parts):
        found = _vocabulary(part, min_df)
        named = [(i, *t.split(_MARK, 1)) for i, t in enumerate(found) if t != _MARK]
        columns = zip(*named, strict=True) if named else ([], [], [])
        kinds = (pa.int32(), pa.string(), pa.string())
        vocabulary = pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["i", "term", "lang"])
        vocabulary = stored(rows.sparkSession.createDataFrame(vocabulary), "vocabulary")
        sums = _sums(part, found)
        number = (F.col("i") + F.lit(k << 32)).alias("tid")
        counts.append(sums.join(vocabulary.drop("lang"), "i").select("lang", "source", number, "term", "n"))
        kept.append(vocabulary.select("lang", number))
    for k in range(1, slices):
        counts[0], kept[0] = counts[0].unionByName(counts[k]), kept[0].unionByName(kept[k])
    return stored(counts[0], "term-counts"), kept[0]


def share(n: str, total: str, v: str) -> Column:
    """The smoothed share of ``n`` occurrences of ``total`` over ``v`` terms, in units of 1 / ``SCALE``."""
    top = f"(CAST({n} AS DECIMAL(20, 0)) + {SMOOTHING}) * {SCALE}"
    return F.expr(f"1 + ({top}) div (CAST({total} AS DECIMAL(20, 0)) + {SMOOTHING} * CAST({v} AS DECIMAL(20, 0)))")


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for sources ``a < b`` of a language."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v")).select(
        "lang",
        F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("sources") / CHUNK_CELLS)).cast("int").alias("chunks"),
        F.ceil(F.col("sources") / CHUNK_SOURCES).cast("int").alias("parts"),
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = F.pmod(F.xxhash64("source"), F.col("parts")).cast("int").alias("mine")
    absent = groups.join(sizes, "lang").withColumn("chunk", every("chunks")).withColumn("part", every("parts")).select(
        "lang", "chunk", "part", mine, "source", F.lit(None).cast("long").alias("t"),
        F.when(F.col("v") > 0, F.col("p0")).otherwise(0).alias("p"),
    )
    present = shares.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("tid"), F.col("chunks")).cast("int").alias("chunk"), "parts", "source",
        F.col("tid").alias("t"), "p",
    )
    present = present.withColumn("part", every("parts")).select("lang", "chunk", "part", mine, "source", "t", "p")

    def compare(table: pa.Table) -> pa.Table:
        marks = table.filter(pc.is_null(table["t"])).sort_by("source")
        names = marks["source"].to_pylist()
        p0 = marks["p"].to_numpy()
        rest = table.filter(pc.is_valid(table["t"]))
        place = {s: i for i, s in enumerate(names)}
        kinds = rest["source"].combine_chunks().dictionary_encode()
        kinds = kinds.combine_chunks() if isinstance(kinds, pa.ChunkedArray) else kinds
        rows = np.array([place[s] for s in kinds.dictionary.to_pylist()], dtype=int)[kinds.indices.to_numpy()] if rest.num_rows else []
        known, columns = np.unique(rest["t"].to_numpy(), return_inverse=True)
        p = np.repeat(p0[:, None], len(known), axis=1)
        p[rows, columns] = rest["p"].to_numpy()
        own = np.flatnonzero(marks["mine"].to_numpy() == marks["part"].to_numpy())
        one, two, value = [], [], []
        for i in own:
            one += [names[i]] * (len(names) - i - 1)
            two += names[i + 1 :]
            value.append(np.abs(p[i + 1 :] - p[i]).sum(axis=1))
        values = np.concatenate(value) if value else np.zeros(0, dtype=np.int64)
        lang = pa.array([table["lang"][0].as_py()] * len(values), pa.string())
        return pa.table(
            {"lang": lang, "a": pa.array(one, pa.string()), "b": pa.array(two, pa.string()), "value": pa.array(values, pa.int64())}
        )

    partial = absent.unionByName(present).groupBy("lang", "chunk", "part").applyInArrow(
        compare, "lang string, a string, b string, value long"
    )
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_df: int = MIN_DF,
    top: int = TOP, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: how far the source is from each other one of its language, all of
    them. Part ``term``: the terms that it has more of than its language, the ``top``
    of them.
    """
    rows = stored(_marked(docs, lang_col, source_col, text_col), "terms")
    counts, kept = group_counts(rows, min_df, max_terms)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v")])
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "total", "v"))), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    shares = counts.join(groups, ["lang", "source"]).join(langs, "lang").withColumn(
        "lang_n", F.sum("n").over(Window.partitionBy("tid"))
    )
    shares = stored(
        shares.select(
            "lang", "source", "tid", "term", share("n", "total", "v").alias("p"), share("lang_n", "lang_total", "v").alias("q")
        ),
        "shares",
    )
    found = _pairs(shares, groups)
    either = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = found.select("lang", either.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    over = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    out = ranked(pairs).unionByName(ranked(over).filter(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))

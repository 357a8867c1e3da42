"""Token-id files with Elias-Fano coded document boundaries (operator 10).

Documents are put in id order by range partitioning, encoded, and written as
segments of some million ids. A segment is one binary value:

    magic "EFT1" | ids' width in bytes u8 | low bits u8 | 0 u16 | documents u32 | ids u64
    | select samples u32 each | high bits | low bits | ids, little endian

Boundaries are the ends of documents in the concatenated ids, a rising sequence.
Each is split: the low bits are packed as they are, the high part is written in
unary, so a document costs about two bits plus the logarithm of its mean length.
The position of every ``SAMPLE``-th one bit is kept, so ``select`` scans a bounded
stretch. Segments are Parquet rows with the documents' ids beside them, since
Spark reads and writes those on any store, also where executors share no folder.

Texts go whole to the tokenizers library. Byte-level BPE splits a text into words and
merges inside each; here the library is told to split into runs of words instead where
no merge of the vocabulary could join two neighbours, which gives the same ids from
far fewer pieces. See ``RUNS``; a vocabulary for which it may not hold keeps its words.

Defined results: a NULL text is empty and holds the end id only; NULL ids come
first; rows that repeat an id are in text order; no rows give no segments.
"""

from __future__ import annotations

import array
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.functions.shared import shared_dir
from clipledger.llm.common import text_or_empty

END_ID = 0
MAGIC = b"EFT1"
HEAD = struct.Struct("<4sBBHIQ")
SAMPLE = 256
#: Ids per segment; a segment ends with the document that reaches it.
SEGMENT_IDS = 2 << 20
#: Bytes of text handed to the tokenizer at a time.
PIECE_BYTES = 1 << 20
#: Most words in a run.
RUN_WORDS = 24

#: How the library's ByteLevel splits a text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Those of its words that a run may hold: each is what WORDS matches at its place. Symbols with an apostrophe
#: and white space of more than one character stay words of their own.
IN_RUN = r"(?: ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}']++(?!'))|[\t\n\r](?=[!-~])|'(?:[stmd]|re|ve|ll)(?!\p{L}))"
#: A run goes on before a space, or between two ASCII characters; ``joins_words`` tells which merges may not be then.
GOES_ON = r"(?:(?= )|(?<=[!-~\t\n\r])(?=[!-~\t\n\r]))"
RUNS = rf"(?>{IN_RUN}(?:{GOES_ON}{IN_RUN}){{0,{RUN_WORDS - 1}}})|{WORDS}"


class EliasFano:
    """A rising sequence of integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        low_bits = max(0, (most // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[at] = 1
        low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(bits), np.packbits(low.astype(np.uint8).ravel()), at[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low parts of rising numbers, from the bytes between the first and the last."""
        if not len(i):
            return np.zeros(0, dtype=np.int64)
        first, last = int(i[0]) * self.low_bits, (int(i[-1]) + 1) * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3])[first & 7 :][: last - first]
        bits = bits.reshape(int(i[-1] - i[0]) + 1, self.low_bits)
        return bits[i - i[0]].astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high))
        return ((ones - np.arange(self.n)) << self.low_bits) + self._low(np.arange(self.n))

    def select(self, i: int) -> int:
        """The ``i``-th value, from the sample before it."""
        at = int(self.samples[i // SAMPLE])
        byte, left = at >> 3, i % SAMPLE
        chunk = np.unpackbits(self.high[byte : byte + 64])
        chunk[: at & 7] = 0
        while left >= (ones := int(chunk.sum())):
            left -= ones
            byte += 64
            chunk = np.unpackbits(self.high[byte : byte + 64])
        high = (byte << 3) + int(np.flatnonzero(chunk)[left]) - i
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first >> 3 : (first + self.low_bits + 7) >> 3])[first & 7 :][: self.low_bits]
        return (high << self.low_bits) + int(bits.astype(np.int64) @ (np.int64(1) << np.arange(len(bits), dtype=np.int64)))

    def select_many(self, numbers: np.ndarray) -> np.ndarray:
        """The values of rising ``numbers``; those with the same sample share the stretch from it to the next."""
        numbers = np.asarray(numbers, dtype=np.int64)
        found = np.zeros(len(numbers), dtype=np.int64)
        stretches = numbers // SAMPLE
        for k in np.unique(stretches):
            first, last = np.searchsorted(stretches, [k, k + 1])
            at = int(self.samples[k])
            end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
            bits = np.unpackbits(self.high[at >> 3 : (end + 7) >> 3])
            bits[: at & 7] = 0
            i = numbers[first:last]
            found[first:last] = ((np.flatnonzero(bits)[i - k * SAMPLE] + (at >> 3 << 3) - i) << self.low_bits) + self._low(i)
        return found


def pack(ids: bytes, width: int, ends: np.ndarray) -> bytes:
    ef = EliasFano.of(ends)
    head = HEAD.pack(MAGIC, width, ef.low_bits, 0, ef.n, len(ids) // width)
    return b"".join([head, ef.samples.tobytes(), struct.pack("<I", len(ef.high)), ef.high.tobytes(), ef.low.tobytes(), ids])


class Segment:
    """A packed segment; documents are read by their number."""

    def __init__(self, data: bytes):
        magic, width, low_bits, _, n, total = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        at += samples.nbytes
        (n_high,) = struct.unpack_from("<I", data, at)
        high = np.frombuffer(data, np.uint8, n_high, at + 4)
        at += 4 + n_high
        low = np.frombuffer(data, np.uint8, (n * low_bits + 7) // 8, at)
        self.ends = EliasFano(n, low_bits, high, low, samples)
        self.ids = np.frombuffer(data, f"<u{width}", total, at + len(low))

    def document(self, i: int) -> np.ndarray:
        start = self.ends.select(i - 1) if i else 0
        return self.ids[start : self.ends.select(i)]

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each document starts and ends in ``ids``, by select from the samples."""
        ends = self.ends.select_many(np.arange(self.ends.n))
        return np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)], ends


def _kind(char: str) -> str | None:
    """Of a character of a byte-level token: letter, number, symbol, apostrophe, white space, or none of ASCII's."""
    if "!" <= char <= "~":
        return "letter" if char.isalpha() else "number" if char.isdigit() else "'" if char == "'" else "symbol"
    return "space" if char == "Ġ" else "white" if char in "ĉĊč" else None


def joins_words(left: str, right: str) -> bool:
    """Whether the merge of two byte-level tokens may reach across a place where ``RUNS`` goes on.

    Words of a run have no space but as their first character, and no white space after it, such as a no-break space.
    """
    a, b = _kind(left[-1]), _kind(right[0])
    if b == "space":
        return a not in ("space", "white") and not right.startswith("ĠÂł")
    return a in ("letter", "number", "symbol", "white") and b is not None and a != b and (a, b) != ("symbol", "'")


def _runs_give_its_ids(settings: dict, alphabet: list[str]) -> bool:
    """Whether a tokenizer file asks for byte-level words and plain merges, none of which joins words of a run."""
    words, model = settings["pre_tokenizer"] or {}, settings["model"]
    if words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True):
        return False
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if model.get("type") != "BPE" or any(model.get(k) for k in odd) or not model["vocab"].keys() >= set(alphabet):
        return False
    return not any(joins_words(*(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"])


_ENCODERS: dict[str, _Encoder] = {}


class _Encoder:
    """Ids of whole texts from the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            if _runs_give_its_ids(json.load(f), ByteLevel.alphabet()):
                as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
                self.model.pre_tokenizer = Sequence([Split(Regex(RUNS), "isolated"), as_bytes])
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.model.encode_batch_fast(texts, add_special_tokens=False):
            yield array.array(self.code, e.ids).tobytes()


def _pieces(texts: pa.StringArray) -> Iterator[slice]:
    """Runs of texts of some ``PIECE_BYTES`` together; a longer text is alone."""
    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1), len(texts)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _encoder(path: str) -> _Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def write_segments(
    docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Writes ``part, segment, doc_ids, n_ids, payload`` rows to ``path``."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), text.alias("t"))
    # The checksum lets rows that repeat an id be dealt to several tasks.
    ordered = rows.repartitionByRange("id", "crc").sortWithinPartitions("id", "crc", "t").select("id", "t")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(vocabulary)
        end = END_ID.to_bytes(coder.width, "little")
        part, number = TaskContext.get().partitionId(), 0
        ids, ends, out, size = [], [], [], 0

        def flush():
            nonlocal ids, ends, out, size, number
            payload = pack(b"".join(out), coder.width, np.array(ends, dtype=np.uint64))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([size], pa.int64()), pa.array([payload], pa.binary())],
                names=["part", "segment", "doc_ids", "n_ids", "payload"],
            )
            ids, ends, out, size, number = [], [], [], 0, number + 1
            return batch

        for b in batches:
            for piece in _pieces(b.column(1)):
                texts = b.column(1)[piece.start : piece.stop].to_pylist()
                doc_ids = b.column(0)[piece.start : piece.stop].to_pylist()
                for doc_id, coded in zip(doc_ids, coder.encode(texts), strict=True):
                    size += len(coded) // coder.width + 1
                    ids.append(doc_id)
                    ends.append(size)
                    out += (coded, end)
                    if size >= segment_ids:
                        yield flush()
        if ids:
            yield flush()

    schema = "part int, segment int, doc_ids array<bigint>, n_ids bigint, payload binary"
    ordered.mapInArrow(encode, schema).write.parquet(path)


def read_documents(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the segments."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                seg = Segment(b.column("payload")[row].as_py())
                starts, ends = seg.bounds()
                wide = seg.ids.astype("<u4")
                crc = [zlib.crc32(wide[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("part")[row].as_py()] * n, pa.int32()),
                     pa.array([b.column("segment")[row].as_py()] * n, pa.int32()), b.column("doc_ids")[row].values,
                     pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["part", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = segments.select("part", "segment", "doc_ids", "payload").mapInArrow(
        decode, "part int, segment int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # Ids before a segment: a running sum over the parts, then one inside each part.
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    bases = segments.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("base"))
    bases = bases.join(parts, "part").select("part", "segment", (F.col("base") + F.col("part_start")).alias("base"))
    return read.join(bases, ["part", "segment"]).select(
        "doc_id", (F.col("base") + F.col("inside")).cast("long").alias("start"), "n_tokens", "ids_crc32"
    )


def token_output(docs: DataFrame, vocabulary: str, path: str | None = None, **how) -> DataFrame:
    """Writes the segments (to a shared folder by default), reads them back and tells what they hold."""
    spark = docs.sparkSession
    if path is None:
        path = shared_dir(spark, "token-segments")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    write_segments(docs, path, vocabulary, **how)
    schema = "part int, segment int, doc_ids array<bigint>, n_ids bigint, payload binary"
    return read_documents(spark.read.schema(schema).parquet(path))

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from clipledger.llm.token_output import EliasFano, Segment, _Encoder, _pieces, pack, token_output

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coder():
    return _Encoder(VOCABULARY)


@pytest.mark.parametrize("n,step", [(0, 1), (1, 5), (700, 0), (700, 1), (900, 50), (3000, 4000)])
def test_boundaries_round_trip(n, step):
    rng = np.random.default_rng(n + step)
    values = np.cumsum(rng.integers(0, step + 1, n)).astype(np.uint64)
    ef = EliasFano.of(values)
    assert ef.values().tolist() == values.tolist()
    assert [ef.select(i) for i in range(n)] == values.tolist()
    if n and values[-1]:
        bits = 8 * (len(ef.high) + len(ef.low))
        assert bits <= n * (3 + max(0, np.log2(int(values[-1]) / n))) + 16


def test_segment_round_trip():
    docs = [np.arange(k, dtype="<u2") for k in (3, 0, 5, 1)]
    seg = Segment(pack(b"".join(d.tobytes() for d in docs), 2, np.cumsum([len(d) for d in docs])))
    assert [seg.document(i).tolist() for i in range(4)] == [d.tolist() for d in docs]


def test_pieces_of_a_batch_are_whole_texts(coder):
    """Texts handed over together give the ids of each alone; a long text is one piece."""
    rng = random.Random(2)
    parts = ["a", "bc", " ", " ", "  ", "\n", "\t", "'s", "12", "...", "é", "\u00a0", "<|endoftext|>", "ß", "🙂", "e\u0301", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(500)]
    texts += ["word " * (1 << 18), "", "x" * (1 << 20), "tail"]
    pieces = list(_pieces(pa.array(texts)))
    assert [i for p in pieces for i in range(p.start, p.stop)] == list(range(len(texts)))
    assert 3 <= len(pieces) <= 8
    got = [c for p in pieces for c in coder.encode(texts[p])]
    alone = [np.array(coder.model.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts[:500]]
    assert got[:500] == alone and len(got) == len(texts)


@pytest.mark.parametrize("n,step", [(0, 1), (1, 5), (256, 1), (257, 0), (700, 0), (900, 50), (3000, 4000)])
def test_bounds_come_by_select(monkeypatch, n, step):
    rng = np.random.default_rng(n + step)
    ends = np.cumsum(rng.integers(0, step + 1, n)).astype(np.int64)
    seg = Segment(pack(np.zeros(int(ends[-1]) if n else 0, dtype="<u2").tobytes(), 2, ends))
    some = np.flatnonzero(rng.random(n) < 0.05)
    assert seg.ends.select_many(some).tolist() == ends[some].tolist()
    monkeypatch.delattr(EliasFano, "values")
    starts, got = seg.bounds()
    assert got.tolist() == ends.tolist()
    assert starts.tolist() == [0, *ends.tolist()][:n]


def test_files_with_no_break_spaces(documents, coder):
    rows = [(1, "a b", "en", "a"), (2, "one \u00a0 \u00a0 two" + " \u00a0" * 9, "en", "a"), (3, "c d", "en", "b")]
    got = [tuple(r) for r in token_output(documents(rows), VOCABULARY).collect()]
    assert sorted(got, key=lambda r: r[1]) == want(rows, coder)


def want(rows, coder):
    out, start = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r[1] or ""))
    for doc_id, text, *_ in ordered:
        ids = np.array([*coder.model.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment_ids", [1, 50, 1 << 20])
def test_files(documents, awkward, coder, segment_ids):
    df = documents(awkward).repartition(3)
    got = [tuple(r) for r in token_output(df, VOCABULARY, segment_ids=segment_ids).collect()]
    assert sorted(got, key=lambda r: r[1]) == want(awkward, coder)


def test_clashing_columns_and_empty_table(clashing, documents, awkward, coder):
    got = [tuple(r) for r in token_output(clashing, VOCABULARY).collect()]
    assert sorted(got, key=lambda r: r[1]) == want(awkward, coder)
    assert token_output(documents([]), VOCABULARY).count() == 0


#: Letters, numbers, symbols, apostrophes and white space of one byte and more, control characters, half-width forms.
ODD = [
    "a", "B", "the", "é", "É", "ñ", "ß", "中", "の", "я", "ʼ", "ª", "1", "42", "٣", "½", "Ⅷ", "'", "''", "'s", "'re", "'ll", "'S",
    "’s", ".", ",", "...", "(", "—", "…", "€", "Â", "ł", "Ġ", "Ċ", "🙂", "\u0301", "\u200d", " ", " ", " ", "  ", "\n", "\n\n", "\t",
    "\r\n", "\v", "\f", "\x1c", "\x00", "\x7f", "\x85", "\u00a0", " \u00a0", "\u2003", "\u2028", "\u3000", "\ufeff", "<|endoftext|>",
]


def test_runs_of_words_give_the_ids_of_words(coder):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(7)
    texts = [a + b + c for a in ODD for b in ODD for c in ("", " ", "'s", "x", "\u00a0")]
    texts += ["".join(rng.choices(ODD, k=rng.randint(3, 40))) for _ in range(6000)]
    texts += ["".join(rng.choices("st '.\n1é", k=rng.randint(3, 60))) for _ in range(6000)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_run_is_one_piece_for_the_library(coder):
    pieces = coder.model.pre_tokenizer.pre_tokenize_str("It's the café with 2 doors, (red)\nand\tblue")
    assert len(pieces) == 1
    assert len(coder.model.pre_tokenizer.pre_tokenize_str("word " * 1000)) < 50


@pytest.mark.parametrize(
    "left,right,text",
    [("e", "Ġt", "one two three"), ("e", "1", "e1 e1"), (".", "s", ".s a.s"), ("Ċ", "a", "b\na"), ("©", "Ġ", "é é"), ("n", "'", "n't")],
)
def test_merges_across_words_keep_the_words(tmp_path, left, right, text):
    from tokenizers import Tokenizer

    settings = json.load(open(VOCABULARY, encoding="utf-8"))
    settings["model"]["vocab"] |= {"Ġt": settings["model"]["vocab"]["Ġt"], left + right: 50300}
    at = 1 if right == "Ġt" else 0
    settings["model"]["merges"].insert(at, [left, right])
    path = tmp_path / "crossing.json"
    path.write_text(json.dumps(settings), encoding="utf-8")
    plain, crossing = Tokenizer.from_file(str(path)), _Encoder(str(path))
    (got,) = crossing.encode([text])
    assert np.frombuffer(got, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert len(crossing.model.pre_tokenizer.pre_tokenize_str("one two three")) == 3

import numpy as np
import pyarrow as pa
import pytest

from rowsift.llm import wavelet
from rowsift.llm.wavelet import NO_ID, Tokenizer, WaveletMatrix, build, token_shards

from .conftest import frame, prose


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000, 5000])
def test_access_rank_select_are_those_of_an_array(n, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 256)
    r = np.random.default_rng(n)
    t = r.integers(0, 60, n)
    m = WaveletMatrix(build(t, np.array([0]), np.array([1]), 6))
    assert len(m) == n and m.tokens().tolist() == t.tolist()
    for i in r.integers(0, max(1, n), 30 if n else 0):
        assert m.access(int(i)) == t[i]
    for x in range(0, 64, 7):
        where = np.flatnonzero(t == x)
        assert m.count(x) == len(where)
        a, z = sorted(r.integers(0, n + 1, 2).tolist())
        assert m.count(x, a, z) == int((t[a:z] == x).sum()) and m.rank(x, z) == int((t[:z] == x).sum())
        assert m.occurrences(x) == where.tolist()
    assert m.count(1 << 20) == 0 and m.count(-1) == 0
    for bad in (-1, n):
        with pytest.raises(IndexError):
            m.access(bad)
    with pytest.raises(IndexError):
        m.select(3, m.count(3))


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        WaveletMatrix(b"something else" * 10)


def test_chunks_encode_as_whole_texts():
    texts = ["", "a", "  two  blanks", "don't\tstop\n\nnow ", "Zahl 12345 é ü 日本 語 nbsp  em", "x\x1c y", "line\r\n  indented", None, prose(1, 500), "1  2   3\n \n4", "　 wide", "🙂 🙂🙂  end  "]
    tok = Tokenizer(wavelet.vocabulary_path())
    ids, at = tok.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tok.encoding.encode_ordinary(t or "")


def test_distinct_chunks_are_encoded_together():
    tok, calls = Tokenizer(wavelet.vocabulary_path()), []

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return whole(text)

    whole, tok.encoding = tok.encoding.encode_ordinary, Counted()
    texts = [prose(i, 200) for i in range(20)] + [f"w{i}" for i in range(200)] + ["ends in blanks  ", "\u3000wide", "'s first"]
    ids, at = tok.encode(pa.array(texts))
    assert len(calls) < 10
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole(t)


def test_chunks_in_any_mixture_encode_as_whole_texts():
    tok, r = Tokenizer(wavelet.vocabulary_path()), np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "a", "The", "é", "日", "か", "12", ".", "'s", "'", "“", "🙂", "\x00", "x" * 70]
    for _ in range(200):
        texts = ["".join(r.choice(parts, r.integers(0, 12))) for _ in range(20)]
        ids, at = tok.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encoding.encode_ordinary(t)


def test_long_chunks_of_one_hash_are_told_apart():
    a, b = "a", "b"
    for _ in range(12):  # Thue-Morse texts: equal under any polynomial hash modulo 2^64
        a, b = a + b, b + a
    tok = Tokenizer(wavelet.vocabulary_path())
    ids, at = tok.encode(pa.array([a, b]))
    assert [tok.encoding.decode(ids[at[i] : at[i + 1]].tolist()) for i in (0, 1)] == [a, b]


def test_round_trip_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    tok, seen = Tokenizer(wavelet.vocabulary_path()), []
    for row in token_shards(docs, shard_bytes=100_000).collect():
        m = WaveletMatrix(bytes(row.file))
        t = m.tokens()
        assert len(t) == row.n_tokens and len(m.doc_ids) == row.n_docs and len(row.file) == row.n_bytes and m.doc_ids[0] == row.first_doc
        for k, doc in enumerate(m.doc_ids.tolist()):
            a, z = m.document(k)
            assert tok.encoding.decode(t[a:z].tolist()) == texts[doc]
            seen.append(doc)
    assert sorted(seen) == sorted(texts)


def test_shards_close_at_documents(spark):
    docs = frame(spark, [(i, prose(i, 50)) for i in range(100)]).coalesce(1)
    rows = token_shards(docs, shard_bytes=5000).collect()
    assert len(rows) > 3 and [r.shard_id for r in rows] == sorted(r.shard_id for r in rows) and sum(r.n_docs for r in rows) == 100


def test_edges_of_shards(spark, edges, edge_rows, nothing, nulls_only):
    tok, got = Tokenizer(wavelet.vocabulary_path()), []
    for row in token_shards(edges).collect():
        m = WaveletMatrix(bytes(row.file))
        t = m.tokens()
        for k, doc in enumerate(m.doc_ids.tolist()):
            a, z = m.document(k)
            got.append((None if doc == NO_ID else doc, tok.encoding.decode(t[a:z].tolist())))
    assert sorted(got, key=str) == sorted([(i, t or "") for i, t in edge_rows], key=str)
    assert token_shards(nothing).count() == 0
    (row,) = token_shards(nulls_only.coalesce(1)).collect()
    assert (row.n_docs, row.n_tokens, row.first_doc) == (2, 0, None)

"""Token-ID output: one wavelet matrix per shard.

Texts are tokenised by a public byte-level BPE vocabulary; each shard's token ids become a wavelet matrix: bit plane after
bit plane, highest bit first, each sorted stably by the bits before it.  Planes are stored in compressed blocks
with the number of ones before each block, so access, rank (counting) and select (occurrence lookup) open one block a
plane.

File layout: magic, then little-endian uint64 counts (tokens, documents, bits, blocks a plane, block bits), the documents' first
token positions and ids, the zeros of each plane, the ones before each block, the blocks' offsets, then the blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import ragged_take, substring_hashes, text_buffers

MAGIC = b"WVLT0001"
BLOCK_BITS = 1 << 17
#: A shard is closed at the first document end from so many bytes of text on.
SHARD_BYTES = 8_000_000
#: Longer chunks are encoded each for itself: polynomials modulo 2^64 name some texts of a kilobyte alike.
NAMED_BYTES = 64
VOCABULARY = "byte_bpe_50k.tiktoken"
NO_ID = -(2**63)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Tokenizer:
    """Byte-level BPE over chunks of blanks and the non-blanks behind them.

    The vocabulary's pattern never joins what such a cut separates, so chunks encode as they would within the text.
    Of equal chunks of a slice one is encoded.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("shard", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.top = max(ranks.values())
        self.width = np.zeros(self.top + 1, dtype=np.int64)
        self.width[list(ranks.values())] = [len(x) for x in ranks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, and where each text begins (one more entry than texts)."""
        buf, offs = text_buffers(texts)
        start, end = chunks(buf, offs)
        if not len(start):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offs), dtype=np.int64)
        named = end - start <= NAMED_BYTES
        _, where, at = np.unique(substring_hashes(buf, start[named], end[named]), return_index=True, return_inverse=True)
        pick = np.concatenate([np.flatnonzero(named)[where], np.flatnonzero(~named)])
        inverse = np.empty(len(start), dtype=np.int64)
        inverse[named], inverse[~named] = at, np.arange(len(where), len(pick))
        flat, first, size = self._encode_chunks(buf, start[pick], end[pick])
        n = size[inverse]
        at = np.cumsum(n) - n
        total = int(n.sum())
        out = flat[np.arange(total) - np.repeat(at, n) + np.repeat(first[inverse], n)]
        return out, np.append(at, total)[np.searchsorted(start, offs)]

    def _encode_chunks(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token ids, and where in them each chunk's begin and how many they are.

        Chunks that surely end in no blank are encoded in one call: those that begin with a blank follow the one before
        as they are, and those that surely begin with none follow a line feed, which the pattern keeps apart.
        """
        blank = _BLANK[buf[start]]
        joined = ~_maybe_blank(buf, end) & (blank | _SURE_FIRST[buf[start]])
        one, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        gap = ~blank[one]
        gap[:1] = False
        length = end[one] - start[one]
        till = np.cumsum(length + gap)
        text = np.full(int(till[-1]) if len(one) else 0, 10, dtype=np.uint8)
        inside = np.ones(len(text), dtype=bool)
        inside[(till - length - gap)[gap]] = False
        text[inside] = ragged_take(buf, start[one], length)
        ids = [self._ids(text.tobytes()), *(self._ids(buf[start[i] : end[i]].tobytes()) for i in rest)]
        first, size = np.empty(len(start), dtype=np.int64), np.empty(len(start), dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum(self.width[ids[0]])])  # bytes before each token
        first[one] = np.searchsorted(upto, till - length)
        size[one] = np.searchsorted(upto, till) - first[one]
        size[rest] = [len(x) for x in ids[1:]]
        first[rest] = len(ids[0]) + np.cumsum(size[rest]) - size[rest]
        return np.concatenate(ids), first, size

    def _ids(self, raw: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(raw.decode("utf-8")), dtype=np.int32)


def chunks(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that begin at a text's start, and at every ASCII blank behind what surely is no blank."""
    if not len(buf):
        return (np.zeros(0, dtype=np.int64),) * 2
    cut = _BLANK[buf]
    cut[0] = True
    at = np.flatnonzero(cut[1:]) + 1
    cut[at[_maybe_blank(buf, at)]] = False
    begin = offs[:-1][offs[1:] > offs[:-1]]
    cut[begin] = True
    start = np.flatnonzero(cut)
    return start, np.append(start[1:], len(buf))


def _maybe_blank(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place, 1 or more, may be a blank."""
    before, two, three = buf[at - 1], buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    return _UNSURE[before] | (before >= 128) & ((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_UNSURE = _BLANK.copy()
_UNSURE[28:32] = True
_SURE_FIRST = ~_UNSURE
_SURE_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def build(tokens: np.ndarray, doc_starts: np.ndarray, doc_ids: np.ndarray, bits: int) -> bytes:
    """The file of a shard; ``doc_starts`` are the first token positions of its documents."""
    n = len(tokens)
    per_plane = max(1, -(-n // BLOCK_BITS))
    zeros, ones, blocks = np.zeros(bits, dtype=np.uint64), np.zeros((bits, per_plane), dtype=np.uint64), []
    pack = zstandard.ZstdCompressor(level=1)
    seq = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits):
        bit = (seq >> (bits - 1 - level)) & 1 != 0
        packed = np.packbits(bit, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, max(1, len(packed)), BLOCK_BITS // 8), dtype=np.uint64) if n else np.zeros(1, dtype=np.uint64)
        ones[level] = np.cumsum(counts) - counts
        low = ~bit
        zeros[level] = np.count_nonzero(low)
        for i in range(per_plane):
            raw = packed[i * BLOCK_BITS // 8 : (i + 1) * BLOCK_BITS // 8].tobytes()
            z = pack.compress(raw)
            blocks.append(b"\1" + z if len(z) < len(raw) else b"\0" + raw)
        seq = np.concatenate([seq[low], seq[bit]])
    offsets = np.cumsum([0, *map(len, blocks)]).astype(np.uint64)
    head = np.array([n, len(doc_starts), bits, per_plane, BLOCK_BITS], dtype="<u8")
    parts = [MAGIC, head, np.asarray(doc_starts, dtype="<u8"), np.asarray(doc_ids, dtype="<i8"), zeros.astype("<u8"), ones.astype("<u8").ravel(), offsets.astype("<u8")]
    return b"".join([p if isinstance(p, bytes) else p.tobytes() for p in parts] + blocks)


class WaveletMatrix:
    """Reader of one file; decompresses only the blocks that a question touches."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix file")
        self.data = data
        self.n, docs, self.bits, self.per_plane, self.block = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        at = 48

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += 8 * count
            return out

        self.doc_starts, self.doc_ids = take("<u8", docs).astype(np.int64), take("<i8", docs)
        self.zeros = take("<u8", self.bits).astype(np.int64)
        self.ones = take("<u8", self.bits * self.per_plane).reshape(self.bits, self.per_plane).astype(np.int64)
        self.offsets = take("<u8", self.bits * self.per_plane + 1).astype(np.int64)
        self.base = at
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def __len__(self) -> int:
        return self.n

    def _bits(self, level: int, block: int) -> np.ndarray:
        key = (level, block)
        if key not in self._open:
            i = level * self.per_plane + block
            raw = self.data[self.base + self.offsets[i] : self.base + self.offsets[i + 1]]
            body = zstandard.ZstdDecompressor().decompress(raw[1:], max_output_size=self.block // 8) if raw[:1] == b"\1" else raw[1:]
            self._open[key] = np.frombuffer(body, dtype=np.uint8)
        return self._open[key]

    def _ones_before(self, level: int, i: int) -> int:
        block, rest = divmod(i, self.block)
        if block == self.per_plane:
            block, rest = block - 1, self.block
        b = self._bits(level, block)
        whole, odd = divmod(rest, 8)
        n = int(self.ones[level, block]) + int(np.bitwise_count(b[:whole]).sum())
        return n + (int(b[whole]) & ((1 << odd) - 1)).bit_count() if odd else n

    def access(self, i: int) -> int:
        """Token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level in range(self.bits):
            block, rest = divmod(i, self.block)
            bit = self._bits(level, block)[rest >> 3] >> (rest & 7) & 1
            token = token << 1 | int(bit)
            one = self._ones_before(level, i)
            i = int(self.zeros[level]) + one if bit else i - one
        return token

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        return (lambda r: r[1] - r[0])(self._range(token, 0, i))

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, z = self._range(token, start, self.n if end is None else end)
        return z - a

    def _range(self, token: int, a: int, z: int) -> tuple[int, int]:
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for level in range(self.bits):
            oa, oz = self._ones_before(level, a), self._ones_before(level, z)
            if token >> (self.bits - 1 - level) & 1:
                a, z = int(self.zeros[level]) + oa, int(self.zeros[level]) + oz
            else:
                a, z = a - oa, z - oz
        return a, z

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence of a token, from 0."""
        a, z = self._range(token, 0, self.n)
        if not 0 <= k < z - a:
            raise IndexError(k)
        i = a + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._find(level, i - int(self.zeros[level]) if one else i, one)
        return i

    def _find(self, level: int, k: int, one: int) -> int:
        """Place of the k-th one or zero of a plane."""
        before = self.ones[level] if one else np.arange(self.per_plane) * self.block - self.ones[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._bits(level, block), bitorder="little")[: self.n - block * self.block]
        return block * self.block + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens, in order: the planes undone from the last to the first."""
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        planes = [np.concatenate([np.unpackbits(self._bits(level, b), bitorder="little") for b in range(self.per_plane)])[: self.n].astype(np.int64) for level in range(self.bits)]
        at, out = np.arange(self.n), np.zeros(self.n, dtype=np.int64)
        for level, bit in enumerate(planes):
            one = np.cumsum(bit) - bit
            here = bit[at]
            out = out << 1 | here
            at = np.where(here == 1, self.zeros[level] + one[at], at - one[at])
        return out

    def document(self, k: int) -> tuple[int, int]:
        """Token range of the k-th document of the shard."""
        return int(self.doc_starts[k]), int(self.doc_starts[k + 1]) if k + 1 < len(self.doc_starts) else self.n


SHARD_ROWS = "shard_id string, n_docs long, first_doc long, n_tokens long, n_bytes long, file binary"


def token_shards(docs: DataFrame, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard_id, n_docs, first_doc, n_tokens, n_bytes, file): the corpus as wavelet-matrix files.

    Documents stay in the order of the input; a shard is a run of documents of one input partition and is made where it lies, so
    nothing is shuffled.  ``shard_id`` is the partition and the number of the shard in it.  Defined cases: null and empty texts are
    documents of no tokens; a null doc_id is kept as -2^63; a long text is never split over shards; repeated
    rows are kept; partitions without rows, and empty tables, give no shard; other columns play no part.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part, number = None, TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            tokens = np.concatenate([t for t, _, _ in held])
            base = np.cumsum([0] + [len(t) for t, _, _ in held])
            starts = np.concatenate([s[:-1] + b for (_, s, _), b in zip(held, base, strict=False)])
            ids = np.concatenate([i for _, _, i in held])
            data = build(tokens, starts, ids, int(tokenizer.top).bit_length())
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}"]), *(pa.array([v], pa.int64()) for v in (len(ids), None if ids[0] == NO_ID else int(ids[0]), len(tokens), len(data))), pa.array([data], pa.binary())], names=names)

        names = [c.split()[0] for c in SHARD_ROWS.split(", ")]
        for batch in batches:
            tokenizer = tokenizer or Tokenizer(path)
            _, offs = text_buffers(batch.column(1))
            at = 0
            while at < batch.num_rows:
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(offs, offs[at] + min(shard_bytes - size, 2_000_000), "left"))))
                rows = batch.slice(at, end - at)
                ids = rows.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held.append((*tokenizer.encode(rows.column(1)), ids))
                size += int(offs[end] - offs[at])
                at = end
                if size >= shard_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SHARD_ROWS)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))

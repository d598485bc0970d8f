"""SimHash near-duplicates by a binary-trie self-join.

Signature.  ``simhash`` (64 bits) sums the hashes of the distinct words of a text; ``check``
(192 bits) does the same for its distinct pairs of neighbouring words and serves to verify.  Texts
with one signature are one node, so exact copies never meet each other in the join.

Join.  Node pairs of a binary trie are traversed together, bit by bit, with the differing bits
accumulated; a pair is pruned as soon as it exceeds the error budget, and small ones are compared
outright.  The budget follows from the cycle lemma: the 64 bits are five blocks with limits t that make
sum(t + 1) = k + 1, so if two signatures differ in at most k bits there is a block from which on, going round,
the first j blocks differ in less than the sum of their t + 1, for every j.  So five turned tries are joined, one from each block,
under that tightening budget, and no pair within k is lost.  A pair counts for the first block that finds it.

Distribution.  A trie is cut below its first block: each subtrie pair of that block, which may differ in t <= 2 bits, meets
under one key.  For t = 1 a signature goes to its own block value and to those with one bit cleared, for t = 2 to its own and to all
with one bit changed; of the keys that two signatures share one counts.  That is 44 copies on average for k = 10, whatever the
size of the input, and a key has about a thousandth of the signatures.  Signatures with equal SimHash are compared by their check words in
squares of ``SQUARE`` rows, spread over the tasks.

Groups.  Tasks hand on spanning forests instead of all pairs; connected components by alternating large-star and small-star
steps over them; each step is a checkpoint, so lineage stays short and lost executors cost one step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_ids, fresh, keep_ids, keyed, settle, table, unkeyed
from .textkit import ALNUM, Tokens, U, gram_hashes, mix, signed, slices, text_buffers

WIDTHS = (14, 13, 13, 12, 12)
STARTS = (0, 14, 27, 40, 52)
MAX_BITS = 10
MAX_CHECK = 64
FRONTIER = 1 << 18
PAIRS_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 200_000
LEAF = 48
SQUARE = 8192
_DOC_BITS = 20


def _bit_sums(values: np.ndarray, first: np.ndarray, words: int) -> np.ndarray:
    """Majority bits of the values of each document; words 64-bit planes from one value each."""
    out = np.zeros((len(first), words), dtype=np.uint64)
    ends = np.append(first[1:], len(values))
    full = ends > first
    if not full.any():
        return out
    starts, sizes = first[full], (ends - first)[full]
    for plane in range(words):
        v = mix(values + U(plane * 0x9E3779B97F4A7C15 % 2**64))
        bits = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full, plane] = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _distinct(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, in document order, and where each document begins.

    Of a hash the upper 44 bits count, whatever else is in the slice, so equal texts get equal signatures everywhere.
    """
    bits = _DOC_BITS
    assert n_docs <= 1 << bits
    key = np.sort((doc.astype(np.uint64) << U(64 - bits)) | (h >> U(bits)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    first = np.searchsorted(key, np.arange(n_docs, dtype=np.uint64) << U(64 - bits))
    return mix(key << U(bits)), first


def signatures_of(texts: pa.Array) -> np.ndarray:
    """n x 4 words: simhash and three check words.  A text without words is stood for by its hash."""
    buf, offs = text_buffers(texts, lower=True)
    tok = Tokens(buf, offs, ALNUM)
    n, doc, h = len(offs) - 1, tok.doc(), tok.hashes()
    out = np.zeros((n, 4), dtype=np.uint64)
    v, first = _distinct(doc, h, n)
    out[:, 0] = _bit_sums(v, first, 1)[:, 0]
    pairs = gram_hashes(h, 2)
    inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, dtype=bool)
    lone = tok.counts == 1
    pd, ph = doc[:-1][inside], pairs[inside]
    if lone.any():
        pd, ph = np.concatenate([pd, np.flatnonzero(lone)]), np.concatenate([ph, h[tok.bounds[:-1][lone]]])
    v, first = _distinct(pd, ph, n)
    out[:, 1:] = _bit_sums(v, first, 3)
    bare = tok.counts == 0
    if bare.any():
        raw = np.array([hash_bytes(buf[offs[i] : offs[i + 1]]) for i in np.flatnonzero(bare)], dtype=np.uint64)
        for j in range(4):
            out[bare, j] = mix(raw + U(j + 1))
    return out


def hash_bytes(b: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b.tobytes())


SIGNATURES = "doc_id long, simhash long, c1 long, c2 long, c3 long"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id and signature of every row with an id and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows=1 << _DOC_BITS):
                s = signatures_of(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(signed(s[:, j].copy())) for j in range(4))], names=["doc_id", "simhash", "c1", "c2", "c3"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null and text is not null").mapInArrow(run, SIGNATURES)


def limits(max_bits: int) -> tuple[int, ...]:
    """Differing bits allowed in each block if the join starts there; -1: it needn't start there."""
    total = max_bits + 1 - len(WIDTHS)
    out = tuple(total // len(WIDTHS) + (i < total % len(WIDTHS)) for i in range(len(WIDTHS)))
    if max(out) > 2:
        raise ValueError("signatures may differ in at most 14 bits")
    return out


def budget(max_bits: int, block: int) -> np.ndarray:
    """Differing bits allowed in the first bits, going round from a block, for each number of bits from 1 to 64."""
    n, out, cap = limits(max_bits), [], -1
    for k in range(len(WIDTHS)):
        i = (block + k) % len(WIDTHS)
        cap += n[i] + 1
        out += [cap] * WIDTHS[i]
    return np.array(out)


def turned(x: np.ndarray, block: int) -> np.ndarray:
    """Signatures turned so that the block comes first."""
    r = STARTS[block]
    return x if r == 0 else (x << U(r)) | (x >> U(64 - r))


def passes(diff: np.ndarray, block: int, max_bits: int) -> np.ndarray:
    """Whether the differences keep to the budget from a block on."""
    if limits(max_bits)[block] < 0:
        return np.zeros(len(diff), dtype=bool)
    d, ok, bits = turned(diff, block), np.ones(len(diff), dtype=bool), 0
    allowed = budget(max_bits, block)
    for k in range(len(WIDTHS)):
        bits += WIDTHS[(block + k) % len(WIDTHS)]
        ok &= np.bitwise_count(d >> U(64 - bits)) <= allowed[bits - 1]
    return ok


def keys_of(s: np.ndarray, block: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys): the keys of a block under which signatures meet."""
    value = (turned(s, block) >> U(64 - WIDTHS[block])).astype(np.int64)
    rows = np.arange(len(s))
    yield rows, value
    for bit in range(WIDTHS[block] if limit else 0):
        flag = 1 << bit
        at = rows if limit == 2 else np.flatnonzero(value & flag)
        yield at, value[at] ^ flag


def meet(key: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether two block values, both sent to the key, count there; they do so under one key if they differ in at most ``limit`` bits."""
    d = a ^ b
    n, low = np.bitwise_count(d), d & -d
    return (n <= limit) & np.where(n == 0, key == a, np.where(n == 1, key == (a & b), key == np.minimum(a ^ low, a ^ d ^ low)))


def trie_join(x: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) below the given pairs of trie nodes that may be within the budget.

    A node is a range of x, sorted there, whose members agree in the first ``depth`` bits; pairs are (from, to, from, to, errors so far).
    A node with itself gives each pair once, i < j.
    """
    ones: dict[int, np.ndarray] = {}

    def split(d: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([[0], np.cumsum((x >> U(63 - d)) & U(1), dtype=np.int64)])
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(depth, *pairs)]
    while stack:
        d, la, ha, lb, hb, err = stack.pop()
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [(d, *(c[:half] for c in (la, ha, lb, hb, err))), (d, *(c[half:] for c in (la, ha, lb, hb, err)))]
            continue
        size = (ha - la) * (hb - lb)
        leaf = (size <= LEAF) | (d == 64)
        for at in _cut(np.flatnonzero(leaf), size):
            which = np.repeat(at, size[at])
            k = np.arange(len(which)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
            i, j = la[which] + k // (hb - lb)[which], lb[which] + k % (hb - lb)[which]
            keep = (la[which] != lb[which]) | (i < j)
            yield i[keep], j[keep]
        la, ha, lb, hb, err = (c[~leaf] for c in (la, ha, lb, hb, err))
        if not len(la):
            continue
        ma, mb, same = split(d, la, ha), split(d, lb, hb), la == lb
        parts = [(la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la, ma, mb, hb, err + 1), tuple(c[~same] for c in (ma, ha, lb, mb, err + 1))]
        la, ha, lb, hb, err = (np.concatenate(c) for c in zip(*parts, strict=True))
        ok = (ha > la) & (hb > lb) & (err <= allowed[d])
        if ok.any():
            stack.append((d + 1, *(c[ok] for c in (la, ha, lb, hb, err))))


def _cut(at: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of ``at`` with at most PAIRS_AT_ONCE pairs, one member at least."""
    total = np.cumsum(size[at])
    a = 0
    while a < len(at):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        yield at[a:z]
        a = z


def forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) edges, one a node at most, that connect what the given edges connect."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[far]], ids[far]


PAIRS = "src long, dst long, bits int"


def _told(found: list[tuple[np.ndarray, ...]], all_pairs: bool) -> pa.RecordBatch:
    src, dst, bits = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    if not all_pairs and len(src):
        src, dst = forest(src, dst)
        bits = np.zeros(len(src), dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(bits, pa.int32())], names=["src", "dst", "bits"])


def near_pairs(nodes: DataFrame, max_bits: int = MAX_BITS, max_check: int = MAX_CHECK, all_pairs: bool = True) -> DataFrame:
    """Verified pairs (src, dst, bits) of nodes (node, simhash, c1, c2, c3), src < dst, each once.

    Without ``all_pairs`` every task gives a spanning forest of its pairs instead, and ``bits`` is 0.
    """
    lim = limits(max_bits)
    names = ["node", "simhash", "c1", "c2", "c3"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 16_384) for i in range(0, batch.num_rows, 16_384)):
                cols = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                for block, limit in enumerate(lim):
                    if limit < 0:
                        continue
                    rows, keys = (np.concatenate(c) for c in zip(*keys_of(cols[1].view(np.uint64), block, limit), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(keys | block << 16), *(pa.array(c[rows]) for c in cols)], names=["key", *names])

    def section(block: int, key: np.ndarray, node: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Pairs of the rows of whole keys of one block."""
        x = turned(sig[:, 0], block)
        order = np.lexsort((x, key))
        key, node, sig, x = key[order], node[order], sig[order], x[order]
        new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (key[1:] != key[:-1])]))
        many, ux, ukey = np.diff(np.append(new, len(x))), x[new], key[new] & 0xFFFF
        value = (ux >> U(64 - WIDTHS[block])).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (ukey[1:] != ukey[:-1])]))
        hi = np.append(lo[1:], len(ux))
        skey, sval = ukey[lo], value[lo]
        rest = np.searchsorted(skey, skey, "right") - np.arange(len(lo))  # subtries from each on in its key
        i = np.repeat(np.arange(len(lo)), rest)
        j = i + np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest)
        ok = meet(skey[i], sval[i], sval[j], lim[block])
        i, j = i[ok], j[ok]
        start = lo[i], hi[i], lo[j], hi[j], np.bitwise_count(sval[i] ^ sval[j]).astype(np.int64)
        out = []
        for i, j in trie_join(ux, start, WIDTHS[block], budget(max_bits, block)):
            diff = ux[i] ^ ux[j]
            diff = diff if block == 0 else (diff >> U(STARTS[block])) | (diff << U(64 - STARTS[block]))
            ok = np.bitwise_count(diff) <= max_bits
            i, j, diff = i[ok], j[ok], diff[ok]
            ok = passes(diff, block, max_bits)
            for q in range(block):
                ok &= ~passes(diff, q, max_bits)
            i, j, diff = i[ok], j[ok], diff[ok]
            size = many[i] * many[j]
            for at in _cut(np.arange(len(i)), size):
                w = np.repeat(at, size[at])
                k = np.arange(len(w)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
                a, b = new[i[w]] + k // many[j[w]], new[j[w]] + k % many[j[w]]
                ok = np.bitwise_count(sig[a, 1:] ^ sig[b, 1:]).sum(axis=1) <= max_check
                a, b = node[a[ok]], node[b[ok]]
                found = np.minimum(a, b), np.maximum(a, b), np.bitwise_count(diff[w[ok]]).astype(np.int32)
                if not all_pairs:
                    found = (*forest(a, b), None) if len(a) else found
                    found = (found[0], found[1], np.zeros(len(found[0]), dtype=np.int32))
                out.append(found)
        return out

    def chunk(cols: list[np.ndarray]) -> pa.RecordBatch:
        key, node = cols[0], cols[1]
        sig = np.stack([c.view(np.uint64) for c in cols[2:]], axis=1)
        edge = np.searchsorted(key, np.arange(len(WIDTHS) + 1) << 16)
        return _told([f for b in range(len(WIDTHS)) if edge[b + 1] > edge[b] for f in section(b, *(c[edge[b] : edge[b + 1]] for c in (key, node, sig)))], all_pairs)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n, enough = 0, ROWS_AT_ONCE
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n < enough:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.searchsorted(cols[0], cols[0][-1]))
            if end:
                yield chunk([c[:end] for c in cols])
            held, n = [[c[end:] for c in cols]], len(cols[0]) - end
            enough = max(ROWS_AT_ONCE, 2 * n)
        if n:
            yield chunk([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = nodes.select(*names)
    copies = rows.mapInArrow(spread, "key long, node long, simhash long, c1 long, c2 long, c3 long")
    return copies.repartition("key").sortWithinPartitions("key").mapInArrow(join, PAIRS).unionByName(_equal_simhash(rows, max_check, all_pairs))


def _equal_simhash(nodes: DataFrame, max_check: int, all_pairs: bool) -> DataFrame:
    """Pairs of nodes with one SimHash and different check words, by squares of SQUARE x SQUARE nodes."""
    many = nodes.groupBy("simhash").agg(F.count("*").alias("n")).where("n > 1")
    side = F.ceil(F.col("n") / SQUARE).cast("int")
    b = F.pmod(F.xxhash64("node"), side).cast("int")
    placed = nodes.join(many, "simhash").withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), side - 1)))
    squares = placed.select("simhash", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).alias("right"), "node", "c1", "c2", "c3")

    def compare(part: pa.Table) -> pa.Table:
        node, right = part["node"].to_numpy(), part["right"].to_numpy()
        sig = np.stack([part[c].to_numpy().view(np.uint64) for c in ("c1", "c2", "c3")], axis=1)
        own = part["i"][0].as_py() == part["j"][0].as_py()
        left, other = (np.arange(len(node)), np.arange(len(node))) if own else (np.flatnonzero(~right), np.flatnonzero(right))
        out = []
        for a in range(0, len(left), 256):
            x = left[a : a + 256]
            y = other[a:] if own else other
            off = np.zeros((len(x), len(y)), dtype=np.uint16)
            for c in range(3):
                off += np.bitwise_count(sig[x, c][:, None] ^ sig[y, c][None, :])
            i, j = np.nonzero(off <= max_check)
            i, j = (i[j > i], j[j > i]) if own else (i, j)
            p, q = node[x[i]], node[y[j]]
            found = (np.minimum(p, q), np.maximum(p, q)) if all_pairs or not len(p) else forest(p, q)
            out.append((*found, np.zeros(len(found[0]), dtype=np.int32)))
        return pa.Table.from_batches([_told(out, all_pairs)])

    return squares.groupBy("simhash", "i", "j").applyInArrow(compare, PAIRS)


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of the nodes in pairs (src, dst); root is the smallest node of the component."""
    edges = settle(pairs.select("src", "dst").distinct())
    while True:
        # large star: every larger neighbour goes to the smallest node around
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        # small star: every smaller neighbour goes to the smallest one
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst")).alias("a"), F.col("low").alias("b"))
        new = settle(small.where("a != b").select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct())
        same = new.count() == edges.count() and new.join(edges, ["src", "dst"], "left_anti").isEmpty()
        edges = new
        if same:
            return edges.select(F.col("dst").alias("node"), F.col("src").alias("root"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, max_check: int = MAX_CHECK) -> DataFrame:
    """(doc_id, kept_id): every document that goes and the document of its group that stays.

    Two texts are near copies if their 64-bit word SimHashes differ in at most ``max_bits`` bits and
    their 192-bit word-pair SimHashes in at most ``max_check``; groups are the connected
    components, and the smallest doc_id of a group stays.  All pairs within the thresholds are
    found.  Defined cases: a null text or a null doc_id is never a copy; very long texts are read whole; texts without a word
    (the empty one too) are copies only if equal; rows that share a doc_id are one document
    with several texts and join the groups of all of them; no documents give no rows.
    Columns other than doc_id and text play no part.
    """
    sig = settle(signatures(docs))
    cols = ["simhash", "c1", "c2", "c3"]
    node_of = sig.groupBy(*cols).agg(F.min("doc_id").alias("node"))
    nodes = settle(node_of)
    pairs = near_pairs(nodes, max_bits, max_check, all_pairs=False).select("src", "dst")
    members = sig.join(nodes, cols).select("doc_id", "node")
    ties = members.where("doc_id != node").select(F.col("node").alias("src"), F.col("doc_id").alias("dst"))
    return components(pairs.union(_cross_ties(ties, members))).transform(lambda c: _labelled(c, members))


def _cross_ties(ties: DataFrame, members: DataFrame) -> DataFrame:
    """Edges to documents that carry several signatures; others hang on their node alone."""
    several = members.groupBy("doc_id").agg(F.count_distinct("node").alias("n")).where("n > 1").select(F.col("doc_id").alias("dst"))
    return ties.join(several, "dst", "left_semi").select("src", "dst")


def _labelled(roots: DataFrame, members: DataFrame) -> DataFrame:
    full = members.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("kept_id"))
    return full.groupBy("doc_id").agg(F.min("kept_id").alias("kept_id")).where("doc_id != kept_id")


def one_per_group(docs: DataFrame, **params) -> DataFrame:
    """The documents without those that near_duplicates removes, in the columns they have, whatever they are called.

    Of a group the smallest doc_id stays.  No documents give none.  Rows without a text stay; those without an id are told apart by all their columns.  Of rows that share a doc_id one stays, the one with
    the smallest text.
    """
    docs, held = keyed(docs)
    left = drop_ids(docs, near_duplicates(docs, **params))
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return unkeyed(left, held)
    from pyspark.sql import Window

    order = [F.col("text").asc_nulls_last(), *(F.col(c) for c in left.columns if dict(left.dtypes)[c] in ("bigint", "int", "string") and c not in ("doc_id", "text"))]
    (rank,) = fresh(docs, "__rank")
    ranked = keep_ids(left, twice).withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    return unkeyed(drop_ids(left, twice).unionByName(ranked.where(F.col(rank) == 1).drop(rank)), held)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

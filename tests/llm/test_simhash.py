import numpy as np
import pyarrow as pa
import pytest

from rowsift.llm import simhash
from rowsift.llm.simhash import components, near_duplicates, near_pairs, one_per_group, signatures_of, trie_join
from rowsift.llm.textkit import slices

from .conftest import DOCS, frame, prose, rows_of


def brute_pairs(sig, max_bits, max_check):
    out = set()
    for i in range(len(sig)):
        d = np.bitwise_count(sig[i + 1 :, 0] ^ sig[i, 0])
        c = np.bitwise_count(sig[i + 1 :, 1:] ^ sig[i, 1:]).sum(axis=1)
        out |= {(i, i + 1 + int(j)) for j in np.flatnonzero((d <= max_bits) & (c <= max_check))}
    return out


def grouped(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in range(n) if find(i) != i}


@pytest.fixture(scope="module")
def copies():
    """40 texts, each with copies that differ by some words; ids are positions."""
    import random

    r, texts = random.Random(3), []
    for i in range(40):
        words = prose(100 + i, 120).split()
        texts.append(" ".join(words))
        for k in range(i % 4):
            w = words[:]
            for _ in range(k * 2):
                w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    return texts


def test_pairs_and_groups_are_those_of_brute_force(spark, copies):
    sig = signatures_of(pa.array(copies))
    expected = grouped(len(copies), brute_pairs(sig, simhash.MAX_BITS, simhash.MAX_CHECK))
    got = dict(rows_of(near_duplicates(frame(spark, enumerate(copies)))))
    assert got == expected
    assert len(expected) >= 50


def test_a_signature_depends_on_its_text_alone(copies, monkeypatch):
    texts = copies + ["", "one", "...", prose(5, 3000)]
    together = signatures_of(pa.array(texts))
    assert (together == np.concatenate([signatures_of(pa.array([t])) for t in texts])).all()
    assert (together[::-1] == signatures_of(pa.array(texts[::-1]))).all()
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for most, rows in ((1, 1 << 20), (5000, 7), (10**9, 1), (10**9, 3)):
        parts = list(slices(batch, most=most, rows=rows))
        assert [t for p in parts for t in p.column(0).to_pylist()] == texts and max(p.num_rows for p in parts) <= rows
        assert (together == np.concatenate([signatures_of(p.column(0)) for p in parts])).all()


def near_and_far(max_bits, n=150):
    r = np.random.default_rng(max_bits)
    base = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
    near = [base]
    for _ in range(4):
        x = base.copy()
        for _ in range(max_bits + 1):
            x ^= np.uint64(1) << r.integers(0, 64, len(base)).astype(np.uint64)
        near.append(x)
    return np.unique(np.concatenate(near))


@pytest.mark.parametrize("max_bits", [0, 3, 10, 14])
def test_from_some_block_on_every_difference_is_within_the_budget(max_bits):
    r = np.random.default_rng(max_bits)
    diff = np.zeros(4000, dtype=np.uint64)
    for i in range(len(diff)):
        for bit in r.choice(64, r.integers(0, max_bits + 1), replace=False):
            diff[i] ^= np.uint64(1) << np.uint64(bit)
    assert sum(n + 1 for n in simhash.limits(max_bits)) == max_bits + 1
    assert np.any([simhash.passes(diff, b, max_bits) for b in range(5)], axis=0).all()
    with pytest.raises(ValueError, match="14"):
        simhash.limits(15)


@pytest.mark.parametrize("limit", [0, 1, 2])
def test_two_block_values_meet_under_one_key(limit):
    r = np.random.default_rng(limit)
    for block in (0, 3):
        a = r.integers(0, 2**63, 300, dtype=np.uint64)
        b = a.copy()
        for _ in range(3):
            b ^= np.where(r.random(300) < 0.6, np.uint64(1) << (np.uint64(63 - simhash.STARTS[block]) - r.integers(0, 12, 300).astype(np.uint64)), np.uint64(0))
        keys = lambda s: [set(int(k[list(rows).index(i)]) for rows, k in simhash.keys_of(s, block, limit) if i in set(rows)) for i in range(len(s))]
        value = lambda s: (simhash.turned(s, block) >> np.uint64(64 - simhash.WIDTHS[block])).astype(np.int64)
        for i, (ka, kb) in enumerate(zip(keys(a), keys(b), strict=True)):
            shared = np.array(sorted(ka & kb), dtype=np.int64)
            x, y = value(a)[i : i + 1], value(b)[i : i + 1]
            assert simhash.meet(shared, np.repeat(x, len(shared)), np.repeat(y, len(shared)), limit).sum() == (np.bitwise_count(x ^ y)[0] <= limit)


@pytest.mark.parametrize("max_bits", [0, 3, 10])
@pytest.mark.parametrize("leaf", [0, 48])
def test_trie_join_from_all_blocks_loses_no_pair(max_bits, leaf, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FRONTIER", 100)
    s, found = near_and_far(max_bits), set()
    for block in range(5):
        x = simhash.turned(s, block)
        order = np.argsort(x)
        one = np.array([0]), np.array([len(x)]), np.array([0]), np.array([len(x)]), np.array([0])
        for i, j in trie_join(x[order], one, 0, simhash.budget(max_bits, block)):
            pairs = {tuple(sorted((int(order[a]), int(order[b])))) for a, b in zip(i, j, strict=True)}
            assert len(pairs) == len(i)
            found |= pairs
    brute = {(i, int(j)) for i in range(len(s)) for j in np.flatnonzero(np.bitwise_count(s ^ s[i]) <= max_bits) if j > i}
    assert brute == {p for p in found if np.bitwise_count(s[p[0]] ^ s[p[1]]) <= max_bits}
    if not leaf:  # what the trie alone reports may not exceed the budget
        assert found == brute


def random_nodes(spark, n=300):
    r = np.random.default_rng(5)
    sig = r.integers(0, 2**63, (n, 4), dtype=np.uint64)
    sig[n // 2 :] = sig[: n // 2]
    for k in range(8):
        sig[n // 2 :, 0] ^= np.uint64(1) << r.integers(0, 64, n // 2).astype(np.uint64)
    sig[: n // 10, 0] = sig[0, 0]  # one SimHash with many check words, some of them alike
    sig[: n // 20, 1:] = sig[0, 1:]
    sig[: n // 20, 1] ^= np.uint64(1) << np.arange(n // 20, dtype=np.uint64)
    rows = [(i, *(int(x) for x in s.view(np.int64))) for i, s in enumerate(sig)]
    return sig, spark.createDataFrame(rows, "node long, simhash long, c1 long, c2 long, c3 long")


@pytest.mark.parametrize("rows", [1, 200_000])
def test_pairs_are_those_of_brute_force_each_once(spark, monkeypatch, rows):
    sig, nodes = random_nodes(spark)
    brute = brute_pairs(sig, 10, 64)
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", rows)
    monkeypatch.setattr(simhash, "SQUARE", 7)
    got = [(a, b) for a, b, _ in rows_of(near_pairs(nodes))]
    assert set(got) == brute and len(got) == len(brute) > 200
    links = [(a, b) for a, b, _ in rows_of(near_pairs(nodes, all_pairs=False))]
    assert grouped(len(sig), links) == grouped(len(sig), brute) and set(links) <= {(a, b) for a in range(300) for b in range(a, 300)}


def test_copies_of_a_signature_do_not_depend_on_how_many_there_are():
    r = np.random.default_rng(1)
    for n in (100, 20_000):
        s = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, n, dtype=np.uint64)
        copies = sum(len(rows) for b, limit in enumerate(simhash.limits(10)) for rows, _ in simhash.keys_of(s, b, limit))
        assert 42 < copies / n < 46


def test_forest_connects_what_the_edges_connect():
    r = np.random.default_rng(7)
    a, b = r.integers(0, 500, 400), r.integers(0, 500, 400)
    low, high = simhash.forest(a, b)
    assert (low < high).all() and len(low) < 500
    assert grouped(500, zip(low.tolist(), high.tolist(), strict=True)) == grouped(500, zip(a.tolist(), b.tolist(), strict=True))


def test_hot_simhash_of_many_texts(spark):
    """Twelve words in 20,000 orders: one SimHash, so the check words decide, in squares."""
    import random

    r, words = random.Random(1), prose(1, 12).split()
    texts = sorted({" ".join(r.sample(words, 12)) for _ in range(20_000)})
    assert len({int(x) for x in signatures_of(pa.array(texts))[:, 0]}) == 1
    got = dict(rows_of(near_duplicates(frame(spark, enumerate(texts)))))
    part = [0, *sorted(got)[:40]]  # whatever goes is near some other text of its group, and the smallest stays
    sig = signatures_of(pa.array(texts))
    for i in part[1:]:
        off = np.bitwise_count(sig[:, 1:] ^ sig[i, 1:]).sum(axis=1)
        assert (np.delete(off, i) <= 64).any() and got[i] < i and got[i] not in got


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200}


def test_edges(spark, edges, nothing, nulls_only):
    assert rows_of(near_duplicates(edges)) == [(5, 4)]
    kept = rows_of(one_per_group(edges), "doc_id", "text")
    assert len(kept) == len(edges.collect()) - 3  # both rows of 5, and the second text of 6
    assert [t for i, t in kept if i == 6] == ["first text of a shared id"]
    assert one_per_group(edges).columns == edges.columns
    assert rows_of(near_duplicates(nothing)) == [] and one_per_group(nothing).count() == 0
    assert rows_of(near_duplicates(nulls_only)) == [] and one_per_group(nulls_only).count() == 2


def test_wordless_texts_are_copies_only_if_equal(spark):
    docs = spark.createDataFrame([(1, "...", "", "", 3), (2, "...", "", "", 3), (3, "....", "", "", 4), (4, "", "", "", 0), (5, "", "", "", 0)], DOCS)
    assert rows_of(near_duplicates(docs)) == [(2, 1), (5, 4)]


def test_a_document_with_two_texts_joins_both_groups(spark):
    a, b = prose(1, 80), prose(2, 80)
    docs = frame(spark, [(1, a), (2, b), (3, a), (3, b), (4, prose(3, 80))])
    assert rows_of(near_duplicates(docs)) == [(2, 1), (3, 1)]


def test_hot_group_of_exact_copies(spark):
    text = prose(9, 50)
    got = rows_of(near_duplicates(frame(spark, [(i, text) for i in range(2000)])))
    assert got == [(i, 0) for i in range(1, 2000)]

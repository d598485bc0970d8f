"""Repeated passages (op9, op10) and shared spans (op2) against brute force."""

import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from rowsift.llm import fpindex, passages, suffix
from rowsift.llm.decontaminate import clean, shared_spans
from rowsift.llm.fpindex import FingerprintIndex, incremental_repeats
from rowsift.llm.passages import rows_of as texts_of
from rowsift.llm.suffix import repeated_passages

from .conftest import frame, prose, rows_of

N = passages.WINDOW


@pytest.fixture(scope="module")
def corpus():
    """Texts with shared passages, some overlapping, some touching, one right at a window's length, and repeats within a text."""
    r = random.Random(8)
    shared = [prose(500 + i, n).split() for i, n in enumerate((N - 1, N, N + 1, 80, 200))]
    docs = []
    for i in range(60):
        words = prose(1000 + i, r.randint(0, 150)).split()
        for _ in range(r.randint(0, 3)):
            s = shared[r.randrange(5)]
            a = r.randint(0, len(s) // 3)
            at = r.randint(0, len(words))
            words[at:at] = s[a:]
        docs.append((i, r.choice([" ", "\n", "  "]).join(words)))
    docs += [(60, docs[3][1]), (61, " ".join(["again"] * 130)), (62, " ".join(shared[3] + shared[4] + shared[3]))]
    return docs


def windows(docs):
    for doc, text in sorted(docs):
        w = re.findall(r"[^ \t\n\f\r]+", text)
        for p in range(len(w) - N + 1):
            yield tuple(w[p : p + N]), doc, p


def runs(marked):
    """(doc, start, n_words) of neighbouring marked windows."""
    out = []
    for doc, places in sorted(marked.items()):
        places = sorted(places)
        a = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] != places[i - 1] + 1:
                out.append((doc, places[a], places[i - 1] - places[a] + N))
                a = i
    return out


def brute(docs, earlier):
    where = defaultdict(list)
    for w, doc, p in windows(docs):
        where[w].append((doc, p))
    marked, info = defaultdict(list), {}
    for places in where.values():
        for k, (doc, p) in enumerate(places):
            info[doc, p] = (places[0][0], len(places))
            if (k > 0) if earlier else len(places) > 1:
                marked[doc].append(p)
    return [(doc, s, n, *info[doc, s][: 1 if earlier else 2]) for doc, s, n in runs(marked)]


def test_suffix_dedup_is_brute_force(spark, corpus):
    got = rows_of(repeated_passages(frame(spark, corpus)), "doc_id", "start", "n_words", "first_doc", "copies")
    assert got == brute(corpus, False) and len(got) > 20


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_substring_dedup_is_brute_force_for_any_batches(spark, corpus, batches):
    got = rows_of(incremental_repeats(frame(spark, corpus), batches), "doc_id", "start", "n_words", "first_doc")
    assert got == brute(corpus, True) and len(got) > 20


def test_groups_that_span_chunks_of_a_task(spark, corpus, monkeypatch):
    for module in (suffix, fpindex):
        monkeypatch.setattr(module, "ROWS_AT_ONCE", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = rows_of(repeated_passages(frame(spark, corpus)), "doc_id", "start", "n_words", "first_doc", "copies")
        assert got == brute(corpus, False)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_buckets_are_refined_to_the_order_of_the_suffixes(spark, monkeypatch):
    """Suffixes of periodic and shared texts: buckets are equal prefixes, and in a bucket the order is that of the pointers."""
    r = random.Random(3)
    texts = {i: [r.choice("abc") for _ in range(120)] + ["z"] * 60 for i in range(6)}
    texts[6] = texts[2][:70] + ["q"] * 60
    name = {w: k for k, w in enumerate("abcqz")}
    grams = sorted({tuple(t[p : p + 13]) for t in texts.values() for p in range(len(t) - 12)})
    number = {g: 10 * k for k, g in enumerate(grams)}  # initial buckets in the order of their tokens
    assert name
    at = lambda i, p: number[tuple(texts[i][p : p + 13])]
    rows = [(at(i, p), at(i, p + 13), i, p) for i, t in texts.items() for p in range(len(t) - 25)]
    df = spark.createDataFrame(rows, suffix.SUFFIXES).coalesce(1)
    monkeypatch.setattr(suffix, "ROWS_AT_ONCE", 5)
    one = suffix.refine(df)
    two = suffix.refine(suffix.pointers(one, 24))
    for level, n in ((one, 26), (two, 50)):
        got, by = level.collect(), defaultdict(set)
        count = defaultdict(int)
        for i, t in texts.items():
            for p in range(len(t) - n + 1):
                count[tuple(t[p : p + n])] += 1
        assert {(x.c, x.p) for x in got} == {(i, p) for i, t in texts.items() for p in range(len(t) - n + 1) if count[tuple(t[p : p + n])] > 1}
        for x in got:
            by[x.b].add(tuple(texts[x.c][x.p : x.p + n]))
        assert all(len(v) == 1 for v in by.values()) and len(by) == sum(k > 1 for k in count.values())
        parts = defaultdict(list)
        for b, v in by.items():
            parts[b >> 40].append((b, next(iter(v))))
        if n == 26:
            for part in parts.values():  # each task's buckets lie in the order of their tokens
                assert [v for _, v in sorted(part)] == sorted(v for _, v in part)


def test_index_is_compacted_without_a_shuffle_and_can_be_opened_again(spark, corpus):
    rows = texts_of(frame(spark, corpus)).cache()
    index, told = FingerprintIndex(spark, buckets=8), []
    for a in range(0, 64, 8):
        part = index.ingest(rows.where(f"doc_id >= {a} and doc_id < {a + 8}"), rows.where(f"doc_id < {a}"), a)
        told.append(part)
        if a in (8, 24, 40):
            index.close()
            path, runs = index.path, index.runs
            index = FingerprintIndex(spark, path)
            assert index.runs == runs and index.buckets == 8
    assert [level for level, _ in index.runs] == [3]
    got = sorted(r for part in told for r in rows_of(part, "doc_id", "start", "n_words", "first_doc"))
    assert got == brute(corpus, True)
    entries = index.entries().collect()
    assert len(entries) == len({(e.key, e.ctx) for e in entries})
    folder = Path(index.path.removeprefix("file:"))
    assert {p.name for p in folder.iterdir() if not p.name.startswith(".")} == {"run-000015", "manifest-00000015.json"}
    plan = index._merged([n for _, n in index.runs] * 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    keys = spark.createDataFrame([(e.key,) for e in entries[:5]], "key long").distinct()
    for side in index.matching(keys)._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1:]:
        run = side.split("Bucketed: true")[0]
        assert "Exchange" not in run.splitlines()[-1] and "SortMergeJoin" not in run
    assert {e.key for e in index.matching(keys).collect()} == {e.key for e in entries[:5]}
    index.drop()
    assert not folder.exists()


def test_stretches_whose_texts_differ_are_not_told(spark):
    p = prose(3, 60)
    rows = texts_of(frame(spark, [(1, p), (2, p), (3, prose(4, 60))]))
    th = {r.doc_id: r.th for r in rows.collect()}
    claims = [(2, th[2], 0, 60, 1, th[1], 0), (2, th[2], 0, 60, 3, th[3], 0), (2, th[2], 3, 57, 1, th[1], 2)]
    df = spark.createDataFrame(claims, "doc_id long, th int, start int, n_words int, first_doc long, first_th int, first_pos int")
    got = fpindex._verified(df, rows.where("doc_id >= 2"), rows.where("doc_id < 2"), 2)
    assert rows_of(got, "doc_id", "start", "first_doc") == [(2, 0, 1)]


def test_edges_of_passage_finders(spark, edges, nothing, nulls_only):
    for find in (repeated_passages, incremental_repeats):
        assert rows_of(find(edges)) == [] and rows_of(find(nothing)) == [] and rows_of(find(nulls_only)) == []
    p = prose(77, 70)
    docs = frame(spark, [(5, p), (5, p), (5, "lead " + p), (None, p), (9, p)], extra=True)
    assert rows_of(repeated_passages(docs), "doc_id", "start", "n_words", "copies")[-1] == (9, 0, 70, 3)
    # rows that share doc_id 5 hold windows at two places each, so what repeats is found in both readings
    assert {r[0] for r in rows_of(repeated_passages(docs))} == {5, 9}
    assert rows_of(incremental_repeats(docs), "doc_id", "first_doc")[-1] == (9, 5)


def test_minima_of_long_texts_are_counted_in_chunks(monkeypatch):
    from rowsift.llm import textkit

    grams = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    grams[1000:1400] = 7
    whole = textkit.window_minima(grams, 35)
    assert (whole == [i + int(np.argmin(grams[i : i + 35] >> np.uint64(26))) for i in range(len(grams) - 34)]).all()
    monkeypatch.setattr(textkit, "_POS_BITS", 8)
    short = [i + int(np.argmin(grams[i : i + 35] >> np.uint64(8))) for i in range(len(grams) - 34)]
    assert (textkit.window_minima(grams, 35) == short).all()


# ── Decontamination ──

LEAST = 13


def brute_spans(docs, items):
    out = set()
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    for d, text in docs:
        x = word.findall(text.lower())
        for b, item in items:
            y = word.findall(item.lower())
            for i in range(len(x)):
                for j in range(len(y)):
                    if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                        n = 0
                        while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                            n += 1
                        if n >= LEAST:
                            out.add((d, b, i, j, n))
    return sorted(out)


@pytest.fixture(scope="module")
def leaks():
    r = random.Random(4)
    items = [(i, prose(i, r.randint(5, 60))) for i in range(12)] + [(12, " ".join(["echo"] * 30)), (13, "Ça VA, l'été à Nîmes: " + prose(13, 14))]
    docs = []
    for i in range(50):
        words = prose(300 + i, r.randint(0, 60)).split()
        for _ in range(r.randint(0, 2)):
            x = items[r.randrange(len(items))][1].split()
            a = r.randint(0, max(0, len(x) - 10))
            at = r.randint(0, len(words))
            words[at:at] = x[a : a + r.choice([11, 12, 13, 14, 40])]
        docs.append((i, " ".join(words).upper() if i % 3 else ", ".join(words)))
    docs.append((50, " ".join(["echo"] * 40)))
    return docs, items


def test_spans_are_those_of_brute_force(spark, leaks):
    docs, items = leaks
    got = rows_of(shared_spans(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "doc_start", "item_start", "n_words")
    expected = brute_spans(docs, items)
    assert got == expected and len(expected) > 20
    left = {r.doc_id for r in clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {s[0] for s in expected}


def test_spans_when_sides_are_too_large_to_broadcast(spark, leaks, monkeypatch):
    from rowsift.llm import common

    docs, items = leaks
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    got = rows_of(shared_spans(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "doc_start", "item_start", "n_words")
    assert got == brute_spans(docs, items)


def test_edges_of_decontamination(spark, edges, edge_rows, nothing, nulls_only):
    passage = prose(1, 60_000).split()[30_000:30_020]
    from pyspark.sql import functions as F

    items = spark.createDataFrame([(1, " ".join(passage)), (1, " ".join(passage)), (None, "x"), (2, None), (3, "")], "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("h", F.lit(0))
    assert rows_of(shared_spans(edges, items)) == [(7, 1, 30_000, 0, 20)]
    left = clean(edges, items)
    assert left.columns == edges.columns and left.count() == len(edge_rows) - 1
    empty = items.limit(0)
    assert shared_spans(edges, empty).count() == 0 and clean(edges, empty).count() == len(edge_rows)
    assert shared_spans(nothing, items).count() == 0 and clean(nothing, items).count() == 0
    assert clean(nulls_only, items).count() == 2
    twice = frame(spark, [(5, " ".join(passage)), (5, "lead " + " ".join(passage)), (6, " ".join(passage)), (6, " ".join(passage))])
    assert rows_of(shared_spans(twice, items), "doc_id", "doc_start") == [(5, 0), (5, 1), (6, 0)]

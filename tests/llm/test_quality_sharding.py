"""Quality rules (op7) and sharding (op8) against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsift.llm import quality, sharding
from rowsift.llm.quality import RULES, SHARES, acceptable, measures_of, verdicts

from .conftest import DOCS, frame, prose, rows_of


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^ \t\n\f\r]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if line:
            if line in seen:
                repeated += len(re.findall(r"[^ \t\n\f\r]+", line))
            seen.add(line)
    upper = sum("A" <= c <= "Z" for c in text)
    return [len(text), sum(c in quality.SYMBOLS for c in text), upper, upper + sum("a" <= c <= "z" for c in text), len(w), w.count("|"), repeated, sum(a == b for a, b in zip(w, w[1:]))]


def brute_prior(hosts):
    """Mean and weight of the prior from (failures, documents) of each host, straight from the analysis of variance."""
    n, h = sum(k for _, k in hosts), len(hosts)
    m = sum(x for x, _ in hosts) / n
    if h < 2 or n == h:
        return m, 1e6
    between = sum(k * (x / k - m) ** 2 for x, k in hosts) / (h - 1)
    within = sum(k * (x / k) * (1 - x / k) for x, k in hosts) / (n - h)
    each = (n - sum(k * k for _, k in hosts) / n) / (h - 1)
    spread = between + (each - 1) * within
    share = (between - within) / spread if spread else 0
    return m, max(1 / share - 1, 1.0) if share > 1e-6 else 1e6


def brute_verdicts(rows):
    judged = []
    for doc, text, host in rows:
        chars, symbols, upper, letters, tokens, bars, repeated, echoed = brute_measures(text)

        def beyond(k):
            at = {r: SHARES[r][k] for r in RULES}
            many = tokens >= 10
            return {"symbols": symbols > chars * at["symbols"], "capitals": letters >= 20 and upper > letters * at["capitals"], "bars": many and bars > tokens * at["bars"], "repeats": many and repeated > tokens * at["repeats"], "echoes": many and echoed > tokens * at["echoes"]}

        judged.append((doc, host, beyond(1), any(beyond(0).values())))
    hosts = defaultdict(list)
    for _, host, failed, _ in judged:
        hosts[host].append(any(failed.values()))
    m, weight = brute_prior([(sum(v), len(v)) for v in hosts.values()])
    out = []
    for doc, host, failed, doubt in judged:
        rate = (sum(hosts[host]) + m * weight) / (len(hosts[host]) + weight)
        out.append((doc, not any(failed.values()) and not (doubt and rate > quality.HOST_RATE), round(rate, 6)))
    return out


def judged_rows():
    r = random.Random(6)
    rows = []
    for i in range(300):
        host = f"h{i % 7}"
        kind = r.random() if host == "h3" else r.random() * 0.3
        kind = 0.3 if host == "h3" and r.random() < 0.4 else kind
        words = prose(i, r.randint(5, 60)).split()
        if kind > 0.8:
            words = [w + "##" if r.random() < 0.3 else w for w in words]
        elif kind > 0.6:
            words = [w.upper() if r.random() < 0.35 else w for w in words]
        elif kind > 0.5:
            words = words + words[-1:] * (len(words) // 4)
        elif kind > 0.27:
            words = ["|"] * len(words) + words
        lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        rows.append((i, "\n".join(lines + lines[: r.randint(0, 3)]), host))
    return rows


def test_measures_are_those_of_brute_force():
    texts = [t for _, t, _ in judged_rows()] + ["", None, "\n\n", "é é É", "a\n\na\na", "| |\t|", "a a\na a"]
    got = np.stack(measures_of(pa.array(texts)), axis=1).tolist()
    assert got == [brute_measures(t) for t in texts]


def test_verdicts_are_those_of_brute_force(spark):
    rows = judged_rows()
    docs = frame(spark, rows)
    got = rows_of(verdicts(docs), "doc_id", "keep", "host_rate")
    expected = brute_verdicts(rows)
    assert [g[:2] for g in got] == [e[:2] for e in expected]
    assert np.allclose([g[2] for g in got], [e[2] for e in expected], atol=2e-6)
    kept = {d for d, k, _ in expected if k}
    assert {r.doc_id for r in acceptable(docs).collect()} == kept
    doubted_at_bad = [r for r in verdicts(docs).collect() if r.host_bad and r.doubtful and not any(r[f"failed_{n}"] for n in RULES)]
    assert doubted_at_bad and not any(r.keep for r in doubted_at_bad)


def test_clean_documents_stay_even_at_a_bad_host(spark):
    rows = [(i, "### " * 12, "bad") for i in range(50)] + [(50 + i, prose(i, 40), "bad" if i == 0 else "good") for i in range(50)]
    assert {r.doc_id for r in acceptable(frame(spark, rows)).collect()} == set(range(50, 100))


def test_edges_of_quality(spark, edges, edge_rows, nothing, nulls_only):
    v = verdicts(edges)
    assert v.count() == len(edge_rows)
    got = defaultdict(list)
    for r in v.collect():
        got[r.doc_id].append(r.keep)
    assert got[1] == [True] and got[2] == [True] and got[3] == [True] and got[5] == [True, True] and got[None] == [True, True]
    assert got[10] == [False] and got[11] == [False] and got[7] == [True]
    left = acceptable(edges)
    assert left.columns == edges.columns and left.count() == len(edge_rows) - 2
    assert verdicts(nothing).count() == 0 and acceptable(nothing).count() == 0
    assert [r.keep for r in verdicts(nulls_only).collect()] == [True, True] and acceptable(nulls_only).count() == 2


def test_a_share_right_at_the_threshold_passes(spark):
    text = "#" * 12 + "a" * 88
    row = verdicts(frame(spark, [(1, text)])).first()
    assert row.doubtful and not row.failed_symbols and verdicts(frame(spark, [(1, "#" + text)])).first().failed_symbols


# ── Sharding ──


def best_capacity(sizes, k):
    """Dynamic programme over all contiguous partitions."""
    n = len(sizes)
    pre = np.concatenate([[0], np.cumsum(sizes)])
    cost = pre[1:].astype(float)
    for _ in range(k - 1):
        cost = np.array([min([cost[i]] + [max(cost[j], pre[i + 1] - pre[j + 1]) for j in range(i)]) for i in range(n)])
    return int(cost[-1])


@pytest.mark.parametrize("seed", range(6))
def test_capacity_is_minimal(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(0 if seed % 2 else 1, [2, 50, 1000][seed % 3], 40)
    for k in (1, 2, 5, 40, 50):
        assert sharding.smallest_capacity(sizes, k) == max(best_capacity(sizes, min(k, 40)), 0)


def shard_docs():
    r = random.Random(2)
    return [(i, "x" * r.randint(0, 300), f"s{i % 5}") for i in range(1500)]


def test_plan_is_contiguous_atomic_and_minimal(spark):
    docs = frame(spark, shard_docs())
    rows = sorted(sharding.plan(docs, 8, 64).collect(), key=lambda r: (r.source, r.block))
    sizes = np.array([r["size"] for r in rows])
    assert sizes.sum() == sum(len(t) for _, t, _ in shard_docs())
    shards = [r["shard"] for r in rows]
    assert shards == sorted(shards) and len(set(shards)) <= 8
    capacity = rows[0]["capacity"]
    assert capacity == best_capacity(sizes, 8)
    assert max(sizes[np.array(shards) == s].sum() for s in set(shards)) == capacity
    placed = sharding.sharded(docs, 8, 64).collect()
    by = {(r.source, r.block): r["shard"] for r in rows}
    assert len(placed) == 1500 and all(r.shard == by[r.source, r.doc_id // 64] for r in placed)


@pytest.mark.parametrize("coarse", [1, 3, 40])
def test_search_with_few_prefix_sums_at_a_time_finds_the_same(spark, monkeypatch, coarse):
    docs = frame(spark, shard_docs() + [(5000, "x" * 9000, "s1"), (5300, "x" * 9000, "s1")])
    key = lambda df: rows_of(df, "source", "block", "size", "shard", "capacity")
    expected = key(sharding.plan(docs, 8, 16))
    monkeypatch.setattr(sharding, "COARSE", coarse)
    assert key(sharding.plan(docs, 8, 16)) == expected
    assert expected[0][4] == best_capacity(np.array([r[2] for r in expected]), 8)


def test_blocks_of_large_and_negative_ids_are_exact(spark):
    ids = [2**62 + 255, 2**62 + 256, 2**53 + 1, -1, -256, -257, 0, None]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(sharding.block_of(F.col("i"), 256)).collect()]
    assert got == [None if i is None else i // 256 for i in ids]


def test_a_host_of_few_documents_shrinks_to_the_mean_and_chance_is_no_difference(spark):
    judged = [("big", i % 10 == 0) for i in range(1000)] + [("far", i % 2 == 0) for i in range(1000)] + [(f"one{i}", i < 4) for i in range(40)]
    rates = {r.host: r.host_rate for r in quality.host_rates(spark.createDataFrame(judged, "host string, failed boolean")).collect()}
    m, weight = brute_prior([(100, 1000), (500, 1000)] + [(int(i < 4), 1) for i in range(40)])
    assert weight > 1.5 and np.isclose(rates["one0"], (1 + m * weight) / (1 + weight)) and abs(rates["far"] - 0.5) < 0.01
    same = [(f"h{i % 4}", i // 4 % 5 == 0) for i in range(400)]
    assert {round(r.host_rate, 9) for r in quality.host_rates(spark.createDataFrame(same, "host string, failed boolean")).collect()} == {0.2}
    for alone in ([("a", True)], [("a", True), ("b", False)], []):
        assert quality.host_rates(spark.createDataFrame(alone, "host string, failed boolean")).count() == len(alone)


def test_edges_of_sharding(spark, edges, edge_rows, nothing, nulls_only):
    p = sharding.plan(edges, 4, 2)
    assert sum(r["docs"] for r in p.collect()) == len(edge_rows)
    out = sharding.sharded(edges, 4, 2)
    assert sorted(out.columns) == sorted(edges.columns) and out.count() == len(edge_rows) and out.where("shard is null").count() == 0
    assert sharding.plan(nothing).count() == 0 and sharding.sharded(nothing).count() == 0
    assert rows_of(sharding.plan(nulls_only)) == [(None, None, 2, 0, 0, 0)]
    assert sharding.sharded(nulls_only).where("shard = 0").count() == 2
    equal = spark.createDataFrame([(i * 256, "abcd", "en", "s", 4) for i in range(8)], DOCS)
    assert [r[0] for r in rows_of(sharding.plan(equal, 4), "shard")] == [0, 0, 1, 1, 2, 2, 3, 3]

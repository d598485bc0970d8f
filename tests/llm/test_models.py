"""Trained operators: HTML extraction (op1), secret scan (op4), mixing (op6); exact parts by brute force, models by held-out accuracy."""

import itertools
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowsift.llm import html, mixing, secrets
from rowsift.llm.textkit import text_buffers

from .conftest import DOCS, frame, prose, rows_of

# ── HTML ──


def test_marginals_are_those_of_enumeration():
    r = np.random.default_rng(0)
    forest = html.Forest([html.Page("<div><p>a<b>b</b></p><ul><li>c</li></ul></div>"), html.Page("<p>x</p>")])
    model = html.TreeModel()
    model.w, model.pair = r.normal(size=html.N_FEATURES), r.normal(size=(2, 2, 2))
    marginal, _, z = model.infer(forest)
    n, parent, kind = len(forest.parent), forest.parent, forest.block.astype(int)
    scores, states = [], list(itertools.product((0, 1), repeat=n))
    for s in states:
        scores.append(sum((forest.x[i] @ model.w) * s[i] for i in range(n)) + sum(model.pair[kind[i], s[parent[i]], s[i]] for i in range(n) if parent[i] >= 0))
    p = np.exp(np.array(scores) - np.logaddexp.reduce(scores))
    assert np.isclose(np.logaddexp.reduce(scores), z)
    assert np.allclose(np.array(states).T @ p, marginal)


def test_gradient_of_the_tree_model():
    r = np.random.default_rng(1)
    forest = html.Forest([html.Page(p) for p in html.labelled_pages(3, 5)])
    truth, model = html.labels_of(forest), html.TreeModel()
    model.w, model.pair = r.normal(size=html.N_FEATURES) * 0.1, r.normal(size=(2, 2, 2)) * 0.1
    _, gw, gp = model.likelihood(forest, truth)
    for k in (0, 5, 20):
        model.w[k] += 1e-5
        up, _, _ = model.likelihood(forest, truth)
        model.w[k] -= 2e-5
        down, _, _ = model.likelihood(forest, truth)
        model.w[k] += 1e-5
        assert np.isclose((up - down) / 2e-5, gw[k], atol=1e-2, rtol=1e-3)
    model.pair[1, 0, 1] += 1e-5
    up, _, _ = model.likelihood(forest, truth)
    model.pair[1, 0, 1] -= 2e-5
    down, _, _ = model.likelihood(forest, truth)
    assert np.isclose((up - down) / 2e-5, gp[1, 0, 1], atol=1e-2, rtol=1e-3)


def test_held_out_pages():
    forest = html.Forest([html.Page(p) for p in html.labelled_pages(80, 99)])
    marginal, _, _ = html.trained().infer(forest)
    texts = forest.x[:, html.N_GROUPS + 1] > 0  # nodes with text of their own
    shown = texts & ~forest.hidden
    assert ((marginal > 0.5) == (html.labels_of(forest) == 1))[shown].mean() > 0.95


def test_pages_of_the_tables_keep_their_paragraphs(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r.text for r in html.extracted(pages).collect()}
    assert len(out) == pages.count()
    lengths = [len(out[r.page_id]) for r in pages.collect()]
    assert np.mean([n > 0 for n in lengths]) > 0.95
    for r in pages.limit(50).collect():
        assert "<" not in out[r.page_id] or "&lt;" in r.html


def test_edges_of_extraction(spark):
    deep = "<div>" * 3000 + "<p>" + prose(1, 200) + "</p>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "   "), (None, None, "<p>broken <b>tags</p></i><script>x<"), (5, "u", "plain text without tags. " * 10), (6, "u", deep), (7, "u", "<!-- only"), (7, "u", "<!-- only"), (8, "u", "<a href='" + "x" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_nodes": F.lit(0), "node": F.lit(0)})
    got = html.extracted(pages).collect()
    assert len(got) == len(rows) and [r.n_nodes for r in got if r.page_id in (1, 2, 3)] == [0, 0, 0]
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert "var" not in "".join(r.text for r in got) and [r.url for r in got if r.page_id == 3] == [None]
    assert html.extracted(pages.limit(0)).count() == 0


def test_self_closed_svg_and_capitals_that_grow_lose_no_text():
    said = lambda page: "".join(t for _, t in html.Page(page).pieces)
    assert said('<p>before</p><svg width="1"/><p>after</p>') == "beforeafter"
    assert said("<p>before</p><svg/><p>between</p><svg><text>drawn</text></SVG><p>after</p>") == "beforebetweenafter"
    assert said("<p>" + "İ" * 40 + "</p><script>x = 1</Script><p>right behind it, and more</p>") == "İ" * 40 + "right behind it, and more"


# ── Secrets ──


def test_gradient_of_the_network():
    which, classes, inside, truth = secrets.findings_windows(secrets.labelled_findings(40, 3))
    net = secrets.Network(1)
    y = truth[which]

    def loss():
        z = net.logits(classes, inside).astype(np.float64)
        return float((np.logaddexp(0, z) - y * z).mean())

    before = loss()
    net.fit(classes, inside, y, epochs=8, size=16)
    assert loss() < before * 0.8


def test_held_out_findings():
    net = secrets.trained()
    findings = secrets.labelled_findings(800, 12345)
    which, classes, inside, truth = secrets.findings_windows(findings)
    best = np.full(len(truth), -np.inf)
    np.maximum.at(best, which, net.logits(classes, inside))
    said = net.score(best) >= net.threshold
    assert said[truth == 1].mean() >= 0.96 and (~said)[truth == 0].mean() >= 0.9


def test_every_long_run_and_every_assigned_value_is_a_candidate():
    texts = ["id 0123456789ab end", "password=hunter2!", "no digits inhere", "token: abc12", "a" * 30 + "B" + "c" * 30, 'api_key = "' + "x1" * 500 + '"', "é1234567890123"]
    buf, offs = text_buffers(pa.array(texts))
    start, end = secrets.candidates(buf, offs)
    got = [bytes(buf[a:z]).decode() for a, z in zip(start, end, strict=True)]
    assert got == ["0123456789ab", "hunter2!", "a" * 30 + "B" + "c" * 30, "x1" * 500, "1234567890123"]
    brute = {(m.start(), m.end()) for m in re.finditer(rb"[A-Za-z0-9_\-+/.]{12,}", bytes(buf)) if re.search(rb"\d", m.group())}
    assert {(int(a), int(z)) for a, z in zip(start, end, strict=True)} >= {(a, z) for a, z in brute if not any(a < o < z for o in offs)}


def test_an_assigned_value_is_whole_though_a_run_lies_inside():
    buf, offs = text_buffers(pa.array(['password = "N7!kq9x-4421-ab33-zz"', "token: 0123456789ab"]))
    got = [bytes(buf[a:z]).decode() for a, z in zip(*secrets.candidates(buf, offs), strict=True)]
    assert got == ["N7!kq9x-4421-ab33-zz", "kq9x-4421-ab33-zz", "0123456789ab"]


def test_windows_cover_long_candidates():
    buf, offs = text_buffers(pa.array(["k " + "a1" * 150 + " end"]))
    _, classes, inside = secrets.encode(buf, offs, np.array([2]), np.array([302]))
    seen = np.zeros(len(buf), dtype=bool)
    for k in range(len(classes)):
        at = 2 + k * secrets.STRIDE - secrets.SIDE + np.flatnonzero(inside[k])
        seen[at] = True
    assert seen[2:302].all() and not seen[:2].any()


def test_edges_of_scan(spark, edges, nothing, nulls_only):
    assert secrets.scan(edges).count() == 0 and secrets.scan(nothing).count() == 0 and secrets.scan(nulls_only).count() == 0
    r = random.Random(5)
    key = "ghp_" + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36))
    docs = frame(spark, [(None, f"use {key} now"), (1, f"use {key} now"), (1, f"use {key} now"), (2, prose(1, 30_000) + f" api_key={key}")], extra=True)
    got = rows_of(secrets.scan(docs), "doc_id", "n_bytes", "shown", "is_secret")
    assert got == [(None, 40, "ghp_", True), (1, 40, "ghp_", True), (1, 40, "ghp_", True), (2, 40, "ghp_", True)]


# ── Mixing ──


def test_rates_solve_the_least_squares(spark):
    r = np.random.default_rng(2)
    n, k = 400, 3
    p = r.dirichlet([0.3] * k, n).round(6)
    tokens = r.integers(0, 500, n)
    members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, posterior array<double>")
    domains, targets = ("a", "b", "c"), {"a": 0.2, "b": 0.3, "c": 0.5}
    steps = mixing.fit_rates(members, domains, targets, iterations=200)
    rate = mixing.rates_of(p, steps)
    total = (rate * tokens) @ p
    assert (rate >= 0).all() and np.allclose(total / total.sum(), [0.2, 0.3, 0.5], atol=1e-3)
    # the same projected gradient, in one piece
    natural = tokens @ p
    want = np.array([0.2, 0.3, 0.5])
    budget = min(natural.sum(), mixing.MAX_REPEAT * (natural / want).min())
    x = np.ones(n)
    for _ in range(len(steps)):
        x = np.maximum(0, x - p @ (((x * tokens) @ p - want * budget) / natural))
    assert np.allclose(x, rate, atol=1e-6)


@pytest.mark.parametrize("scarce", ["toxic", "es"])
def test_a_scarce_domain_does_not_cut_the_others(spark, scarce):
    tokens = {"en": 5000, "de": 1700, "fr": 1700, "es": 1300, "junk": 500, "toxic": 300} | {scarce: 20}
    one = np.eye(len(mixing.DOMAINS))
    members = spark.createDataFrame([(i, tokens[d], one[i].tolist()) for i, d in enumerate(mixing.DOMAINS)], "doc_id long, tokens long, posterior array<double>")
    rate = dict(zip(mixing.DOMAINS, mixing.rates_of(one, mixing.fit_rates(members)), strict=True))
    assert all(rate[d] >= 1 - 1e-6 for d in mixing.WHOLE) and max(rate.values()) <= mixing.MAX_REPEAT + 1e-6
    assert scarce == "toxic" or np.isclose(rate["es"], mixing.MAX_REPEAT)


def test_no_recognised_toxic_document_stays(spark):
    p = np.array([[0.02, 0, 0, 0, 0, 0.98], [0.0, 0.0, 0.0, 0.45, 0.0, 0.55], [0.8, 0, 0, 0, 0, 0.2], [0.3, 0, 0, 0, 0.7, 0.0]] + [list(x) for x in np.eye(6)[:4]])
    tokens = [100, 100, 100, 100, 5000, 1700, 1700, 400]
    members = spark.createDataFrame([(i, t, q.tolist()) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, tokens long, posterior array<double>")
    rate = mixing.rates_of(p, mixing.fit_rates(members), mixing.unwanted(mixing.DOMAINS, mixing.TARGETS))
    assert rate[[0, 1, 3]].tolist() == [0, 0, 0] and (rate[[2, 4, 5, 6, 7]] > 0.9).all()


def test_toxic_documents_of_the_tables_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mixing_rates(docs, labels).toPandas()
    said = np.array(mixing.DOMAINS)[np.stack(rows.posterior).argmax(axis=1)]
    assert (said == "toxic").sum() > 0 and (rows.copies[np.isin(said, ["toxic", "junk"])] == 0).all() and (rows.rate[~np.isin(said, ["toxic", "junk"])] > 0.5).mean() > 0.99
    gone = set(rows.doc_id[said == "toxic"])
    assert not gone & {r.doc_id for r in mixing.remixed(docs, labels).select("doc_id").collect()}


def test_held_out_domains(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = mixing.labelled(docs, labels, 10_000).where(F.col("domain").isin(*mixing.DOMAINS)).toPandas().sort_values("doc_id")
    at = {d: i for i, d in enumerate(mixing.DOMAINS)}
    y = rows.domain.map(at).to_numpy()
    cut = len(rows) // 2
    model = mixing.Classifier().fit(pa.array(rows.text[:cut]), y[:cut])
    p, _ = model.posteriors(pa.array(rows.text[cut:]))
    assert (p.argmax(axis=1) == y[cut:]).mean() > 0.9
    toxic = y[cut:] == at["toxic"]
    said = p.argmax(axis=1) == at["toxic"]
    assert said[toxic].mean() > 0.7 and said[~toxic].mean() < 0.01  # two in five labelled toxic documents have no word that marks them


def test_labels_that_contradict_one_another_count_by_the_worst(spark):
    docs = frame(spark, [(i, prose(i, 20)) for i in range(6)] * 4)
    labels = [(0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 1, 0), (2, None, 0), (2, 1, None), (3, 1, 0), (None, 0, 1)]
    want = [(0, "toxic"), (1, "junk"), (2, "en"), (3, "en")]
    for rows in (labels, labels[::-1]):
        lab = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").repartition(3)
        assert rows_of(mixing.labelled(docs, lab), "doc_id", "domain") == want  # one row each, however often the text is there


def test_totals_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mixing.mixing_rates(docs, labels).toPandas()
    total = (rows.rate.to_numpy() * rows.tokens.to_numpy()) @ np.stack(rows.posterior)
    assert np.allclose(total / total.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], atol=0.02)
    assert np.allclose(rows.copies, rows.rate, atol=1) and (rows.copies >= np.floor(rows.rate)).all()


def test_edges_of_mixing(spark, edges, edge_rows, nothing, nulls_only):
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 1), (7, None, None), (2, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = mixing.mixing_rates(edges, labels)
    assert got.count() == len(edge_rows) and got.where("rate is null or rate < 0 or copies is null").count() == 0
    assert mixing.remixed(edges, labels).columns == edges.columns
    for lab in (labels, labels.limit(0)):
        assert mixing.mixing_rates(nothing, lab).count() == 0 and mixing.remixed(nothing, lab).count() == 0
        assert mixing.mixing_rates(nulls_only, lab).count() == 2
    uniform = mixing.mixing_rates(edges, labels.limit(0)).first().posterior
    assert np.allclose(uniform, 1 / len(mixing.DOMAINS), atol=1e-6)


def test_copies_follow_the_rate(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(1.3).alias("rate"))
    n = [r.n for r in df.select(mixing.copies_of(F.col("rate"), F.col("doc_id")).alias("n")).collect()]
    assert set(n) == {1, 2} and abs(np.mean(n) - 1.3) < 0.02


def test_documents_without_an_id_keep_null_columns(spark):
    docs = spark.createDataFrame([(None, "some words", None, None, None)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixing_rates(docs, labels).count() == 1


@pytest.fixture(autouse=True)
def _quiet():
    with np.errstate(over="ignore"):
        yield

"""Secret scan (op4) against a naive scan, a naive forward pass, and the secrets planted in the tables."""

import re

import numpy as np
import pyarrow as pa

from rowsift.llm import secrets
from rowsift.llm.textkit import text_buffers

from .conftest import frame, rows_of

_NAMED = re.compile(r"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?["']?[ \t\n\r\f\v]*(?=[:=])""")
_VALUE = re.compile(r"""[:=][ \t\n\r\f\v]*["']?([^ \t\n\r\f\v"',;<>]{6,})""")


def naive(text):
    """Candidates of one ASCII text, by regular expressions over the whole of it."""
    out = set()
    for m in re.finditer(r"[A-Za-z0-9_\-+/.]{12,}", text):
        run = m.group()
        if re.search(r"\d", run) or (len(run) >= 20 and re.search("[a-z][A-Z]", run)):
            out.add(m.span())
    for m in _NAMED.finditer(text):
        v = _VALUE.match(text, m.end())
        if v:
            out.add(v.span(1))
    return sorted(out)


def found(*texts):
    buf, offs = text_buffers(pa.array(texts))
    return [bytes(buf[a:z]).decode() for a, z in zip(*secrets.candidates(buf, offs), strict=True)]


def test_no_bound_on_blanks_or_inner_runs():
    assert found("password" + " " * 30 + '= "p@ss!w0rd#x"') == ["p@ss!w0rd#x"]
    assert found("password =" + "\n" * 300 + "p@ss!w0rd#x") == ["p@ss!w0rd#x"]
    assert found('password = "hunt!abcdefghijk12345"') == ["hunt!abcdefghijk12345", "abcdefghijk12345"]
    assert found("password" + " " * 5000 + ":" + " " * 5000 + "'" + "!x" * 4000 + "'") == ["!x" * 4000]
    assert found("password =", "p@ss!w0rd#x") == [] and found("password", "= p@ss!w0rd#x") == []


def test_candidates_are_those_of_a_naive_scan():
    r = np.random.default_rng(4)
    parts = ["password", "tokens", "Auth", "api-key", '"', "'", " ", "  ", "\n", "=", ":", "x1", "aB", "zz!", "#@", "word", "0123456789ab", ",", ";", "/", "-", "secret\t=", "pwd:"]
    texts = ["".join(parts[i] for i in r.integers(0, len(parts), r.integers(1, 60))) for _ in range(400)]
    for t in texts:
        buf, offs = text_buffers(pa.array([t]))
        assert [(int(a), int(z)) for a, z in zip(*secrets.candidates(buf, offs), strict=True)] == naive(t), t
    buf, offs = text_buffers(pa.array(texts))  # the same when all lie in one slice
    assert [(int(a), int(z)) for a, z in zip(*secrets.candidates(buf, offs), strict=True)] == [(a + int(o), z + int(o)) for t, o in zip(texts, offs, strict=False) for a, z in naive(t)]


def test_logits_are_those_of_a_naive_forward_pass():
    net = secrets.Network(5)
    buf, offs = text_buffers(pa.array(['before token = "abcDEF0123456789xyz" behind']))
    start, end = np.array([16]), np.array([35])
    _, classes, inside = secrets.encode(buf, offs, start, end)
    p = net.p
    rows = [[float(x) for x in p["emb"][c]] + [float(i)] for c, i in zip(classes[0], inside[0], strict=True)]
    acts = []
    for at in range(secrets.WIDTH - net.K + 1):
        flat = [x for row in rows[at : at + net.K] for x in row]
        acts.append([max(0.0, sum(flat[i] * float(p["conv"][i, c]) for i in range(len(flat))) + float(p["cb"][c])) for c in range(net.C)])
    pooled = [max(a[c] for a in acts) for c in range(net.C)] + [sum(a[c] for a in acts) / len(acts) for c in range(net.C)]
    hidden = [max(0.0, sum(pooled[i] * float(p["w1"][i, j]) for i in range(2 * net.C)) + float(p["b1"][j])) for j in range(net.H)]
    z = sum(hidden[j] * float(p["w2"][j, 0]) for j in range(net.H)) + float(p["b2"][0])
    assert np.isclose(net.logits(classes, inside)[0], z, atol=1e-4)


def test_the_threshold_is_the_highest_with_the_recall():
    r = np.random.default_rng(0)
    z, truth = r.normal(size=500) * 3 + 4, (r.random(500) < 0.6).astype(float)
    net = secrets.Network(1)
    net.calibrate(z, truth, 0.9)
    score = net.score(z)[truth > 0]
    assert (score >= net.threshold).mean() >= 0.9 and (score > net.threshold).mean() < 0.9


def test_planted_secrets_of_the_tables_are_found(spark):
    """Recall on the corpus: the documents hold keys of 40 hexadecimal digits assigned to ``token``."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = {(d, m.group(1)[:4]) for d, t in docs.where("text like '%token = %'").select("doc_id", "text").collect() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    said = set(rows_of(secrets.scan(docs).where("is_secret and n_bytes = 40"), "doc_id", "shown"))
    assert len(planted) > 100 and len(planted & said) >= secrets.RECALL * len(planted)


def test_a_long_text_is_scanned_whole(spark):
    text = "plain words " * 50_000 + 'secret = "k9!' + "q7w" * 10 + '" ' + "more words " * 50_000
    assert rows_of(secrets.scan(frame(spark, [(1, text)])), "start", "n_bytes")[0] == (len("plain words ") * 50_000 + 10, 33)

"""Secret scan: a character convolutional network over every candidate and its context.

Candidates are all runs of secret-like characters and all values assigned to a telling name.  The network, in numpy,
sees each candidate whole with 32 characters on either side: embedding, convolution of width 5, maximum and mean over
places, one hidden layer.  It is trained on labelled findings; its scores are calibrated by a
logistic curve on findings held back, and the threshold is the highest that keeps the required recall on them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkit import slices, text_buffers

SIDE, SPAN, STRIDE = 32, 64, 48
WIDTH = SIDE + SPAN + SIDE
MIN_RUN, MIN_MIXED, MIN_VALUE = 12, 20, 6
RECALL = 0.98
FINDINGS, SEED = 2400, 7

_RUN = np.zeros(256, dtype=bool)
_RUN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+/."]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LOWER, _UPPER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LOWER[97:123], _UPPER[65:91] = True, True
_NAME = re.compile(rb"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?[\"']?$")
#: No name, with its plural and a quote behind it, is longer than this.
NAME_BYTES = 16
_BLANK, _STOP = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BLANK[[*b" \t\n\r\f\v"]] = True
_STOP[[*b" \t\n\r\f\v\"',;<>"]] = True
_QUOTE = np.zeros(256, dtype=bool)
_QUOTE[[*b"\"'"]] = True
_LAST = np.zeros(256, dtype=bool)
_LAST[[*b"dsetnylhDSETNYLH\"'"]] = True  # how names end

#: Character classes: pad, 95 printable ASCII, other, blank other than the space.
_CLASS = np.full(256, 96, dtype=np.int64)
_CLASS[32:127] = np.arange(1, 96)
_CLASS[[9, 10, 13]] = 97
CLASSES = 98


def candidates(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the candidates of all texts, in order, each once.

    A run counts from 12 characters if it has a digit, from 20 if it changes from small letters to capitals
    inside; an assigned value counts from 6, whole, also if runs lie inside it.
    """
    inside = _RUN[buf]
    prev, after = np.zeros_like(inside), np.zeros_like(inside)
    if len(buf):
        prev[1:], after[:-1] = inside[:-1], inside[1:]
        full = offs[1:] > offs[:-1]
        prev[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~prev), np.flatnonzero(inside & ~after) + 1
    long = end - start >= MIN_RUN
    start, end = start[long], end[long]
    digits = np.flatnonzero(_DIGIT[buf])
    has = np.searchsorted(digits, end) > np.searchsorted(digits, start)
    turns = np.flatnonzero(_LOWER[buf[:-1]] & _UPPER[buf[1:]]) + 1 if len(buf) else digits
    mixed = (end - start >= MIN_MIXED) & (np.searchsorted(turns, end) > np.searchsorted(turns, start, "right"))
    start, end = start[has | mixed], end[has | mixed]
    extra = assigned(buf, offs)
    if len(extra):
        start, end = np.unique(np.concatenate([np.stack([start, end], axis=1), extra]), axis=0).T
    return start, end


def assigned(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte ranges of the values assigned to a telling name: name, quote, blanks, a sign, blanks, quote, value.

    Blanks may be any number, on either side of the sign, but all lies within one text.
    """
    none = np.zeros((0, 2), dtype=np.int64)
    signs = np.flatnonzero((buf == ord("=")) | (buf == ord(":")))
    if not len(signs):
        return none
    doc = np.searchsorted(offs, signs, "right") - 1
    first, limit = offs[doc], offs[doc + 1]
    solid = np.flatnonzero(~_BLANK[buf])
    before = solid[np.maximum(np.searchsorted(solid, signs) - 1, 0)]  # last byte of the name
    at = np.searchsorted(solid, signs, "right")
    value = np.append(solid, len(buf))[at]
    ok = (before < signs) & (before >= first) & _LAST[buf[before]] & (value < limit)
    signs, first, limit, before, value = signs[ok], first[ok], limit[ok], before[ok], value[ok]
    if not len(signs):
        return none
    value = value + _QUOTE[buf[value]]
    stops = np.append(np.flatnonzero(_STOP[buf]), len(buf))
    stop = np.minimum(stops[np.searchsorted(stops, value)], limit)
    ok = np.flatnonzero(stop - value >= MIN_VALUE)
    told = [bool(_NAME.search(buf[max(a, b + 1 - NAME_BYTES) : b + 1].tobytes())) for a, b in zip(first[ok].tolist(), before[ok].tolist(), strict=True)]
    ok = ok[np.array(told, dtype=bool)]
    return np.stack([value[ok], stop[ok]], axis=1)


def encode(buf: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, classes, inside): windows of the candidates; a candidate beyond 64 characters has several that overlap."""
    more = np.maximum(0, -(-(end - start - SPAN) // STRIDE))
    which = np.repeat(np.arange(len(start)), more + 1)
    k = np.arange(len(which)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    left = start[which] + k * STRIDE - SIDE
    at = left[:, None] + np.arange(WIDTH)
    doc = np.searchsorted(offs, start[which], "right") - 1
    near = (at >= np.maximum(offs[doc], start[which] - SIDE)[:, None]) & (at < np.minimum(offs[doc + 1], end[which] + SIDE)[:, None])
    classes = np.where(near, _CLASS[buf[np.clip(at, 0, max(0, len(buf) - 1))]], 0) if len(buf) else np.zeros((0, WIDTH), dtype=np.int64)
    inside = near & (at >= start[which][:, None]) & (at < end[which][:, None])
    return which, classes, inside


def _sigmoid(y: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -y))


class Network:
    """Embedding 8 + mark, convolution 5 x 24, maximum and mean, hidden 24, one output."""

    E, C, H, K = 8, 24, 24, 5

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        width = self.K * (self.E + 1)
        self.p = {"emb": f(CLASSES, self.E, scale=0.5), "conv": f(width, self.C, scale=(2 / width) ** 0.5), "cb": np.zeros(self.C, np.float32), "w1": f(2 * self.C, self.H, scale=(1 / self.C) ** 0.5), "b1": np.zeros(self.H, np.float32), "w2": f(self.H, 1, scale=self.H**-0.5), "b2": np.zeros(1, np.float32)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, classes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n, places = self.p, len(classes), WIDTH - self.K + 1
        x = np.concatenate([p["emb"][classes], inside[..., None].astype(np.float32)], axis=2)
        cols = np.concatenate([x[:, j : j + places] for j in range(self.K)], axis=2).reshape(n * places, -1)
        a = np.maximum(cols @ p["conv"] + p["cb"], 0).reshape(n, places, self.C)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(axis=1)], axis=1)
        h = np.maximum(pooled @ p["w1"] + p["b1"], 0)
        return (h @ p["w2"] + p["b2"])[:, 0], (cols, a, top, pooled, h)

    def logits(self, classes: np.ndarray, inside: np.ndarray, at_once: int = 512) -> np.ndarray:
        parts = [self._forward(classes[i : i + at_once], inside[i : i + at_once])[0] for i in range(0, len(classes), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def fit(self, classes: np.ndarray, inside: np.ndarray, truth: np.ndarray, epochs: int = 10, rate: float = 5e-3, size: int = 64, seed: int = SEED) -> None:
        """Adam on the log-loss, by mini-batches."""
        r, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        places = WIDTH - self.K + 1
        for _ in range(epochs):
            order = r.permutation(len(truth))
            for i in range(0, len(order), size):
                at = order[i : i + size]
                n = len(at)
                z, (cols, a, top, pooled, h) = self._forward(classes[at], inside[at])
                d = ((_sigmoid(z) - truth[at]) / n).astype(np.float32)[:, None]
                g = {"w2": h.T @ d, "b2": d.sum(0)}
                dh = (d @ p["w2"].T) * (h > 0)
                g["w1"], g["b1"] = pooled.T @ dh, dh.sum(0)
                dp = dh @ p["w1"].T
                da = np.repeat(dp[:, None, self.C :] / places, places, axis=1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, : self.C], 1)
                da = (da * (a > 0)).reshape(n * places, self.C)
                g["conv"], g["cb"] = cols.T @ da, da.sum(0)
                dx = np.zeros((n, WIDTH, self.E + 1), np.float32)
                back = (da @ p["conv"].T).reshape(n, places, self.K, self.E + 1)
                for j in range(self.K):
                    dx[:, j : j + places] += back[:, :, j]
                flat, de = classes[at].ravel(), dx[..., : self.E].reshape(-1, self.E)
                g["emb"] = np.stack([np.bincount(flat, weights=de[:, e], minlength=CLASSES) for e in range(self.E)], axis=1).astype(np.float32)
                t += 1
                for k in p:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)

    def calibrate(self, z: np.ndarray, truth: np.ndarray, recall: float = RECALL) -> None:
        """Logistic calibration by Newton steps, then the highest threshold with the recall."""
        soft = np.where(truth > 0, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
        x = np.stack([z.astype(np.float64), np.ones(len(z))], axis=1)

        def loss(c: np.ndarray) -> float:
            y = x @ c
            return float((np.logaddexp(0, y) - soft * y).sum() + 0.05 * (c[0] - 1) ** 2)

        c = np.array([1.0, 0.0])
        for _ in range(50):
            q = _sigmoid(x @ c)
            grad = x.T @ (q - soft) + [0.1 * (c[0] - 1), 0]
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0.1, 1e-3]), grad)
            pace = 1.0
            while loss(c - pace * step) > loss(c) and pace > 1e-6:
                pace /= 2
            c = c - pace * step
        a, b = c
        self.slope, self.shift = float(a), float(b)
        score = np.sort(self.score(z)[truth > 0])
        self.threshold = float(score[int(np.floor((1 - recall) * len(score)))]) if len(score) else 0.5

    def score(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * z.astype(np.float64) + self.shift)

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score) of all candidates; a long one counts by its most suspect window."""
        start, end = candidates(buf, offs)
        best = np.full(len(start), -np.inf)
        for i in range(0, len(start), 2048):
            which, classes, inside = encode(buf, offs, start[i : i + 2048], end[i : i + 2048])
            np.maximum.at(best, which + i, self.logits(classes, inside))
        return start, end, self.score(best)


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(text before, candidate, text behind, label): known kinds of secrets and of what looks like them."""
    r = np.random.default_rng(seed)
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    alnum = b64[:62]
    low = "abcdefghijklmnopqrstuvwxyzéèäöüñ"

    def some(chars: str, k: int) -> str:
        return "".join(chars[i] for i in r.integers(0, len(chars), k))

    def word() -> str:
        return some(low[: r.integers(26, len(low))], int(r.integers(2, 11)))

    def prose() -> str:
        if r.random() < 0.15:  # the finding begins or ends the text
            return ""
        marks = ["", "", "", ",", ".", "###", "$$$", " |", "!!"]
        return " ".join(word() + marks[r.integers(len(marks))] for _ in range(6))

    names = ["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "API_KEY", "SECRET_KEY", "passwd"]
    signs = [" = ", "=", ": ", ":", ' = "', '="', ': "', " = '"]
    digits = hexa[:10]
    good = [
        lambda: (some(hexa, int(r.choice([32, 40, 40, 64]))), True),
        lambda: (some(alnum, int(r.integers(20, 44))), True),
        lambda: (some(b64, int(r.integers(32, 90))), True),
        lambda: ("AKIA" + some(alnum[:26] + digits, 16), r.random() < 0.5),
        lambda: ("ghp_" + some(alnum, 36), r.random() < 0.5),
        lambda: ("sk_live_" + some(alnum, 24), r.random() < 0.5),
        lambda: ("xoxb-" + some(digits, 12) + "-" + some(alnum, 24), r.random() < 0.5),
        lambda: ("eyJ" + some(alnum, 30) + ".eyJ" + some(alnum, int(r.integers(40, 160))) + "." + some(alnum + "_-", 43), r.random() < 0.5),
        lambda: (some(alnum + "!#%&*@", int(r.integers(8, 18))), True),
    ]
    calls = ["commit ", "sha1 ", "md5: ", "rev ", "checksum ", "build ", "image ", "blob ", "etag: "]
    bad = [
        lambda: ("", some(digits, 16)),
        lambda: ("", ".".join(str(int(x)) for x in r.integers(100, 255, 4))),
        lambda: ("", f"{some(digits, 3)}-{some(digits, 3)}-{some(digits, 4)}"),
        lambda: (calls[r.integers(len(calls))], some(hexa, int(r.choice([32, 40, 64])))),
        lambda: ("id ", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", f"20{some(digits[:3], 1)}{some(digits, 1)}-0{some('123456789', 1)}-1{some(digits, 1)}T10.{some(digits, 2)}.{some(digits, 2)}"),
        lambda: ("", "www." + some(low[:26], 8) + ".example.com/" + some(low[:26], 5) + "/" + some(digits, 3)),
        lambda: ("", "/".join(some(low[:26], int(r.integers(3, 8))) for _ in range(4)) + ".v" + some(digits, 1)),
        lambda: ("", some(low[:26], int(r.integers(9, 14))) + some(digits, int(r.integers(1, 4)))),
        lambda: ("", "".join(some(low[:26], 5).capitalize() for _ in range(5))),
        lambda: ("version ", f"v{some('123', 1)}.{some(digits, 2)}.{some(digits, 1)}-beta.{some(digits, 2)}"),
        lambda: (some(low[:26], 7) + "@", f"mail{some(digits, 1)}.example.{['com', 'net', 'org'][r.integers(3)]}"),
        lambda: ("base64,", some(b64, int(r.integers(60, 140)))),
        lambda: (names[r.integers(len(names))] + signs[r.integers(4)], ["changeme", "your-token-here", "example-value-1", "placeholder-000", "xxxxxxxxxxxx", "not-set-in-v1.0"][r.integers(6)]),
    ]
    out = []
    for i in range(n):
        if i % 2:
            value, named = good[r.integers(len(good))]()
            sign = signs[r.integers(len(signs))]
            lead = names[r.integers(len(names))] + sign if named else ["key ", "use ", "", "Authorization: Bearer "][r.integers(4)]
            tail = sign[-1] if sign[-1] in "\"'" and named else ""
            out.append((f"{prose()} {lead}", value, f"{tail}{['', '###', '&&&', '.', ' |'][r.integers(5)]} {prose()}", 1))
        else:
            lead, value = bad[r.integers(len(bad))]()
            out.append((f"{prose()} {lead}", value, f"{['', '.', ',', '###', ' |'][r.integers(5)]} {prose()}", 0))
    return out


def findings_windows(findings: list[tuple[str, str, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    texts = [a + b + c for a, b, c, _ in findings]
    buf, offs = text_buffers(pa.array(texts))
    start = offs[:-1] + np.array([len(a.encode()) for a, _, _, _ in findings])
    end = start + np.array([len(b.encode()) for _, b, _, _ in findings])
    which, classes, inside = encode(buf, offs, start, end)
    return which, classes, inside, np.array([y for *_, y in findings], dtype=np.float64)


@lru_cache(maxsize=2)
def trained(n: int = FINDINGS, seed: int = SEED, recall: float = RECALL) -> Network:
    """Network fitted on three quarters of the labelled findings, calibrated on the rest."""
    which, classes, inside, truth = findings_windows(labelled_findings(n, seed))
    cut = n * 3 // 4
    net = Network(seed)
    fit = which < cut
    net.fit(classes[fit], inside[fit], truth[which[fit]])
    best = np.full(n, -np.inf)
    np.maximum.at(best, which[~fit], net.logits(classes[~fit], inside[~fit]))
    net.calibrate(best[cut:], truth[cut:], recall)
    return net


SCAN = "doc_id long, start long, n_bytes long, shown string, score double, is_secret boolean"


def scan(docs: DataFrame, model: Network | None = None) -> DataFrame:
    """(doc_id, start, n_bytes, shown, score, is_secret), one row a candidate, whether or not it is a secret.

    ``start`` and ``n_bytes`` are UTF-8 bytes of the text; ``shown`` is the first four characters; ``score`` is the calibrated
    probability.  Defined cases: null and empty texts have no candidates; rows without doc_id are reported with a null doc_id; a very long
    text is scanned whole, and a long candidate is seen whole, by overlapping windows; of candidates with the same bytes one is
    reported, and a run inside an assigned value beside the value; a score right at the threshold is a secret; repeated rows are
    reported each time; an empty table gives no rows; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch):
                buf, offs = text_buffers(part.column(1))
                start, end, score = net.scan(buf, offs)
                doc = np.searchsorted(offs, start, "right") - 1
                shown = [buf[a : min(z, a + 4)].tobytes().decode("utf-8", "replace") for a, z in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(start - offs[doc]), pa.array(end - start), pa.array(shown, pa.string()), pa.array(np.round(score, 4)), pa.array(score >= net.threshold)], names=["doc_id", "start", "n_bytes", "shown", "score", "is_secret"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCAN)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

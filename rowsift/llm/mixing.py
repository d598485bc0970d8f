"""Soft-membership mixing of sources to target weights.

Domains are learned from the labels table: a labelled document is ``toxic``, else ``junk`` (quality 0), else of its language.
A multinomial logistic regression on hashed word counts, and on how many words of each domain's own a document has, gives every
document, labelled or not, a posterior over the domains.  A rate r >= 0 is then fitted for each document such that the expected domain totals, sum of r * tokens * posterior, meet the
targets: projected-gradient least squares, where each iteration is one distributed sum of the domain
totals, and the step of a document follows from its posterior and the residuals alone.  A document whose likeliest
domain has the target 0 is barred: its rate is 0.  What other documents have of such a domain is left to them, lest a rare
one cut documents that only resemble it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, row_key, settle, table
from .textkit import ALNUM, U, Tokens, slices, text_buffers

#: The classifier is fitted on at most so many labelled documents, those with the smallest hashes of doc_id.
TRAIN_DOCS = 3000
BUCKETS = 1 << 17
#: A word is a domain's own if so many labelled documents of the domain have it, and at least this share of all that do.
OWN_DOCS, OWN_SHARE = 8, 0.9
DOMAINS = ("en", "de", "fr", "es", "junk", "toxic")
#: Shares of the domains, scaled to a sum of 1.
TARGETS = {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.13, "junk": 0.0, "toxic": 0.0}
#: Domains of which nothing is cut in total, however scarce another one is; no document is repeated more than MAX_REPEAT times.
WHOLE, MAX_REPEAT = ("en", "de", "fr", "es"), 4.0
ITERATIONS = 12
SEED = "mixing"


class Classifier:
    """Softmax regression.

    A document is the square roots of its hashed word counts, scaled to length 1, the shares of symbols, capitals, bars and
    echoed words, and for each domain how many different words of its own there are, up to three.
    """

    def __init__(self, domains: tuple[str, ...] = DOMAINS, buckets: int = BUCKETS):
        self.domains, self.buckets = tuple(domains), buckets
        self.weights = np.zeros((buckets + 4 + len(domains), len(domains)), dtype=np.float32)
        self.bias = np.zeros(len(domains), dtype=np.float32)
        self.own = np.zeros((buckets, len(domains)), dtype=bool)

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, value) of the words of each document, dense features, and the number of words of each row."""
        raw, raw_offs = text_buffers(texts)
        buf, offs = text_buffers(texts, lower=True)
        tok = Tokens(buf, offs, ALNUM)
        n, doc, h = len(offs) - 1, tok.doc(), tok.hashes()
        col = (h % U(self.buckets)).astype(np.int64)
        key, times = np.unique(doc * self.buckets + col, return_counts=True)
        row, col, val = key // self.buckets, key % self.buckets, np.sqrt(times)
        norm = np.sqrt(np.bincount(row, weights=times, minlength=n))
        val = val / np.maximum(norm[row], 1)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])]) if len(h) else np.zeros(0, dtype=bool)
        words = np.maximum(tok.counts, 1)

        def share(flags: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.minimum(1, np.diff(np.searchsorted(np.flatnonzero(flags), at)) / of)

        size = np.maximum(np.diff(raw_offs), 1)
        dense = np.stack([share(_SYMBOL[raw], size, raw_offs) * 4, share(_UPPER[raw], size, raw_offs) * 2, share(raw == ord("|"), size, raw_offs) * 8, np.bincount(doc, weights=same, minlength=n) / words * 2], axis=1)
        return row, col, val, dense, tok.counts

    def _features(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of all features, ordered by row."""
        n, k = len(dense), len(self.domains)
        count = np.stack([np.bincount(row, weights=self.own[col, j], minlength=n) for j in range(k)], axis=1)
        dense = np.concatenate([dense, np.minimum(count, 3) * (2 / 3)], axis=1)
        row = np.concatenate([row, np.repeat(np.arange(n), 4 + k)])
        col = np.concatenate([col, np.tile(np.arange(self.buckets, self.buckets + 4 + k), n)])
        val = np.concatenate([val, dense.ravel()])
        order = np.argsort(row, kind="stable")
        return row[order], col[order], val[order].astype(np.float32)

    def _scores(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        part = self.weights[col] * val[:, None]
        first = np.searchsorted(row, np.arange(n))
        return np.add.reduceat(part, first, axis=0) + self.bias if n else np.zeros((0, len(self.domains)), dtype=np.float32)

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        *parts, words = self._words(texts)
        s = self._scores(*self._features(*parts), len(words)).astype(np.float64)
        s = np.exp(s - s.max(axis=1, keepdims=True)) if len(s) else s
        return s / s.sum(axis=1, keepdims=True), words

    def fit(self, texts: pa.Array, labels: np.ndarray, epochs: int = 60, rate: float = 0.5, decay: float = 1e-5) -> Classifier:
        """Full-batch Adam on the log-loss; labels are indices into the domains."""
        n, k = len(texts), len(self.domains)
        if not n:
            return self
        found, before = [], 0
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"])):
            row, col, val, dense, _ = self._words(part.column(0))
            found.append((row + before, col, val, dense))
            before += part.num_rows
        row, col, val, dense = (np.concatenate(x) for x in zip(*found, strict=True))
        have = np.stack([np.bincount(col[labels[row] == j], minlength=self.buckets) for j in range(k)], axis=1)
        self.own = (have >= OWN_DOCS) & (have >= OWN_SHARE * have.sum(axis=1, keepdims=True))
        row, col, val = self._features(row, col, val, dense)
        truth = np.eye(k, dtype=np.float32)[labels]
        used, col = np.unique(col, return_inverse=True)
        w, first = np.zeros((len(used), k), dtype=np.float32), np.searchsorted(row, np.arange(n))
        b = np.log((truth.sum(axis=0) + 0.5) / (n + 0.5 * k)).astype(np.float32)
        order = np.argsort(col, kind="stable")
        starts = np.searchsorted(col[order], np.arange(len(used)))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, epochs + 1):
            s = np.add.reduceat(w[col] * val[:, None], first, axis=0) + b
            p = np.exp(s - s.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - truth) / n
            g = np.add.reduceat((d[row] * val[:, None])[order], starts, axis=0) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= rate * d.sum(axis=0)
        self.weights[used], self.bias = w, b
        return self


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*b"#$%&*+<=>@[\\]^_`{}~"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True


def labelled(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, domain) of at most ``most`` labelled documents, one row each; the choice depends on the doc_ids alone.

    Of several labels of a document the worst counts: toxic if one says so, of quality 0 if one says so.  Of several texts of a
    doc_id the smallest counts.
    """
    lab = labels.select(F.col("doc_id").alias("__lab"), F.col("quality").alias("__q"), F.col("toxic").alias("__t")).where("__lab is not null")
    lab = lab.groupBy("__lab").agg(F.min("__q").alias("__q"), F.max("__t").alias("__t"))
    chosen = lab.orderBy(F.xxhash64(F.lit(SEED), "__lab"), "__lab").limit(most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    joined = rows.where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__lab"))
    one = joined.groupBy("doc_id").agg(F.min(F.struct("text", "lang", "__q", "__t")).alias("r")).select("doc_id", "r.*")
    domain = F.when(F.col("__t") == 1, "toxic").when(F.col("__q") == 0, "junk").otherwise(F.col("lang"))
    return one.select("doc_id", "text", domain.alias("domain"))


def train(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, most: int = TRAIN_DOCS) -> Classifier:
    rows = labelled(docs, labels, most).where(F.col("domain").isin(*domains)).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    at = {d: i for i, d in enumerate(domains)}
    return Classifier(domains).fit(rows["text"].combine_chunks(), np.array([at[d] for d in rows["domain"].to_pylist()], dtype=np.int64))


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, tokens, posterior) of every row; tokens are words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p, words = shared.value.posteriors(part.column(1))
                flat = pa.array(np.round(p, 6).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), lists], names=["doc_id", "tokens", "posterior"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, tokens long, posterior array<double>")


def fit_rates(members: DataFrame, domains: tuple[str, ...] = DOMAINS, targets: dict[str, float] = TARGETS, iterations: int = ITERATIONS) -> list[np.ndarray]:
    """Steps of the projected gradient; rate_of applies them.

    The objective is sum over the domains with a target of (total - target)^2 / natural total.  A step of 1 is safe: by Cauchy-Schwarz the curvature in
    the scaled rates is at most 1, as the posteriors of a document sum to 1.  The budget is the smallest under which no domain of ``WHOLE`` is cut.
    A domain whose share of it is more than MAX_REPEAT times what there is gets MAX_REPEAT times that and falls short of its target; the others
    keep theirs.  Domains that the corpus lacks get nothing.
    """
    natural, _ = _totals(members, [], len(domains))
    want, bar = np.array([targets.get(d, 0.0) for d in domains]), unwanted(domains, targets)
    want = np.where(natural > 0, want, 0)
    if not want.sum():
        return []
    want /= want.sum()
    ratio = natural / np.where(want > 0, want, np.inf)
    whole = [ratio[i] for i, d in enumerate(domains) if d in WHOLE and want[i] > 0] or [natural.sum()]
    goal = np.minimum(want * max(whole), MAX_REPEAT * natural)
    steps: list[np.ndarray] = []
    for _ in range(iterations):
        total, _ = _totals(members, steps, len(domains), bar)
        step = np.where((natural > 0) & ~bar, (total - goal) / np.maximum(natural, 1e-9), 0)
        steps.append(step)
        if np.abs(step).max() < 1e-4:
            break
    return steps


def unwanted(domains: tuple[str, ...], targets: dict[str, float]) -> np.ndarray:
    """Flags of the domains whose target is 0."""
    return np.array([targets.get(d, 0.0) <= 0 for d in domains])


def rates_of(posterior: np.ndarray, steps: list[np.ndarray], bar: np.ndarray | None = None) -> np.ndarray:
    """Rates of documents; 0 if one of the domains flagged in ``bar`` is likelier than all others."""
    r = np.ones(len(posterior))
    for step in steps:
        r = np.clip(r - posterior @ step, 0, MAX_REPEAT)
    if bar is not None and bar.any() and not bar.all():
        r[posterior[:, bar].max(axis=1) > posterior[:, ~bar].max(axis=1)] = 0
    return r


def _rated(members: DataFrame, steps: list[np.ndarray], bar: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            flat = pa.compute.list_flatten(b.column(2)).to_numpy() if n else np.zeros(0)
            p = flat.reshape(n, -1) if n else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates_of(p, steps, bar) if n else np.zeros(0))], names=["doc_id", "tokens", "posterior", "rate"])

    return members.mapInArrow(run, "doc_id long, tokens long, posterior array<double>, rate double")


def _totals(members: DataFrame, steps: list[np.ndarray], k: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Expected tokens of each domain under the rates so far; each batch is summed where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k)
        for b in batches:
            if b.num_rows:
                p = pa.compute.list_flatten(b.column(2)).to_numpy().reshape(b.num_rows, k)
                out += (rates_of(p, steps, bar) * b.column(1).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(out)], names=["d", "v"])

    rows = members.mapInArrow(run, "d int, v double").groupBy("d").agg(F.collect_list("v").alias("v")).collect()
    out = np.zeros(k)
    for r in rows:
        out[r.d] = np.sort(np.array(r.v)).sum()  # the same whatever order the parts come in
    return out, float(out.sum())


def mixing_rates(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, tokens, posterior, rate, copies) of every row of docs.

    ``rate`` is the expected number of copies and ``copies`` its random rounding, decided by a hash of doc_id.  Defined
    cases: null and empty texts have no tokens and still get a rate; very long texts are read whole; rows without doc_id are rounded like one
    another; repeated rows and rows that share a doc_id get their rates one by one; of labels that contradict one another the worst
    counts (see labelled); a document as likely of a barred domain as of another stays; without labelled rows every posterior is uniform; a
    domain without tokens gets nothing and the other targets are scaled up; no documents give no rows; other columns play no part.
    """
    members = settle(memberships(docs, train(docs, labels, domains)))
    rated = _rated(members, fit_rates(members, domains, targets), unwanted(domains, targets))
    return rated.withColumn("copies", copies_of(F.col("rate"), F.col("doc_id")))


def copies_of(rate, doc_id):
    draw = F.pmod(F.xxhash64(F.lit(SEED), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def remixed(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, each as often as its rounded rate tells, in the columns they have.

    Posteriors are computed again from each row's own text, so no text is shuffled.  Defined cases: rows without doc_id are
    rounded by a hash of the whole row, repeated rows alike; null, empty and very long texts are rated like others; no
    documents give no rows; the columns keep their names and values, whatever they are called.
    """
    model = train(docs, labels, domains)
    members = settle(memberships(docs, model))
    steps = fit_rates(members, domains, targets)
    shared = docs.sparkSession.sparkContext.broadcast((model, steps, unwanted(domains, targets)))

    def rate(texts: pa.Array) -> pa.Array:
        model, steps, bar = shared.value
        parts = [rates_of(np.round(model.posteriors(p.column(0))[0], 6), steps, bar) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    rate_col, n_col, i_col = fresh(docs, "__rate", "__n", "__i")
    rated = docs.withColumn(rate_col, F.arrow_udf(rate, "double").asNondeterministic()(F.col("text").cast("string")))
    times = rated.withColumn(n_col, copies_of(F.col(rate_col), row_key(docs))).where(F.col(n_col) > 0)
    return times.withColumn(i_col, F.explode(F.sequence(F.lit(1), F.col(n_col)))).drop(rate_col, n_col, i_col)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Quality rules with host-level verdicts.

Each document is measured once and held against five rules, each with two thresholds: above the upper one the document
fails, above the lower one it is in doubt.  The failures are aggregated by host (``source``); each host's rate is
shrunk by a beta prior whose two parameters are fitted to all hosts' rates by moments; and the host's verdict is
joined back.  A document goes if it fails a rule, and at a bad host if it is in doubt.  A document
that no rule doubts stays wherever it comes from.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, settle, small, table, text_bytes
from .textkit import SOLID, Tokens, slices, text_buffers

#: (doubt, failure) above these shares: symbols of characters, capitals of ASCII letters, lone bars of tokens, tokens
#: in lines that occurred before, tokens that repeat the one before.
SHARES = {"symbols": (0.06, 0.12), "capitals": (0.3, 0.5), "bars": (0.12, 0.25), "repeats": (0.45, 0.5), "echoes": (0.2, 0.3)}
#: Capitals count only from so many ASCII letters on; bars, repeats and echoes from so many tokens.
MIN_LETTERS, MIN_TOKENS = 20, 10
HOST_RATE = 0.4
SYMBOLS = "#$%&*+<=>@[\\]^_`{}~"
RULES = tuple(SHARES)

_kind = np.zeros(256, dtype=np.uint8)
_kind[[*SYMBOLS.encode()]] = 1
_kind[65:91] = 2
_kind[97:123] = 3

MEASURES = "chars long, symbols long, upper long, letters long, tokens long, bars long, repeated long, echoed long"


def measures_of(texts: pa.Array) -> list[np.ndarray]:
    """Counts of each text: characters, symbols, capitals, ASCII letters, tokens, lone bars, tokens in lines that occurred before in the text, and tokens that repeat the one before."""
    buf, offs = text_buffers(texts)
    n = len(offs) - 1

    def count(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), offs))

    kind = _kind[buf]
    upper = count(kind == 2)
    tok = Tokens(buf, offs, SOLID)
    sizes = tok.end - tok.start
    bar = (sizes == 1) & (buf[tok.start] == ord("|")) if len(sizes) else np.zeros(0, dtype=bool)
    bars = np.diff(np.searchsorted(np.flatnonzero(bar), tok.bounds))
    h = tok.hashes()
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    same[tok.bounds[:-1][tok.counts > 0]] = False
    echoed = np.diff(np.searchsorted(np.flatnonzero(same), tok.bounds))
    lines = Tokens(buf, offs, _LINE)
    repeated = np.zeros(n, dtype=np.int64)
    if len(lines.start):
        h = lines.hashes()
        doc = lines.doc()
        order = np.lexsort((np.arange(len(h)), h, doc))
        again = np.zeros(len(h), dtype=bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        held = np.searchsorted(tok.start, lines.end) - np.searchsorted(tok.start, lines.start)
        repeated = np.bincount(doc, weights=np.where(again, held, 0), minlength=n).astype(np.int64)
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [chars, count(kind == 1), upper, upper + count(kind == 3), tok.counts.astype(np.int64), bars, repeated, echoed]


_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _measure(texts: pa.Array) -> pa.Array:
    parts = [measures_of(p.column(0)) for p in slices(pa.RecordBatch.from_arrays([texts], names=["text"]))]
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * len(NAMES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)


NAMES = [x.split()[0] for x in MEASURES.split(", ")]
STRUCT = f"struct<{MEASURES.replace(' long', ':bigint')}>"


def measure(text: Column) -> Column:
    """The measures of a text, as a struct; one Arrow batch at a time."""
    return F.arrow_udf(_measure, STRUCT).asNondeterministic()(text.cast("string"))  # so that it runs once a row


def rules(level: int, measures: str = "__m") -> dict[str, Column]:
    """Doubt (0) or failure (1) by each rule, from the measures in a column."""
    c = lambda name: F.col(measures)[name]
    enough = c("tokens") >= MIN_TOKENS
    at = {r: F.lit(t[level]) for r, t in SHARES.items()}
    return {
        "symbols": c("symbols") > c("chars") * at["symbols"],
        "capitals": (c("letters") >= MIN_LETTERS) & (c("upper") > c("letters") * at["capitals"]),
        "bars": enough & (c("bars") > c("tokens") * at["bars"]),
        "repeats": enough & (c("repeated") > c("tokens") * at["repeats"]),
        "echoes": enough & (c("echoed") > c("tokens") * at["echoes"]),
    }


def _any(flags: dict[str, Column]) -> Column:
    return reduce(Column.__or__, (F.coalesce(c, F.lit(False)) for c in flags.values()))


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, host_docs, host_rate) from (host, failed): rates of documents that fail a rule, shrunk to the mean of all.

    The beta prior is fitted by moments, hosts weighed by their documents and the binomial noise taken off: with N documents at H hosts,
    x failures among a host's n, B = (sum x^2/n - X^2/N)/(H-1) between and W = (X - sum x^2/n)/(N-H) within hosts, n0 = (N - sum n^2/N)/(H-1),
    the share of variance between hosts is r = (B - W)/(B + (n0-1)W) and the prior weighs 1/r - 1 documents: at least 1, and 1e6
    where hosts differ no more than chance would have it.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col("failed").cast("int")).alias("bad"))
    n, x = F.col("host_docs").cast("double"), F.col("bad").cast("double")
    sums = hosts.agg(F.sum(n).alias("N"), F.sum(x).alias("X"), F.sum(x * x / n).alias("A"), F.sum(n * n).alias("Q"), F.count("*").cast("double").alias("H"))
    between, within = F.expr("(A - X * X / N) / nullif(H - 1, 0)"), F.expr("(X - A) / nullif(N - H, 0)")
    share = F.when((F.col("H") > 1) & (F.col("N") > F.col("H")), F.try_divide(between - within, between + (F.expr("(N - Q / N) / nullif(H - 1, 0)") - 1) * within))
    weight = F.when(share > 1e-6, F.greatest(1 / F.when(share > 1e-6, share) - 1, F.lit(1.0))).otherwise(F.lit(1e6))
    prior = sums.select((F.col("X") / F.col("N")).alias("m"), weight.alias("weight"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", ((F.col("bad") + F.col("m") * F.col("weight")) / (F.col("host_docs") + F.col("weight"))).alias("host_rate"))


def verdicts(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, source, the failed rules, the host's shrunken rate and whether the document stays.

    Defined cases: a null text measures zero and, like an empty one, fails no rule; very long texts are measured whole; rows without doc_id are judged
    like others; documents without a source form one host; repeated rows are judged, and counted for their
    host, one by one; the thresholds are strict, so a share right at one passes; no documents give no rows; other columns play no part.
    """
    failed, doubted = rules(1), rules(0)
    flags = [F.coalesce(failed[r], F.lit(False)).alias(f"failed_{r}") for r in RULES]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), measure(F.col("text")).alias("__m"))
    judged = settle(rows.select("doc_id", "host", *flags, _any(failed).alias("failed"), _any(doubted).alias("doubtful")))
    rates = settle(host_rates(judged).select(F.col("host").alias("of_host"), "host_docs", "host_rate"))
    n, size = text_bytes(rates, "of_host")
    joined = judged.join(small(rates, 1, size + 40 * n), F.col("host").eqNullSafe(F.col("of_host")))
    bad = F.col("host_rate") > HOST_RATE
    keep = ~F.col("failed") & ~(F.col("doubtful") & bad)
    return joined.select("doc_id", F.col("host").alias("source"), *(f"failed_{r}" for r in RULES), "doubtful", "host_docs", F.round("host_rate", 6).alias("host_rate"), bad.alias("host_bad"), keep.alias("keep"))


def acceptable(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules and the host verdicts keep, in the columns they have.

    The measures are taken once to judge the hosts and once more, with the few bad hosts at hand, to filter row by row; so no text is shuffled and
    rows need no id.  Defined cases are those of verdicts; columns keep their names and values, whatever they are called.
    """
    measured = docs.select(F.col("source").cast("string").alias("host"), measure(F.col("text")).alias("__m"))
    bad = settle(host_rates(measured.select("host", _any(rules(1)).alias("failed"))).where(F.col("host_rate") > HOST_RATE).select(F.col("host").alias("__bad_host")))
    n, size = text_bytes(bad, "__bad_host")
    m, doubt = fresh(docs, "__m", "__doubt")
    marked = docs.withColumn(m, measure(F.col("text"))).where(~_any(rules(1, m))).withColumn(doubt, _any(rules(0, m)))
    host = marked["source"].cast("string").eqNullSafe(bad["__bad_host"])
    return marked.join(small(bad, 1, size + 24 * n), host & marked[doubt], "left_anti").drop(m, doubt)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]+'), 1) AS i FROM documents),
n AS (SELECT doc_id, len(regexp_extract_all(line, '[^ \t\n\f\r]+')) AS k, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM l),
rep AS (SELECT doc_id, sum(k) FILTER (WHERE nth > 1) AS repeated FROM n GROUP BY doc_id),
t AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^ \t\n\f\r]+') AS w FROM documents),
m AS (SELECT doc_id, source, length(text) AS chars, length(text) - length(regexp_replace(text, '[#$%&*+<=>@\[\\\]^_`{}~]', '', 'g')) AS symbols,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters,
        len(w) AS tokens, len(list_filter(w, lambda x: x = '|')) AS bars, coalesce(repeated, 0) AS repeated,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echoed
      FROM t LEFT JOIN rep USING (doc_id)),
f AS (SELECT doc_id, source, symbols > chars * 0.12 AS failed_symbols, letters >= 20 AND upper > letters * 0.5 AS failed_capitals,
        tokens >= 10 AND bars > tokens * 0.25 AS failed_bars, tokens >= 10 AND repeated > tokens * 0.5 AS failed_repeats, tokens >= 10 AND echoed > tokens * 0.3 AS failed_echoes,
        symbols > chars * 0.06 OR (letters >= 20 AND upper > letters * 0.3) OR (tokens >= 10 AND (bars > tokens * 0.12 OR repeated > tokens * 0.45 OR echoed > tokens * 0.2)) AS doubtful
      FROM m),
h AS (SELECT source, count(*)::DOUBLE AS host_docs, (count(*) FILTER (WHERE failed_symbols OR failed_capitals OR failed_bars OR failed_repeats OR failed_echoes))::DOUBLE AS bad FROM f GROUP BY source),
p AS (SELECT sum(host_docs) AS n, sum(bad) AS x, sum(bad * bad / host_docs) AS a, sum(host_docs * host_docs) AS q, count(*)::DOUBLE AS h FROM h),
v AS (SELECT x / n AS m, CASE WHEN h > 1 AND n > h THEN (a - x * x / n) / (h - 1) END AS b, CASE WHEN h > 1 AND n > h THEN (x - a) / (n - h) END AS w, (n - q / n) / nullif(h - 1, 0) AS n0 FROM p),
s AS (SELECT m, (b - w) / nullif(b + (n0 - 1) * w, 0) AS share FROM v),
q AS (SELECT m, CASE WHEN share > 1e-6 THEN greatest(1 / share - 1, 1.0) ELSE 1e6 END AS weight FROM s),
r AS (SELECT source, host_docs, (bad + m * weight) / (host_docs + weight) AS rate FROM h, q)
SELECT doc_id, source, failed_symbols, failed_capitals, failed_bars, failed_repeats, failed_echoes, doubtful, CAST(host_docs AS BIGINT) AS host_docs, round(rate, 6) AS host_rate, rate > 0.4 AS host_bad,
       NOT (failed_symbols OR failed_capitals OR failed_bars OR failed_repeats OR failed_echoes) AND NOT (doubtful AND rate > 0.4) AS keep
FROM f JOIN r USING (source)
"""

"""Quality classifier by hierarchical empirical Bayes.

Document evidence comes from two small logistic models, fitted on a bounded sample of labelled
rows: one says whether a text is good, one whether it is toxic.  Features are style measures and
lexical evidence (clipped log odds of words that one label prefers).  The evidence of all documents
is then summed by host and by path; a host's rate of good documents is shrunk towards the global
rate and a path's towards its host's, by as many pseudo-documents as the variance between hosts and
between paths suggests, so that sparse sites follow their priors.  A document's posterior joins its
own evidence with the prior odds of its path, its own share left out.

Sums are grouped (partial aggregation first) and joined back by key, so a host with a third of all
rows costs one row a task; scoring is one pass without shuffle.

Defined results: null and empty texts have all features 0; null hosts or paths form groups of
their own; without usable labels every document gets the prior 0.5 and is kept; repeated rows are
scored each; labels of repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut
from .textnp import Words, column, raw, sets, slices

#: Labelled rows used at most (the smallest by a hash of the id).
MAX_LABELS = 20_000
#: Words with evidence at most, and labelled documents that must have a word.
MAX_WORDS, MIN_DOCS = 4096, 5
STYLE = 9
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[ord(c) for c in "#*$%&|<>{}[]_=~^\\"]] = 1
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?"]] = 1


def _by_row(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def style(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(style features by row, distinct word hashes, their offsets)."""
    rows = len(w.first) - 1
    distinct, o = sets(w.doc, w.hash, rows)
    n = np.diff(w.first).astype(float)
    size = np.maximum(n, 1)
    chars = np.bincount(w.doc, (w.end - w.start).astype(float), rows) if rows else np.zeros(0)
    body = np.maximum(chars, 1)
    upper, digit, mark, stop = (_by_row(t, w.data, w.offsets) for t in (_UPPER, _DIGIT, _MARK, _STOP))
    x = np.stack([np.ones(rows), np.log1p(n) / 8, n < 20, np.minimum(chars / size, 30) / 10, upper / body, digit / body, mark / body, np.diff(o) / size, np.minimum(stop / size, 1)], 1)
    x[n == 0, 1:] = 0
    return x, distinct, o


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton steps; the first column is the intercept."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Lexical evidence and weights of both heads."""

    def __init__(self, words: np.ndarray, odds: np.ndarray, good: np.ndarray | None, toxic: np.ndarray | None):
        order = np.argsort(words)
        self.words, self.odds, self.good, self.toxic = words[order], odds[order], good, toxic

    def features(self, arr: pa.Array) -> np.ndarray:
        x, distinct, o = style(Words(*raw(arr)))
        lex = np.zeros((len(arr), 2))
        if len(self.words) and len(distinct):
            at = np.minimum(np.searchsorted(self.words, distinct), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == distinct)
            row = np.searchsorted(o, hit, "right") - 1
            for k in (0, 1):
                lex[:, k] = np.clip(np.bincount(row, self.odds[at[hit], k], len(arr)), -10, 10) / 3
        return np.hstack([x, lex])

    def logits(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = self.features(arr)
        zero = np.zeros(len(x))
        return (zero if self.good is None else np.clip(x @ self.good, -12, 12)), (zero - 12 if self.toxic is None else np.clip(x @ self.toxic, -12, 12))


def _texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    good, toxic = F.col("quality"), F.col("toxic")
    some = labels.filter(F.col(id_col).isNotNull() & good.isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(good).cast("int").alias("q"), F.max(F.coalesce(toxic, F.lit(0))).cast("int").alias("x"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(some), "id").select("text", "q", "x")  # at most MAX_LABELS short rows


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELS) -> Model:
    """Fit both heads on at most ``most`` labelled documents."""
    rows = cut(_texts(docs, labels, id_col, text_col, most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(*raw(column(batch, "text")))
            h, o = sets(w.doc, w.hash, batch.num_rows)
            row = np.repeat(np.arange(batch.num_rows), np.diff(o))
            q, x = (batch.column(i).to_numpy()[row] for i in (1, 2))
            u, of = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(of, minlength=len(u))), pa.array(np.bincount(of, q == 0, len(u)).astype(np.int64)), pa.array(np.bincount(of, x == 1, len(u)).astype(np.int64))], ["h", "n", "bad", "toxic"])

    size = rows.agg(F.count(F.lit(1)), F.count_if(F.col("q") == 0), F.count_if(F.col("x") == 1)).first()
    if not size[0]:
        return Model(np.zeros(0, np.uint64), np.zeros((0, 2)), None, None)
    counts = rows.mapInArrow(count, "h long, n long, bad long, toxic long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= MIN_DOCS)

    def odds(k: str, total: int) -> Column:
        # log ratio of the rates, shrunk by one pseudo-document in each class
        rate, rest = (F.col(k) + 0.5) / F.lit(total + 1.0), (F.col("n") - F.col(k) + 0.5) / F.lit(size[0] - total + 1.0)
        return F.log(rate / rest)

    scored = counts.select("h", odds("bad", size[1]).alias("a"), odds("toxic", size[2]).alias("b"))
    top = scored.filter((F.abs("a") > 1.5) | (F.abs("b") > 1.5)).orderBy(F.greatest(F.abs("a"), F.abs("b")).desc(), "h").limit(MAX_WORDS).collect()
    words = np.array([r.h for r in top], np.int64).view(np.uint64)
    strong = np.array([[r.a if abs(r.a) > 1.5 else 0.0, r.b if abs(r.b) > 1.5 else 0.0] for r in top]).reshape(-1, 2)
    model = Model(words, np.clip(strong, -3, 3), None, None)

    def rowwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = model.features(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["f", "q", "x"])

    data = rows.mapInArrow(rowwise, "f array<double>, q int, x int").collect()  # at most MAX_LABELS rows of 11 numbers
    f = np.array([r.f for r in data])
    order = np.lexsort(f.T)  # the same sums whatever the order of arrival
    f, q, x = f[order], np.array([r.q for r in data])[order], np.array([r.x for r in data])[order]
    if 0 < q.sum() < len(q):
        model.good = fit(f, q.astype(float))
    if 0 < x.sum() < len(x):
        model.toxic = fit(f, x.astype(float))
    return model


def evidence(docs: DataFrame, model: Model, id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """(id, host, path, logit, toxic) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            good, toxic = model.logits(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(good), pa.array(toxic)], ["id", "host", "path", "logit", "toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, host string, path string, logit double, toxic double")


def _strength(rate: Column, n: Column, m: Column) -> list[Column]:
    """Moments from which the number of pseudo-documents of a level follows."""
    return [F.sum(n).alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(n * (rate - m) ** 2).alias("between")]


def pseudo(n: float | None, groups: int, between: float | None, m: float) -> float:
    """Pseudo-documents by the method of moments: within over excess between-group variance, in [1, 1000]."""
    if not n or groups < 2:
        return 10.0
    within = max(m * (1 - m), 1e-6)
    excess = (between or 0.0) / n - within * (groups - 1) / n
    return float(min(1000.0, max(1.0, within / excess))) if excess > 0 else 1000.0


#: Sites that are broadcast at most, and parts into which the rows of a site are dealt beyond that.
MAX_SITES, SALT = 100_000, 32


def _with_sites(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``rows`` with the sums of their (host, path): broadcast while these are few, else by salted keys, as one site may hold a third of all rows."""
    if paths.limit(MAX_SITES + 1).count() <= MAX_SITES:
        return rows.join(F.broadcast(paths), ["host", "path"])
    every = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(every, ["host", "path", "salt"]).drop("salt")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str | Column = "source", path: str | Column = "lang", most: int = MAX_LABELS) -> DataFrame:
    """Per row: id, host, path, ``doc_score`` (evidence alone), ``host_score``, ``path_score``,
    ``quality`` (posterior), ``toxic_score`` and ``kept`` (quality and toxicity on the right side of one half)."""
    host, path = (F.col(x) if isinstance(x, str) else x for x in (host, path))
    rows = evidence(docs, learn(docs, labels, id_col, text_col, most), id_col, text_col, host, path)
    p = 1 / (1 + F.exp(-F.col("logit")))
    rows = cut(rows).withColumn("p", p)  # texts are scored once
    paths = cut(rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    total = hosts.agg(F.sum("hs"), F.sum("hn")).first()
    m = min(0.999, max(0.001, (total[0] or 0.5) / (total[1] or 1)))
    a = pseudo(*hosts.agg(*_strength(F.col("hs") / F.col("hn"), F.col("hn"), F.lit(m))).first(), m)
    hosts = hosts.withColumn("host_score", (F.col("hs") + a * m) / (F.col("hn") + a))
    paths = paths.join(hosts, "host")
    b = pseudo(*paths.agg(*_strength(F.col("s") / F.col("n"), F.col("n"), F.col("host_score"))).first(), m)
    paths = paths.select("host", "path", "s", "n", "host_score", ((F.col("s") + b * F.col("host_score")) / (F.col("n") + b)).alias("path_score"))
    prior = (F.col("s") - F.col("p") + b * F.col("host_score")) / (F.col("n") - 1 + b)
    prior = F.least(F.lit(0.999), F.greatest(F.lit(0.001), prior))
    logit = F.col("logit") + F.log(prior / (1 - prior)) - F.log(F.lit(m / (1 - m)))
    out = _with_sites(rows, paths).withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("toxic_score", 1 / (1 + F.exp(-F.col("toxic"))))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("p").alias("doc_score"), "host_score", "path_score", "quality", "toxic_score", ((F.col("quality") >= 0.5) & (F.col("toxic_score") < 0.5)).alias("kept"))

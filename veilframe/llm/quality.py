"""Quality scores by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics (FEATURES).  Class means
and covariances come from sums over a bounded sample of the labelled training
rows, made in Spark; only those sums (one number per class and pair of
features) reach the driver.  Every text is then scored where it lies.
Each covariance is shrunk towards the pooled diagonal, its Cholesky factor is
kept, and a text's score is the difference of the two Mahalanobis
log-densities plus the log prior ratio, squashed to 0..1 by softsign (it keeps
order where a logistic would round to 1).

Defined cases: null and empty texts have the statistics of an empty text and
are scored; null labels and labels without a document teach nothing; repeated
labels each count; a class with no rows gives 0.5 everywhere (predicted 1);
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv

#: Text bytes that are counted at once; the counting needs some forty times as many.
SLICE = 1 << 20

FEATURES = (
    "log bytes", "letters", "upper case", "digits", "stops", "symbols", "bars", "breaks", "non-ASCII",
    "mean word length", "word length spread", "distinct words", "words repeated at once", "most frequent word", "words a line",
)

_KINDS = np.zeros((7, 256), np.float64)
_KINDS[0, 65:91] = _KINDS[0, 97:123] = 1
_KINDS[0, 128:] = 0.5
_KINDS[1, 65:91] = 1
_KINDS[2, 48:58] = 1
_KINDS[3, [ord(c) for c in ".,;:?!'\"-()"]] = 1
_KINDS[4, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?!'\"-()|"]] = 1
_KINDS[5, ord("|")] = 1
_KINDS[6, 10] = 1


def statistics(column) -> np.ndarray:
    """One row of FEATURES for each text."""
    data, offs = tv.text_buffers(column)
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    some = size > 0
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        data = np.full(1, 32, np.uint8)
    at = offs[:-1][some]

    def each(values):
        res = np.zeros(n)
        if len(at):
            res[some] = np.add.reduceat(values, at)
        return res

    share = lambda x, y: np.log(x / np.maximum(y, 1) + 1e-3)
    counts = [each(_KINDS[k][data]) for k in range(len(_KINDS))]
    out[:, 0] = np.log1p(size)
    for k, c in enumerate(counts):
        out[:, 1 + k] = share(c, size)
    out[:, 8] = share(each((data >= 128).astype(float)), size)
    h, first = tv.word_hashes(data if some.any() else np.zeros(0, np.uint8), offs)
    words = np.diff(first).astype(float)
    blanks = each((~tv.WORD[data]).astype(float))
    mean = (size - blanks) / np.maximum(words, 1)
    out[:, 9] = np.log1p(mean)
    inside = tv.WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    place = np.searchsorted(offs, start, side="right") - 1
    # from each word to the next one of its text, or to the text's end
    gaps = np.minimum(np.minimum(np.append(start[1:], len(data)), offs[place + 1]) - start, 1000).astype(float)
    n1 = np.maximum(np.bincount(place, minlength=n)[:n], 1)
    m1 = np.bincount(place, gaps, minlength=n)[:n] / n1
    m2 = np.bincount(place, gaps**2, minlength=n)[:n] / n1
    out[:, 10] = 0.5 * np.log1p(np.maximum(m2 - m1**2, 0))
    for i in range(n):
        w = h[first[i] : first[i + 1]]
        if len(w):
            s = np.sort(w)
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            out[i, 11] = np.log(len(new) / len(w)) * 2 / np.log(len(w) + 2)
            out[i, 12] = np.log(np.count_nonzero(w[1:] == w[:-1]) / len(w) + 1e-3)
            out[i, 13] = np.log(np.diff(new, append=len(s)).max() / len(w) + 1e-2)
    out[:, 14] = np.log((words + 1) / (counts[6] + 1))
    return out


class Model:
    """Means, Cholesky factors and prior of both classes."""

    def __init__(self, n, sums, outer, shrink: float = 0.1):
        d = sums.shape[1]
        self.known = bool((n > 0).all())
        if not self.known:
            return
        self.mean = sums / n[:, None]
        cov = np.array([outer[c] / n[c] - np.outer(self.mean[c], self.mean[c]) for c in (0, 1)])
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        target = np.diag(np.diag(pooled) + 1e-4)
        # the fewer rows a class has for its d (d + 1) / 2 covariances, the more it leans on the pooled diagonal
        amount = [min(1.0, shrink + d * (d + 1) / 2 / (n[c] + 1)) for c in (0, 1)]
        self.chol = [np.linalg.cholesky((1 - amount[c]) * cov[c] + amount[c] * target) for c in (0, 1)]
        self.logdet = [2 * np.log(np.diag(x)).sum() for x in self.chol]
        self.prior = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), 0.5)
        dens = []
        for c in (0, 1):
            z = np.linalg.solve(self.chol[c], (x - self.mean[c]).T)
            dens.append(-0.5 * ((z * z).sum(axis=0) + self.logdet[c]))
        s = (dens[1] - dens[0] + self.prior) / 4
        return 0.5 + 0.5 * s / (1 + np.abs(s))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.1, folds: int = 3, held: int = 1, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod `folds` isn't `held`: at most `sample`, those of the smallest hashes of their ids.

    The sample is a bound on the learning only, so its ids can be broadcast and
    no other text leaves its task.
    """
    d = len(FEATURES)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & (shared.crc_rest("doc_id", folds) != held))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)

    def sums(batches):
        n, s, o = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            for part in shared.slices(b, 0, SLICE):
                x, y = statistics(part.column(0)), part.column(1).to_numpy()
                for c in (0, 1):
                    m = x[y == c]
                    n[c] += len(m)
                    s[c] += m.sum(axis=0)
                    o[c] += m.T @ m
        flat = np.concatenate([n, s.ravel(), o.ravel()])
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    joined = _named(docs, id_col, text_col).join(F.broadcast(rows), "doc_id").select("text", "y")
    total = {r.i: r.v for r in joined.mapInArrow(shared.task(sums), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([total.get(i, 0.0) for i in range(2 + 2 * d + 2 * d * d)])
    return Model(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d), shrink)


def score(docs: DataFrame, model: Model, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def each(batches):
        for batch in batches:
            for s in shared.slices(batch, 1, SLICE):
                p = model.score(statistics(s.column(1)))
                yield pa.record_batch([s.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = _named(docs, id_col, text_col).mapInArrow(shared.task(each), "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(shared.crc_rest("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, fit(docs, labels, **options))


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, text_col=text_col, **options)
    where = docs.columns.index(text_col)

    def each(batches):
        for batch in batches:
            for s in shared.slices(batch, where, SLICE):
                yield s.filter(pa.array(model.score(statistics(s.column(where))) >= 0.5))

    return docs.mapInArrow(shared.task(each), docs.schema)

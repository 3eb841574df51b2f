"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each document becomes one vector of transformed statistics (logarithms of
counts, square roots of shares). Each class has its mean and a covariance shrunk
towards the pooled one and then its own diagonal; the Cholesky factors are
computed once and shipped. The difference of log densities (Mahalanobis
distances and log determinants) is mapped to a probability by a logistic
curve fitted on part of the sample that the densities have not seen.

The sample is bounded: SAMPLE_PER_CLASS labelled documents of each class, drawn
by a hash of the id, of which the driver gets vectors, never texts.

Null and empty texts have a vector like any other (all counts 0) and a score.
With one class or none labelled the score is that class's share, 0.5 with none.
Every input row gives one row. Ids with more than one label count once for each.
Texts, not labels or other columns, decide a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import durable, fold
from lexroute.llm.textops import blocks, byte_prefix, local_index, word_spans

SAMPLE_PER_CLASS = 3000
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "wide": range(128, 256), "breaks": [10],
    "space": [32, 9, 11, 12, 13], "marks": b"!?", "stops": b".,;:", "symbols": b"#*$%&|<>", "brackets": b"()[]{}/\\_=+@^~", "quotes": b"'\"`-",
}
_SUMS = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _SUMS[list(_members), _k] = 1
FEATURES = ["log_words", "mean_word", "sd_word", "distinct_words", "repeated_triples", "dup_lines", "line_words", "byte_entropy", *_CLASSES]


def distinct_share(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each row, distinct values over values (1 if it has none)."""
    total = np.bincount(row, minlength=n)
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return np.where(total, np.bincount(r[new], minlength=n) / np.maximum(total, 1), 1.0)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The vector of each text."""
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    size = np.maximum(hist.sum(1), 1)
    p = hist / size[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    s, e, first = word_spans(data, off)
    row, _ = local_index(first, len(s))
    words = np.diff(first)
    length = (e - s).astype(float)
    mean = np.bincount(row, length, n) / np.maximum(words, 1)
    var = np.bincount(row, length**2, n) / np.maximum(words, 1) - mean**2
    prefix = byte_prefix(data)
    h = prefix.of(s, e)
    triple = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    h3 = h[triple] * np.uint64(3) + (h[triple + 1] ^ (h[triple + 2] * np.uint64(0x9E3779B97F4A7C15))) if len(triple) else h[:0]
    breaks = np.flatnonzero(data == 10)
    begin = np.union1d(off[:-1], breaks + 1)
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data)) - 0
    end = np.where(data[end - 1] == 10, end - 1, end) if len(end) else end
    filled = end > begin
    begin, end = begin[filled], end[filled]
    lines = text[begin]
    n_lines = np.bincount(lines, minlength=n)
    out = [np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(var, 0))), np.sqrt(distinct_share(row, h, n)), np.sqrt(1 - distinct_share(row[triple], h3, n)), np.sqrt(1 - distinct_share(lines, prefix.of(begin, end), n)), np.log1p(words / np.maximum(n_lines, 1)), entropy]
    return np.column_stack([*out, np.sqrt(hist @ _SUMS / size[:, None])])


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        """Fits densities and the logistic curve to vectors x with classes y (0 or 1)."""
        self.share = float(y.mean()) if len(y) else 0.5
        self.ready = len(y) >= 8 and min(np.bincount(y, minlength=2)) >= 4
        if not self.ready:
            return
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mid) / self.scale
        held = np.zeros(len(y), bool)
        for c in (0, 1):
            held[np.flatnonzero(y == c)[::4]] = True
        zf, yf = z[~held], y[~held]
        self.means = [zf[yf == c].mean(0) for c in (0, 1)]
        own = [np.cov(zf[yf == c].T, bias=True) for c in (0, 1)]
        pooled = sum(np.mean(yf == c) * own[c] for c in (0, 1))
        self.whiten, self.log_det = [], []
        for c in (0, 1):
            s = (1 - SHRINK_POOLED) * own[c] + SHRINK_POOLED * pooled
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + RIDGE * np.eye(len(s))
            chol = np.linalg.cholesky(s)
            self.whiten.append(np.linalg.inv(chol).T)
            self.log_det.append(2 * np.log(np.diag(chol)).sum())
        self.slope, self.shift = logistic(self.raw(x[held]), y[held])

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, its size damped by a square root beyond 1."""
        z = (x - self.mid) / self.scale
        d = [-0.5 * (((z - m) @ w) ** 2).sum(1) - 0.5 * g for m, w, g in zip(self.means, self.whiten, self.log_det)]
        r = d[1] - d[0]
        return np.sign(r) * np.log1p(np.abs(r))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Newton's method for one slope, kept positive, and a shift."""
    w = np.array([1.0, 0.0])
    a = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - y) + ridge * np.array([w[0] - 1, 0])
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-3])
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                x = statistics(data, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat], ["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x array<double>")


def fit(x: DataFrame, labels: DataFrame, where=None, per_class: int = SAMPLE_PER_CLASS) -> Discriminant:
    """Learns from a bounded sample of the labelled rows that satisfy where."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    known = known.filter(where) if where is not None else known
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 30))
    share = F.when(F.col("quality") == 1, int(min(1.0, per_class / max(1, sizes.get(1, 0))) * (1 << 30))).otherwise(int(min(1.0, per_class / max(1, sizes.get(0, 0))) * (1 << 30)))
    rows = x.join(known.filter(unit < share), "doc_id").select("doc_id", "quality", "x").collect()  # about per_class of each class
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    return Discriminant(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], np.int64))


def score(docs: DataFrame, labels: DataFrame, where=None) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    x = durable(vectors(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit(x, labels, where))

    def run(batches):
        m = shared.value
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(v))], ["doc_id", "score"])

    kind = x.schema["doc_id"].dataType.simpleString()
    return x.mapInArrow(run, f"doc_id {kind}, score double")


def held_out(modulus: int = 3, remainder: int = 1):
    return F.coalesce(fold("doc_id", modulus) == remainder, F.lit(False))

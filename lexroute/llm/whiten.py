"""Whitening of embeddings: centred, projected on the main axes of their covariance and scaled to unit variance.

An entry c becomes the whole number x = floor(256 c). Each distinct x vector counts once (the fit list): n of them, with
sums S in each dimension. Three passes over the fit list, each of them partial sums of a size fixed by the dimension:

1. n and S, in whole numbers.
2. The covariance. x - S/n is a pair of doubles (the mean is, too), and is cut into slices of SLICE bits on one
   common grid for a block of BLOCK rows. Products of two slices summed over a block fit into a double without rounding, so a
   matrix product of slices is an error-free transformation of the block's outer products. These are added up in double-double,
   and the high and low parts of all tasks are merged in double-double again. The sum does not depend on how rows were dealt,
   beyond about 2**-100 of its size.
3. The covariance of the whitened fit list itself, for identity_error.

The eigen-solve is LAPACK's divide and conquer over the tridiagonal form (`syevd`, behind numpy.linalg.eigh) on the driver, on
d x d numbers; d is the dimension, not a count of rows.

Rows whose vector is null, empty, or holds a null or an entry that is not finite are dropped; all others come out, repeated rows and null ids too.
Vectors of different lengths are whitened apart, each length by its own fit list. Components whose variance is not above LEAST of the trace
(a list of one vector has none; two have one) give no rows. An empty table gives none. Ties between variances: any orthonormal axes
of them are right; the same ones serve all rows. `deviation` is null where it does not fit into 64 bits, and entries from 2**45 on count as 2**53 units.
There is no text here, so none can be long; other columns are left out.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import dropped, durable, quoted, width

SCALE, COMPONENTS = 256, 4
#: Rows of a block, bits of a slice and slices: 2 * SLICE + log2(2 * BLOCK) bits must fit into 53.
BLOCK, SLICE, SLICES = 1024, 20, 5
#: Share of the trace above which a variance counts as one.
LEAST = 1e-12
#: Largest |x|, and the bits of the lower of the two halves in which they are added up.
LARGEST, HALF = 1 << 53, 27


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding took from it, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(x: tuple[np.ndarray, np.ndarray], hi: np.ndarray, lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(x[0], hi)
    t, f = two_sum(x[1], np.asarray(lo, float))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x - mean as double-doubles; x holds whole numbers of at most 53 bits."""
    return add((x.astype(float), np.zeros(x.shape)), -mean[0], -mean[1])


def slices(y: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Parts that add up to y (but for what lies SLICE * SLICES bits below its largest entry), each of SLICE bits on one grid."""
    top = float(np.abs(y[0]).max(initial=0.0))
    if not top:
        return []
    grid, out, rest = 2.0 ** (math.frexp(top)[1] - SLICE), [], y
    for _ in range(SLICES):
        part = np.rint(rest[0] / grid) * grid
        out.append(part)
        rest = add(rest, -part)
        grid /= 2.0**SLICE
    return out


def outer_sum(total: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """total plus the sum of the outer products of y's rows: matrix products of slices are exact, their sum is in double-double."""
    parts = slices(y)
    for i, a in enumerate(parts):
        for b in parts[: len(parts) - i]:
            total = add(total, a.T @ b)
    return total


def _blocks(batches, d: int):
    """Vectors of a column of lists, in blocks of at most BLOCK rows that may span batches."""
    held, n = [], 0
    for batch in batches:
        col = batch.column(0)
        x = col.flatten().to_numpy().reshape(len(col), d)
        for k in range(0, len(x), BLOCK):
            held.append(x[k : k + BLOCK])
            n += len(held[-1])
            if n >= BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _summed(fit: DataFrame, d: int, start, step, wide: int) -> np.ndarray:
    """Double-double sums over all rows of fit, of an array of d rows and `wide` columns: step(total, block) in each task, then merged by row of the array."""

    def part(batches):
        total = start()
        for x in _blocks(batches, d):
            total = step(total, x)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total[0]))), *(pa.array(list(t), pa.list_(pa.float64())) for t in total)], ["i", "hi", "lo"])

    def merged(batches):
        sums: dict[int, tuple] = {}
        for batch in batches:
            for i, hi, lo in zip(batch.column(0).to_pylist(), *(np.asarray(batch.column(k).flatten()).reshape(-1, wide) for k in (1, 2))):
                sums[i] = add(sums[i], hi, lo) if i in sums else (hi, lo)
        rows = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *(pa.array([sums[i][k] for i in rows], pa.list_(pa.float64())) for k in (0, 1))], ["i", "hi", "lo"])

    kind = "i long, hi array<double>, lo array<double>"
    rows = fit.select("x").mapInArrow(part, kind).repartition(width(fit), "i").mapInArrow(merged, kind).collect()  # as many rows as `total`
    hi, lo = (np.array([r[k] for r in sorted(rows, key=lambda r: r["i"])]).reshape(-1, wide) for k in ("hi", "lo"))
    return hi, lo


class Model:
    """n, S, the mean as a pair of doubles, axes over square roots of variances, shares of the trace, identity_error."""

    def __init__(self, fit: DataFrame, d: int):
        def sums(batches):
            high, low, n = np.zeros(d, np.int64), np.zeros(d, np.int64), 0
            for x in _blocks(batches, d):
                high, low, n = high + (x >> HALF).sum(0), low + (x & ((1 << HALF) - 1)).sum(0), n + len(x)
            yield pa.RecordBatch.from_arrays([pa.array(range(d + 1)), pa.array([*high.tolist(), n]), pa.array([*low.tolist(), 0])], ["i", "high", "low"])

        rows = fit.select("x").mapInArrow(sums, "i long, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # d + 1 rows
        got = {r["i"]: (r["high"], r["low"]) for r in rows}
        self.d, self.n, self.sums = d, got[d][0], [(got[i][0] << HALF) + got[i][1] for i in range(d)]
        exact = [Fraction(s, self.n) for s in self.sums]
        hi = np.array([float(m) for m in exact])
        mean = self.mean = hi, np.array([float(m - Fraction(float(h))) for m, h in zip(exact, hi)])
        v = _summed(fit, d, lambda: (np.zeros((d, d)),) * 2, lambda t, x: outer_sum(t, centred(x, mean)), d)
        self.covariance = (v[0] + v[1]) / self.n
        trace = float(math.fsum([*np.diag(v[0]), *np.diag(v[1])])) / self.n
        e, axes = np.linalg.eigh((self.covariance + self.covariance.T) / 2)
        kept = [k for k in np.argsort(-e, kind="stable")[:COMPONENTS] if e[k] > LEAST * trace]
        self.explained = [float(e[k] / trace) for k in kept]
        scaled = self.scaled = axes[:, kept] / np.sqrt(e[kept])
        m = len(kept)
        self.identity_error = 0.0
        if m:
            z = _summed(fit, d, lambda: (np.zeros((m + 1, m)),) * 2, lambda t, x: _second_moments(t, whitened(x, mean, scaled)), m)
            sums, products = z[0][0] + z[1][0], z[0][1:] + z[1][1:]
            self.identity_error = float(np.abs(products / self.n - np.outer(sums, sums) / self.n**2 - np.eye(m)).max())


def whitened(x: np.ndarray, mean, scaled: np.ndarray) -> np.ndarray:
    y = centred(x, mean)
    return y[0] @ scaled + y[1] @ scaled


def _second_moments(total, z: np.ndarray):
    zero = np.zeros(z.shape)
    first = add((total[0][:1], total[1][:1]), np.array([[math.fsum(c) for c in z.T]]))
    rest = outer_sum((total[0][1:], total[1][1:]), (z, zero))
    return tuple(np.concatenate([a, b]) for a, b in zip(first, rest))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)**2 of each row, exactly; None beyond 64 bits."""
    own, total = np.array(sums, object), sum(s * s for s in sums)
    small = len(x) and int(np.abs(x).max()) < 1 << 20 and max(map(abs, sums)) < 1 << 36 and x.shape[1] <= 64
    if small:
        squares, crossed = (x * x).sum(1).tolist(), (x @ own.astype(np.int64)).tolist()
    else:
        y = x.astype(object)
        squares, crossed = (y * y).sum(1).tolist(), (y * own).sum(1).tolist()
    out = (n * n * a - 2 * n * b + total for a, b in zip(squares, crossed))
    return [v if v < 1 << 63 else None for v in out]


def units(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector holds finite numbers only."""
    v = quoted(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    return vectors.select(quoted(id).alias("vec_id"), F.when((F.size(v) > 0) & finite, x).alias("x")).filter("x is not null")


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row and component up to COMPONENTS: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = units(vectors, id, vector)
    fit = durable(rows.select("x").distinct())
    models = {d: Model(fit.filter(F.size("x") == d), d) for (d,) in sorted(fit.select(F.size("x")).distinct().collect())}  # a row for each length of vectors
    dropped(fit)

    def run(batches):
        for batch in batches:
            ids, xs = batch.column(0), batch.column(1)
            lengths = np.asarray(xs.value_lengths())
            for d in np.unique(lengths):
                m, at = models[int(d)], np.flatnonzero(lengths == d)
                k = len(m.explained)
                for a in range(0, len(at), BLOCK):
                    here = pa.array(at[a : a + BLOCK])
                    x = xs.take(here).flatten().to_numpy().reshape(len(here), int(d))
                    r = len(x)
                    each = pa.array(np.repeat(np.arange(r), k))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(here).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), r)), pa.array(np.full(r * k, m.n)),
                        pa.array(deviations(x, m.n, m.sums), pa.int64()).take(each), pa.array(whitened(x, m.mean, m.scaled).ravel()),
                        pa.array(np.tile(np.array(m.explained, float), r)), pa.array(np.full(r * k, m.identity_error)),
                    ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")

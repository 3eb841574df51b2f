"""Ridge models and screens of features against a label.

Fits are sums over all rows: each pass is one aggregate of (p + 1)(p + 2) / 2 products that
Spark combines map-side, and only those sums come to the driver. p is the number of
features named, a few dozen, never the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.operators import ordering
from lexroute.operators.inference import RESAMPLES, holm
from lexroute.operators.resampling import Sample, interval

#: Penalty of the slopes, rounds and tolerance of the logistic fit, bound of its linear term, power asked for.
RIDGE, ROUNDS, TOLERANCE, CLIP, POWER = 1.0, 100, 1e-10, 30.0, 0.8


def imputed(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with their features as doubles; null and non-finite ones become the median of the finite ones, 0 if there is none."""
    clean = [F.when((x := F.col(f).cast("double")).isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(f) for f in features]
    medians = rows.select(*clean).agg(*(F.coalesce(F.percentile(f, F.lit(0.5)), F.lit(0.0)).alias(f) for f in features)).first()
    return rows.withColumns({f: F.coalesce(c, F.lit(medians[f])) for f, c in zip(features, clean)})


def constant_columns(rows: DataFrame, features: list[str]) -> list[str]:
    """Features without variance; of no rows, all."""
    spread = rows.agg(*((F.max(f) - F.min(f)).alias(f) for f in features)).first()
    return [f for f in features if not spread[f]]


def _moments(rows: DataFrame, columns: list[Column], weight: Column, residual: Column) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weight * x * x' and of residual * x in one pass."""
    n = len(columns)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    terms = [F.sum(F.col("_w") * columns[i] * columns[j]) for i, j in upper] + [F.sum(F.col("_r") * c) for c in columns]
    got = [v or 0.0 for v in rows.withColumns({"_w": weight, "_r": residual}).agg(*(t.alias(f"s{k}") for k, t in enumerate(terms))).first()]
    square = np.zeros((n, n))
    for (i, j), v in zip(upper, got):
        square[i, j] = square[j, i] = v
    return square, np.array(got[len(upper) :])


@dataclass(frozen=True)
class Model:
    """A fit: features in order, their centres and scales, slopes on the scaled features, intercept."""

    features: list[str]
    centre: list[float]
    scale: list[float]
    slopes: list[float]
    intercept: float
    rounds: int = 1
    converged: bool = True

    def score(self) -> Column:
        """The linear term of a row."""
        return sum(((F.col(f) - F.lit(m)) / F.lit(s) * F.lit(b) for f, m, s, b in zip(self.features, self.centre, self.scale, self.slopes)), F.lit(self.intercept))


def ridge_linear(rows: DataFrame, features: list[str], target: str, ridge: float = RIDGE) -> Model:
    """Least squares with a penalty on the slopes, none on the intercept; rows with a null target are left out. No rows: all zero."""
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    square, right = _moments(rows.filter(F.col(target).isNotNull()), x, F.lit(1.0), F.col(target).cast("double"))
    k = len(features)
    if not square[0, 0]:
        return Model(features, [0.0] * k, [1.0] * k, [0.0] * k, 0.0, 0, False)
    penalty = ridge * np.eye(k + 1)
    penalty[0, 0] = 0.0
    beta = np.linalg.lstsq(square + penalty, right, rcond=None)[0]
    return Model(features, [0.0] * k, [1.0] * k, beta[1:].tolist(), float(beta[0]))


def ridge_logistic(rows: DataFrame, features: list[str], label: str, ridge: float = RIDGE, balanced: bool = True) -> Model:
    """Logistic regression by reweighted least squares on standardised features, both classes weighing the same.

    Labels are 0 and 1; rows with another one are left out. The passes read rows again, so hand in
    a kept frame. Without rows of both classes the weights are 1; without rows all slopes are 0.
    """
    rows = rows.filter(F.col(label).isin(0, 1)).withColumn("_y", F.col(label).cast("double"))
    k = len(features)
    stats = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("ones"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features))).first()
    n, ones = stats["n"], stats["ones"] or 0.0
    if not n:
        return Model(features, [0.0] * k, [1.0] * k, [0.0] * k, 0.0, 0, False)
    centre, scale = [stats[f"m{i}"] for i in range(k)], [stats[f"s{i}"] or 1.0 for i in range(k)]
    share = F.when(F.col("_y") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))) if balanced and 0 < ones < n else F.lit(1.0)
    z = [F.lit(1.0), *((F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(features, centre, scale))]
    beta, penalty, done, used = np.zeros(k + 1), ridge * np.eye(k + 1), False, 0
    penalty[0, 0] = 0.0
    for used in range(1, ROUNDS + 1):
        eta = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), sum((F.lit(float(b)) * c for b, c in zip(beta, z)), F.lit(0.0))))
        mu = 1 / (1 + F.exp(-eta))
        square, right = _moments(rows.withColumn("_mu", mu), z, share * F.greatest(F.lit(1e-9), F.col("_mu") * (1 - F.col("_mu"))), share * (F.col("_y") - F.col("_mu")))
        step = np.linalg.lstsq(square + penalty, right - penalty @ beta, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < TOLERANCE:
            done = True
            break
    return Model(features, centre, scale, beta[1:].tolist(), float(beta[0]), used, done)


def auc(ones: np.ndarray, zeros: np.ndarray) -> float | None:
    """The chance that one of the first stands above one of the second, ties as half; null if a class is empty."""
    if not len(ones) or not len(zeros):
        return None
    low = np.sort(zeros)
    return float((np.searchsorted(low, ones, "left") + np.searchsorted(low, ones, "right")).sum() / 2 / len(ones) / len(low))


def screen(rows: DataFrame, features: list[str], label: str, rounds: int = 2000, draws: int = 1000, seed: int = 0) -> DataFrame:
    """One row a feature: AUC with interval (classes resampled apart), two-sided p of its distance from a half under shuffled labels, class means, p adjusted over the family.

    Rows with a null value or a label other than 0 and 1 are left out; a feature without both classes has no row.
    A shuffle of labels is a pick of as many mid-ranks, so it needs no ranking of its own.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features)))
    long = sessions.cut(rows.filter(F.col(label).isin(0, 1)).select(F.col(label).cast("int").alias("y"), pairs.alias("x")).select("y", "x.feature", "x.v").filter("v is not null and not isnan(v)"))
    by = ["feature"]
    seen = ordering.auc(long, "v", "y", by).filter("auc is not null")
    g = ordering.group(by).alias("_g")
    wanted = sessions.cut(seen.select(g, F.col("ones").alias("k"), "zeros", "auc"))
    ranked = ordering.with_ranks(long, "v", by).join(seen.select("feature"), "feature")
    moved = Sample(ranked, by, ["mid_rank"], rounds=rounds, seed=seed).picked(wanted).join(wanted.drop("k"), "_g")
    other = (F.col("s0") - F.col("k") * (F.col("k") + 1) / 2) / (F.col("k") * F.col("zeros"))
    p = moved.groupBy("_g").agg(((F.count_if(F.abs(other - 0.5) >= F.abs(F.col("auc") - 0.5) - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    drawn = Sample(ranked, [*by, "y"], ["v"], rounds=draws, seed=seed).resamples()
    drawn = ordering.auc(drawn.select("_g.feature", "_g.y", "round", F.col("p0").alias("v"), "w"), "v", "y", ["feature", "round"], "w")
    band = drawn.groupBy(g).agg(*interval("auc"))
    means = long.groupBy(g).agg(F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("mean_one"), F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("mean_zero"))
    x = wanted.join(p, "_g").join(band, "_g").join(means, "_g")
    side = F.when(F.col("auc") >= 0.5, "positive").otherwise("negative")
    out = x.select("_g.feature", "auc", side.alias("direction"), F.greatest(F.col("auc"), 1 - F.col("auc")).alias("oriented_auc"), F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"), "p", "mean_one", "mean_zero")
    return holm(out.withColumn("family", F.lit("features")), "p", ["family"]).drop("family")


def whole_procedure_p(x: np.ndarray, y: np.ndarray, fit: np.ndarray, held: np.ndarray, seen: float, rounds: int = RESAMPLES, seed: int = 0) -> tuple[float, int]:
    """One-sided p of a held-out AUC when labels are shuffled before the fit, and the rounds that had both classes held out."""
    rng, hits, valid = np.random.default_rng(seed), 0, 0
    for _ in range(rounds):
        z = rng.permutation(y)
        beta, centre, scale = _logistic(x[fit], z[fit])
        s = (x[held] - centre) / scale @ beta[1:]
        got = auc(s[z[held] == 1], s[z[held] == 0])
        valid += got is not None
        hits += got is not None and got >= seen
    return (hits + 1) / (valid + 1), valid


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fit of ridge_logistic on a matrix, for resampling."""
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, 1.0)
    z, ones = np.column_stack([np.ones(len(x)), (x - centre) / scale]), (y == 1).sum()
    share = np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones))) if 0 < ones < len(y) else np.ones(len(y))
    beta, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 0.0
    for _ in range(ROUNDS):
        mu = 1 / (1 + np.exp(-np.clip(z @ beta, -CLIP, CLIP)))
        step = np.linalg.lstsq(z.T @ (z * (share * np.maximum(mu * (1 - mu), 1e-9))[:, None]) + penalty, z.T @ (share * (y - mu)) - penalty @ beta, rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < TOLERANCE:
            break
    return beta, centre, scale


def auc_error(true_auc: float, ones: int, zeros: int) -> float:
    """Standard error of an AUC by Hanley and McNeil."""
    q1, q2, square = true_auc / (2 - true_auc), 2 * true_auc**2 / (1 + true_auc), true_auc**2
    return math.sqrt(max((true_auc * (1 - true_auc) + (ones - 1) * (q1 - square) + (zeros - 1) * (q2 - square)) / (ones * zeros), 0.0))


def power_grid(ones: int, zeros: int) -> list[tuple[float, float, float, bool]]:
    """(true AUC, its error, chance that the 95 % interval lies above a half, whether that is enough), from 0.55 to 1 by 0.025."""
    out = []
    for k in range(22, 41):
        a = k / 40
        e = auc_error(a, ones, zeros) if ones and zeros else math.inf
        p = 1.0 if e <= 0 else 0.0 if math.isinf(e) else 0.5 * (1 + math.erf((a - 1.96 * e - 0.5) / e / math.sqrt(2)))
        out.append((a, e, p, p >= POWER))
    return out

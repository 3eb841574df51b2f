"""Paired tests and resampling of evaluation rows, by group (a metric, a pair of systems).

Ranks, medians and draws are dealt over tasks (ordering, resampling): no group is one task. Only the exact laws of a
test see one row for each group.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lexroute.functions import sessions
from lexroute.operators import ordering
from lexroute.operators.resampling import ROUNDS, Sample, interval, ungrouped

#: Largest n of the exact signed-rank law, resamples, least p-value that is reported.
EXACT_N, RESAMPLES, LEAST_P = 25, ROUNDS, 1e-9
#: Rounds and seed of the random policies.
POLICY_ROUNDS, POLICY_SEED = 1000, 20250101


def sign_test(positive: int, negative: int) -> float:
    """Exact two-sided binomial test of equal odds; above a thousand rows in logarithms."""
    n, low = positive + negative, min(positive, negative)
    if n <= 1000:
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0
    term = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2)
    total, share = 1.0, 1.0
    for i in range(low, 0, -1):  # terms fall at least as fast as a geometric row
        share *= i / (n - i + 1)
        total += share
        if share < 1e-17 * total:
            break
    return min(1.0, 2 * math.exp(term) * total)


def rank_law(n: int, w: float, tied: float) -> tuple[float, str]:
    """Two-sided p of a signed-rank statistic and its method: exact for few rows without ties, else normal with both corrections."""
    if not n:
        return 1.0, "degenerate"
    if n <= EXACT_N and not tied:
        ways = np.zeros(n * (n + 1) // 2 + 1, dtype=object)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[: len(ways) - r]
        return max(LEAST_P, min(1.0, 2 * int(sum(ways[: int(w) + 1])) / 2**n)), "exact"
    variance = n * (n + 1) * (2 * n + 1) / 24 - tied / 24
    if variance <= 0:
        return 1.0, "degenerate"
    z = (abs(w - n * (n + 1) / 4) - 0.5) / math.sqrt(variance)
    return max(LEAST_P, 1.0 if z <= 0 else math.erfc(z / math.sqrt(2))), "normal"


@F.pandas_udf(StructType([StructField("p", DoubleType()), StructField("method", StringType()), StructField("sign_p", DoubleType())]))
def _laws(n: pd.Series, w: pd.Series, tied: pd.Series, up: pd.Series, down: pd.Series) -> pd.DataFrame:
    rows = [(*rank_law(int(a), b, c), sign_test(int(u), int(d))) for a, b, c, u, d in zip(n, w, tied, up, down)]
    return pd.DataFrame(rows, columns=["p", "method", "sign_p"])


def _finite(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, d) without nulls; a value that is not finite ends the job."""
    d = F.col(value).cast("double")
    bad = F.isnan(d) | (F.abs(d) == float("inf"))
    return rows.filter(F.col(value).isNotNull()).select(*by, F.when(bad, F.raise_error(F.lit("differences must be finite")).cast("double")).otherwise(d).alias("d"))


def median_intervals(differences: DataFrame, by: list[str], value: str = "d", rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per group: the median and the percentile interval of the median over resamples."""
    x = sessions.cut(_finite(differences, by, value))
    middle = ordering.quantiles(x, "d", by, {"median_d": ordering.median}).select(ordering.group(by).alias("_g"), "median_d")
    drawn = Sample(x, by, ["d"], rounds=rounds, seed=seed).medians().groupBy("_g").agg(*interval("median"))
    return ungrouped(middle.join(drawn, "_g"), by, "median_d", F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))


def compare(differences: DataFrame, by: list[str], value: str = "d", rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per group: pairs, wins, ties, losses, mean and median difference, its interval, signed-rank and sign test."""
    x = sessions.cut(_finite(differences, by, value))
    g = ordering.group(by).alias("_g")
    counts = x.groupBy(g).agg(F.count("*").alias("n"), *(F.count_if(c).alias(n) for n, c in (("wins", F.col("d") > 0), ("ties", F.col("d") == 0), ("losses", F.col("d") < 0))), F.avg("d").alias("mean_d"))
    w = ordering.signed_ranks(x, "d", by).select(g, F.col("n").alias("nz"), F.least("w_plus", "w_minus").alias("w"), "tied")
    middle = median_intervals(x, by, "d", rounds, seed).select(g, "median_d", "ci_low", "ci_high")
    y = counts.join(middle, "_g").join(w, "_g", "left").fillna(0, ["nz", "w", "tied"]).withColumn("x", _laws("nz", "w", "tied", "wins", "losses"))
    return ungrouped(y, by, "n", "wins", "ties", "losses", "mean_d", "median_d", "ci_low", "ci_high", "w", "x.p", "x.method", "x.sign_p")


def holm(tests: DataFrame, p: str, by: list[str]) -> DataFrame:
    """tests with p_holm: step-down adjustment within each family; a missing p counts as 1."""
    from pyspark.sql import Window

    q = F.coalesce(F.col(p), F.lit(1.0))
    w = Window.partitionBy(*by)
    rank, m = F.row_number().over(w.orderBy(q)), F.count("*").over(w)
    x = tests.withColumn("_step", (m - rank + 1) * q).withColumn("_rank", rank)
    high = F.max("_step").over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("p_holm", F.round(F.least(F.lit(1.0), high), 6)).drop("_step", "_rank")


def mean_intervals(differences: DataFrame, by: list[str], value: str = "d", rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per group: n, mean and the percentile interval of the mean over resamples."""
    x = _finite(differences, by, value)
    drawn = Sample(x, by, ["d"], rounds=rounds, seed=seed).sums().withColumn("mean", F.col("s0") / F.col("n")).groupBy("_g", "n").agg(*interval("mean"))
    mean = x.groupBy(ordering.group(by).alias("_g")).agg(F.avg("d").alias("mean_d"))
    return ungrouped(drawn.join(mean, "_g"), by, "n", "mean_d", "lo", "hi")


def _share(hit: Column) -> Column:
    """One is added to both counts."""
    return (F.count_if(hit) + 1) / (F.count("*") + 1)


def sign_flips(differences: DataFrame, by: list[str], value: str = "d", rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per group: the absolute mean and its two-sided p under random signs."""
    x = _finite(differences, by, value)
    seen = x.groupBy(ordering.group(by).alias("_g")).agg(F.abs(F.avg("d")).alias("statistic"))
    drawn = Sample(x, by, ["d"], rounds=rounds, seed=seed).flips().join(seen, "_g")
    out = drawn.groupBy("_g", "statistic").agg(_share(F.abs("s0") / F.col("n") >= F.col("statistic") - 1e-12).alias("p_value"))
    return ungrouped(out, by, "statistic", "p_value")


def cluster_intervals(differences: DataFrame, by: list[str], cluster: str, value: str = "d", rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per group: n, clusters and the interval of the mean when whole clusters are drawn; rows without a cluster take no part."""
    x = differences.dropna(subset=[cluster, value]).groupBy(*by, cluster).agg(F.sum(F.col(value).cast("double")).alias("total"), F.count("*").alias("size"))
    drawn = Sample(x, by, ["total", "size"], [cluster], rounds, seed).sums().withColumn("mean", F.col("s0") / F.col("s1"))
    rows = x.groupBy(ordering.group(by).alias("_g")).agg(F.sum("size").alias("rows"))
    out = drawn.groupBy("_g", "n").agg(*interval("mean")).join(rows, "_g")
    return ungrouped(out, by, F.col("rows").alias("n"), F.col("n").alias("clusters"), "lo", "hi")


def rank_intervals(pairs: DataFrame, by: list[str], x: str, y: str, rounds: int = POLICY_ROUNDS, seed: int = 0) -> DataFrame:
    """Per group: n, mid-rank correlation, its interval over resampled pairs and the number of constant resamples, which have none."""
    drawn = Sample(pairs, by, [x, y], rounds=rounds, seed=seed).resamples()
    rho = ordering.spearman(drawn, "p0", "p1", ["_g", "round"], "w").groupBy("_g").agg(*interval("rho"), F.count_if(F.col("rho").isNull()).alias("constant"))
    seen = ordering.spearman(pairs, x, y, by).select(ordering.group(by).alias("_g"), "n", "rho")
    return ungrouped(seen.join(rho, "_g"), by, "n", "rho", "lo", "hi", "constant")


def policy_ablation(records: DataFrame, by: list[str], cheap: str, dear: str, chosen: str, rounds: int = POLICY_ROUNDS, seed: int = POLICY_SEED) -> DataFrame:
    """Per group: quality of a policy that takes the dear arm where `chosen`, against random picks of as many rows."""
    x = records.dropna(subset=[cheap, dear, chosen]).select(*by, F.col(cheap).cast("double").alias("c"), (F.col(dear).cast("double") - F.col(cheap).cast("double")).alias("gain"), F.col(chosen).cast("boolean").alias("on"))
    base = x.groupBy(ordering.group(by).alias("_g")).agg(F.count_if("on").alias("k"), F.sum("c").alias("base"), F.avg(F.when(F.col("on"), F.col("c") + F.col("gain")).otherwise(F.col("c"))).alias("quality"))
    drawn = Sample(x, by, ["gain"], rounds=rounds, seed=seed).picked(base).join(base.drop("k"), "_g").withColumn("random", (F.col("base") + F.col("s0")) / F.col("n"))
    out = drawn.groupBy("_g", "n", "k", "quality").agg(F.avg("random").alias("random_quality"), F.avg((F.col("random") >= F.col("quality") - 1e-12).cast("double")).alias("share_reaching"))
    return ungrouped(out, by, "n", F.col("k").alias("spent"), "quality", "random_quality", "share_reaching")


def mean_permutations(rows: DataFrame, by: list[str], value: str, first: str, rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """Per group: rows of both samples (`first` tells them apart), difference of their means, its two-sided p under shuffled membership; 1 if one is empty."""
    x = _finite(rows.dropna(subset=[first]).select(*by, F.col(first).cast("boolean").alias("on"), F.col(value).alias("d")), [*by, "on"], "d")
    side = lambda on: F.sum(F.when(F.col("on") == on, F.col("d")).otherwise(0.0))
    seen = x.groupBy(ordering.group(by).alias("_g")).agg(F.count_if("on").alias("k"), F.count("*").alias("all"), side(True).alias("a"), side(False).alias("b"))
    gap = lambda a, b, k, n: F.coalesce(F.try_divide(a, k) - F.try_divide(b, n - k), F.lit(0.0))
    seen = seen.withColumn("difference", gap(F.col("a"), F.col("b"), F.col("k"), F.col("all")))
    drawn = Sample(x, by, ["d"], rounds=rounds, seed=seed).picked(seen).join(seen.drop("k"), "_g")
    moved = gap(F.col("s0"), F.col("a") + F.col("b") - F.col("s0"), F.col("k"), F.col("n"))
    out = drawn.groupBy("_g", "n", "k", "difference").agg(_share(F.abs(moved) >= F.abs("difference") - 1e-12).alias("p_value"))
    return ungrouped(out, by, F.col("k").alias("n_first"), (F.col("n") - F.col("k")).alias("n_second"), "difference", "p_value")


def contingency_permutation(rows: DataFrame, row: str, column: str, rounds: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(n, chi_square, phi, p_value): association of two categories, and its p when one of them is shuffled among the rows.

    A shuffle deals the smallest numbers of a round to the first column, the next to the second and so on, so nested
    picks give each cell. Categories are named on the driver, rows are not.
    """
    x = sessions.cut(rows.dropna(subset=[row, column]).select(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("c")))
    table = x.groupBy("r", "c").agg(F.count("*").alias("n")).collect()  # a row for each pair of categories
    names_r, names_c = sorted({t["r"] for t in table}), sorted({t["c"] for t in table})
    n, of_r, of_c = sum(t["n"] for t in table), {k: sum(t["n"] for t in table if t["r"] == k) for k in names_r}, {k: sum(t["n"] for t in table if t["c"] == k) for k in names_c}
    spark = x.sparkSession
    if not n:
        return spark.createDataFrame([], "n long, chi_square double, phi double, p_value double")
    count = {(t["r"], t["c"]): t["n"] for t in table}
    # only the sum of squares of a cell's count over its expectation moves with a shuffle
    seen = sum(count.get((r, c), 0) ** 2 * n / (of_r[r] * of_c[c]) for r in names_r for c in names_c) - n
    flags = x.select(*(F.when(F.col("r") == r, 1.0).otherwise(0.0).alias(f"is{j}") for j, r in enumerate(names_r)))
    sample, done, squares = Sample(flags, [], [f"is{j}" for j in range(len(names_r))], rounds=rounds, seed=seed), 0, None
    for c in names_c:
        done += of_c[c]
        part = sample.picked(sample.n.select("_g", F.lit(done).cast("long").alias("k"))).select("round", F.array(*(f"s{j}" for j in range(len(names_r)))).alias("upto"))
        term = lambda cells: sum((F.get(cells, F.lit(j)) * F.get(cells, F.lit(j)) * (n / (of_r[r] * of_c[c])) for j, r in enumerate(names_r)), F.lit(0.0))  # noqa: B023, E731
        if squares is None:
            squares = part.select("round", F.col("upto").alias("before"), term(F.col("upto")).alias("q"))
        else:
            own = F.zip_with("upto", "before", lambda a, b: a - b)
            squares = squares.join(part, "round").select("round", F.col("upto").alias("before"), (F.col("q") + term(own)).alias("q"))
        squares = sessions.cut(squares)
    p = squares.agg(_share(F.col("q") - n >= seen - 1e-9).alias("p_value"))
    return p.select(F.lit(n).cast("long").alias("n"), F.lit(float(seen)).alias("chi_square"), F.lit(math.sqrt(max(seen, 0.0) / n)).alias("phi"), "p_value")

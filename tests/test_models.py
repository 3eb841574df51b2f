"""Ridge fits against NumPy on the whole matrix, screens against counting, power against its formula."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import models  # noqa: E402

SCHEMA = "a double, b double, c double, y int"


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1, 5, 0] + [0, 2, 7]
    y = (x[:, 0] + rng.normal(size=200) > 0.8).astype(int)
    return x, y, spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], SCHEMA).cache()


def test_linear_fit_is_the_normal_equations(sample):
    x, y, df = sample
    m = models.ridge_linear(df, ["a", "b"], "y", 2.0)
    z = np.column_stack([np.ones(len(x)), x[:, :2]])
    want = np.linalg.solve(z.T @ z + np.diag([0, 2.0, 2.0]), z.T @ y)
    assert np.allclose([m.intercept, *m.slopes], want)


def test_logistic_fit_has_no_gradient_left(sample):
    x, y, df = sample
    m = models.ridge_logistic(df, ["a", "b", "c"], "y")
    z = np.column_stack([np.ones(len(x)), (x[:, 0] - x[:, 0].mean()) / x[:, 0].std(), (x[:, 1] - x[:, 1].mean()) / x[:, 1].std(), np.zeros(len(x))])
    beta = np.array([m.intercept, *m.slopes])
    w = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    left = z.T @ (w * (y - 1 / (1 + np.exp(-z @ beta)))) - beta * [0, 1, 1, 1]
    assert m.converged and np.abs(left).max() < 1e-8 and m.slopes[0] > 1 and m.slopes[2] == 0
    assert np.allclose(models._logistic(x, y)[0], beta)
    scores = np.array([r[0] for r in df.select(m.score()).collect()])
    assert np.allclose(np.sort(scores), np.sort(z @ beta))


def test_fits_of_few_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert models.ridge_linear(empty, ["a"], "y").slopes == [0.0] and models.ridge_logistic(empty, ["a"], "y").slopes == [0.0]
    one = spark.createDataFrame([(1.0, 2.0, 3.0, 1), (2.0, 2.0, 3.0, 1), (None, 1.0, 1.0, None)], SCHEMA)
    assert models.ridge_logistic(one, ["a"], "y").intercept > 5
    assert models.screen(one, ["a", "b"], "y", 5, 5).count() == 0


def test_medians_fill_gaps(spark):
    df = spark.createDataFrame([(1.0, None, 5.0, 0), (float("nan"), None, 5.0, 0), (3.0, None, 5.0, 0), (float("inf"), None, 5.0, 0), (4.0, None, 5.0, 0)], SCHEMA)
    got = models.imputed(df, ["a", "b"])
    assert [(r["a"], r["b"]) for r in got.collect()] == [(1, 0), (3, 0), (3, 0), (3, 0), (4, 0)]
    assert models.constant_columns(got, ["a", "b", "c"]) == ["b", "c"]
    assert models.constant_columns(got.limit(0), ["a"]) == ["a"]


def test_screen_counts_pairs(sample):
    x, y, df = sample
    got = {r["feature"]: r for r in models.screen(df, ["a", "b", "c"], "y", 200, 100).collect()}
    above = [(p > q) + (p == q) / 2 for p in x[y == 1, 0] for q in x[y == 0, 0]]
    assert got["a"]["auc"] == pytest.approx(np.mean(above)) and got["a"]["ci_low"] < got["a"]["auc"] < got["a"]["ci_high"]
    assert got["a"]["p"] == pytest.approx(1 / 201) and got["a"]["p_holm"] == pytest.approx(3 / 201, abs=1e-6)
    assert (got["c"]["auc"], got["c"]["p"], got["c"]["direction"]) == (0.5, 1.0, "positive")


def test_whole_procedure(sample):
    x, y, _ = sample
    fit, held = np.arange(0, 120), np.arange(120, 200)
    beta, m, s = models._logistic(x[fit], y[fit])
    scores = (x[held] - m) / s @ beta[1:]
    p, valid = models.whole_procedure_p(x, y, fit, held, models.auc(scores[y[held] == 1], scores[y[held] == 0]), 60)
    assert valid == 60 and p == pytest.approx(1 / 61)
    assert models.whole_procedure_p(x, y, fit, held, 0.0, 20)[0] == 1


def test_power_grows_with_rows():
    few, many = models.power_grid(6, 54), models.power_grid(600, 5400)
    assert len(few) == 19 and few[0][0] == 0.55 and few[-1][0] == 1 and few[-1][1:] == (0.0, 1.0, True)
    assert all(a[2] <= b[2] for a, b in zip(few, many)) and min(a for a, _, _, ok in many if ok) < min(a for a, _, _, ok in few if ok)
    a, e, p, _ = few[8]
    assert p == pytest.approx(0.5 * math.erfc(-((a - 0.5) / e - 1.96) / math.sqrt(2)))
    assert not any(ok for *_, ok in models.power_grid(0, 5))

"""Order statistics and resampling over many tasks and blocks, against NumPy on the whole column with the same numbers."""

import math
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import inference, ordering, resampling  # noqa: E402
from lexroute.operators.resampling import CHUNK, DRAW, PICK, PRIME, SIGN, Sample  # noqa: E402


@pytest.fixture(scope="module")
def column(spark):
    rng = np.random.default_rng(8)
    rows = [("a", float(v), i) for i, v in enumerate(rng.integers(0, 40, 700))] + [("a", 7.0, 1000 + i) for i in range(400)] + [(None, float(v), i) for i, v in enumerate(rng.normal(size=31))] + [("c", 1.5, 0), ("a", None, 1)]
    return rows, spark.createDataFrame(rows, "g string, v double, i long").repartition(6)


def of(rows, g):
    return np.sort([r[1] for r in rows if r[0] == g and r[1] is not None])


def test_ranks_and_quantiles(column):
    rows, df = column
    got = {(r["_g"]["g"], r["v"]): r["mid_rank"] for r in ordering.ranks(df, "v", ["g"]).collect()}
    for g in ("a", None, "c"):
        x = of(rows, g)
        want = pd.Series(x).rank()
        assert all(got[g, v] == r for v, r in zip(x, want))
    q = ordering.quantiles(df, "v", ["g"], {"mid": ordering.median, "p95": ordering.nearest_rank(0.95), "q3": ordering.linear(0.3)})
    for r in q.collect():
        x = of(rows, r["g"])
        assert r["n"] == len(x) and r["mid"] == pytest.approx(np.median(x)) and r["q3"] == pytest.approx(np.quantile(x, 0.3)) and r["p95"] == x[min(max(round(0.95 * len(x)) - 1, 0), len(x) - 1)]
    assert ordering.with_ranks(df, "v", ["g"]).count() == len(rows) and ordering.quantiles(df.limit(0), "v", [], {"m": ordering.median}).count() == 0
    plan = ordering.quantiles(df, "v", [], {"m": ordering.median})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_correlation_auc_precision(spark):
    rng = np.random.default_rng(9)
    x, y, t = rng.integers(0, 12, 300), rng.integers(0, 9, 300), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(a), int(b), int(c), k) for k, (a, b, c) in enumerate(zip(x, y, t))], "x long, y long, t int, id long")
    assert ordering.spearman(df, "x", "y").first()["rho"] == pytest.approx(np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1])
    assert ordering.spearman(df.withColumn("x", F.lit(1)), "x", "y").first()["rho"] is None
    above = [(p > q) + (p == q) / 2 for p in x[t == 1] for q in x[t == 0]]
    assert ordering.auc(df, "x", "t").first()["auc"] == pytest.approx(np.mean(above))
    assert ordering.auc(df.filter("t = 1"), "x", "t").first()["auc"] is None
    order = np.lexsort((np.arange(300), -x))
    hits = np.cumsum(t[order])
    assert ordering.average_precision(df, "x", "t", "id").first()["ap"] == pytest.approx(np.mean([hits[k] / (k + 1) for k in range(300) if t[order][k]]))
    d = x - y
    w, p, method = plain_signed_rank(d.astype(float))
    got = ordering.signed_ranks(df.withColumn("d", F.col("x") - F.col("y")), "d").first()
    assert min(got["w_plus"], got["w_minus"]) == w and inference.rank_law(got["n"], w, got["tied"]) == (pytest.approx(p), method)


def plain_signed_rank(d):
    d = d[d != 0]
    rank = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    _, times = np.unique(np.abs(d), return_counts=True)
    return (w, *inference.rank_law(len(d), w, float((times.astype(float) ** 3 - times).sum())))


def test_numbers_look_even():
    u = resampling.numbers(3, DRAW, np.arange(400), 0, 500)
    assert u.min() >= 0 and u.max() < PRIME
    counts = np.bincount((u.ravel() * 64 // PRIME), minlength=64)
    assert ((counts - u.size / 64) ** 2 / (u.size / 64)).sum() < 63 + 5 * math.sqrt(126)
    z = u / PRIME - 0.5
    for a, b in ((z[:, 1:], z[:, :-1]), (z[1:], z[:-1]), (z, resampling.numbers(4, DRAW, np.arange(400), 0, 500) / PRIME - 0.5), (z, resampling.numbers(3, SIGN, np.arange(400), 0, 500) / PRIME - 0.5), (z, resampling.numbers(3, DRAW, np.arange(400), 1, 500) / PRIME - 0.5)):
        assert abs((a * b).mean() * 12) * math.sqrt(a.size) < 5
    assert abs(((u & 1) * 2.0 - 1).mean()) * math.sqrt(u.size) < 5
    assert len(np.unique(u)) > u.size * 0.9999 and resampling.numbers(3, DRAW, np.arange(400), 0, 500).tolist() == u.tolist()


def draws_of(n, block_size, rounds, seed):
    """The rows of each resample, as the two stages of the generator deal them."""
    starts = range(0, n, block_size)
    sizes = [min(block_size, n - s) for s in starts]
    if len(sizes) == 1:
        counts = np.full((1, rounds), n)
    else:
        counts = np.zeros((len(sizes), rounds), int)
        for b, size in enumerate(sizes):
            to = resampling.numbers(seed, resampling.DEAL, np.arange(rounds), b, size) * n // PRIME // block_size
            for r in range(rounds):
                counts[:, r] += np.bincount(to[r], minlength=len(sizes))
    out = []
    for r in range(rounds):
        out.append(np.concatenate([s + resampling.numbers(seed, DRAW, np.array([r]), b, int(counts[b, r]))[0] * size // PRIME for b, (s, size) in enumerate(zip(starts, sizes))]))
    return out


@pytest.mark.parametrize("block", [1 << 14, 256])
def test_resamples_are_the_plain_ones(column, monkeypatch, block):
    rows, df = column
    monkeypatch.setattr(resampling, "BLOCK", block)
    rounds = CHUNK + 9
    sample = Sample(df, ["g"], ["v"], rounds=rounds, seed=5)
    sums, medians, flips = ({(r["_g"]["g"], r["round"]): r for r in x.collect()} for x in (sample.sums(), sample.medians(), sample.flips()))
    again = sample.resamples().groupBy("_g", "round").agg(F.sum(F.col("p0") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    again = {(r["_g"]["g"], r["round"]): r for r in again.collect()}
    for g in ("a", None, "c"):
        x = of(rows, g)
        drawn = draws_of(len(x), block, rounds, 5)
        for r, at in enumerate(drawn):
            assert len(at) == len(x) and sums[g, r]["s0"] == pytest.approx(x[at].sum()) and sums[g, r]["n"] == len(x)
            assert medians[g, r]["median"] == pytest.approx(np.median(x[at]))
            assert again[g, r]["s"] == pytest.approx(x[at].sum()) and again[g, r]["w"] == len(x)
        signs = np.concatenate([(resampling.numbers(5, SIGN, np.arange(rounds), b, len(x[s : s + block])) & 1) * 2.0 - 1 for b, s in enumerate(range(0, len(x), block))], axis=1)
        assert np.allclose([flips[g, r]["s0"] for r in range(rounds)], signs @ x)
    assert len(sums) == 3 * rounds


@pytest.mark.parametrize("block", [1 << 14, 256])
def test_picks_are_the_smallest_numbers(spark, column, monkeypatch, block):
    rows, df = column
    monkeypatch.setattr(resampling, "BLOCK", block)
    wanted = {"a": 300, None: 31, "c": 0}
    sample = Sample(df, ["g"], ["v"], rounds=20, seed=2)
    k = sample.n.select("_g", F.when(F.col("_g.g") == "a", 300).when(F.col("_g.g") == "c", 0).otherwise(31).cast("long").alias("k"))
    got = {(r["_g"]["g"], r["round"]): r["s0"] for r in sample.picked(k).collect()}
    assert len(got) == 60
    for g, n in wanted.items():
        x = of(rows, g)
        u = np.concatenate([resampling.numbers(2, PICK, np.arange(20), b, len(x[s : s + block])) for b, s in enumerate(range(0, len(x), block))], axis=1)
        for r in range(20):
            assert got[g, r] == pytest.approx(x[np.lexsort((np.arange(len(x)), u[r]))[:n]].sum())


def test_a_bound_out_of_reach_is_found_again(spark, monkeypatch):
    """Numbers so uneven that the bound lies nowhere near its place."""
    def uneven(seed, stream, rounds, block, n):
        return np.tile(np.arange(n), (len(rounds), 1)) + rounds[:, None] * 0

    monkeypatch.setattr(resampling, "numbers", uneven)
    df = spark.range(4000).select(F.col("id").cast("double").alias("v"))
    sample = Sample(df, [], ["v"], rounds=3)
    got = sample.picked(sample.n.select("_g", F.lit(2000).cast("long").alias("k"))).collect()
    assert [r["s0"] for r in got] == [sum(range(2000))] * 3


def test_tests_of_samples(spark):
    x = spark.createDataFrame([(float(i), i >= 50, i % 3, i % 3 if i % 10 else 0) for i in range(100)], "v double, on boolean, a int, b int")
    r = inference.mean_permutations(x, [], "v", "on", 500).first()
    assert (r["n_first"], r["n_second"], r["difference"]) == (50, 50, 50.0) and r["p_value"] == pytest.approx(1 / 501)
    r = inference.mean_permutations(x.filter("on"), [], "v", "on", 50).first()
    assert (r["n_second"], r["difference"], r["p_value"]) == (0, 0.0, 1.0)
    r = inference.contingency_permutation(x, "a", "b", 300).first()
    table = np.zeros((3, 3))
    for i in range(100):
        table[i % 3, i % 3 if i % 10 else 0] += 1
    e = np.outer(table.sum(1), table.sum(0)) / 100
    assert r["chi_square"] == pytest.approx(((table - e) ** 2 / e).sum()) and r["p_value"] == pytest.approx(1 / 301)
    r = inference.contingency_permutation(spark.createDataFrame([(i % 2, i // 2 % 2) for i in range(40)], "a int, b int"), "a", "b", 100).first()
    assert r["chi_square"] == pytest.approx(0, abs=1e-9) and r["p_value"] == 1.0
    assert inference.contingency_permutation(x.limit(0), "a", "b").count() == 0
    lone = spark.createDataFrame([(3.0, 4.0)], "c double, d double").withColumn("on", F.lit(True))
    r = inference.policy_ablation(lone, [], "c", "d", "on", 10).first()
    assert (r["n"], r["spent"], r["quality"], r["random_quality"], r["share_reaching"]) == (1, 1, 4.0, 4.0, 1.0)


def test_laws():
    assert inference.sign_test(3000, 2800) == pytest.approx(math.erfc((200 - 1) / math.sqrt(5800) / math.sqrt(2)), rel=0.01)
    assert inference.sign_test(600, 500) == pytest.approx(2 * sum(math.comb(1100, i) for i in range(501)) / 2**1100)


@pytest.mark.parametrize("stream", [SIGN, PICK])
def test_numbers_of_later_blocks_are_those_of_the_sql(stream):
    """A row has the same sign and pick in the SQL, which knows no blocks."""
    size = resampling.BLOCK
    text = resampling.sql(7, stream, "select unnest(range(3)) as r", f"select unnest(range({size - 2}, {2 * size + 3})) as i")
    want = np.array(duckdb.sql(f"with {text} select u from u order by r, i").fetchall()).reshape(3, -1)
    got = np.concatenate([resampling.numbers(7, stream, np.arange(3), b, size) for b in range(3)], axis=1)
    assert (got[:, size - 2 : 2 * size + 3] == want).all()


def test_permutations_of_more_rows_than_a_block(spark):
    """Against the SQL's own way: rows in order, each with its number of the round."""
    n, rounds = resampling.BLOCK + 3000, 40
    x = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("on"))
    r = inference.mean_permutations(x, [], "v", "on", rounds).first()
    rows = x.toPandas()
    v, k, total = np.sort(rows["v"].to_numpy()), int(rows["on"].sum()), rows["v"].sum()
    text = resampling.sql(0, PICK, f"select unnest(range({rounds})) as r", f"select unnest(range({n})) as i")
    u = np.array(duckdb.sql(f"with {text} select u from u order by r, i").fetchall()).reshape(rounds, n)
    first = np.array([v[np.lexsort((np.arange(n), row))[:k]].sum() for row in u])
    gap = np.abs(first / k - (total - first) / (n - k))
    assert r["p_value"] == pytest.approx(((gap >= abs(r["difference"]) - 1e-12).sum() + 1) / (rounds + 1))

"""Studies and resampling on rows whose answers are known."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import inference, studies  # noqa: E402


def test_transitions_pair_by_key(spark):
    a = spark.createDataFrame([(1, "x", 0.2, 5.0), (2, "x", 0.4, None), (3, "x", None, 1.0), (4, "x", 1.0, 1.0)], "q long, s string, v double, ms double")
    b = spark.createDataFrame([(1, "y", 0.6, 9.0), (2, "y", 0.4, 2.0), (3, "y", 0.1, 1.0), (9, "y", 0.1, 1.0)], "q long, s string, v double, ms double")
    got = {(r["from_strategy"], r["to_strategy"], r["reason"]): r for r in studies.transition_quality(a, b, "q", "s", ["v", "ms"]).collect()}
    paired = got["x", "y", "paired"]
    assert (paired["n"], paired["v_before"], paired["v_after"], paired["v_change"], paired["ms_change"]) == (2, 0.3, 0.5, 0.2, 4.0)
    assert {k: r["n"] for k, r in got.items()} == {("x", "y", "paired"): 2, ("x", "y", "no_quality"): 1, ("x", None, "no_after"): 1, (None, "y", "no_before"): 1}


def test_changes_are_null_safe(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "d"), (5, "")], "id long, t string")
    new = spark.createDataFrame([(1, "b"), (2, None), (3, "c"), (6, "d"), (5, None)], "id long, t string")
    assert {tuple(r) for r in studies.changes(old, new, "id", "t").collect()} == {(1, "changed"), (3, "changed"), (4, "removed"), (6, "added"), (5, "changed")}


def test_judged_scores(spark):
    said = ['{"score": 4}', '```json\n{"score": "3.5", "why": "x"}\n```', 'Sure: {"score": "high"}', "no score", None, '{"other": 1}', "{broken"]
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").select("i", studies.judged_score(F.col("t"), "score").alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [4.0, 3.5, None, None, None, None, None]


def test_latency_must_be_there(spark):
    q = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.1)], "q long, v double")
    ms = spark.createDataFrame([(1, 10.0), (2, 20.0)], "q long, ms double")
    assert studies.with_latency(q, ms, ["q"], "ms").count() == 2
    with pytest.raises(Exception, match="no ms for 3"):
        studies.with_latency(q, ms.union(spark.createDataFrame([(3, None)], "q long, ms double")), ["q"], "ms").collect()


def test_small_expressions(spark):
    x = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "a double, b double")
    assert [r[0] for r in x.select(studies.total_latency(F.col("a"), F.col("b"))).collect()] == [3.0, 2.0, None]
    t = spark.createDataFrame([([["a", "b|c"], ["1", None]],), ([["a"]],), ([],)], "rows array<array<string>>")
    assert [r[0] for r in t.select(studies.markdown_table(F.col("rows"))).collect()] == ["| a | b\\|c |\n| --- | --- |\n| 1 |  |", "| a |\n| --- |", ""]
    tied = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.5), (2, 0.6), (3, None)], "q long, v double")
    assert {(r["q"], r["n"], r["tied"]) for r in studies.tie_artefact(tied, "q", "v").collect()} == {(1, 2, True), (2, 2, False), (3, 0, None)}


def test_resampling_by_group(spark):
    rng = np.random.default_rng(5)
    d = rng.normal(1.0, 1.0, 200)
    rows = [("far", i % 20, float(v)) for i, v in enumerate(d)] + [("none", i % 20, float(v)) for i, v in enumerate(d - d.mean())] + [("none", 0, None)]
    x = spark.createDataFrame(rows, "g string, c long, d double").repartition(3)
    ci = {r["g"]: r for r in inference.mean_intervals(x, ["g"]).collect()}
    half = 1.96 * d.std(ddof=1) / np.sqrt(200)
    assert ci["far"]["n"] == ci["none"]["n"] == 200
    assert ci["far"]["lo"] == pytest.approx(d.mean() - half, abs=0.03) and ci["far"]["hi"] == pytest.approx(d.mean() + half, abs=0.03)
    again = {r["g"]: r for r in inference.mean_intervals(x.repartition(7), ["g"]).collect()}
    assert all(tuple(again[g])[2:] == pytest.approx(tuple(ci[g])[2:], abs=1e-12) for g in ci)
    flips = {r["g"]: r["p_value"] for r in inference.sign_flips(x, ["g"]).collect()}
    assert flips["far"] == 1 / 10_001 and flips["none"] == 1.0
    for r in inference.cluster_intervals(x, ["g"], "c").collect():
        assert r["clusters"] == 20 and r["lo"] < (d.mean() if r["g"] == "far" else 0) < r["hi"]


def test_sign_flips_against_all_signs(spark):
    d = np.array([1.0, 2.0, -0.5, 3.0, 0.25, 1.5])
    signs = np.array(np.meshgrid(*[[-1, 1]] * 6)).reshape(6, -1).T
    exact = (np.abs(signs @ d) >= abs(d.sum()) - 1e-9).mean()
    got = inference.sign_flips(spark.createDataFrame([(float(v),) for v in d], "d double"), []).first()["p_value"]
    assert got == pytest.approx(exact, abs=0.01)


def test_policy_against_random_picks(spark):
    rows = [("p", 0.0, 1.0 if i < 5 else 0.0, i < 5) for i in range(20)]
    r = inference.policy_ablation(spark.createDataFrame(rows, "g string, a double, b double, on boolean"), ["g"], "a", "b", "on").first()
    assert (r["n"], r["spent"], r["quality"]) == (20, 5, 0.25) and r["random_quality"] == pytest.approx(1.25 / 20, abs=0.01) and r["share_reaching"] < 0.01

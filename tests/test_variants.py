"""Policies, grids, decisions of variants and the registry."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import routing  # noqa: E402
from lexroute.plans import variants as V  # noqa: E402


@pytest.mark.parametrize("bad", [dict(available=()), dict(available=("bm25", "bm25"), ladder=()), dict(ladder=("bm25", "sparse")), dict(available=("bm25",)), dict(steps=4), dict(steps=-1), dict(groups=()), dict(groups=("colour",)), dict(enough=1.1), dict(min_results=0), dict(cost_weight=-0.1)])
def test_contradictions_are_refused(bad):
    with pytest.raises(ValueError):
        V.Policy(**bad)


def test_grids():
    assert [v.baseline for v in V.escalation_variants()] == [True, False, False]
    assert [v.name for v in V.feature_variants(V.Policy(groups=("entity", "lexical")))] == ["full", "without_lexical", "without_entity"]
    assert len(V.feature_variants(V.Policy(groups=("entity",)))) == 1
    assert [v.policy.steps for v in V.step_variants(values=(-1, 1, 9))] == [0, 1, 3]
    assert [v.name for v in V.cost_variants() if v.baseline] == ["cost_weight=0.25"]
    assert V.summary(V.escalation_variants() + V.cost_variants(values=(0.5,))) == {"escalation": ["route_only", "check_only", "check_and_escalate"], "cost_weight": ["cost_weight=0.5"]}
    for bad in (("coverage", (0.1,)), ("min_results", (1.5,))):
        with pytest.raises(ValueError):
            V.threshold_variants(V.Policy(), *bad)
    a, b = V.Policy(), V.Policy(cost_weight=0.5, steps=2)
    assert V.varied(b, a) == {"cost_weight": 0.5, "steps": 2} and V.varied(a, a) == {} and V.digest(a) == V.digest(V.Policy()) != V.digest(b)


def test_one_plan_decides_as_each_alone(spark):
    texts = ["What is BM25?", "Why does dense retrieval outperform sparse methods and how does it scale", "RFC-2119 vs RFC-8174", "tokenizer latency", ""]
    analysed = routing.features(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string"))
    grid = V.feature_variants() + V.cost_variants()
    got = {(r["query_id"], r["study"], r["variant"]): r["strategy"] for r in V.routes(analysed, grid).collect()}
    assert len(got) == 4 * len(grid)
    for v in grid:
        alone = routing.route(analysed, list(v.policy.available), list(v.policy.groups), v.policy.cost_weight)
        assert {r["query_id"]: r["strategy"] for r in alone.collect()} == {q: s for (q, study, name), s in got.items() if (study, name) == (v.study, v.name)}


def test_outcomes(spark):
    grid = V.escalation_variants() + V.threshold_variants(values=(0.3, 0.7)) + [V.Variant("thresholds", "steps=0", V.Policy(steps=0))]
    routed = spark.createDataFrame([(1, "bm25"), (2, "hybrid_rerank"), (3, "dense"), (4, "bm25")], "query_id int, strategy string").crossJoin(spark.createDataFrame([(v.study, v.name) for v in grid], "study string, variant string"))
    judged = spark.createDataFrame([(1, "bm25", 3, 0.2, 0.1), (2, "hybrid_rerank", 1, 0.0, 0.0), (3, "dense", 5, 1.0, 1.0), (4, "dense", 5, 1.0, 1.0)], "query_id int, strategy string, n_results int, coverage double, top1_coverage double")
    got = {(r["query_id"], r["variant"]): (r["sufficient"], r["to_strategy"], r["reason"]) for r in V.outcomes(routed, judged, grid).collect()}
    assert [got[q, "route_only"] for q in (1, 2, 3)] == [(None, None, "check disabled")] * 3
    assert got[1, "check_only"] == (True, None, "sufficient") and got[1, "enough=0.7"] == (False, "dense", "escalated") and got[1, "enough=0.3"] == (True, None, "sufficient")
    assert got[2, "check_and_escalate"] == (False, None, "strongest strategy") and got[2, "steps=0"][2] == "budget exhausted" and got[2, "check_only"][2] == "escalation disabled"
    assert got[3, "enough=0.7"] == (True, None, "sufficient") and got[4, "enough=0.7"] == (None, None, "not judged")


def test_registry(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert V.registered(spark, path).count() == 0
    a, b = V.escalation_variants()[0], V.cost_variants()[2]
    V.register(spark, path, [V.entry(a, "r1"), V.entry(b, "r2")])
    for twice in ([V.entry(b, "r3")], [V.entry(V.cost_variants()[0], "r4")] * 2):
        with pytest.raises(ValueError, match="registered already"):
            V.register(spark, path, twice)
    V.register(spark, path, [V.entry(b, "r3"), V.entry(V.cost_variants()[0], "r4")], again=True)
    assert {(r["study"], r["n"], tuple(r["variants"])) for r in V.registry_summary(V.registered(spark, path)).collect()} == {("escalation", 1, ("route_only",)), ("cost_weight", 2, ("cost_weight=0.0", "cost_weight=0.5"))}
    assert V.registered(spark, path).filter(F.col("variant") == b.name).first()["run_dir"] == "r3"
    assert V.registered(spark, path).filter(F.col("variant") == b.name).first()["varied"] == '{"cost_weight": 0.5}'
    with pytest.raises(ValueError, match="unknown study"):
        V.entry(V.Variant("colour", "x"), "r")


def test_shared_settings():
    assert V.drifted({"corpus": 1, "k": 10}, {"x": {"corpus": 1, "k": 10, "own": 2}, "y": {"corpus": 2}}) == ["y.corpus", "y.k"]

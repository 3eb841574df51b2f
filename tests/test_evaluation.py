"""Signals, policies, tests, chunks and gates against hand-computed or plain results."""

import itertools
import math
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import chunking, gates, inference, routing, signals  # noqa: E402


def one(spark, a, b, sa=None, sb=None):
    row = (a, b, sa or [], sb or [])
    return spark.createDataFrame([row], "a array<string>, b array<string>, s array<double>, z array<double>")


def value(df, col):
    return df.select(col.alias("x")).first()[0]


def test_sets_of_two_lists(spark):
    a, b = F.col("a"), F.col("b")
    empty, apart, same = one(spark, [], []), one(spark, ["x"], ["y"]), one(spark, ["x", "y"], ["y", "x"])
    assert value(empty, signals.jaccard(a, b)) == value(empty, signals.overlap(a, b)) == value(empty, signals.distinct_ratio(a)) == 1.0
    assert value(apart, signals.union_concentration(a, b)) == 1.0 and value(same, signals.union_concentration(a, b)) == 0.5
    with pytest.raises(Exception, match="needs a result"):
        value(empty, signals.union_concentration(a, b))
    assert not value(empty, signals.top1_agrees(a, b)) and not value(same, signals.top1_agrees(a, b))
    assert value(one(spark, ["x", "x", "y"], []), signals.distinct_ratio(a, 4)) == 0.5
    assert value(one(spark, [], ["x"]), signals.overlap(a, b)) == 1.0


def test_rank_correlation_and_scores(spark):
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    assert value(one(spark, ["x", "y"], ["y", "z"]), signals.rank_correlation(a, b)) is None
    assert value(one(spark, list("abcd"), list("dxcba")), signals.rank_correlation(a, b)) == pytest.approx(-1.0)
    assert value(one(spark, list("abcd"), list("bacd")), signals.rank_correlation(a, b)) == pytest.approx(0.8)
    assert value(one(spark, [], [], [0.0, 1.0]), signals.score_gap(s)) is None
    assert value(one(spark, [], [], [4.0, None, float("nan"), 3.0]), signals.score_gap(s)) == 0.25
    assert value(one(spark, [], [], [4.0, None, 2.0]), signals.score_slope(s)) == -2.0
    assert value(one(spark, [], [], [4.0]), signals.score_slope(s)) is None


def test_change(spark):
    x = spark.createDataFrame([(["a", "b"], ["b", "c", "d"], ["c"], ["c", "a"])], "d array<string>, h array<string>, b array<string>, r array<string>")
    got = x.select(*(c.alias(n) for n, c in signals.change(F.col("d"), F.col("h"), F.col("b"), F.col("r")).items())).first()
    assert tuple(map(tuple, got)) == (("c", "d"), ("a",), ("c",), ("a",), ("bm25_only", "neither"))


def test_policies(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, float("nan"), *map(float, range(30))]), rng.random(), rng.random(), 1.0, 5.0) for _ in range(80)]
    records = spark.createDataFrame(rows, "signal double, cheap double, dear double, cheap_ms double, dear_ms double")
    v = sorted(r[0] for r in rows if r[0] is not None and not math.isnan(r[0]))
    want = []
    for d in range(1, 10):
        r = d * len(v) / 10
        c = (v[min(len(v) - 1, math.floor(r))] + v[min(len(v) - 1, math.ceil(r))]) / 2
        want += [c] if not want or c > want[-1] else []
    cuts = signals.decile_cuts(records, "signal")
    assert sorted(r["cut"] for r in cuts.collect()) == want
    for r in signals.sweep(records.filter("not isnan(signal) or signal is null"), "signal", cuts, "low").collect():
        kept = [x for x in rows if x[0] is None or not math.isnan(x[0])]
        go = [x[0] is not None and x[0] <= r["cut"] for x in kept]
        assert r["rate"] == pytest.approx(np.mean(go)) and r["quality"] == pytest.approx(np.mean([x[2] if g else x[1] for x, g in zip(kept, go)]))
        assert r["tp"] == sum(g and x[2] - x[1] >= 0.01 for x, g in zip(kept, go))
    with pytest.raises(ValueError):
        signals.sweep(records, "signal", cuts, "up")
    none = spark.createDataFrame([("s", "high", 1.0, 4, 0.0, 0.7, 0.1), ("s", "high", 2.0, 4, 1.0, 0.9, 0.1)], "signal string, direction string, cut double, n int, rate double, quality double, error double")
    assert tuple(signals.select_rule(none).first())[2:] == (2.0, 1.0, 0.9, True)


def test_signed_rank_and_sign_test():
    assert inference.sign_test(0, 0) == 1.0 and inference.sign_test(5, 0) == 2 / 32
    sums = [sum(r for r, s in zip(range(1, 7), signs) if s) for signs in itertools.product([0, 1], repeat=6)]
    p, method = inference.rank_law(6, 7.0, 0.0)
    assert method == "exact" and p == pytest.approx(min(1.0, 2 * sum(x <= 7 for x in sums) / 64))
    assert inference.rank_law(0, 0.0, 0.0) == (1.0, "degenerate")
    assert inference.rank_law(4, 1.0, 6.0)[1] == "normal"
    assert inference.rank_law(400, 0.0, 400.0**3 - 400)[0] == inference.LEAST_P


def test_compare_and_holm(spark):
    rows = [("m", float(x)) for x in (0.5, -0.25, 0.0, 1.5)] + [("k", 2.0)] + [("k", None)]
    got = {r["g"]: r for r in inference.compare(spark.createDataFrame(rows, "g string, d double"), ["g"]).collect()}
    assert (got["m"]["wins"], got["m"]["ties"], got["m"]["losses"], got["m"]["median_d"]) == (2, 1, 1, 0.25)
    assert (got["k"]["n"], got["k"]["ci_low"], got["k"]["ci_high"]) == (1, 2.0, 2.0)
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double").withColumn("f", F.lit(1))
    assert sorted(r["p_holm"] for r in inference.holm(tests.filter("p is not null"), "p", ["f"]).collect()) == [0.03, 0.06, 0.06]
    assert max(r["p_holm"] for r in inference.holm(tests, "p", ["f"]).collect()) == 1.0


def test_resampling_is_seeded_and_sane(spark):
    x = spark.range(50).select(F.col("id").cast("double").alias("d"), (F.col("id") >= 25).alias("late"), (F.col("id") * F.col("id")).alias("square"))
    ci = inference.mean_intervals(x, [], rounds=500).first()
    assert tuple(ci) == pytest.approx(tuple(inference.mean_intervals(x.repartition(3), [], rounds=500).first())) and ci["lo"] < 24.5 < ci["hi"]
    records = x.select(F.lit(0.0).alias("c"), F.when(F.col("d") < 5, 1.0).otherwise(0.0).alias("e"), (F.col("d") < 5).alias("on")).limit(20)
    r = inference.policy_ablation(records, [], "c", "e", "on").first()
    assert r["quality"] == 0.25 and 0.04 < r["random_quality"] < 0.09 and r["share_reaching"] < 0.01
    two = x.filter("d < 20").select(F.when(F.col("d") < 10, 0.0).otherwise(1.0).alias("d"), F.floor(F.col("d") / 10).alias("c"))
    r = inference.cluster_intervals(two, [], "c", rounds=500).first()
    assert (r["n"], r["clusters"], r["lo"], r["hi"]) == (20, 2, 0.0, 1.0)
    r = inference.rank_intervals(x, [], "d", "square", 50).first()
    assert r["rho"] == pytest.approx(1.0) and r["constant"] == 0 and r["lo"] == pytest.approx(1.0)


def test_chunks(spark):
    long = "Word word word. " * 400
    rows = [(1, 0, "heading", 1, "A"), (1, 1, "paragraph", None, "short one"), (1, 2, "heading", 2, "B"), (1, 3, "paragraph", None, "short two"), (1, 4, "heading", 2, "C"), (1, 5, "paragraph", None, long), (1, 6, "table", None, long), (2, 0, "paragraph", None, None)]
    out = chunking.chunk(spark.createDataFrame(rows, "page_id long, position int, kind string, level int, text string")).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in out] == list(range(1, len(out) + 1)) and all(r["page_id"] == 1 for r in out)
    assert all(r["n_tokens"] <= chunking.MOST + 50 or r["oversized"] for r in out) and sum(r["oversized"] for r in out) == 1
    assert "short one" in out[0]["text"] and out[0]["section"] == "A"
    assert sum(r["text"].count("word") for r in out) == 4 * 400 and chunking.parts_of("") == []


def test_gates(spark):
    ex = spark.createDataFrame([(1, "q", ["a"], "x"), (1, " ", [], "y"), (2, None, None, None)], "id long, q string, l array<string>, c string")
    got = sorted(map(tuple, gates.structure(ex, "id", "q", "l", ("c", ["x"])).collect()))
    assert got == sorted([("repeated_id", "1"), ("blank_query", "1"), ("blank_query", "2"), ("no_label", "1"), ("no_label", "2"), ("unknown_category", "1"), ("unknown_category", "2")])
    chunks = spark.createDataFrame([(1, "a  b\nc")], "doc_id long, text string")
    quotes = spark.createDataFrame([("e1", 1, "b c"), ("e2", 1, "c b"), ("e3", 9, "b")], "example_id string, doc_id long, quote string")
    assert sorted(map(tuple, gates.grounding(quotes, chunks).collect())) == [("no_chunk", "e3"), ("not_verbatim", "e2")]


def test_duplicate_screen(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)] + ["", None]
    texts += [rng.choice(texts[:40]) for _ in range(8)]
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    sets = [set((t or "").split()) for t in texts]
    like = lambda i, j: 1.0 if not sets[i] and not sets[j] else (len(sets[i] & sets[j]) / len(sets[i] | sets[j]))
    pairs = gates.duplicate_pairs(q, 0.6)
    first = {i: min(j for j in range(len(texts)) if sets[j] == sets[i]) for i in range(len(texts))}
    want = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if like(i, j) >= 0.6 and (first[j] == i or first[i] == i and first[j] == j)]
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == want and sum(first[i] != i for i in first) > 5
    assert all((r["jaccard"] == 1) == (sets[r["a"]] == sets[r["b"]]) for r in pairs.collect())
    kept, flags = [], []
    for i in range(len(texts)):
        hit = next((j for j in kept if like(i, j) >= 0.6), None)
        flags += [] if hit is None else [(i, hit)]
        kept += [i] if hit is None else []
    assert sorted(map(tuple, gates.accepted(pairs, q).collect())) == flags


def test_routing(spark):
    asked = ["What is BM25?", "compare dense retrieval and BM25 versus hybrid", "Why does fusion help", "define recall", "  ", None, "???", "q"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    f = {r["query_id"]: r for r in routing.route(routing.features(q)).collect()}
    assert sorted(f) == [0, 1, 2, 3, 7]
    assert [f[i]["question_type"] for i in (0, 1, 2, 3, 7)] == ["what", "compare", "why", "define", "other"]
    assert f[7]["content_terms"] == ["q"] and f[0]["content_terms"] == ["bm25"] and f[1]["multi_concept"]
    assert f[3]["strategy"] == "bm25" and f[1]["strategy"] == "hybrid"
    assert sorted((r["query_id"], r["reason"]) for r in routing.rejected(q).collect()) == [(4, "query is empty"), (5, "query is empty"), (6, "no term to analyse")]
    only = routing.route(routing.features(q), ["bm25"]).first()
    assert only["confidence"] == 0.0 and only["strategy"] == "bm25"
    with pytest.raises(ValueError):
        routing.route(routing.features(q), ["other"])
    judged = spark.createDataFrame([("bm25", True), ("bm25", False), ("hybrid_rerank", False), ("dense", None)], "strategy string, sufficient boolean")
    assert [tuple(r)[2:] for r in routing.escalation(judged).collect()] == [("sufficient", False, None), ("escalated", True, "dense"), ("strongest available", False, None), ("check disabled", False, None)]
    assert routing.escalation(judged, enabled=False).filter("escalated").count() == 0


def test_no_results_are_insufficient(spark):
    q = routing.features(spark.createDataFrame([(1, "alpha beta")], "query_id long, query string"))
    none = spark.createDataFrame([], "query_id long, doc_id long, rank int")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    r = routing.sufficient(q, none, docs).first()
    assert (r["n_results"], r["score"], r["sufficient"]) == (0, 0.0, False)

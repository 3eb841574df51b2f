"""Caches, vectors as text, report tables, and gates over runs."""

import hashlib
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import gates, reports, studies  # noqa: E402
from lexroute.sources import caches  # noqa: E402


def test_keys(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = spark.createDataFrame([("ä", "a", "r"), (None, "a", "r"), ("", "", "")], "q string, a string, r string").select(caches.embedding_key(F.col("q"), "m", "h", None, True, "v1"), caches.judge_key("p", "m", F.col("q"), F.col("a"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(sha("v1|m|h|None|True|" + sha(q)), sha(f"p|m|{q}|{a}|{r}")) if q is not None else (None, None) for q, a, r in (("ä", "a", "r"), (None, 0, 0), ("", "", ""))]


def test_cache_computes_what_it_lacks(spark, tmp_path):
    cache, asked = caches.Cache(spark, str(tmp_path / "c"), "double"), []
    assert cache.count() == 0

    def compute(missing):
        asked.append(sorted(r["key"] for r in missing.collect()))
        return missing.select("key", F.length("key").cast("double").alias("value"))

    want = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "key string")
    assert sorted(map(tuple, cache.through(want, compute).collect()), key=str) == [("a", 1.0), ("a", 1.0), ("bb", 2.0), (None, None)]
    cache.through(spark.createDataFrame([("bb",), ("ccc",)], "key string"), compute)
    assert asked == [["a", "bb"], ["ccc"]] and cache.count() == 3
    cache.put(spark.createDataFrame([("a", 9.0), (None, 1.0), ("z", None)], "key string, value double"))
    assert {tuple(r) for r in cache.rows().collect()} == {("a", 9.0), ("bb", 2.0), ("ccc", 3.0)} == {tuple(r) for r in cache.compact(str(tmp_path / "d")).rows().collect()}


def test_vectors_as_text(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(caches.unpacked(caches.packed("v"))).collect()] == [[1.5, -2.0], [], None]
    assert df.select(caches.packed("v")).first()[0] == "AADAPwAAAMA="
    assert caches.dimension_checked(df.limit(1), "v", 2).count() == 1
    with pytest.raises(Exception, match="needs 2 places, got -1"):
        caches.dimension_checked(df.filter("v is null"), "v", 2).collect()


def test_refused_batches_are_halved():
    calls = []

    def call(part):
        calls.append(len(part))
        if len(part) > 2 or "bad" in part:
            raise OverflowError
        return [t.upper() for t in part]

    assert caches.embed(list("abcdefg"), call, 5, OverflowError) == list("ABCDEFG") and calls[:3] == [5, 2, 3]
    assert caches.embed([], call, 5, OverflowError) == []
    with pytest.raises(OverflowError):
        caches.embed(["a", "bad"], call, 2, OverflowError)


def test_cells(spark):
    x = spark.createDataFrame([(0.125, 4), (0.375, 5), (1.0, None), (None, 9), (float("nan"), 9)], "v double, n int")
    got = x.select(reports.fixed("v", 2).alias("f"), reports.share("v").alias("s"), reports.few().alias("few"), reports.text("n").alias("t")).collect()
    assert [r["f"] for r in got] == ["0.12", "0.38", "1.00", "", ""] and [r["s"] for r in got] == ["12.5%", "37.5%", "100.0%", "", ""]
    assert [r["few"] for r in got] == ["yes", "no", "", "no", "no"] and [r["t"] for r in got] == ["4", "5", "", "9", "9"]


def test_tables_and_texts(spark):
    df = spark.createDataFrame([("a|b", 0.5, 3), ("c,d", None, 9)], "s string, v double, n int")
    cells = reports.table(df, [("System", reports.text("s")), ("Mean", reports.fixed("v", 3)), ("Few", reports.few())])
    assert [tuple(r) for r in cells.orderBy("System").collect()] == [("a|b", "0.500", "yes"), ("c,d", "", "no")]
    body = reports.markdown(cells, "Means", ["System"]).first()["body"]
    assert body == "### Means\n\n| System | Mean | Few |\n| --- | --- | --- |\n| a\\|b | 0.500 | yes |\n| c,d |  | no |\n"
    assert "_nothing ran_" in reports.markdown(cells.limit(0), "None", ["System"], "nothing ran").first()["body"]
    with pytest.raises(ValueError, match="apart"):
        reports.table(df, [("Overall score", reports.text("v"))])
    with pytest.raises(Exception, match="at most"):
        reports.markdown(spark.range(reports.MOST_ROWS + 1).selectExpr("string(id) as id"), "Long", ["id"]).collect()


def test_all_reports(spark):
    fields = "system string, category string, recall_at_5 double, mrr double, ndcg_at_5 double, total_latency_ms double, routing_latency_ms double, retrieval_latency_ms double, reranking_latency_ms double, escalated boolean, stage_count int, routing_confidence double, initial_strategy string, final_strategy string, context_tokens int, total_tokens int, estimated_cost_usd double, sufficiency_threshold double"
    rows = [("x", "k", 1.0, 0.5, 0.25, 100.0, 10.0, 80.0, None, True, 2, 0.5, "bm25", "dense", 100, None, 0.01, 0.5)] * 2 + [("x", "l", 0.0, 0.0, 0.0, 300.0, None, None, None, None, None, None, None, None, None, None, None, None), ("y", "k", None, None, None, None, None, None, None, False, 1, None, "dense", "dense", 5, 7, None, 0.7)]
    df = spark.createDataFrame(rows, fields)
    made = {name: [r.asDict() for r in reports.report(df, name).collect()] for name in reports.REPORTS}
    x = next(r for r in made["systems"] if r["System"] == "x")
    assert (x["Recall at 5"], x["Median ms"], x["95 % ms"], x["Median reranking ms"], x["Resources"], x["n"], x["Few rows"]) == ("0.6667", "100.00", "300.00", "", "ctx=100 usd=0.010000", "3", "yes")
    y = next(r for r in made["features"] if r["System"] == "y")
    assert (y["Recall at 5"], y["First choice"], y["Escalated"], y["Resources"]) == ("", "dense (100%)", "0.0%", "ctx=5 total=7")
    assert {r["Sufficiency threshold"] for r in made["thresholds"]} == {"", "0.5", "0.7"} and next(r for r in made["overhead"] if r["System"] == "x")["Share of total"] == "10.00%"
    assert {r["Category"] for r in made["categories"]} == {"k", "l"}
    runs = spark.createDataFrame([("q1", True, "bm25", "dense", ["a", "b"], ["b", "c"]), ("q2", True, "bm25", "dense", None, ["z"]), ("q3", False, "bm25", "bm25", None, ["a"])], "query_id string, escalated boolean, initial_strategy string, final_strategy string, pre_escalation_chunk_ids array<string>, retrieved_chunk_ids array<string>")
    gold = spark.createDataFrame([("q1", ["b", "c"]), ("q2", ["z", "y"])], "query_id string, chunk_ids array<string>")
    assert [tuple(r) for r in reports.transitions(runs, gold).collect()] == [("bm25", "dense", "0.5000", "0.7500", "0.5000", "2", "yes")]


def test_gates_over_runs(spark):
    runs = spark.createDataFrame([(1, "x", "ok"), (2, "x", "failed"), (3, "y", None), (3, "y", "ok")], "q int, arm string, status string")
    assert {tuple(r) for r in gates.contaminated(runs, "arm", "q").collect()} == {("not_ok:x", "2"), ("not_ok:y", "3")}
    want = spark.createDataFrame([(1,), (2,), (4,)], "q int")
    assert {tuple(r) for r in gates.coverage(runs, want, "q").collect()} == {("not_run", "4"), ("not_expected", "3"), ("ran_twice", "3")}
    a = spark.createDataFrame([(1, 0.5, None), (2, 0.5, 1.0), (3, None, 1.0)], "q int, u double, v double")
    b = spark.createDataFrame([(1, 0.5 + 1e-12, None), (2, 0.6, None), (3, None, 1.0)], "q int, u double, v double")
    assert {tuple(r) for r in gates.unequal(a, b, "q", ["u", "v"]).collect()} == {("unequal:u", "2"), ("unequal:v", "2")}


def test_runs_compared(spark):
    schema = "metric string, k int, value double, corpus string"
    a = spark.createDataFrame([("hit", 1, 0.5, "c"), ("hit", 5, 0.0, "c"), ("mrr", 5, 0.1, "c")], schema)
    b = spark.createDataFrame([("hit", 1, 0.6, "c"), ("hit", 5, 0.2, "c")], schema)
    assert {(r["metric"], r["k"]): (r["delta"], r["relative"]) for r in studies.run_deltas(a, b, ["corpus"]).collect()} == {("hit", 1): (0.1, 0.2), ("hit", 5): (0.2, None)}
    with pytest.raises(ValueError, match="differ in corpus"):
        studies.run_deltas(a, b.withColumn("corpus", F.lit("d")), ["corpus"])
    assert {tuple(r) for r in studies.by_depth(a, "metric", "k", "value", [1, 5, 10]).collect()} == {("hit", 0.5, 0.0, None), ("mrr", None, 0.1, None)}


def test_replication(spark):
    first = spark.createDataFrame([("a", 0.4, 0.01), ("b", 0.4, 0.01), ("c", 0.2, 0.01), ("d", -0.5, 0.04), ("e", 0.9, 0.05), ("f", 0.9, 0.01), ("g", None, None)], "signal string, rho double, p_holm double")
    second = spark.createDataFrame([("a", 0.3), ("b", -0.4), ("c", 0.9), ("d", -0.3), ("e", 0.9), ("g", 0.9)], "signal string, rho double")
    assert {r["signal"] for r in studies.replicated(first, second).collect() if r["replicated"]} == {"a", "d"}


def test_reranker_decomposition(spark):
    rows = spark.createDataFrame([(1, "r", 0.9), (1, "h", 0.5), (1, "d", 0.7), (2, "r", 0.5), (2, "h", 0.6), (2, "d", 0.5), (3, "r", 0.5), (3, "h", 0.5), (4, "r", 0.5)], "q int, s string, v double")
    assert studies.reranker_decomposition(rows, "q", "s", "v", "r", "h").first().asDict() == {"n": 3, "rises": 1, "falls": 1, "stays": 1, "reranked_beats_others": 1, "base_beats_others": 1, "rises_above_others": 1}

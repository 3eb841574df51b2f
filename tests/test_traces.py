"""Trace texts to rows: every column, gaps, failures, broken texts."""

import json
import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import traces  # noqa: E402


def hit(chunk, doc, rank, path=()):
    return {"chunk_id": chunk, "rank": rank, "score": 1.0 / rank, "text": "t", "metadata": {"document_id": doc, "section_path": list(path), "more": 1}}


FULL = {
    "example_id": "q1", "trace_id": "t1", "category": "x", "status": "ok", "retrieval_latency_ms": 1.5, "rerank_latency_ms": 2, "total_latency_ms": 9, "generation_latency_ms": None, "candidate_generation_latency_ms": 0.25,
    "retrieval": {"results": [hit("a", "d1", 1, ["A", "B"]), hit("b", "d2", 2, ["C"]), hit("c", "d1", 3, ["A"]), hit("e", "d9", 4, [])], "retrieval_metadata": {"query_embedding_latency_ms": 4.5, "search_latency_ms": 0.5}},
    "routing": {
        "routing_latency_ms": 0.125, "initial_strategy": "bm25", "final_strategy": "dense", "stage_count": 2, "stage_latencies_ms": [1.5, 3], "initial_chunk_ids": [], "initial_document_ids": None,
        "escalation": {"escalated": True, "to_strategy": "dense"}, "decision": {"confidence": 0.5}, "features": {"question_type": "why"},
        "sufficiency": {"score": 0.25, "threshold": 0.5, "sufficient": False, "coverage": 1, "signals": [{"name": "n", "passed": True, "value": 1}, {"name": "m", "passed": False}, {"name": "o"}]},
    },
    "context_tokens": 12, "estimated_cost_usd": 0.001, "usage": {"input_tokens": 1, "output_tokens": 2, "total_tokens": 3}, "rerank_candidate_count": 20, "rerank_result_count": 4, "rerank_fallback": False,
    "error": {"stage": "generation", "error_type": "E", "message": "m"},
}


@pytest.fixture(scope="module")
def given(spark):
    texts = [json.dumps(FULL), json.dumps({"trace_id": "q2", "status": "retrieval_failed", "retrieval": None, "total_latency_ms": "soon"}), "{not json", None, json.dumps({"example_id": "zz"}), json.dumps({"status": "ok"}), json.dumps({"example_id": "q3", "retrieval": {"results": []}})]
    examples = [("q1", "k", "test", ["d1", "d3"], [["A"]]), ("q2", "k", "calibration", ["d1"], []), ("q3", "l", "test", None, None)]
    return spark.createDataFrame([(t,) for t in texts], "trace string"), spark.createDataFrame(examples, "query_id string, category string, split string, relevant_documents array<string>, section_prefixes array<array<string>>")


def test_rows(given):
    got = {r["query_id"]: r.asDict() for r in traces.rows(*given, "s", "e").collect()}
    assert sorted(got) == ["q1", "q2", "q3"] and len(got["q1"]) == 6 + 2 + 11 + 9 + 11 + 8 + 3
    r = got["q1"]
    assert (r["recall_at_1"], r["recall_at_5"], r["precision_at_1"], r["precision_at_5"], r["hit_at_1"], r["mrr"]) == (0.5, 0.5, 1.0, 0.5, 1.0, 1.0)
    assert r["ndcg_at_5"] == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert (r["system"], r["experiment_id"], r["category"], r["split"], r["status"], r["retrieved_chunk_ids"], r["retrieved_document_ids"]) == ("s", "e", "k", "test", "ok", ["a", "b", "c", "e"], ["d1", "d2", "d1", "d9"])
    assert (r["reranking_latency_ms"], r["total_latency_ms"], r["generation_latency_ms"], r["query_embedding_latency_ms"], r["search_latency_ms"], r["stage_latencies_ms"], r["routing_latency_ms"]) == (2.0, 9.0, None, 4.5, 0.5, [1.5, 3.0], 0.125)
    assert (r["initial_strategy"], r["final_strategy"], r["escalated"], r["escalation_target"], r["sufficiency_score"], r["sufficient"], r["stage_count"], r["routing_confidence"], r["pre_escalation_chunk_ids"], r["pre_escalation_document_ids"]) == ("bm25", "dense", True, "dense", 0.25, False, 2, 0.5, [], None)
    assert (r["total_tokens"], r["rerank_fallback"], r["error_type"], r["estimated_cost_usd"]) == (3, False, "E", 0.001)
    r = got["q2"]
    assert (r["status"], r["recall_at_10"], r["mrr"], r["ndcg_at_5"], r["total_latency_ms"], r["escalated"], r["retrieved_chunk_ids"], r["stage_latencies_ms"]) == ("retrieval_failed", 0.0, 0.0, 0.0, None, None, [], [])
    assert got["q3"]["precision_at_5"] == got["q3"]["recall_at_5"] == 0.0


def test_losses_and_signals(given):
    text, examples = given
    assert traces.unmatched(text, examples).first().asDict() == {"traces": 7, "unreadable": 2, "nameless": 1, "unknown": 1}
    got = {r["query_id"]: r for r in traces.signals(text).collect()}
    assert (got["q1"]["passed_signals"], got["q1"]["question_type"], got["q1"]["coverage"], got["q1"]["sufficient"], got["q2"]["passed_signals"]) == (["n"], "why", 1.0, False, [])
    scores = {r["query_id"]: (r["scores"], r["ids"]) for r in traces.result_scores(text).collect()}
    assert scores["q1"] == ([1.0, 0.5, pytest.approx(1 / 3), 0.25], ["a", "b", "c", "e"]) and scores["q2"] == ([], [])

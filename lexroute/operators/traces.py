"""Evaluation rows from stored traces: one JSON text for each query, read as a variant and shredded along declared paths.

A field that a trace hasn't got, or has as another type, is null. A text that is no JSON, or a trace of an unknown example, gives no row and is
counted by `unmatched`. A trace without a retrieval has measured failure: its quality is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of a row -> where a trace has it, and its type.
PATHS: dict[str, tuple[str, str]] = {
    "status": ("$.status", "string"),
    "retrieval_latency_ms": ("$.retrieval_latency_ms", "double"), "reranking_latency_ms": ("$.rerank_latency_ms", "double"), "routing_latency_ms": ("$.routing.routing_latency_ms", "double"),
    "total_latency_ms": ("$.total_latency_ms", "double"), "generation_latency_ms": ("$.generation_latency_ms", "double"),
    "query_embedding_latency_ms": ("$.retrieval.retrieval_metadata.query_embedding_latency_ms", "double"), "search_latency_ms": ("$.retrieval.retrieval_metadata.search_latency_ms", "double"),
    "candidate_generation_latency_ms": ("$.candidate_generation_latency_ms", "double"), "stage_latencies_ms": ("$.routing.stage_latencies_ms", "array<double>"),
    "initial_strategy": ("$.routing.initial_strategy", "string"), "final_strategy": ("$.routing.final_strategy", "string"), "escalated": ("$.routing.escalation.escalated", "boolean"),
    "escalation_target": ("$.routing.escalation.to_strategy", "string"), "sufficiency_score": ("$.routing.sufficiency.score", "double"), "sufficiency_threshold": ("$.routing.sufficiency.threshold", "double"),
    "sufficient": ("$.routing.sufficiency.sufficient", "boolean"), "routing_confidence": ("$.routing.decision.confidence", "double"), "stage_count": ("$.routing.stage_count", "int"),
    "pre_escalation_chunk_ids": ("$.routing.initial_chunk_ids", "array<string>"), "pre_escalation_document_ids": ("$.routing.initial_document_ids", "array<string>"),
    "context_tokens": ("$.context_tokens", "int"), "estimated_cost_usd": ("$.estimated_cost_usd", "double"),
    "input_tokens": ("$.usage.input_tokens", "int"), "output_tokens": ("$.usage.output_tokens", "int"), "total_tokens": ("$.usage.total_tokens", "int"),
    "rerank_candidate_count": ("$.rerank_candidate_count", "int"), "rerank_result_count": ("$.rerank_result_count", "int"), "rerank_fallback": ("$.rerank_fallback", "boolean"),
    "error_stage": ("$.error.stage", "string"), "error_type": ("$.error.error_type", "string"), "error_message": ("$.error.message", "string"),
}
#: What routing evidence is read for studies of signals.
SIGNALS: dict[str, tuple[str, str]] = {
    "sufficiency_score": ("$.routing.sufficiency.score", "double"), "coverage": ("$.routing.sufficiency.coverage", "double"), "top1_coverage": ("$.routing.sufficiency.top1_coverage", "double"),
    "sufficient": ("$.routing.sufficiency.sufficient", "boolean"), "initial_strategy": ("$.routing.initial_strategy", "string"), "final_strategy": ("$.routing.final_strategy", "string"),
    "question_type": ("$.routing.features.question_type", "string"), "category": ("$.category", "string"),
}
RESULTS = "array<struct<chunk_id:string,rank:int,score:double,metadata:struct<document_id:string,section_path:array<string>>>>"
DEPTHS = (1, 5, 10)


def shredded(traces: DataFrame, paths: dict[str, tuple[str, str]], text: str = "trace") -> DataFrame:
    """(query_id, the columns of paths, _v) of every text that is JSON and names its example, or else itself."""
    v = traces.select(F.try_parse_json(text).alias("_v")).filter("_v is not null")
    at = lambda path, kind: F.try_variant_get("_v", path, kind)
    out = v.select(F.coalesce(at("$.example_id", "string"), at("$.trace_id", "string")).alias("query_id"), *(at(*p).alias(c) for c, p in paths.items()), "_v")
    return out.filter("query_id is not null")


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits, of), F.lit(0.0))


def quality(results: Column, documents: Column, prefixes: Column) -> dict[str, Column]:
    """The eleven measures of ranked results (see RESULTS) against relevant documents and the section prefixes of a query's labels (none: whole documents).

    Recall, hit and reciprocal rank go by documents; precision and nDCG by chunks, the ideal of which are the relevant chunks that were retrieved.
    """
    held = lambda r: F.array_contains(documents, r["metadata"]["document_id"])
    under = lambda r: (F.size(prefixes) == 0) | F.exists(prefixes, lambda p: F.slice(r["metadata"]["section_path"], 1, F.size(p)) == p)
    flags = F.transform(results, lambda r: F.coalesce(held(r) & under(r), F.lit(False)))
    count = lambda xs: F.size(F.filter(xs, lambda x: x))
    out: dict[str, Column] = {}
    for k in DEPTHS:
        seen = F.array_distinct(F.transform(F.slice(results, 1, k), lambda r: r["metadata"]["document_id"]))
        out[f"recall_at_{k}"] = _share(F.size(F.array_intersect(seen, documents)), F.size(F.array_distinct(documents)))
        out[f"precision_at_{k}"] = _share(count(F.slice(flags, 1, k)), F.size(F.slice(results, 1, k)))
        out[f"hit_at_{k}"] = F.when(out[f"recall_at_{k}"] > 0, 1.0).otherwise(0.0)
    first = F.get(F.filter(results, held), F.lit(0))
    out["mrr"] = F.coalesce(F.try_divide(F.lit(1.0), first["rank"]), F.lit(0.0))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dcg = add(F.transform(F.slice(flags, 1, 5), lambda f, i: F.when(f, 1 / F.log2(i + 2)).otherwise(0.0)))
    ideal = add(F.transform(F.slice(F.filter(flags, lambda f: f), 1, 5), lambda f, i: 1 / F.log2(i + 2)))
    out["ndcg_at_5"] = _share(dcg, ideal)
    return out


def rows(traces: DataFrame, examples: DataFrame, system: str, experiment: str, text: str = "trace") -> DataFrame:
    """One evaluation row for each trace whose example is known.

    examples: (query_id string, category, split, relevant_documents array<string>, section_prefixes array<array<string>>), one row an id.
    """
    x = shredded(traces, PATHS, text).withColumn("_r", F.coalesce(F.try_variant_get("_v", "$.retrieval.results", RESULTS), F.array().cast(RESULTS)))
    x = x.join(examples.select("query_id", "category", "split", "relevant_documents", "section_prefixes"), "query_id")
    scores = quality(F.col("_r"), F.coalesce("relevant_documents", F.array().cast("array<string>")), F.coalesce("section_prefixes", F.array().cast("array<array<string>>")))
    ids = [F.transform("_r", lambda r: r["metadata"]["document_id"]).alias("retrieved_document_ids"), F.transform("_r", lambda r: r["chunk_id"]).alias("retrieved_chunk_ids")]
    fields = [F.coalesce(c, F.array().cast("array<double>")).alias(c) if c == "stage_latencies_ms" else F.col(c) for c in PATHS if c != "status"]
    return x.select("query_id", F.lit(system).alias("system"), F.lit(experiment).alias("experiment_id"), "category", "split", "status", *ids, *(c.alias(n) for n, c in scores.items()), *fields)


def unmatched(traces: DataFrame, examples: DataFrame, text: str = "trace") -> DataFrame:
    """One row: traces, those that are no JSON, those that name no example, those of an unknown one."""
    v = traces.select(F.try_parse_json(text).alias("v"))
    v = v.select(F.col("v").isNull().alias("broken"), F.coalesce(F.try_variant_get("v", "$.example_id", "string"), F.try_variant_get("v", "$.trace_id", "string")).alias("query_id"))
    x = v.join(examples.select("query_id", F.lit(True).alias("known")), "query_id", "left")
    return x.agg(F.count("*").alias("traces"), F.count_if("broken").alias("unreadable"), F.count_if(~F.col("broken") & F.col("query_id").isNull()).alias("nameless"), F.count_if(F.col("query_id").isNotNull() & F.col("known").isNull()).alias("unknown"))


def signals(traces: DataFrame, text: str = "trace") -> DataFrame:
    """(query_id, SIGNALS, passed_signals): the evidence that the router recorded, and the names of the signals that passed."""
    x = shredded(traces, SIGNALS, text)
    told = F.coalesce(F.try_variant_get("_v", "$.routing.sufficiency.signals", "array<struct<name:string,passed:boolean>>"), F.array().cast("array<struct<name:string,passed:boolean>>"))
    passed = F.transform(F.filter(told, lambda s: F.coalesce(s["passed"], F.lit(False))), lambda s: s["name"])
    return x.select("query_id", *SIGNALS, passed.alias("passed_signals"))


def result_scores(traces: DataFrame, text: str = "trace") -> DataFrame:
    """(query_id, scores, ids): of the ranked results, in their order."""
    x = shredded(traces, {"r": ("$.retrieval.results", RESULTS)}, text)
    return x.select("query_id", F.coalesce(F.transform("r", lambda v: v["score"]), F.array().cast("array<double>")).alias("scores"), F.coalesce(F.transform("r", lambda v: v["chunk_id"]), F.array().cast("array<string>")).alias("ids"))

"""Queries on stored runs: evaluation rows and signals out of trace texts, report tables over evaluation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexroute.operators import lexical_index, reports, retrieval, traces


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _searches(spark, sf_dir):
    """The lexical results of each benchmark query, as the text of a trace; and the queries with the documents that hold their passage."""
    docs, bench = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    top = retrieval.bm25(lexical_index.kept(docs), bench)
    place = F.struct(F.col("doc_id").cast("string").alias("document_id"), F.array().cast("array<string>").alias("section_path"))
    results = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "doc_id", place.alias("metadata")))), lambda r: F.struct(F.concat(r["doc_id"].cast("string"), F.lit("::0")).alias("chunk_id"), r["rank"].alias("rank"), r["score"].alias("score"), r["metadata"].alias("metadata")))
    runs = top.groupBy("query_id").agg(results.alias("results"))
    text = F.to_json(F.struct(F.col("query_id").cast("string").alias("example_id"), F.lit("ok").alias("status"), F.struct("results").alias("retrieval"), (F.size("results") * 1.5).alias("total_latency_ms")))
    held = retrieval.holding(docs, bench).groupBy("query_id").agg(F.collect_list(F.col("doc_id").cast("string")).alias("relevant_documents"))
    examples = bench.join(held, "query_id", "left").select(F.col("query_id").cast("string").alias("query_id"), F.concat(F.lit("kind "), F.col("query_id") % 3).alias("category"), F.when(F.col("query_id") % 2 == 1, "test").otherwise("calibration").alias("split"), "relevant_documents", F.array().cast("array<array<string>>").alias("section_prefixes"))
    return runs.select(text.alias("trace")), examples


def trace_rows(spark, sf_dir):
    """Evaluation rows of the lexical runs, out of their trace texts."""
    text, examples = _searches(spark, sf_dir)
    out = traces.rows(text, examples, "bm25", "lexical")
    measures = [f"{m}_at_{k}" for k in traces.DEPTHS for m in ("recall", "precision", "hit")] + ["mrr", "ndcg_at_5"]
    return out.select("query_id", "system", "category", "split", "status", F.size("retrieved_document_ids").alias("n_results"), F.array_join("retrieved_chunk_ids", " ").alias("chunks"), *(F.round(m, 6).alias(m) for m in measures), "total_latency_ms", "escalated")


def _event_traces(spark, sf_dir):
    """Each event as a trace: its JSON properties give the evidence of sufficiency."""
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    signal = lambda name, passed: F.struct(F.lit(name).alias("name"), passed.alias("passed"), k.alias("value"))
    told = F.struct((k / 100.0).alias("score"), (k >= 50).alias("sufficient"), F.array(signal("many", k > 30), signal("even", k % 2 == 0)).alias("signals"))
    routing = F.struct(F.col("event_type").alias("initial_strategy"), told.alias("sufficiency"))
    return e.select(F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("{broken "), "props")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("example_id"), routing.alias("routing")))).alias("trace"))


def trace_signals(spark, sf_dir):
    """Evidence of sufficiency out of trace texts; what is no JSON gives no row."""
    out = traces.signals(_event_traces(spark, sf_dir))
    return out.select("query_id", F.round("sufficiency_score", 6).alias("sufficiency_score"), "sufficient", "initial_strategy", "final_strategy", F.array_join("passed_signals", ",").alias("passed"))


def trace_losses(spark, sf_dir):
    """Events as traces against users as examples: texts read, broken, nameless and of unknown examples."""
    known = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id")).distinct()
    return traces.unmatched(_event_traces(spark, sf_dir), known)


def _rows(spark, sf_dir):
    """Events as evaluation rows: types as systems, users modulo 4 as categories; clocks by odd factors, so that no cell lies on a tie of its decimals."""
    e, v = _t(spark, sf_dir, "events"), F.col("value")
    nothing = F.lit(None).cast("double")
    routed = F.col("event_type").isin("click", "purchase")
    return e.select(
        F.col("event_type").alias("system"), F.concat(F.lit("kind "), F.col("user_id") % 4).alias("category"), F.when(v > 50, 1.0).otherwise(0.0).alias("recall_at_5"), (1 / (1 + F.col("user_id") % 5)).alias("mrr"), F.when(v > 20, 0.5).otherwise(0.25).alias("ndcg_at_5"),
        (v * 1.01371).alias("total_latency_ms"), F.when(routed, v * 0.13137).alias("routing_latency_ms"), (v * 0.51731).alias("retrieval_latency_ms"), nothing.alias("reranking_latency_ms"), F.when(routed, v > 60).alias("escalated"), F.when(routed, F.when(v > 60, 2).otherwise(1)).alias("stage_count"),
        F.when(routed, 0.75).alias("routing_confidence"), F.when(routed, F.when(F.col("user_id") % 3 == 0, "dense").otherwise("bm25")).alias("initial_strategy"), F.when(routed, "hybrid").alias("final_strategy"),
        (F.col("event_id") % 1000).alias("context_tokens"), nothing.alias("total_tokens"), nothing.alias("estimated_cost_usd"), F.when(v > 40, 0.5).otherwise(0.25).alias("sufficiency_threshold"),
    )


def report_systems(spark, sf_dir):
    return reports.report(_rows(spark, sf_dir), "systems")


def report_features(spark, sf_dir):
    return reports.report(_rows(spark, sf_dir), "features")


def report_text(spark, sf_dir):
    """The table of question kinds as one text."""
    return reports.markdown(reports.report(_rows(spark, sf_dir), "categories").select("Category", "Recall at 5", "Median ms", "First choice", "n"), "Kinds of questions", ["Category"])


QUERIES = (trace_rows, trace_signals, trace_losses, report_systems, report_features, report_text)

_EVENT_ROWS = """e as (select event_type, 'kind ' || (user_id % 4) as category, user_id, event_id, value as v, event_type in ('click', 'purchase') as routed, case when user_id % 3 = 0 then 'dense' else 'bm25' end as first from events)"""


def _cell(x: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', round_even({x}, {digits})), '')"


def _p95(x: str) -> str:
    """Nearest rank of a sorted list, halves to even."""
    s = f"list_sort(list({x}) filter ({x} is not null))"
    n = f"count({x})"
    return f"({s})[greatest(1, least({n}, round_even(0.95::double * {n}, 0)::bigint))]"


def _top(x: str, where: str = "routed") -> str:
    return f"(select v || ' (' || printf('%.0f', round_even(100 * k / sum_k, 0)) || '%)' from (select v, k, sum(k) over () as sum_k from (select {x} as v, count(*) as k from e t where {where} and t.{{by}} = e.{{by}} group by 1)) order by k desc, v desc limit 1)"


def sql(bm0: str, b10: str, qrel: str) -> dict[str, str]:
    depths = ", ".join(
        f"""round(coalesce(count(*) filter (hit and rank <= {k}) / nullif(any_value(n_rel), 0)::double, 0), 6) as recall_at_{k}, round(count(*) filter (hit and rank <= {k}) / count(*) filter (rank <= {k})::double, 6) as precision_at_{k},
(count(*) filter (hit and rank <= {k}) > 0)::int::double as hit_at_{k}""" for k in (1, 5, 10)
    )
    return {
        "trace_rows": f"""{bm0}, {b10}, {qrel}, tot as (select query_id, count(*) as n_rel from rel group by query_id),
j as (select b.query_id as q, b.doc_id, b.rank, r.doc_id is not null as hit, coalesce(n_rel, 0) as n_rel from b10 b left join rel r on r.query_id = b.query_id and r.doc_id = b.doc_id left join tot on tot.query_id = b.query_id)
select q::varchar as query_id, 'bm25' as system, 'kind ' || (q % 3) as category, case when q % 2 = 1 then 'test' else 'calibration' end as split, 'ok' as status, count(*)::int as n_results, string_agg(doc_id || '::0', ' ' order by rank) as chunks, {depths},
round(coalesce(1 / min(rank) filter (hit)::double, 0), 6) as mrr, round(coalesce(sum(1 / log2(rank + 1)) filter (hit and rank <= 5) / list_sum(list_transform(range(1, least(count(*) filter (hit), 5) + 1), lambda i: 1 / log2(i + 1))), 0), 6) as ndcg_at_5,
count(*) * 1.5::double as total_latency_ms, null::boolean as escalated from j group by q""",
        "trace_signals": """with e as (select event_id, event_type, (props ->> '$.k')::int as k from events where event_id % 10 <> 9)
select event_id::varchar as query_id, round(k / 100::double, 6) as sufficiency_score, k >= 50 as sufficient, event_type as initial_strategy, null::varchar as final_strategy,
array_to_string(list_filter([case when k > 30 then 'many' end, case when k % 2 = 0 then 'even' end], lambda x: x is not null), ',') as passed from e""",
        "trace_losses": """select count(*) as traces, count(*) filter (event_id % 10 = 9) as unreadable, 0::bigint as nameless, count(*) filter (event_id % 10 <> 9 and event_id not in (select user_id from events)) as unknown from events""",
        "report_systems": f"""with {_EVENT_ROWS} select event_type as "System", {_cell('avg((v > 50)::int)', 4)} as "Recall at 5", {_cell('avg(1 / (1 + user_id % 5)::double)', 4)} as "Reciprocal rank", {_cell('median(v * 1.01371::double)', 2)} as "Median ms", {_cell(_p95('(v * 1.01371::double)'), 2)} as "95 % ms", {_cell('avg(v * 1.01371::double)', 2)} as "Mean ms",
{_cell('median(v * 0.13137::double) filter (routed)', 2)} as "Median routing ms", {_cell('median(v * 0.51731::double)', 2)} as "Median retrieval ms", '' as "Median reranking ms", 'ctx=' || {_cell('avg(event_id % 1000)', 0)} as "Resources", count(*)::varchar as n, case when count(*) < 5 then 'yes' else 'no' end as "Few rows" from e group by event_type""",
        "report_features": f"""with {_EVENT_ROWS} select event_type as "System", {_cell('avg((v > 50)::int)', 4)} as "Recall at 5", {_cell('avg(1 / (1 + user_id % 5)::double)', 4)} as "Reciprocal rank", {_cell('median(v * 1.01371::double)', 2)} as "Median ms", {_cell(_p95('(v * 1.01371::double)'), 2)} as "95 % ms",
case when any_value(routed) then '0.7500' else '' end as "Confidence", coalesce({_top('first').replace('{by}', 'event_type')}, '') as "First choice", case when any_value(routed) then 'hybrid (100%)' else '' end as "Last choice",
case when any_value(routed) then {_cell('100 * avg((v > 60)::int)', 1)} || '%' else '' end as "Escalated", case when any_value(routed) then {_cell('avg(1 + (v > 60)::int)', 2)} else '' end as "Mean stages",
'ctx=' || {_cell('avg(event_id % 1000)', 0)} as "Resources", count(*)::varchar as n, case when count(*) < 5 then 'yes' else 'no' end as "Few rows" from e group by event_type""",
        "report_text": f"""with {_EVENT_ROWS}, c as (select category, {_cell('avg((v > 50)::int)', 4)} as a, {_cell('median(v * 1.01371::double)', 2)} as b, coalesce({_top('first').replace('{by}', 'category')}, '') as f, count(*)::varchar as n from e group by category)
select 'Kinds of questions' as title, '### Kinds of questions' || chr(10) || chr(10) || '| Category | Recall at 5 | Median ms | First choice | n |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| ' || category || ' | ' || a || ' | ' || b || ' | ' || f || ' | ' || n || ' |', chr(10) order by category) || chr(10) as body from c""",
    }

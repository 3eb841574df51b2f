"""The registered queries of the retrieval engine and the SQL each is compared with."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.functions import text as T
from lexroute.operators import chunking, gates, inference, lexical_index, metrics, retrieval, routing, signals, studies
from lexroute.operators.text_scores import rouge_l
from lexroute.plans import analytics, experiments, oracles, ordered, runs, statistics, structure


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bench(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _dense_queries(spark, sf_dir):
    """Queries are the vectors whose id is divisible by 50, against all."""
    return _t(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _index(spark, sf_dir):
    """The index of all documents: made at first use, then read."""
    return lexical_index.kept(_t(spark, sf_dir, "documents"))


def lexical_index_build(spark, sf_dir):
    """The postings of all documents, computed anew."""
    return lexical_index.of(_t(spark, sf_dir, "documents")).postings


def term_stats(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.terms.join(F.broadcast(index.stats)).select("term", "df", "cf", F.round(lexical_index.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))  # stats: one row


def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n_docs", "n_tokens", F.round("avgdl", 6).alias("avgdl"))


def bm25_top10(spark, sf_dir):
    return retrieval.bm25(_index(spark, sf_dir), _bench(spark, sf_dir))


def bm25_filtered(spark, sf_dir):
    return retrieval.bm25(_index(spark, sf_dir), _bench(spark, sf_dir), among=_t(spark, sf_dir, "documents").filter("lang = 'en'"))


def bm25_threshold(spark, sf_dir):
    return retrieval.bm25(_index(spark, sf_dir), _bench(spark, sf_dir), threshold=50.0)


def dense_top10(spark, sf_dir):
    return retrieval.dense(_t(spark, sf_dir, "embeddings"), _dense_queries(spark, sf_dir))


def dense_filter_in(spark, sf_dir):
    return retrieval.dense(_t(spark, sf_dir, "embeddings"), _dense_queries(spark, sf_dir), where=F.col("label").isin(1, 2, 3))


def hybrid_rrf_top10(spark, sf_dir):
    """A dense and a lexical ranking of the texts, fused by ranks."""
    return retrieval.hybrid(_t(spark, sf_dir, "documents"), _index(spark, sf_dir), _bench(spark, sf_dir))


def rerank_top10(spark, sf_dir):
    docs, bench = _t(spark, sf_dir, "documents"), _bench(spark, sf_dir)
    return retrieval.rerank(retrieval.bm25(_index(spark, sf_dir), bench, retrieval.DEPTH), docs, bench)


def qrels(spark, sf_dir):
    """Documents that hold a benchmark passage verbatim."""
    return retrieval.holding(_t(spark, sf_dir, "documents"), _bench(spark, sf_dir))


def eval_rows(spark, sf_dir):
    return metrics.per_query(bm25_top10(spark, sf_dir), sessions.cut(qrels(spark, sf_dir)))  # read twice


def metric_means(spark, sf_dir):
    return eval_rows(spark, sf_dir).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 4).alias(c) for c in ("recall", "precision", "hit", "mrr", "ndcg")))


def _turns(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


def query_features(spark, sf_dir):
    return routing.features(_turns(spark, sf_dir)).drop("query")


def route_decisions(spark, sf_dir):
    return routing.route(routing.features(_turns(spark, sf_dir))).select("conv_id", "turn", "strategy", "score", "confidence")


def rejected_queries(spark, sf_dir):
    return routing.rejected(_turns(spark, sf_dir)).select("conv_id", "turn", "reason")


def sufficiency(spark, sf_dir):
    """Of the lexical results of each benchmark query."""
    return routing.sufficient(routing.features(_bench(spark, sf_dir)), bm25_top10(spark, sf_dir), _t(spark, sf_dir, "documents"))


def adaptive_results(spark, sf_dir):
    """Each query runs on the strategy it is routed to; one whose evidence is insufficient runs once more, on the next rung, and that replaces the first."""
    docs, bench = _t(spark, sf_dir, "documents"), _bench(spark, sf_dir)
    index, routed = _index(spark, sf_dir), routing.route(routing.features(bench))

    def run(strategy, queries):
        if strategy == "bm25":
            return retrieval.bm25(index, queries)
        if strategy == "dense":
            return retrieval.dense_texts(docs, queries)
        return retrieval.hybrid(docs, index, queries) if strategy == "hybrid" else retrieval.rerank(retrieval.hybrid(docs, index, queries, retrieval.DEPTH), docs, queries)

    def results(asked, column):
        used = [r[0] for r in asked.select(column).distinct().collect()]  # at most four
        parts = [run(s, asked.filter(F.col(column) == s)).select("query_id", "doc_id", "rank", F.lit(s).alias("strategy")) for s in sorted(used)]
        out = spark.createDataFrame([], "query_id long, doc_id long, rank int, strategy string") if not parts else parts[0]
        for x in parts[1:]:
            out = out.union(x)
        return out

    routed = sessions.cut(routed)
    first = sessions.cut(results(routed, "strategy"))
    judged = routed.join(routing.sufficient(routed, first, docs).select("query_id", "sufficient"), "query_id")
    after = sessions.cut(routing.escalation(judged).select("query_id", "query", "escalated", "to_strategy", "reason"))
    again = results(after.filter("escalated"), "to_strategy")
    return first.join(after.filter("not escalated").select("query_id"), "query_id").union(again).join(after.select("query_id", "escalated", "reason"), "query_id")


def pair_signals(spark, sf_dir):
    """All signals between the lexical and the dense ranking of a query."""
    docs, bench = _t(spark, sf_dir, "documents"), _bench(spark, sf_dir)
    return signals.pair_signals(retrieval.bm25(_index(spark, sf_dir), bench), retrieval.dense_texts(docs, bench))


def hybrid_change(spark, sf_dir):
    """What fusion brings into the dense top five, and where it comes from."""
    docs, bench, index = _t(spark, sf_dir, "documents"), _bench(spark, sf_dir), _index(spark, sf_dir)
    lists = [signals.ranked_lists(x, n) for x, n in ((retrieval.dense_texts(docs, bench), "d"), (retrieval.hybrid(docs, index, bench), "h"), (retrieval.bm25(index, bench), "b"))]
    rel = qrels(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("rel"))
    x = lists[0].join(lists[1], "query_id").join(lists[2], "query_id").join(rel, "query_id", "left").withColumn("rel", F.coalesce("rel", F.array().cast("array<bigint>")))
    return x.select("query_id", *(c.alias(n) for n, c in signals.change(F.col("d_ids"), F.col("h_ids"), F.col("b_ids"), F.col("rel")).items()))


def decile_cuts(spark, sf_dir):
    return signals.decile_cuts(ordered.records(spark, sf_dir), "signal").select(F.round("cut", 6).alias("cut"))


def _swept(spark, sf_dir):
    records = ordered.records(spark, sf_dir)
    cuts = signals.decile_cuts(records, "signal")
    return signals.sweep(records, "signal", cuts, "high").union(signals.sweep(records, "signal", cuts, "low"))


def rule_sweep(spark, sf_dir):
    return _swept(spark, sf_dir).select("signal", "direction", "n", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("cut", "rate", "quality", "error", "clock", "agreement")))


def selected_rule(spark, sf_dir):
    return signals.select_rule(_swept(spark, sf_dir))


def separation_check(spark, sf_dir):
    d = F.col("dear") - F.col("cheap")
    grouped = ordered.records(spark, sf_dir).withColumn("grp", F.when(d >= 0.01, "helps").when(d <= -0.01, "harms").otherwise("ties"))
    return signals.separation(grouped, ["signal", "cheap", "dear"])


def paired_tests(spark, sf_dir):
    """Signed-rank and sign tests of event types against each other, with seeded intervals and step-down adjustment."""
    x = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    pairs = x.alias("a").join(x.alias("b"), "user_id").filter("a.event_type < b.event_type").select(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b"), F.round(F.col("a.v") - F.col("b.v"), 9).alias("d"))
    return inference.holm(inference.compare(pairs, ["a", "b"]).withColumn("family", F.lit("value")), "p", ["family"])


def metric_grid(spark, sf_dir):
    """Means at each depth of the lexical results."""
    return studies.depth_grid(sessions.cut(bm25_top10(spark, sf_dir)), sessions.cut(qrels(spark, sf_dir)))


def transition_quality(spark, sf_dir):
    """From what a user did least to what the user did most: mean value and number of events before and after."""
    x = _t(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("strategy")).agg(F.avg("value").alias("quality"), F.count("*").alias("cost"))
    pick = lambda order: x.groupBy("user_id").agg(F.min(F.struct(order.alias("o"), "strategy", "quality", "cost")).alias("s")).select("user_id", "s.strategy", "s.quality", "s.cost")
    return studies.transition_quality(pick(F.col("cost")).filter("cost < 5"), pick(-F.col("cost")), "user_id", "strategy", ["quality", "cost"])


def stage_medians(spark, sf_dir):
    """Tax, discount and quantity of lines as three stages of a sample."""
    x = _t(spark, sf_dir, "lineitem").select("l_returnflag", F.create_map(F.lit("tax"), F.col("l_tax").cast("double"), F.lit("discount"), F.col("l_discount").cast("double"), F.lit("quantity"), F.col("l_quantity").cast("double")).alias("stages"))
    return studies.stage_medians(x, "l_returnflag", "stages")


def tie_artefacts(spark, sf_dir):
    return studies.tie_artefact(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_tax")


def corpus_diff(spark, sf_dir):
    """All documents against a later version of them: German ones have new ids, those of long texts are in lower case."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    later = docs.select(F.when(F.col("lang") == "de", F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.length("text") > 1000, F.lower("text")).otherwise(F.col("text")).alias("text"))
    return studies.changes(docs, later, "doc_id", "text")


def dup_pairs(spark, sf_dir):
    return gates.duplicate_pairs(_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "query"))


def dup_screen(spark, sf_dir):
    q = _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "query")
    return gates.accepted(sessions.cut(gates.duplicate_pairs(q)), q)


def dq_structure(spark, sf_dir):
    return gates.structure(_t(spark, sf_dir, "documents"), "doc_id", "text", categories=("lang", ["en", "de"]))


def dq_grounding(spark, sf_dir):
    """Whether the documents said to hold a passage do: each document against the passage of its number modulo that of passages."""
    docs, bench = _t(spark, sf_dir, "documents"), _bench(spark, sf_dir)
    quotes = docs.select("doc_id", (F.col("doc_id") % 40).alias("query_id")).join(bench, "query_id").select(F.col("doc_id").alias("example_id"), (F.col("doc_id") + 1).alias("doc_id"), F.col("query").alias("quote"))
    return gates.grounding(quotes, docs)


def dq_same_ids(spark, sf_dir):
    return gates.same_ids(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id")


def dq_quotas(spark, sf_dir):
    wanted = spark.createDataFrame([("en", 100), ("de", 100), ("xx", 1)], "lang string, expected long")
    return gates.quotas(_t(spark, sf_dir, "documents"), "lang", wanted)


def section_chunks(spark, sf_dir):
    """Chunks of raw pages by their headings, as digests."""
    x = html_elements(spark, sf_dir)
    kind = F.when(F.col("kind").like("h%"), "heading").otherwise("paragraph")
    level = F.when(F.col("kind").like("h%"), F.substring("kind", 2, 1).cast("int"))
    out = chunking.chunk(x.select("page_id", "position", kind.alias("kind"), level.alias("level"), "text"))
    return out.select("page_id", "ordinal", "section", "n_tokens", "oversized", F.md5("text").alias("digest"))


def generation_metrics(spark, sf_dir):
    """Assistant turns as answers, the turn before as reference: rates and means, each over its own rows."""
    c = _t(spark, sf_dir, "conversations").filter("role = 'assistant'")
    empty, cited = F.coalesce(F.trim("text"), F.lit("")) == "", F.size(T.citations(F.col("text"))) > 0
    one = c.agg(F.count("*").alias("answer_count"), F.round(F.avg(empty.cast("double")), 6).alias("empty_rate"), F.round(F.avg(F.when(~empty, cited.cast("double"))), 6).alias("citation_coverage"))
    f1 = token_f1(spark, sf_dir).join(c.select("conv_id", "turn"), ["conv_id", "turn"]).agg(F.round(F.avg("f1"), 5).alias("token_f1"))
    return one.join(F.broadcast(f1))  # one row each


def pair_agreement(spark, sf_dir):
    """Jaccard and overlap of the top ten of two systems, and whether their first agrees."""
    lists = lambda df, n: df.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(n))
    both = lists(bm25_top10(spark, sf_dir), "a").join(lists(rerank_top10(spark, sf_dir), "b"), "query_id")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("query_id", F.round(common / F.size(F.array_union("a", "b")), 6).alias("jaccard"), F.round(common / F.size("a"), 6).alias("overlap"), (F.get("a", F.lit(0)) == F.get("b", F.lit(0))).alias("top1"), F.size(F.array_except("b", "a")).alias("entered"))


def score_geometry(spark, sf_dir):
    """Gap of the two best scores and least-squares slope of score on rank."""
    return bm25_top10(spark, sf_dir).groupBy("query_id").agg(
        F.round(F.try_divide(F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 2, F.col("score"))), F.abs(F.max(F.when(F.col("rank") == 1, F.col("score"))))), 6).alias("gap"),
        F.round(F.regr_slope("score", "rank"), 5).alias("slope"))


def chunks_window(spark, sf_dir):
    """Chunks of 200 words with ordinal and token estimate."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    d = _t(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    d = d.select("doc_id", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 200).cast("int")))).alias("ordinal"))
    piece = F.slice("w", F.col("ordinal") * 200 + 1, 200)
    return d.select("doc_id", "ordinal", F.size(piece).alias("n_words"), F.md5(F.array_join(piece, " ")).alias("digest"))


def token_f1(spark, sf_dir):
    """Multiset token F1 of each assistant turn against the user turn before it."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    tok = c.select("conv_id", "turn", F.explode(T.metric_tokens(F.col("text"))).alias("t")).groupBy("conv_id", "turn", "t").agg(F.count("*").alias("n"))
    size = c.select("conv_id", "turn", F.size(T.metric_tokens(F.col("text"))).alias("k"))
    prev = tok.select("conv_id", (F.col("turn") + 1).alias("turn"), "t", F.col("n").alias("m"))
    common = tok.join(prev, ["conv_id", "turn", "t"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("c"))
    both = size.join(size.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("k").alias("j")), ["conv_id", "turn"]).join(common, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(2.0 * F.coalesce("c", F.lit(0)), (F.col("k") + F.col("j")).cast("double")), F.lit(0.0)), 6).alias("f1"))


def citations(spark, sf_dir):
    """Source markers parsed from a rendered context of each benchmark item."""
    made = F.concat(F.lit("[Source "), F.col("item_id") % 3, F.lit("] and [Source "), F.col("item_id") % 5, F.lit("]"))
    return _t(spark, sf_dir, "benchmark").select("item_id", T.citations(made).alias("cited"))


def context_pack(spark, sf_dir):
    """Rendered passages by rank under a token budget; the first is always kept, oversize ones are skipped, five at most."""
    found = sessions.cut(bm25_top10(spark, sf_dir))
    docs = retrieval.texts_of(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), found)
    top = found.join(docs.select("doc_id", F.coalesce("source", F.lit("N/A")).alias("title"), F.trim("text").alias("text")), "doc_id")
    # the number of a source in its block has one digit, whichever it will be
    block = F.concat(F.lit("[Source 1]\nTitle: "), "title", F.lit("\nSection: General\nPages: N/A\nScore: "), F.format_string("%.3f", "score"), F.lit("\n"), "text")
    runs = top.withColumn("k", T.token_estimate(block)).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "k"))).alias("xs"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<bigint>").alias("ids"))
    step = lambda a, x: F.when((F.size(a["ids"]) < 5) & ((F.size(a["ids"]) == 0) | (a["used"] + x["k"] <= 2000)), F.struct((a["used"] + x["k"]).alias("used"), F.concat(a["ids"], F.array(x["doc_id"])).alias("ids"))).otherwise(a)
    return runs.select("query_id", F.aggregate("xs", start, step).alias("p")).select("query_id", "p.used", "p.ids")


def html_elements(spark, sf_dir):
    """Headings, paragraphs and list items of raw pages, in reading order."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"(?is)<(h[1-6]|p|li)\b[^>]*>.*?</\1>"), 0)
    x = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("position", "e"))
    return x.select("page_id", "position", F.lower(F.regexp_extract("e", r"(?i)^<(\w+)", 1)).alias("kind"), F.trim(F.regexp_replace(F.regexp_replace("e", "(?s)<[^>]*>", " "), r"\s+", " ")).alias("text"))


def rouge_l_turns(spark, sf_dir):
    """ROUGE-L of each assistant turn against the turn before it."""
    c = _t(spark, sf_dir, "conversations")
    now = c.filter("role = 'assistant'").select("conv_id", "turn", T.metric_tokens(F.col("text")).alias("a"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), T.metric_tokens(F.col("text")).alias("b"))
    return now.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(rouge_l("a", "b"), 6).alias("rouge_l"))


def section_paths(spark, sf_dir):
    """The path of headings above each heading of a page: a stack from which those of the same or a deeper level leave."""
    h = html_elements(spark, sf_dir).filter("kind like 'h%'").select("page_id", F.struct("position", F.substring("kind", 2, 1).cast("int").alias("level"), F.col("text").alias("title")).alias("h"))
    runs = h.groupBy("page_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    kind = "struct<position:int,level:int,title:string>"
    start = F.array().cast(f"array<array<{kind}>>")
    top = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.array().cast(f"array<{kind}>"))
    step = lambda acc, x: F.concat(acc, F.array(F.concat(F.filter(top(acc), lambda y: y["level"] < x["level"]), F.array(x.cast(kind)))))
    stacks = runs.select("page_id", F.explode(F.aggregate("hs", start, step)).alias("s"))
    return stacks.select("page_id", F.element_at("s", -1)["position"].alias("position"), F.size("s").alias("depth"), F.transform("s", lambda y: y["title"]).alias("path"))


_TOK = "regexp_extract_all(strip_accents(lower(coalesce({0}, ''))), '[a-z0-9]+')"
_POST = f"tok as (select doc_id, unnest({_TOK.format('text')}) as term from documents), post as (select doc_id, term, count(*) as tf from tok group by all)"
_BM = f"""with {_POST}, dl as (select doc_id, len({_TOK.format('text')}) as dl from documents), one as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from post group by term), qt as (select item_id as query_id, unnest({_TOK.format('text')}) as term from benchmark), q as (select query_id, term, count(*) as qtf from qt group by all),
bm as (select q.query_id, p.doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qtf), 6) as score
from q join post p on q.term = p.term join df on df.term = p.term join dl on dl.doc_id = p.doc_id cross join one WHERE_ group by all)"""
_RANK = "(select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from bm HAVING_)"
_RR = f"""b20 as (select * from {_RANK.replace('HAVING_', '')} where rank <= 20),
ov as (select b.query_id, b.doc_id, b.rank as first_rank, round(len(list_intersect(list_distinct({_TOK.format('i.text')}), list_distinct({_TOK.format('d.text')}))) / cast(greatest(len(list_distinct({_TOK.format('i.text')})), 1) as double), 6) as score
from b20 b join documents d on d.doc_id = b.doc_id join benchmark i on i.item_id = b.query_id),
rr as (select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, first_rank, doc_id) as int) as rank, first_rank from ov)"""
_BM0 = _BM.replace("WHERE_", "")
_B10 = f"b10 as (select * from {_RANK.replace('HAVING_', '')} where rank <= 10)"
_QREL = "rel as (select i.item_id as query_id, d.doc_id from benchmark i join documents d on contains(d.text, i.text))"
_EVAL = f"""{_BM0}, {_B10}, {_QREL}, tot as (select query_id, count(*) as n_rel from rel group by query_id),
j as (select b.*, (r.doc_id is not null)::int as rel from b10 b left join rel r on r.query_id = b.query_id and r.doc_id = b.doc_id),
s as (select query_id, sum(rel) filter (rank <= 5) as hits, count(*) filter (rank <= 5) as rows, min(rank) filter (rel = 1) as first, sum(rel / log2(rank + 1)) filter (rank <= 5) as dcg, sum(rel)::int as found from j group by query_id),
e as (select t.query_id, round(coalesce(hits, 0) / cast(n_rel as double), 6) as recall, round(coalesce(hits / cast(nullif(rows, 0) as double), 0), 6) as precision, case when coalesce(hits, 0) > 0 then 1.0::double else 0.0::double end as hit, round(coalesce(1 / cast(first as double), 0), 6) as mrr,
case when coalesce(found, 0) > 0 then round(dcg / list_sum(list_transform(range(1, least(found, 5) + 1), lambda i: 1 / log2(i + 1))), 6) else 0.0 end as ndcg from tot t left join s on s.query_id = t.query_id)"""
_DENSE = "with c as (select q.vec_id as query_id, v.vec_id as doc_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 6) as score from embeddings q cross join embeddings v where q.vec_id % 50 = 0 WHERE_), r as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from c) select * from r where rank <= 10"

_TAGS = "|".join(f"<{t}\\b[^>]*>.*?</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li"))
_HTML = f"""hs as (select page_id, regexp_extract_all(html, '(?is){_TAGS}') as l from pages), hx as (select page_id, unnest(range(len(l)))::int as position, unnest(l) as e from hs),
el as (select page_id, position, lower(regexp_extract(e, '^<(\\w+)', 1)) as kind, trim(regexp_replace(regexp_replace(e, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g')) as text from hx)"""
_LAST = ", ".join(f"last_value(case when level = {k} then position end ignore nulls) over w as a{k}, last_value(case when level = {k} then text end ignore nulls) over w as t{k}" for k in range(1, 7))
_ABOVE = ", ".join(f"case when a{k} is not null and a{k} > greatest(-1, {', '.join(f'coalesce(a{j}, -1)' for j in range(1, k)) or '-1'}) then t{k} end" for k in range(1, 7))
_PACK = f"""{_BM0.replace('with ', 'with recursive ', 1)}, {_B10}, t as (select query_id, rank, doc_id, greatest(1, length('[Source 1]' || chr(10) || 'Title: ' || coalesce(source, 'N/A') || chr(10) || 'Section: General' || chr(10) || 'Pages: N/A' || chr(10) || 'Score: ' || printf('%.3f', score) || chr(10) || trim(text)) // 4) as k
from b10 join documents using (doc_id)),
st as (select query_id, 0 as rank, 0::bigint as used, []::bigint[] as ids from t group by query_id
union all select st.query_id, t.rank, case when len(ids) < 5 and (len(ids) = 0 or used + k <= 2000) then used + k else used end, case when len(ids) < 5 and (len(ids) = 0 or used + k <= 2000) then list_append(ids, doc_id) else ids end
from st join t on t.query_id = st.query_id and t.rank = st.rank + 1)"""

ORACLE = {
    "html_elements": f"with {_HTML} select page_id, position, kind, text from el",
    "section_paths": f"""with {_HTML}, h as (select page_id, position, text, substr(kind, 2, 1)::int as level from el where kind like 'h%'), l as (select page_id, position, {_LAST} from h window w as (partition by page_id order by position rows between unbounded preceding and current row)),
        p as (select page_id, position, list_filter([{_ABOVE}], lambda x: x is not null) as path from l) select page_id, position, len(path)::int as depth, path from p""",
    "context_pack": f"{_PACK} select query_id, arg_max(used, rank)::int as used, arg_max(ids, rank) as ids from st group by query_id",
    "lexical_index_build": f"with {_POST} select doc_id, term, tf, sum(tf) over (partition by doc_id)::bigint as dl from post",
    "term_stats": f"with {_POST}, n as (select count(*) as n from documents) select term, count(*) as df, sum(tf)::bigint as cf, round(ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) as idf from post cross join n group by term",
    "corpus_stats": f"select count(*) as n_docs, sum(len({_TOK.format('text')}))::bigint as n_tokens, round(avg(len({_TOK.format('text')})), 6) as avgdl from documents",
    "bm25_top10": f"{_BM0}, {_B10} select * from b10",
    "bm25_filtered": f"{_BM.replace('WHERE_', 'where p.doc_id in (select doc_id from documents where lang = ' + chr(39) + 'en' + chr(39) + ')')}, {_B10} select * from b10",
    "bm25_threshold": f"{_BM0}, b10 as (select * from {_RANK.replace('HAVING_', 'where score >= 50')} where rank <= 10) select * from b10",
    "dense_top10": _DENSE.replace("WHERE_", ""),
    "dense_filter_in": _DENSE.replace("WHERE_", "and v.label in (1, 2, 3)"),
    "rerank_top10": f"{_BM0}, {_RR} select query_id, doc_id, score, rank, first_rank from rr where rank <= 10",
    "qrels": f"with {_QREL} select * from rel",
    "eval_rows": f"{_EVAL} select * from e",
    "metric_means": f"{_EVAL} select count(*) as n, round(avg(recall), 4) as recall, round(avg(precision), 4) as precision, round(avg(hit), 4) as hit, round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg from e",
    "metric_grid": " union all ".join(f"select * from ({_EVAL.replace('rank <= 5', f'rank <= {k}').replace('least(found, 5)', f'least(found, {k})')} select {k} as k, count(*) as n, round(avg(recall), 4) as recall, round(avg(precision), 4) as precision, round(avg(hit), 4) as hit, round(avg(mrr), 4) as mrr, round(avg(ndcg), 4) as ndcg from e)" for k in (1, 3, 5, 10)),
    "transition_quality": """with x as (select user_id, event_type as s, avg(value) as v, count(*) as c from events group by all),
        lo as (select * from (select *, row_number() over (partition by user_id order by c, s) as r from x) where r = 1 and c < 5), hi as (select * from (select *, row_number() over (partition by user_id order by c desc, s) as r from x) where r = 1)
        select lo.s as from_strategy, hi.s as to_strategy, case when hi.s is null then 'no_after' when lo.s is null then 'no_before' when lo.v is null or hi.v is null then 'no_quality' else 'paired' end as reason, count(*) as n,
        round(avg(lo.v) filter (hi.v is not null), 6) as quality_before, round(avg(hi.v) filter (lo.v is not null), 6) as quality_after, round(avg(hi.v - lo.v), 6) as quality_change,
        round(avg(lo.c) filter (lo.v is not null and hi.v is not null), 6) as cost_before, round(avg(hi.c) filter (lo.v is not null and hi.v is not null), 6) as cost_after, round(avg(hi.c - lo.c) filter (lo.v is not null and hi.v is not null), 6) as cost_change
        from lo full outer join hi on lo.user_id = hi.user_id group by 1, 2, 3""",
    "stage_medians": """with x as (select l_returnflag, 'tax' as stage, l_tax::double as v from lineitem union all select l_returnflag, 'discount', l_discount::double from lineitem union all select l_returnflag, 'quantity', l_quantity::double from lineitem)
        select l_returnflag, stage, count(v) as n, round(median(v), 6) as median_v, round(avg(v), 6) as mean_v, round(stddev_samp(v), 6) as sd_v from x where v is not null group by all""",
    "tie_artefacts": "select l_orderkey, count(l_tax) as n, round(max(l_tax) - min(l_tax), 6) as spread, max(l_tax) - min(l_tax) <= 1e-9 as tied from lineitem group by l_orderkey",
    "corpus_diff": """select doc_id, 'removed' as change from documents where lang = 'de' union all select doc_id + 1000000000, 'added' from documents where lang = 'de'
        union all select doc_id, 'changed' from documents where lang is distinct from 'de' and length(text) > 1000 and lower(text) <> text""",
    "score_geometry": f"{_BM0}, {_B10} select query_id, round((max(score) filter (rank = 1) - max(score) filter (rank = 2)) / nullif(abs(max(score) filter (rank = 1)), 0), 6) as gap, round(regr_slope(score, rank), 5) as slope from b10 group by query_id",
    "pair_agreement": f"{_BM0}, {_B10}, {_RR}, a as (select query_id, list(doc_id order by rank) as a from b10 group by query_id), b as (select query_id, list(doc_id order by rank) as b from rr where rank <= 10 group by query_id) select query_id, round(len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) as double), 6) as jaccard, round(len(list_intersect(a, b)) / cast(len(a) as double), 6) as overlap, a[1] = b[1] as top1, cast(len(b) - len(list_intersect(a, b)) as int) as entered from a join b using (query_id)",
    "chunks_window": r"with w as (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents), c as (select doc_id, w, unnest(range(0, (len(w) + 199) // 200)) as ordinal from w) select doc_id, cast(ordinal as int) as ordinal, cast(len(w[ordinal * 200 + 1 : ordinal * 200 + 200]) as int) as n_words, md5(array_to_string(w[ordinal * 200 + 1 : ordinal * 200 + 200], ' ')) as digest from c",
    "citations": "select item_id, list_sort(list_distinct([cast(item_id % 3 as int), cast(item_id % 5 as int)])) as cited from benchmark",
    "token_f1": "with k as (select conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from conversations), x as (select conv_id, turn, u.t, count(*) as n from (select conv_id, turn, unnest(t) as t from k) u group by all), c as (select a.conv_id, a.turn, sum(least(a.n, b.n)) as c from x a join x b on a.conv_id = b.conv_id and a.turn = b.turn + 1 and a.t = b.t group by all) select a.conv_id, a.turn, round(coalesce(2.0::double * coalesce(c.c, 0) / nullif(len(a.t) + len(b.t), 0), 0), 6) as f1 from k a join k b on a.conv_id = b.conv_id and a.turn = b.turn + 1 left join c on c.conv_id = a.conv_id and c.turn = a.turn",
}

_QUERIES = (metric_grid, transition_quality, stage_medians, tie_artefacts, corpus_diff, rejected_queries, pair_signals, hybrid_change, decile_cuts, rule_sweep, selected_rule, separation_check, paired_tests, dup_pairs, dup_screen, dq_structure, dq_grounding, dq_same_ids, dq_quotas, section_chunks, generation_metrics, hybrid_rrf_top10, rouge_l_turns, section_paths, lexical_index_build, term_stats, corpus_stats, bm25_top10, bm25_filtered, bm25_threshold, dense_top10, dense_filter_in, rerank_top10, qrels, eval_rows, metric_means, query_features, route_decisions, sufficiency, adaptive_results, pair_agreement, score_geometry, chunks_window, token_f1, citations, context_pack, html_elements)


def queries() -> dict:
    return {f.__name__: f for f in (*_QUERIES, *experiments.QUERIES, *ordered.QUERIES, *structure.QUERIES, *runs.QUERIES)} | {n: partial(analytics.run, name=n) for n in (*analytics.SQL, *statistics.SQL)}


def oracle_sql() -> dict[str, str]:
    return ORACLE | oracles.sql(_BM0, _RANK, _TOK, _QREL) | experiments.oracle_sql() | ordered.SQL | structure.oracle_sql() | runs.sql(_BM0, _B10, _QREL) | {n: analytics.duck_text(n) for n in (*analytics.SQL, *statistics.SQL)}

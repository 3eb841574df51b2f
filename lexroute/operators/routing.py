"""Query analysis, routing by weighted evidence, sufficiency and one-step escalation, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexroute.functions import sessions
from lexroute.functions.text import substring_coverage
from lexroute.operators import retrieval

# --- fixed values: word lists, patterns, weights and costs that results depend on ---
STOPWORDS = (
    "a an the and or but if then than that this these those there here is are was were be been being am do does did doing done "
    "have has had having of in on at to for from by with without about into over under it its as so such not no nor too very can will just "
    "what which who whom whose when where why how i me my we our you your he she they them their"
).split()
TECHNICAL = (
    "bm25,okapi,tf-idf,tfidf,idf,dpr,realm,retro,splade,colbert,contriever,pyserini,faiss,qdrant,hnsw,ann,bi-encoder,cross-encoder,dense retrieval,"
    "dense passage retrieval,sparse retrieval,lexical retrieval,hybrid retrieval,query expansion,reciprocal rank fusion,rank fusion,rerank,reranking,"
    "reranker,inverted index,tokenizer,embedding,embeddings,latent variable,masked language model,masked language modeling,k1,b parameter,latency,throughput"
).split(",")
SEMANTIC = (
    "why,rationale,intuition,motivation,purpose,benefit,advantage,role,impact,effect,explain,concept,conceptual,approach,mechanism,principle,"
    "implication,significance,underlying,reason,how does,how do,how can,what is the role"
).split(",")
COMPARISON = (
    "compare,comparison,versus,vs,vs.,difference,differences,differ,better,worse,outperform,outperforms,relative,than,advantage,disadvantage,"
    "tradeoff,trade-off,contrast,stronger,cheaper"
).split(",")
WHOLE_WORD = ["vs", "vs.", "than", "relative", "differ", "better", "worse"]
CONJUNCTIONS = [" and ", " both ", " or ", " as well as ", " along with ", " versus ", " vs "]
QUESTION_WORDS = ["what", "how", "why", "which", "who", "when", "where"]
QUOTED = "[\"'“‘][^\"'“”‘’]{1,60}[\"'”’]"
WORD = r"[A-Za-z0-9][A-Za-z0-9\-_.]*"
COMPARE = r"\b(compare|comparison|versus|vs\.?|difference|differences|differ|tradeoff|trade-off)\b"
DEFINE = r"(?i)^\s*(define|definition of|what is meant by|what does .* mean|what is .* called|what are .* called)\b"
PREFIX = r"(?i)^\s*(what is|what are|what was|what does|what do|how do|how does|how is|how are|why is|why are|why does|why do|which|who|when|where)\b"
STRATEGIES = ["bm25", "dense", "hybrid", "hybrid_rerank"]
COST_MS = {"bm25": 2.25, "dense": 451.78, "hybrid": 455.97, "hybrid_rerank": 3854.41}
WEIGHTS = {
    "bm25": {"lexical": 1.0, "entity": 1.5, "question_type": 0.8, "semantic": -0.6, "complexity": -0.8, "multi_concept": -1.0},
    "dense": {"lexical": -0.3, "entity": 0.2, "question_type": 0.6, "semantic": 1.5, "complexity": 0.3, "multi_concept": 0.2},
    "hybrid": {"lexical": 0.5, "entity": 0.3, "question_type": 0.5, "semantic": 1.0, "complexity": 1.0, "multi_concept": 1.5},
    "hybrid_rerank": {"lexical": 0.0, "entity": 0.0, "question_type": 0.5, "semantic": 0.3, "complexity": 1.5, "multi_concept": 1.0},
}
SUPPORT = {
    "bm25": {"what": 0.6, "how": 0.2, "why": 0.0, "which": 0.7, "who": 0.8, "when": 0.7, "where": 0.7, "compare": 0.0, "define": 1.0, "other": 0.3},
    "dense": {"what": 0.6, "how": 0.8, "why": 1.0, "which": 0.3, "who": 0.2, "when": 0.2, "where": 0.2, "compare": 0.4, "define": 0.2, "other": 0.6},
    "hybrid": {"what": 0.6, "how": 0.7, "why": 0.7, "which": 0.5, "who": 0.4, "when": 0.4, "where": 0.4, "compare": 1.0, "define": 0.5, "other": 0.7},
    "hybrid_rerank": {"what": 0.4, "how": 0.5, "why": 0.4, "which": 0.3, "who": 0.3, "when": 0.3, "where": 0.3, "compare": 0.7, "define": 0.3, "other": 0.4},
}
GROUPS = ["lexical", "semantic", "entity", "complexity", "multi_concept", "question_type"]
COST_WEIGHT, ENOUGH, MIN_RESULTS, COVERAGE, TOP1_COVERAGE = 0.25, 0.5, 3, 0.5, 0.3
# --- end of fixed values ---


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark lacks."""
    return text.str.normalize("NFKC")


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def cue_count(text: Column, cues: list[str]) -> Column:
    """How many cues the text holds; short ones as whole words only."""
    here = lambda c: text.rlike(rf"\b{re.escape(c)}\b") if c in WHOLE_WORD else F.contains(text, F.lit(c))
    return sum((here(c).cast("int") for c in cues), F.lit(0))


def is_entity(word: Column) -> Column:
    """Acronyms, camel case and identifiers; a word that ends in a full stop counts too."""
    return word.rlike(r"^[A-Z][A-Z0-9\-]+$") | word.rlike(r"^[a-z][A-Z]") | word.rlike(r"^(?=.*\d)[A-Za-z0-9_]") | word.rlike(r"^[A-Za-z0-9_]*[_.\-][A-Za-z0-9_\-]*$")


def question_type(query: Column, norm: Column) -> Column:
    trimmed = F.trim(query)
    first = F.coalesce(F.regexp_extract(norm, WORD, 0), F.lit(""))
    prefix = F.lower(F.regexp_extract(F.regexp_extract(trimmed, PREFIX, 1), r"^\w+", 0))
    return F.when(norm.rlike(COMPARE), "compare").when(trimmed.rlike(DEFINE), "define").when(prefix != "", prefix).when(first.isin(QUESTION_WORDS), first).otherwise("other")


def features(queries: DataFrame, query: str = "query") -> DataFrame:
    """queries with the 17 features of each; blank queries and those without a word leave (see rejected())."""
    q = F.col(query)
    x = queries.filter(~blank(q)).withColumn("_norm", F.regexp_replace(F.trim(F.lower(nfkc(q))), r"\s+", " "))
    x = x.withColumn("_words", F.regexp_extract_all("_norm", F.lit(f"({WORD})"), 1)).filter(F.size("_words") > 0)
    content = F.filter("_words", lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1))
    x = x.withColumn("content_terms", F.when(F.size(content) > 0, content).otherwise(F.slice("_words", 1, 1)))
    n, k = F.size("_words"), F.size("content_terms")
    entities = F.size(F.regexp_extract_all(q, F.lit(f"({QUOTED})"), 1)) + F.size(F.filter(F.regexp_extract_all(q, F.lit(f"({WORD})"), 1), is_entity))
    padded = F.concat(F.lit(" "), F.col("_norm"), F.lit(" "))
    counts = {"entity_indicator_count": entities, "technical_term_count": cue_count(F.col("_norm"), TECHNICAL), "semantic_indicator_count": cue_count(F.col("_norm"), SEMANTIC), "comparison_indicator_count": cue_count(F.col("_norm"), COMPARISON)}
    concepts = sum((F.contains(padded, F.lit(c)).cast("int") for c in CONJUNCTIONS), F.lit(1))
    x = x.withColumns({"query_length_words": n, "query_length_chars": F.length(q), "content_term_count": k, "concept_count": concepts, "question_type": question_type(q, F.col("_norm")), **counts})
    ratio = lambda a, b: F.col(a) / F.col(b)
    blend = 0.30 * unit(F.col("content_term_count") / 12.0) + 0.20 * unit((F.col("concept_count") - 1) / 2.0) + 0.20 * unit(ratio("comparison_indicator_count", "content_term_count")) + 0.15 * unit(ratio("entity_indicator_count", "query_length_words")) + 0.15 * unit(ratio("semantic_indicator_count", "content_term_count"))
    return x.withColumns({
        "lexical_density": F.round(ratio("content_term_count", "query_length_words"), 6), "entity_ratio": F.round(ratio("entity_indicator_count", "query_length_words"), 6),
        "technical_ratio": F.round(ratio("technical_term_count", "content_term_count"), 6), "semantic_ratio": F.round(ratio("semantic_indicator_count", "content_term_count"), 6),
        "multi_concept": F.col("concept_count") > 1, "complexity_score": F.round(unit(blend), 6),
    }).drop("_norm", "_words")


def blank(query: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(query, r"\s+", " ")), F.lit("")) == ""


def rejected(queries: DataFrame, query: str = "query") -> DataFrame:
    """The queries that are refused before any index is touched, with the reason."""
    reason = F.when(blank(F.col(query)), "query is empty").when(~F.col(query).rlike("[A-Za-z0-9]"), "no term to analyse")
    return queries.withColumn("reason", reason).filter("reason is not null")


def ranking(available: list[str] | None = None, groups: list[str] | None = None, cost_weight: float = COST_WEIGHT, weights: dict | None = None) -> Column:
    """All strategies of an analysed query, best first, as (low: score with its sign turned, place, strategy); ties go to the cheaper one."""
    available, groups, weights = available or STRATEGIES, groups or GROUPS, weights or WEIGHTS
    if not available or not set(available) <= set(STRATEGIES) or not set(groups) <= set(GROUPS):
        raise ValueError("strategies and feature groups must be known, with one strategy at least")
    dearest = max(COST_MS[s] for s in available)
    signal = {"lexical": unit(F.col("lexical_density")), "semantic": unit(F.col("semantic_ratio") * 4.0), "entity": unit(F.col("entity_ratio") * 2.0), "complexity": unit(F.col("complexity_score")), "multi_concept": unit((F.col("concept_count") - 1) / 2.0)}

    def total(s: str) -> Column:
        support = F.element_at(F.create_map(*(F.lit(v) for pair in SUPPORT[s].items() for v in pair)), F.col("question_type"))
        # signals have six decimals and weights two, so parts are added up in whole hundred-millionths and rounded once
        parts = [F.round(weights[s][g] * (support if g == "question_type" else signal[g]) * 1e8).cast("long") for g in GROUPS if g in groups and weights[s].get(g)]
        whole = sum(parts, F.lit(-round(cost_weight * COST_MS[s] / dearest * 1e8)).cast("long"))
        return F.floor((whole + 50) / F.lit(100)) / 1e6

    return F.array_sort(F.array(*(F.struct((-total(s)).alias("low"), F.lit(STRATEGIES.index(s)).alias("place"), F.lit(s).alias("strategy")) for s in available)))


def route(analysed: DataFrame, available: list[str] | None = None, groups: list[str] | None = None, cost_weight: float = COST_WEIGHT, weights: dict | None = None) -> DataFrame:
    """analysed with strategy, score and confidence."""
    x = analysed.withColumn("_scored", ranking(available, groups, cost_weight, weights))
    best, second = -F.col("_scored")[0]["low"], -F.try_element_at("_scored", F.lit(2))["low"]
    b, c = (F.round(v * 1_000_000).cast("long") for v in (best, second))  # scores have six decimals: the margin is a fraction of whole numbers, rounded once
    base = F.abs(b) + F.abs(c)
    millionths = F.floor(F.try_divide(2_000_000 * (b - c) + base, 2 * base))
    return x.withColumns({"strategy": F.col("_scored")[0]["strategy"], "score": best, "confidence": F.coalesce(F.greatest(F.lit(0), millionths) / 1_000_000, F.lit(0.0))}).drop("_scored")


def sufficient(analysed: DataFrame, results: DataFrame, docs: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, n_results, coverage, top1_coverage, score, sufficient) of every analysed query, from its ranked results alone."""
    results = sessions.cut(results.select(by, "doc_id", "rank"))
    hits = results.join(retrieval.texts_of(docs.select("doc_id", "text"), results).select("doc_id", F.lower("text").alias("low")), "doc_id")
    packed = hits.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", "low"))).alias("hits"))
    x = analysed.select(by, "content_terms").join(packed, by, "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,low:string>>")))
    hay, one = F.array_join(F.transform("hits", lambda h: F.coalesce(h["low"], F.lit(""))), " "), F.coalesce(F.try_element_at("hits", F.lit(1))["low"], F.lit(""))
    x = x.select(by, F.size("hits").alias("n_results"), substring_coverage(F.col("content_terms"), hay).alias("coverage"), F.when(F.size("hits") == 0, 0.0).otherwise(substring_coverage(F.col("content_terms"), one)).alias("top1_coverage"))
    score = (F.least(F.lit(1.0), F.col("n_results") / MIN_RESULTS) + F.col("coverage") + 0.5 * F.col("top1_coverage")) / 2.5
    return x.select(by, "n_results", F.round("coverage", 6).alias("coverage"), F.round("top1_coverage", 6).alias("top1_coverage"), F.round(score, 6).alias("score"), (score >= ENOUGH).alias("sufficient"))


def escalation(judged: DataFrame, ladder: list[str] | None = None, enabled: bool = True, steps: int = 1) -> DataFrame:
    """judged (strategy, sufficient) with escalated, to_strategy and the reason; the next rung of the ladder at most once."""
    ladder = ladder or STRATEGIES
    after = F.element_at(F.create_map(*(F.lit(v) for pair in [*zip(ladder, ladder[1:]), ("", "")] for v in pair)), F.col("strategy"))
    reason = F.when(F.col("sufficient").isNull(), "check disabled").when(F.col("sufficient"), "sufficient").when(F.lit(not enabled), "escalation disabled").when(F.lit(steps < 1), "budget exhausted").when(after.isNull(), "strongest available").otherwise("escalated")
    x = judged.withColumn("reason", reason).withColumn("escalated", F.col("reason") == "escalated")
    return x.withColumn("to_strategy", F.when(F.col("escalated"), after))

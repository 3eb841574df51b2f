"""Lexical, dense and fused retrieval for batches of queries.

Queries are a table: each operator is one plan for all of them. The words asked for
are few next to the postings and Spark decides by size whether to broadcast them. Top-k uses
row_number() <= k, which Spark turns into a per-partition group limit before the shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexroute.functions import sessions
from lexroute.functions.text import index_tokens
from lexroute.operators.lexical_index import LexicalIndex, idf

DIM = 64
K1, B, RRF_K, DEPTH, TOP = 1.2, 0.75, 60, 20, 10
#: Words of all queries, each query's counted apart, that are sent to every worker: a few MB.
SENT = 1 << 17
#: Asked postings that are dealt by document at once, about 13 bytes of disk each, and in a task; more go in several passes, as many as PASSES, since each reads all that are asked for.
HITS, TASK_HITS, PASSES = 1 << 24, 1 << 19, 8
#: Ids of documents that are sent to the texts at once, 8 bytes each; more go in several passes.
ASKED = 1 << 20
#: Words of a run that a document and a passage must share to be compared.
RUN = 5


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def bm25(index: LexicalIndex, queries: DataFrame, k: int = TOP, among: DataFrame | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank). Statistics are those of the whole index; `among` (doc_id) applies before ranking.

    Only folders and pages of asked terms are read. Up to SENT words of queries travel to the postings; those that are asked for are then dealt by document
    once, before each is multiplied by the queries that ask for it, and the sums need no further shuffle. Many postings go in passes over documents, of which
    each keeps its first k, so that what is shuffled lies on disk for a pass only. With more words, Spark joins by term.
    """
    terms = queries.select("query_id", F.explode(index_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    one = F.broadcast(index.stats)  # a single row
    asked = terms.join(index.terms, "term").join(one).select("query_id", "term", (idf(F.col("n_docs"), F.col("df")) * (K1 + 1) * F.col("qtf")).alias("w"))
    hits = index.postings_of(terms)
    hits = hits if among is None else hits.join(among.select("doc_id"), "doc_id", "left_semi")

    def best(hits: DataFrame, asked: DataFrame) -> DataFrame:
        hits = hits.join(one).select("doc_id", "term", (F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("part"))
        scored = hits.join(asked, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("part")), 6).alias("score"))
        if threshold is not None:
            scored = scored.filter(F.col("score") >= threshold)
        return top_k(scored, k, F.desc("score"), F.asc("doc_id"))

    if terms.count() > SENT:
        return best(hits, asked)
    n = index.asked(terms)
    passes = max(1, min(PASSES, -(-n // HITS)))
    tasks = -(-n // (passes * TASK_HITS))
    by_doc = (tasks, "doc_id") if tasks > hits.sparkSession.sparkContext.defaultParallelism else ("doc_id",)  # few may be dealt anew by size
    hits = hits.select("doc_id", "term", "tf", "dl").join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    if passes == 1:
        return best(hits.repartition(*by_doc), F.broadcast(asked))
    asked = F.broadcast(sessions.cut(asked))
    each = [sessions.cut(best(hits.filter(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == p).repartition(*by_doc), asked)) for p in range(passes)]
    return top_k(functools.reduce(DataFrame.union, each), k, F.desc("score"), F.asc("doc_id"))


def texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs whose doc_id is in rows, null ones too. Ids travel to the texts, in passes of ASKED, so that only texts that are asked for can be shuffled. rows should be cut: they are read for their number and in each pass."""
    ids = rows.select(F.col("doc_id").alias("_asked")).distinct()
    parts = max(1, -(-ids.count() // ASKED))
    passes = (ids.filter(F.pmod(F.xxhash64("_asked"), F.lit(parts)) == k) for k in range(parts))
    return functools.reduce(DataFrame.union, (docs.join(F.broadcast(x), F.col("doc_id").eqNullSafe(F.col("_asked")), "left_semi") for x in passes))


def word_runs(words: Column) -> Column:
    """Distinct hashes of all runs of RUN words."""
    starts = F.when(F.size(words) >= RUN, F.sequence(F.lit(1), F.size(words) - RUN + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, RUN))))


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id) of every document that holds a passage verbatim.

    The words of a passage less the first and the last, which the text around may continue, stand
    whole in each text that holds it. So candidates share its rarest run of RUN such words, and are
    then compared in full. Passages too short for a run are compared with every text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    p = passages.select("query_id", "query", words(F.col("query")).alias("w"))
    long = F.size("w") >= RUN + 2
    runs = p.filter(long).select("query_id", "query", F.explode(word_runs(F.slice("w", F.lit(2), F.size("w") - 2))).alias("run"))
    every = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(word_runs(F.col("w"))).alias("run"))  # a column first: the lambda would split anew for each run
    every = sessions.cut(every.join(runs.select("run").distinct(), "run", "left_semi"))  # the passages' own runs alone: texts are read once
    df = every.groupBy("run").agg(F.count("*").alias("df"))
    rarest = runs.join(df, "run", "left").groupBy("query_id", "query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run"))["run"].alias("run"))
    near = sessions.cut(every.join(rarest.select("run", F.col("query_id").alias("q")), "run").select("doc_id", "q").distinct())
    d, n = texts_of(docs.select("doc_id", "text"), near).alias("d"), near.alias("n")
    both = n.join(d, F.col("n.doc_id").eqNullSafe(F.col("d.doc_id"))).select("q", "d.doc_id", "text").join(p.filter(long), F.col("q").eqNullSafe(F.col("query_id")))
    plain = docs.select("doc_id", "text").join(p.filter(~long), F.contains("text", "query"))
    return both.filter(F.contains("text", "query")).select("query_id", "doc_id").union(plain.select("query_id", "doc_id"))


#: Bytes of query vectors that are sent to the workers at once; more go in several passes.
QUERY_BYTES = 32 << 20


@F.pandas_udf(ArrayType(DoubleType()))
def hashed_embedding(text: pd.Series) -> pd.Series:
    """The default embedder: counts of tokens in DIM places by their hash. Any Pandas UDF of a text can stand in for it."""
    place: dict[str, int] = {}

    def one(t):
        v = [0.0] * DIM
        for w in re.findall("[a-z0-9]+", (t or "").lower()):
            if w not in place:
                place[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % DIM
            v[place[w]] += 1
        return v

    return text.map(one)


def unit_rows(values: list) -> np.ndarray:
    """Rows of length one; NaN for those that are null, empty, zero or hold a null."""
    dim = max((len(v) for v in values if v is not None), default=1)
    out = np.array([np.full(dim, np.nan) if v is None or len(v) != dim else np.asarray(v, dtype=float) for v in values]).reshape(len(values), dim)
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.sqrt((out * out).sum(1, keepdims=True))


def dense(vectors: DataFrame, queries: DataFrame, k: int = TOP, where: Column | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Exact cosine top-k: queries (query_id, q) against every vector that passes the filter, as matrix products.

    Queries travel in passes of QUERY_BYTES, so what is broadcast is bounded; of each batch of vectors
    only those that may be in a query's first k leave the worker.
    """
    pool = (vectors.filter(where) if where is not None else vectors).select(F.col(id).alias("doc_id"), F.col(vector).alias("v"))
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {pool.schema['doc_id'].dataType.simpleString()}, score double"
    sized = queries.filter("q is not null").select("query_id", "q")
    width = sized.select(F.max(F.size("q"))).first()[0] or 1
    each, parts = max(1, QUERY_BYTES // (8 * width)), 1
    total = sized.count()
    parts = max(1, -(-total // each))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))) if parts > 1 else sized.withColumn("part", F.lit(0))

    def scored(part: int) -> DataFrame:
        rows = dealt.filter(F.col("part") == part).select("query_id", "q").collect()  # about QUERY_BYTES
        shared = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], unit_rows([r[1] for r in rows])))

        def run(batches):
            ids, q = shared.value
            for pdf in batches:
                if not len(pdf) or not ids:
                    continue
                x = unit_rows(pdf["v"].tolist())
                if x.shape[1] != q.shape[1]:
                    continue
                s, docs = np.round(q @ x.T, 6), pdf["doc_id"].to_numpy()
                for i, row in enumerate(s):
                    ok = np.flatnonzero(~np.isnan(row))
                    if len(ok) > k:
                        ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k]]
                    if len(ok):
                        yield pd.DataFrame({"query_id": [ids[i]] * len(ok), "doc_id": docs[ok], "score": row[ok]})

        return pool.mapInPandas(run, kind)

    out = scored(0)
    for part in range(1, parts):
        out = out.union(scored(part))
    return top_k(out, k, F.desc("score"), F.asc("doc_id"))


def dense_texts(docs: DataFrame, queries: DataFrame, k: int = TOP, embed=hashed_embedding) -> DataFrame:
    """Dense retrieval of texts with any embedder."""
    return dense(docs.select("doc_id", embed("text").alias("embedding")), queries.select("query_id", embed("query").alias("q")), k, id="doc_id")


def hybrid(docs: DataFrame, index: LexicalIndex, queries: DataFrame, k: int = TOP, embed=hashed_embedding) -> DataFrame:
    """The dense and the lexical list, DEPTH deep each, fused by ranks."""
    return rrf([dense_texts(docs, queries, DEPTH, embed), bm25(index, queries, DEPTH)], k)


def rrf(lists: list[DataFrame], k: int = TOP, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: a union and one aggregate instead of outer joins."""
    every = lists[0].select("query_id", "doc_id", "rank")
    for x in lists[1:]:
        every = every.union(x.select("query_id", "doc_id", "rank"))
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("score"), F.min("rank").alias("best"))
    return top_k(fused, k, F.desc("score"), F.asc("best"), F.asc("doc_id")).select("query_id", "doc_id", "score", "rank")


def overlap_scores(first: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The deterministic second-stage scorer: share of distinct query tokens in the passage."""
    q = queries.select("query_id", F.array_distinct(index_tokens(F.col("query"))).alias("qt"))
    first = sessions.cut(first.select("query_id", "doc_id", "score", "rank"))
    asked = texts_of(docs.select("doc_id", "text"), first)
    d = asked.select("doc_id", F.array_distinct(index_tokens(F.col("text"))).alias("dt"))
    both = first.join(q, "query_id").join(d, "doc_id")
    return both.select("query_id", "doc_id", F.col("score").alias("first_score"), F.col("rank").alias("first_rank"), F.round(F.size(F.array_intersect("qt", "dt")) / F.greatest(F.size("qt"), F.lit(1)), 6).alias("score"))


def rerank(first: DataFrame, docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    return top_k(overlap_scores(first, docs, queries), k, F.desc("score"), F.asc("first_rank"), F.asc("doc_id")).select("query_id", "doc_id", "score", "rank", "first_rank")

"""Which chunks lie under a labelled section, by pre-order numbers of each document's section tree.

Paths of a document in the order of their components are its tree in pre-order: a section comes before
all that lies under it, and those follow one another. So each node is an interval of numbers, "lies under" is a test of
an interval, and two nodes are nested or apart. Sizes of sections are sums of their chunks; no chunk is paired with a label to count it.
A null document or path takes no part; the empty path is the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexroute.operators import ordering


def tree(chunks: DataFrame, document: str = "document_id", path: str = "section_path") -> DataFrame:
    """(document, prefix, low, high, n_chunks): every node that a chunk lies under, the first and last number of its paths, and its chunks."""
    known = chunks.filter(F.col(document).isNotNull() & F.col(path).isNotNull())
    paths = known.groupBy(ordering.group([document]).alias("_g"), F.col(path).alias("p")).agg(F.count("*").alias("m"), F.lit(1).cast("long").alias("one"))
    numbered, _ = ordering.prefix(paths, ["p"], ["one"])
    above = F.transform(F.sequence(F.lit(0), F.size("p")), lambda k: F.slice("p", 1, k))
    nodes = numbered.select(F.col("_g").getField(document).alias(document), F.explode(above).alias("prefix"), F.col("one_before").alias("no"), "m")
    return nodes.groupBy(document, "prefix").agg(F.min("no").alias("low"), F.max("no").alias("high"), F.sum("m").alias("n_chunks"))


def numbered(chunks: DataFrame, nodes: DataFrame, document: str = "document_id", path: str = "section_path") -> DataFrame:
    """chunks with the number of their path, `no`."""
    return chunks.join(nodes.select(document, F.col("prefix").alias(path), F.col("low").alias("no")), [document, path], "left")


def spans(relevant: DataFrame, refs: DataFrame, nodes: DataFrame, pooled: bool = True, id: str = "query_id", document: str = "document_id", prefix: str = "prefix") -> DataFrame:
    """(query, document, low, high, n_chunks): the intervals a query's labels stand for, none within another.

    relevant has (query, document), refs (query, document, prefix). Refs of documents that are not relevant don't count. Where a query has refs, only what lies
    under one of them is relevant: pooled, a ref holds for all relevant documents of its query; otherwise for its own, and documents without
    refs are relevant as a whole. A prefix that a document hasn't got stands for nothing.
    """
    docs = relevant.select(id, document).distinct()
    own = refs.select(id, document, F.col(prefix).alias("prefix")).join(docs, [id, document], "left_semi").distinct()
    wanted = docs.join(own.select(id, "prefix").distinct(), id, "left") if pooled else docs.join(own, [id, document], "left")
    wanted = wanted.withColumn("prefix", F.coalesce("prefix", F.array().cast("array<string>")))
    found = wanted.join(nodes, [document, "prefix"]).select(id, document, "low", "high", "n_chunks").distinct()
    before = Window.partitionBy(id, document).orderBy("low", F.desc("high")).rowsBetween(Window.unboundedPreceding, -1)  # the labels of one query
    return found.withColumn("reach", F.max("high").over(before)).filter("reach is null or low > reach").drop("reach")


def gold_sizes(relevant: DataFrame, found: DataFrame, id: str = "query_id") -> DataFrame:
    """(query, n_gold): chunks that a query's labels stand for, over the whole corpus."""
    return relevant.select(id).distinct().join(found.groupBy(id).agg(F.sum("n_chunks").alias("n")), id, "left").select(id, F.coalesce("n", F.lit(0)).alias("n_gold"))


def judged(results: DataFrame, chunks: DataFrame, found: DataFrame, id: str = "query_id", document: str = "document_id", chunk: str = "chunk_id") -> DataFrame:
    """results (query, chunk, rank) with `relevant`; chunks has (chunk, document, no)."""
    x = results.select(id, chunk, "rank").join(chunks.select(chunk, document, "no"), chunk, "left")
    inside = found.select(F.col(id).alias("_q"), F.col(document).alias("_d"), "low", "high")
    hit = (F.col(id) == F.col("_q")) & (F.col(document) == F.col("_d")) & F.col("no").between(F.col("low"), F.col("high"))
    return x.join(inside, hit, "left").select(id, chunk, "rank", F.col("_q").isNotNull().alias("relevant"))


def _gain(k: int) -> Column:
    return F.coalesce(F.sum(F.when(F.col("relevant") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0))


def scores(results: DataFrame, sizes: DataFrame, k: int = 5, id: str = "query_id") -> DataFrame:
    """(query, n_gold, recall, ndcg) of judged results: recall over all gold chunks of the corpus, null without any; nDCG against an ideal of the relevant chunks that were retrieved."""
    some = results.groupBy(id).agg(F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("hits"), F.count_if("relevant").alias("found"), _gain(k).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("found").cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    x = sizes.join(some, id, "left")
    return x.select(id, "n_gold", F.try_divide(F.coalesce("hits", F.lit(0)), "n_gold").alias("recall"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"))


def repaired_refs(refs: DataFrame, repairs: DataFrame, label: str = "label_id", prefix: str = "prefix") -> DataFrame:
    """refs with the prefixes of safe repairs (label, repaired, verdict) in place of their own; all others stay as they are."""
    safe = repairs.filter("verdict = 'safe'").select(label, "repaired")
    return refs.join(safe, label, "left").withColumn(prefix, F.coalesce("repaired", prefix)).drop("repaired")

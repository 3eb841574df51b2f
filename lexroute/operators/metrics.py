"""Ranking metrics over (query_id, doc_id, rank) and qrels (query_id, doc_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(results: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """One row per labelled query: recall, precision, hit, reciprocal rank and nDCG at k.

    Precision divides by rows returned; the ideal gain uses the relevant rows
    that were retrieved.
    """
    total = qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    judged = results.join(qrels.select("query_id", "doc_id", F.lit(1).alias("rel")).distinct(), ["query_id", "doc_id"], "left")
    rel, top = F.coalesce(F.col("rel"), F.lit(0)), F.col("rank") <= k
    stats = judged.groupBy("query_id").agg(
        F.sum(F.when(top, rel)).alias("hits"), F.count(F.when(top, 1)).alias("rows"), F.min(F.when(rel == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(top, rel / F.log2(F.col("rank") + 1))).alias("dcg"), F.sum(rel).alias("found"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("found").cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return total.join(stats, "query_id", "left").select(
        "query_id", F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("n_rel"), 6).alias("recall"), F.round(F.coalesce(F.try_divide("hits", "rows"), F.lit(0.0)), 6).alias("precision"),
        F.when(F.coalesce(F.col("hits"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.when(F.coalesce(F.col("found"), F.lit(0)) > 0, F.round(F.col("dcg") / ideal, 6)).otherwise(0.0).alias("ndcg"),
    )

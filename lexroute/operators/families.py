"""Comparisons of arms over the same queries: guarded pairing, a test for each kind of metric, adjustment within each metric.

All pairs of arms and all metrics are one plan. Arms are paired only if they measured the same queries, each once: that is told by
fingerprints of their ids (a count and two sums of hashes), which are as many rows as arms; ids are not moved for it.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.operators import inference, ordering

# --- fixed values: kinds of metrics, bounds of a plausibly symmetric sample, level and seed ---
QUALITY = ["recall_at_1", "recall_at_5", "recall_at_10", "precision_at_1", "precision_at_5", "precision_at_10", "hit_at_1", "hit_at_5", "hit_at_10", "mrr", "ndcg_at_5"]
LATENCY = ["routing_latency_ms", "retrieval_latency_ms", "reranking_latency_ms", "generation_latency_ms", "query_embedding_latency_ms", "search_latency_ms", "candidate_generation_latency_ms", "total_latency_ms"]
COST = ["context_tokens", "input_tokens", "output_tokens", "total_tokens", "estimated_cost_usd"]
SKEW, EXCESS_KURTOSIS, LEAST_N, MOMENTS_N = 0.5, 2.0, 10, 3
LEVEL, SEED = 0.05, 20250101
# --- end of fixed values ---

KIND = {**dict.fromkeys(QUALITY, "quality"), **dict.fromkeys(LATENCY, "latency"), **dict.fromkeys(COST, "cost")}


class PairingError(ValueError):
    """Two arms did not measure the same queries, each once."""


def fingerprints(rows: DataFrame, arm: str, id: str = "query_id") -> DataFrame:
    """(arm, n, s, x): equal for two arms if they hold the same ids, each as often (but for a chance of about 2**-100)."""
    return rows.groupBy(arm).agg(F.count("*").alias("n"), F.sum(F.xxhash64(id).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.col(id), F.lit(7))).alias("x"))


def guarded(rows: DataFrame, arms: list[str], arm: str = "system", id: str = "query_id") -> list[str]:
    """Those of arms that have rows; PairingError if they are not over the same ids, or one has an id twice."""
    if len(set(arms)) != len(arms):
        raise PairingError(f"an arm is named twice: {arms}")
    some = rows.filter(F.col(arm).isin(arms))
    prints = {r[arm]: (r["n"], r["s"], r["x"]) for r in fingerprints(some, arm, id).collect()}  # a row for each arm
    here = [a for a in arms if a in prints]
    odd = [a for a in here if prints[a] != prints[here[0]]]
    if odd:
        raise PairingError(f"{odd} did not measure the queries of {here[0]}")
    if here and not some.filter(F.col(arm) == here[0]).groupBy(id).count().filter("count > 1").isEmpty():
        raise PairingError(f"{here[0]} has a query twice")
    return here


def against(arms: list[str], baseline: str) -> list[tuple[str, str]]:
    """(treatment, baseline) for each other arm."""
    return [(a, baseline) for a in arms if a != baseline]


def all_pairs(arms: list[str]) -> list[tuple[str, str]]:
    """(later, earlier) for each pair, in the order of arms."""
    return [(b, a) for a, b in combinations(arms, 2)]


def before_and_after(arms: list[str]) -> list[tuple[str, str]]:
    """(after, before) of each arm of two runs whose rows name their arm as run/arm."""
    return [(f"after/{a}", f"before/{a}") for a in arms]


def symmetry(differences: DataFrame, by: list[str]) -> DataFrame:
    """(by, skew, excess_kurtosis, symmetric) of the differences d that are not 0: population moments; few or skewed ones are not taken for symmetric."""
    x = differences.filter("d <> 0")
    g = ordering.group(by).alias("_g")
    centre = x.groupBy(g).agg(F.avg("d").alias("mu"))
    c = x.withColumn("_g", ordering.group(by)).join(F.broadcast(centre), "_g").withColumn("c", F.col("d") - F.col("mu"))  # a row for each pair and metric
    m = c.groupBy("_g").agg(F.count("*").alias("n"), *(F.avg(F.pow("c", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)), (F.max("d") - F.min("d")).alias("width"))
    alike = (F.col("width") == 0) & (F.col("n") >= MOMENTS_N)
    known = (F.col("width") > 0) & (F.col("n") >= MOMENTS_N)
    skew, kurtosis = F.when(known, F.col("m3") / F.pow("m2", F.lit(1.5))), F.when(known, F.col("m4") / (F.col("m2") * F.col("m2")) - 3)
    even = (F.abs(skew) <= SKEW) & (F.abs(kurtosis) <= EXCESS_KURTOSIS) & (F.col("n") >= LEAST_N)
    return m.select(*(F.col("_g").getField(k).alias(k) for k in by), skew.alias("skew"), kurtosis.alias("excess_kurtosis"), F.coalesce(alike | even, alike, F.lit(False)).alias("symmetric"))


def compare(rows: DataFrame, pairs: list[tuple[str, str]], metrics: list[str], arm: str = "system", id: str = "query_id", rounds: int = inference.RESAMPLES, level: float = LEVEL, missing: str = "left out", pair_up: bool = True) -> DataFrame:
    """One row for each metric and pair (treatment, baseline), also of arms without rows.

    Quality is judged by signed ranks where the differences are plausibly symmetric, else by signs; latency and cost always by signs. Queries
    without a value in both arms take no part, and are counted. p_holm is adjusted over the pairs of one metric; a pair without a p is left out
    of its family, or stands in it with a p of 1 (missing="one"). pair_up: refuse arms that are not over the same queries.
    """
    unknown = [m for m in metrics if m not in KIND]
    if unknown or missing not in ("left out", "one"):
        raise ValueError(f"unknown metrics {unknown} or treatment of missing values {missing}")
    arms = list(dict.fromkeys(a for p in pairs for a in reversed(p)))
    if pair_up:
        guarded(rows, arms, arm, id)
    spark, by = rows.sparkSession, ["metric", "treatment", "baseline"]
    wanted = spark.createDataFrame([(m, KIND[m], a, b) for m in metrics for a, b in pairs], "metric string, kind string, treatment string, baseline string")
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))
    long = rows.filter(F.col(arm).isin(arms)).select(F.col(id).alias("id"), F.col(arm).alias("arm"), cells.alias("x")).select("id", "arm", "x.*")
    asked = F.broadcast(wanted.select(*by))  # metrics times pairs
    left = long.join(asked, ["metric"]).filter("arm = treatment").select("id", *by, F.col("v").alias("t"))
    right = long.select("id", "metric", F.col("arm").alias("baseline"), F.col("v").alias("b"))
    both = sessions.cut(left.join(right, ["id", "metric", "baseline"]).select(*by, "t", "b", (F.col("t") - F.col("b")).alias("d")))
    counts = both.groupBy(*by).agg(F.count("*").alias("n_queries"), F.count_if(F.col("t").isNull()).alias("no_treatment"), F.count_if(F.col("b").isNull()).alias("no_baseline"))
    d = both.filter("d is not null").select(*by, "d")
    tested = inference.compare(d, by, "d", rounds, SEED)
    x = wanted.join(counts, by, "left").join(tested, by, "left").join(symmetry(d, by), by, "left")
    ranked = (F.col("kind") == "quality") & F.coalesce("symmetric", F.lit(False))
    x = x.withColumn("test", F.when(F.col("n").isNull(), None).when(ranked, "signed ranks").otherwise("signs"))
    x = x.withColumn("p_value", F.when(ranked, F.col("p")).otherwise(F.col("sign_p")))
    family = x if missing == "one" else x.filter("p_value is not null")
    adjusted = inference.holm(family.select(*by, "p_value"), "p_value", ["metric"]).withColumn("family_size", F.count("*").over(_within("metric")))
    out = x.join(adjusted.drop("p_value"), by, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*by, "kind", zero("n_queries"), zero("no_treatment"), zero("no_baseline"), F.coalesce("n", F.lit(0).cast("long")).alias("n_pairs"), "wins", "ties", "losses", "mean_d", "median_d", "ci_low", "ci_high", "symmetric", "test", "p_value", "p_holm", "family_size", F.coalesce(F.col("p_holm") < level, F.lit(False)).alias("significant"))


def _within(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)  # the pairs of one metric

"""Studies over evaluation rows: quality by depth, by transition and by stage, versions of a corpus, checks of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexroute.operators import metrics

#: Depths of the report.
DEPTHS = (1, 3, 5, 10)
MEASURES = ("recall", "precision", "hit", "mrr", "ndcg")


def depth_grid(results: DataFrame, qrels: DataFrame, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(k, n, mean of each measure): one row for each depth. Results and qrels are read once for each, so hand in kept frames."""
    out = None
    for k in depths:
        one = metrics.per_query(results, qrels, k).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in MEASURES)).select(F.lit(k).alias("k"), "n", *MEASURES)
        out = one if out is None else out.union(one)
    return out


def transition_quality(first: DataFrame, second: DataFrame, key: str, strategy: str, values: list[str]) -> DataFrame:
    """For each pair of strategies before and after: rows paired, means before and after of each value, and the mean change.

    A key that only one side has, or whose first value is null on a side, is unpaired and counted under its
    reason, with null means; a value beyond the first is averaged over the paired rows that have it twice.
    """
    a = first.select(F.col(key).alias("k"), F.col(strategy).alias("from_strategy"), *(F.col(v).cast("double").alias(f"a{i}") for i, v in enumerate(values)), F.lit(True).alias("in_a"))
    b = second.select(F.col(key).alias("k"), F.col(strategy).alias("to_strategy"), *(F.col(v).cast("double").alias(f"b{i}") for i, v in enumerate(values)), F.lit(True).alias("in_b"))
    reason = F.when(F.col("in_b").isNull(), "no_after").when(F.col("in_a").isNull(), "no_before").when(F.col("a0").isNull() | F.col("b0").isNull(), "no_quality").otherwise("paired")
    x = a.join(b, "k", "full_outer").withColumn("reason", reason)
    out = []
    for i, v in enumerate(values):
        ok = (F.col("reason") == "paired") & F.col(f"a{i}").isNotNull() & F.col(f"b{i}").isNotNull()
        out += [F.round(F.avg(F.when(ok, F.col(f"a{i}"))), 6).alias(f"{v}_before"), F.round(F.avg(F.when(ok, F.col(f"b{i}"))), 6).alias(f"{v}_after"), F.round(F.avg(F.when(ok, F.col(f"b{i}") - F.col(f"a{i}"))), 6).alias(f"{v}_change")]
    return x.groupBy("from_strategy", "to_strategy", "reason").agg(F.count("*").alias("n"), *out)


def stage_medians(samples: DataFrame, by: str, stages: str) -> DataFrame:
    """(by, stage, n, median_v, mean_v, sd_v) over a map of stage to value; stages that a sample lacks, or has as null, are left out of theirs.

    The median is exact; its state in a task is the distinct values of a group.
    """
    long = samples.select(by, F.explode(stages).alias("stage", "v")).filter("v is not null")
    return long.groupBy(by, "stage").agg(
        F.count("*").alias("n"), F.round(F.percentile("v", F.lit(0.5)), 6).alias("median_v"), F.round(F.avg("v"), 6).alias("mean_v"), F.round(F.stddev_samp("v"), 6).alias("sd_v")
    )


def changes(old: DataFrame, new: DataFrame, id: str, content: str) -> DataFrame:
    """(id, change) of what was added, removed or changed between two versions; null content differs from any text, not from null."""
    a = old.select(F.col(id).alias("i"), F.sha2(content, 256).alias("c"), F.lit(True).alias("old"))  # digests, so that no text is shuffled
    b = new.select(F.col(id).alias("j"), F.sha2(content, 256).alias("d"), F.lit(True).alias("new"))
    x = a.join(b, F.col("i").eqNullSafe(F.col("j")), "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("c").eqNullSafe(F.col("d")), "changed")
    return x.select(F.coalesce("i", "j").alias(id), kind.alias("change")).filter("change is not null")


def tie_artefact(rows: DataFrame, by: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """(by, n, spread, tied): whether the winner of a group is only the first of equals."""
    spread = F.max(value) - F.min(value)
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(spread, 6).alias("spread"), (spread <= tolerance).alias("tied"))


def with_latency(quality: DataFrame, latency: DataFrame, keys: list[str], column: str) -> DataFrame:
    """quality with its latency; a row whose latency is null ends the job, one that has none is left out."""
    said = F.concat(F.lit(f"no {column} for "), F.concat_ws("/", *keys))
    return quality.join(latency.select(*keys, column), keys).withColumn(column, F.when(F.col(column).isNull(), F.raise_error(said).cast("double")).otherwise(F.col(column)))


def total_latency(*parts: Column) -> Column:
    """The sum of the parts that are there; null if none is."""
    some = F.coalesce(*parts).isNotNull()
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
    return F.when(some, total)


def judged_score(answer: Column, field: str) -> Column:
    """The number under a field of the JSON object in a judge's answer, fenced or not; null if there is none."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.try_element_at(F.from_json(body, "map<string,string>"), F.lit(field)).try_cast("double")


def markdown_table(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table: the first row, a rule, the others; bars in cells are escaped."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    first = F.get(rows, F.lit(0))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(first, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(first), rule), body), "\n")).otherwise("")


def run_deltas(a: DataFrame, b: DataFrame, same: list[str], keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """(keys, before, after, delta, relative) of the metrics that both runs have; relative is null where before is 0.

    same names columns (corpus, number of queries) that must hold one value over both runs; another one is refused.
    """
    keys = keys or ["metric", "k"]
    for column in same:
        if a.select(column).union(b.select(column)).distinct().limit(2).count() > 1:
            raise ValueError(f"the runs differ in {column}")
    x = a.select(*keys, F.col(value).cast("double").alias("before")).join(b.select(*keys, F.col(value).cast("double").alias("after")), keys)
    delta = F.col("after") - F.col("before")
    return x.select(*keys, F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(delta, 6).alias("delta"), F.round(F.try_divide(delta, F.col("before")), 6).alias("relative"))


def by_depth(rows: DataFrame, metric: str, depth: str, value: str, depths: list[int]) -> DataFrame:
    """One row a metric, one column a depth (named by it): the mean, null where there is none."""
    return rows.groupBy(metric).pivot(depth, depths).agg(F.round(F.avg(value), 6))


def replicated(first: DataFrame, second: DataFrame, signal: str = "signal", least: float = 0.30, level: float = 0.05) -> DataFrame:
    """(signal, rho_first, rho_second, replicated) over rows of (signal, rho, p_holm) of two arms.

    A signal replicates if its correlation is strong enough and significant after adjustment on the first arm, and of
    the same sign and strong enough on the second. One that the second arm lacks does not.
    """
    x = first.select(signal, F.col("rho").alias("rho_first"), "p_holm").join(second.select(signal, F.col("rho").alias("rho_second")), signal, "left")
    strong = lambda c: F.abs(c) >= least
    held = strong("rho_first") & (F.col("p_holm") < level) & strong("rho_second") & (F.signum("rho_first") == F.signum("rho_second"))
    return x.select(signal, "rho_first", "rho_second", F.coalesce(held, F.lit(False)).alias("replicated"))


def reranker_decomposition(rows: DataFrame, by: str, system: str, value: str, reranked: str, base: str, epsilon: float = 1e-9) -> DataFrame:
    """One row: queries that the reranked arm and its base both have, how many rise, fall and stay, and how often each beats all other arms."""
    per = rows.groupBy(by).agg(
        F.max(F.when(F.col(system) == reranked, F.col(value))).alias("r"), F.max(F.when(F.col(system) == base, F.col(value))).alias("b"), F.max(F.when(~F.col(system).isin(reranked, base), F.col(value))).alias("o")
    ).filter("r is not null and b is not null")
    d = F.col("r") - F.col("b")
    count = F.count_if
    return per.agg(
        F.count("*").alias("n"), count(d > epsilon).alias("rises"), count(d < -epsilon).alias("falls"), count(F.abs(d) <= epsilon).alias("stays"),
        count(F.col("r") > F.col("o") + epsilon).alias("reranked_beats_others"), count(F.col("b") > F.col("o") + epsilon).alias("base_beats_others"),
        count((d > epsilon) & (F.col("r") > F.col("o") + epsilon)).alias("rises_above_others"),
    )

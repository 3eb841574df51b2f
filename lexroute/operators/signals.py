"""Signals between ranked lists of one query, and what follows from them for routing policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexroute.operators import ordering


def ranked_lists(results: DataFrame, name: str, by: str = "query_id") -> DataFrame:
    """(query_id, <name>_ids, <name>_scores) in the order of ranks."""
    packed = F.array_sort(F.collect_list(F.struct("rank", "doc_id", F.col("score").cast("double").alias("score"))))
    return results.groupBy(by).agg(packed.alias("x")).select(by, F.transform("x", lambda r: r["doc_id"]).alias(f"{name}_ids"), F.transform("x", lambda r: r["score"]).alias(f"{name}_scores"))


def top(ids: Column, k: int) -> Column:
    """The first k places, repeats once."""
    return F.array_distinct(F.slice(ids, 1, k))


def jaccard(a: Column, b: Column, k: int = 10) -> Column:
    """Of the top k; 1 if both are empty."""
    x, y = top(a, k), top(b, k)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0))


def overlap(a: Column, b: Column, k: int = 10) -> Column:
    """Share of a's top k that b has too; 1 if a is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(top(a, k), top(b, k))), F.size(top(a, k))), F.lit(1.0))


def union_concentration(a: Column, b: Column, k: int = 10) -> Column:
    """Union over the sum of both sizes: 1 if disjoint, 0.5 if alike; two empty lists are an error."""
    both = F.size(top(a, k)) + F.size(top(b, k))
    return F.when(both == 0, F.raise_error(F.lit("union_concentration needs a result")).cast("double")).otherwise(F.size(F.array_union(top(a, k), top(b, k))) / both)


def distinct_ratio(ids: Column, k: int = 10) -> Column:
    return F.when(F.size(F.slice(ids, 1, k)) == 0, 1.0).otherwise(F.size(top(ids, k)) / float(k))


def top1_agrees(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1)), F.lit(False))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of two arrays of one length; null below two values or if one is constant."""
    n = F.size(x)
    total = lambda z: F.aggregate(z, F.lit(0.0), lambda s, v: s + v)
    centred = lambda z: F.transform(z, lambda v: v - total(z) / n)
    dot = lambda p, q: total(F.zip_with(p, q, lambda u, v: u * v))
    a, b = centred(x), centred(y)
    return F.when((n >= 2) & (dot(a, a) > 0) & (dot(b, b) > 0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def rank_correlation(a: Column, b: Column, k: int = 10) -> Column:
    """Spearman's rho over the documents both hold, by their order there; ranks of distinct places have no ties."""
    x, y = top(a, k), top(b, k)
    shared = F.array_intersect(x, y)
    place = lambda ids: F.transform(shared, lambda d: F.size(F.filter(shared, lambda e: F.array_position(ids, e) <= F.array_position(ids, d))).cast("double"))
    return correlation(place(x), place(y))


def finite(scores: Column, k: int = 10) -> Column:
    return F.filter(F.slice(scores, 1, k), lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")))


def score_gap(scores: Column, k: int = 10) -> Column:
    s = finite(scores, k)
    return F.when(F.size(s) >= 2, F.try_divide(F.get(s, F.lit(0)) - F.get(s, F.lit(1)), F.abs(F.get(s, F.lit(0)))))


def score_slope(scores: Column, k: int = 10) -> Column:
    """Least-squares slope of score on place, finite scores only, numbered anew."""
    s = finite(scores, k)
    n = F.size(s)
    mid = (n + 1) / 2.0
    num = F.aggregate(F.transform(s, lambda v, i: (i + 1 - mid) * v), F.lit(0.0), lambda t, v: t + v)
    den = F.aggregate(F.transform(s, lambda v, i: (i + 1 - mid) * (i + 1 - mid)), F.lit(0.0), lambda t, v: t + v)
    return F.when(n >= 2, F.try_divide(num, den))


def change(before: Column, after: Column, other: Column, relevant: Column, k: int = 5, depth: int = 10) -> dict[str, Column]:
    """What entered and left the top k, the relevant part of both, and which pools hold what entered."""
    x, y = top(before, k), top(after, k)
    entered, left = F.array_sort(F.array_except(y, x)), F.array_sort(F.array_except(x, y))
    has = lambda ids, d: F.array_contains(F.slice(ids, 1, depth), d)
    source = F.transform(entered, lambda d: F.when(has(before, d) & has(other, d), "both").when(has(before, d), "dense_only").when(has(other, d), "bm25_only").otherwise("neither"))
    return {"entered": entered, "gone": left, "relevant_entered": F.array_sort(F.array_intersect(relevant, entered)), "relevant_left": F.array_sort(F.array_intersect(relevant, left)), "entered_source": source}


def pair_signals(a: DataFrame, b: DataFrame, k: int = 10, by: str = "query_id") -> DataFrame:
    """One row for each query of both systems, with all signals of the pair."""
    x, y = F.col("a_ids"), F.col("b_ids")
    signals = {
        "jaccard": jaccard(x, y, k), "overlap": overlap(x, y, k), "union_concentration": union_concentration(x, y, k), "rank_correlation": rank_correlation(x, y, k), "distinct_ratio_a": distinct_ratio(x, k),
        "distinct_ratio_b": distinct_ratio(y, k), "gap_a": score_gap(F.col("a_scores"), k), "gap_b": score_gap(F.col("b_scores"), k), "slope_a": score_slope(F.col("a_scores"), k),
    }
    both = ranked_lists(a, "a", by).join(ranked_lists(b, "b", by), by)
    return both.select(by, *(F.round(c, 5).alias(n) for n, c in signals.items()), top1_agrees(x, y).alias("top1"))


# --- policies: records (signal columns, quality of the cheap and the dear arm, clocks, label) ---


def decile_cuts(records: DataFrame, signal: str) -> DataFrame:
    """(cut): at most nine rising values, each the mean of the order statistics around a decile. Finite values only."""
    v = records.select(F.col(signal).cast("double").alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")

    def around(d: int):
        return lambda n: [(F.greatest(F.lit(0), F.least(n - 1, f(n * d / 10.0))), F.lit(0.5)) for f in (F.floor, F.ceil)]

    cuts = ordering.quantiles(v, "v", [], {f"d{d}": around(d) for d in range(1, 10)})
    return cuts.select(F.explode(F.array(*(f"d{d}" for d in range(1, 10)))).alias("cut")).distinct()


def sweep(records: DataFrame, signal: str, cuts: DataFrame, direction: str, epsilon: float = 0.01) -> DataFrame:
    """Each cut of one rule scored on all records: rate, quality with standard error, clock, confusion with the label."""
    if direction not in ("high", "low"):
        raise ValueError(f"unknown direction {direction}")
    go = F.coalesce(F.col(signal) >= F.col("cut") if direction == "high" else F.col(signal) <= F.col("cut"), F.lit(False))
    x = records.withColumn("label", F.col("dear") - F.col("cheap") >= epsilon).join(F.broadcast(cuts)).withColumn("go", go)  # nine cuts at most
    quality, clock = F.when(F.col("go"), F.col("dear")).otherwise(F.col("cheap")), F.col("cheap_ms") + F.when(F.col("go"), F.col("dear_ms")).otherwise(0.0)
    both = lambda g, y: F.count_if((F.col("go") == g) & (F.col("label") == y))
    out = x.groupBy("cut").agg(F.count("*").alias("n"), F.avg(F.col("go").cast("double")).alias("rate"), F.avg(quality).alias("quality"), (F.stddev_samp(quality) / F.sqrt(F.count("*"))).alias("error"), F.avg(clock).alias("clock"), both(True, True).alias("tp"), both(True, False).alias("fp"), both(False, True).alias("fn"), both(False, False).alias("tn"))
    return out.select(F.lit(signal).alias("signal"), F.lit(direction).alias("direction"), "*", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("agreement"))


def select_rule(swept: DataFrame, least: float = 0.05, most: float = 0.95) -> DataFrame:
    """The rule of lowest rate within one standard error of the best among those of a fair rate; else the best, marked degenerate."""
    x = swept.withColumn("fair", F.col("rate").between(least, most))
    best = x.agg(F.max(F.when(F.col("fair"), F.col("quality"))).alias("ceiling"))
    x = x.join(F.broadcast(best)).withColumn("near", F.coalesce(F.col("fair") & (F.col("quality") >= F.col("ceiling") - F.col("error")), F.lit(False)) | F.coalesce(F.col("fair") & (F.col("quality") >= F.col("ceiling")), F.lit(False)))
    # near rules by rate, signal and cut; without any, the best by quality
    order = [F.desc("near"), F.when(F.col("near"), F.col("rate")).otherwise(-F.col("quality")), "signal", "cut"]
    return x.orderBy(*order).limit(1).select("signal", "direction", "cut", F.round("rate", 6).alias("rate"), F.round("quality", 6).alias("quality"), (~F.col("near")).alias("degenerate"))


def separation(records: DataFrame, features: list[str], group: str = "grp") -> DataFrame:
    """Whether any one direction parts the helped from the harmed, for each feature; nulls are left out."""
    long = records.select(group, F.explode(F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*(F.col(f).cast("double") for f in features)))).alias("feature", "v")).filter("v is not null")
    side = lambda g, f: f(F.when(F.col(group) == g, F.col("v")))
    x = long.groupBy("feature").agg(side("helps", F.min).alias("lo_h"), side("helps", F.max).alias("hi_h"), side("harms", F.min).alias("lo_m"), side("harms", F.max).alias("hi_m"))
    direction = F.when(F.col("hi_h") < F.col("lo_m"), "helps_below_harms").when(F.col("hi_m") < F.col("lo_h"), "helps_above_harms")
    return x.select("feature", direction.isNotNull().alias("separates"), direction.alias("direction"))

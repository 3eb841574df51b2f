"""Order statistics of whole columns: ranks, quantiles and what follows from them, with no column in one task.

Rows are first counted by their value, which is combined map-side, so a value that a third of all rows
share is one row from then on. The different values are dealt to tasks by ranges; each task adds up its own, and the
totals of the tasks (a row for each task and group) give each its offset. Ties get the mean of their places from
the two edges of their run. Null values take no part; NaN is the largest value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexroute.functions import sessions

#: Name -> for a group of n rows, the places (from 0) whose values are added up, and the weight of each.
Picks = dict[str, Callable[[Column], list[tuple[Column, Column]]]]


def group(by: list[str]) -> Column:
    """All keys of a group as one value, in which nulls are equal."""
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def prefix(counts: DataFrame, order: list[str], sums: list[str]) -> tuple[DataFrame, DataFrame]:
    """counts (one row for each `_g` and order) with <s>_before, the sum of s over smaller keys of its group, and the offsets of its parts.

    The second frame has (_g, _part, <s>_off, <s>_sum), a row for each task and group that it has rows of.
    """
    width = max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sessions.cut(counts.repartitionByRange(width, "_g", *order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_g", "_part").agg(*(F.sum(s).alias(f"{s}_sum") for s in sums))
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda s, w: F.coalesce(F.sum(s).over(w), F.lit(0))
    offsets = sessions.cut(totals.select("*", *(zero(f"{s}_sum", earlier).alias(f"{s}_off") for s in sums)))
    inside = Window.partitionBy("_g", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *(zero(s, inside).alias(f"{s}_in") for s in sums))
    out = own.join(offsets.drop(*(f"{s}_sum" for s in sums)), ["_g", "_part"])
    return out.withColumns({f"{s}_before": F.col(f"{s}_in") + F.col(f"{s}_off") for s in sums}).drop(*(f"{s}_{x}" for s in sums for x in ("in", "off"))), offsets


def _times(weight: str | None) -> Column:
    """How many rows a row stands for."""
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def runs(rows: DataFrame, value: str, by: list[str], *more: Column, weight: str | None = None) -> DataFrame:
    """(_g, v, m): each value of each group, how often it stands there, and further aggregates."""
    return rows.filter(F.col(value).isNotNull()).groupBy(group(by).alias("_g"), F.col(value).alias("v")).agg(F.sum(_times(weight)).alias("m"), *more)


def mid_rank() -> Column:
    return F.col("m_before") + (F.col("m") + 1) / 2.0


def ranks(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(_g, v, m, mid_rank, n): the mean place, from 1, of each value among the n rows of its group."""
    counts = runs(rows, value, by or [])
    placed, offsets = prefix(counts, ["v"], ["m"])
    n = offsets.groupBy("_g").agg(F.sum("m_sum").alias("n"))
    return placed.join(n, "_g").select("_g", "v", "m", mid_rank().alias("mid_rank"), "n")


def with_ranks(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """rows with the mid-rank of their value in their group; null values have none."""
    r = ranks(rows, value, by).select("_g", F.col("v").alias("_v"), "mid_rank")
    return rows.withColumns({"_g": group(by or []), "_v": F.col(value)}).join(r, ["_g", "_v"], "left").drop("_g", "_v")


def _ungrouped(df: DataFrame, by: list[str], *columns) -> DataFrame:
    return df.select(*(F.col("_g").getField(c).alias(c) for c in by), *columns)


def quantiles(rows: DataFrame, value: str, by: list[str], picks: Picks) -> DataFrame:
    """(by, n, <name>...): for each pick the weighted sum of the values at its places. The part that holds a place is found first, then the run in it."""
    placed, offsets = prefix(runs(rows, value, by), ["v"], ["m"])
    n = offsets.groupBy("_g").agg(F.sum("m_sum").alias("n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), p.cast("long").alias("pos"), w.cast("double").alias("w")) for name, f in picks.items() for p, w in f(F.col("n"))))
    asked = n.select("_g", "n", F.explode(wanted).alias("x")).select("_g", "n", "x.*")
    parts = asked.join(offsets, "_g").filter("pos >= m_off and pos < m_off + m_sum").select("_g", "_part", "n", "name", "pos", "w")
    found = placed.join(parts, ["_g", "_part"]).filter("pos >= m_before and pos < m_before + m")
    out = found.groupBy("_g", "n").agg(*(F.sum(F.when(F.col("name") == name, F.col("v") * F.col("w"))).alias(name) for name in picks))
    return _ungrouped(out, by, "n", *picks)


def median(n: Column) -> list[tuple[Column, Column]]:
    return [(F.floor((n - 1) / 2), F.lit(0.5)), (F.floor(n / 2), F.lit(0.5))]


def nearest_rank(share: float) -> Callable[[Column], list[tuple[Column, Column]]]:
    """The value at round(share * n), halves to even, counted from 1."""
    return lambda n: [(F.least(F.greatest(F.bround(F.lit(share) * n).cast("long") - 1, F.lit(0)), n - 1), F.lit(1.0))]


def linear(share: float) -> Callable[[Column], list[tuple[Column, Column]]]:
    """Between the two values around share * (n - 1)."""
    def at(n: Column) -> list[tuple[Column, Column]]:
        h = F.lit(share) * (n - 1)
        return [(F.floor(h), 1 - (h - F.floor(h))), (F.ceil(h), h - F.floor(h))]

    return at


def auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, ones, zeros, auc): the chance that a row of label 1 scores above one of label 0, ties as half; null without both."""
    by = by or []
    counts = runs(rows.filter(F.col(label).isin(0, 1)), score, by, F.sum(F.when(F.col(label) == 1, _times(weight)).otherwise(0)).alias("p"), weight=weight)
    placed, _ = prefix(counts, ["v"], ["m"])
    x = placed.groupBy("_g").agg(F.sum(F.col("p") * mid_rank()).alias("r"), F.sum("p").cast("double").alias("ones"), (F.sum("m") - F.sum("p")).cast("double").alias("zeros"))
    return _ungrouped(x, by, F.col("ones").cast("long").alias("ones"), F.col("zeros").cast("long").alias("zeros"), F.try_divide(F.col("r") - F.col("ones") * (F.col("ones") + 1) / 2, F.col("ones") * F.col("zeros")).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, id: str, by: list[str] | None = None) -> DataFrame:
    """(by, ap): mean precision at the rows of label 1, by falling score, ties by id; null without any. Of rows alike in score and id the ones come first."""
    by = by or []
    counts = rows.filter(F.col(label).isin(0, 1)).groupBy(group(by).alias("_g"), (-F.col(score)).alias("low"), F.col(id).alias("i")).agg(F.count("*").alias("m"), F.sum(F.col(label).cast("long")).alias("p"))
    placed, _ = prefix(counts, ["low", "i"], ["m", "p"])
    each = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("p")), F.lit(0.0), lambda a, j: a + (F.col("p_before") + j) / (F.col("m_before") + j))
    x = placed.groupBy("_g").agg(F.sum(F.when(F.col("p") > 0, each).otherwise(0.0)).alias("s"), F.sum("p").alias("p"))
    return _ungrouped(x, by, F.try_divide("s", "p").alias("ap"))


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, n, rho): correlation of mid-ranks over rows that have both values; null if one is constant."""
    by = by or []
    pairs = sessions.cut(rows.dropna(subset=[x, y]).groupBy(group(by).alias("_g"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(_times(weight)).alias("w")))
    side = lambda c: prefix(pairs.groupBy("_g", c).agg(F.sum("w").alias("m")), [c], ["m"])
    (rx, offsets), (ry, _) = side("x"), side("y")
    n = offsets.groupBy("_g").agg(F.sum("m_sum").alias("n"))
    z = pairs.join(rx.select("_g", "x", mid_rank().alias("rx")), ["_g", "x"]).join(ry.select("_g", "y", mid_rank().alias("ry")), ["_g", "y"]).join(n, "_g")
    a, b = F.col("rx") - (F.col("n") + 1) / 2.0, F.col("ry") - (F.col("n") + 1) / 2.0
    s = z.groupBy("_g", "n").agg(F.sum(F.col("w") * a * b).alias("ab"), F.sum(F.col("w") * a * a).alias("aa"), F.sum(F.col("w") * b * b).alias("bb"))
    return _ungrouped(s, by, "n", F.try_divide("ab", F.sqrt("aa") * F.sqrt("bb")).alias("rho"))


def signed_ranks(differences: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, n, w_plus, w_minus, tied): sums of the mid-ranks of |d| over rising and falling rows, zeros dropped, and the sum of t**3 - t over runs of ties."""
    by = by or []
    d = differences.filter(F.col(value) != 0).withColumn("_size", F.abs(value)).withColumn("_up", F.col(value) > 0)
    placed, _ = prefix(runs(d, "_size", by, F.count_if("_up").alias("up")), ["v"], ["m"])
    t = F.col("m").cast("double")
    x = placed.groupBy("_g").agg(F.sum("m").alias("n"), F.sum(F.col("up") * mid_rank()).alias("w_plus"), F.sum((F.col("m") - F.col("up")) * mid_rank()).alias("w_minus"), F.sum(t * t * t - t).alias("tied"))
    return _ungrouped(x, by, "n", "w_plus", "w_minus", "tied")

"""Integrity gates over frames: each returns the rows that break it, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexroute.functions import sessions
from lexroute.functions.text import metric_tokens


def _found(df: DataFrame, gate: str, id: str) -> DataFrame:
    return df.select(F.lit(gate).alias("gate"), F.col(id).cast("string").alias("id"))


def structure(examples: DataFrame, id: str, query: str, labels: str | None = None, categories: tuple[str, list] | None = None, split: str | None = None) -> DataFrame:
    """(gate, id): repeated ids, blank queries, empty labels, unknown categories, ids in several splits."""
    out = _found(examples.groupBy(id).count().filter("count > 1"), "repeated_id", id)
    out = out.union(_found(examples.filter(F.coalesce(F.trim(F.col(query)), F.lit("")) == ""), "blank_query", id))
    if labels:
        out = out.union(_found(examples.filter(F.coalesce(F.size(labels), F.lit(0)) <= 0), "no_label", id))
    if categories:
        out = out.union(_found(examples.filter(~F.coalesce(F.col(categories[0]).isin(categories[1]), F.lit(False))), "unknown_category", id))
    if split:
        out = out.union(_found(examples.groupBy(id).agg(F.countDistinct(split).alias("n")).filter("n > 1"), "several_splits", id))
    return out


def grounding(quotes: DataFrame, chunks: DataFrame, id: str = "example_id", chunk: str = "doc_id", quote: str = "quote", text: str = "text") -> DataFrame:
    """(gate, id): quotes of chunks that are not there, and quotes that their chunk does not hold word for word, white space aside."""
    flat = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    orphan = _found(quotes.join(chunks.select(chunk), chunk, "left_anti"), "no_chunk", id)
    both = quotes.select(id, chunk, flat(quote).alias("_q")).join(chunks.select(chunk, flat(text).alias("_t")), chunk)
    return orphan.union(_found(both.filter(~F.coalesce(F.contains("_t", "_q"), F.lit(False))), "not_verbatim", id))


def same_ids(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """(gate, id): ids of one side only, and ids repeated on either: an empty frame allows a paired test."""
    twice = [_found(x.groupBy(id).count().filter("count > 1"), f"repeated_{n}", id) for x, n in ((a, "left"), (b, "right"))]
    return _found(a.join(b, id, "left_anti"), "left_only", id).union(_found(b.join(a, id, "left_anti"), "right_only", id)).union(twice[0]).union(twice[1])


def quotas(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """(column, expected, got) of each category whose number is not that of wanted (column, expected); unexpected ones expect none."""
    got = rows.groupBy(column).agg(F.count("*").alias("got"))
    both = wanted.join(got, column, "full_outer").select(column, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("got", F.lit(0)).alias("got"))
    return both.filter("expected <> got")


def duplicate_pairs(queries: DataFrame, threshold: float = 0.8, id: str = "query_id", text: str = "query") -> DataFrame:
    """(a, b, jaccard), a < b, of queries whose token sets are that alike.

    Queries of one token set are a class that its smallest id stands for: each of the others makes a row with it (jaccard 1, which no other pair
    has), and only those representatives are compared; so copies give as many rows as there are. Empty sets are a class, and unlike all others.
    Candidates share one of the rarest tokens of both: a set of n tokens has to share one of any
    n - ceil(threshold n) + 1 of its tokens with each set that is near it.
    """
    x = queries.select(F.col(id).alias("id"), F.array_sort(F.array_distinct(metric_tokens(F.col(text)))).alias("t"))
    classes = sessions.cut(x.groupBy("t").agg(F.min("id").alias("id")))
    copies = x.select(F.col("id").alias("b"), "t").join(classes.select(F.col("id").alias("a"), "t"), "t").filter("a < b").select("a", "b", F.lit(1.0).alias("s"))
    words = classes.select("id", F.explode("t").alias("w"))
    rank = Window.partitionBy("id").orderBy("df", "w")
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    sized = words.join(df, "w").join(classes.select("id", F.size("t").alias("n")), "id").withColumn("r", F.row_number().over(rank))
    prefix = sized.filter(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("id", "w")
    near = prefix.select(F.col("id").alias("a"), "w").join(prefix.select(F.col("id").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    score = F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))
    full = near.join(classes.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(classes.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    found = full.select("a", "b", score.alias("s")).filter(F.col("s") >= threshold)
    return found.select("a", "b", F.least(F.round("s", 4), F.lit(0.9999)).alias("jaccard")).union(copies.select("a", "b", "s"))


def accepted(pairs: DataFrame, queries: DataFrame, id: str = "query_id") -> DataFrame:
    """(id, matches): queries flagged by sequential acceptance in the order of ids, with the first accepted one that each is like.

    pairs as duplicate_pairs gives them. What is like a copy is like its representative, which comes before it, so only representatives take part in the rounds;
    a copy matches what its representative matches, or that one itself. Rounds settle every query whose earlier neighbours are
    settled; a chain of k look-alikes takes k rounds at most.
    """
    copies = pairs.filter("jaccard = 1").select(F.col("b").alias("id"), F.col("a").alias("rep"))
    state = queries.select(F.col(id).alias("id")).distinct().join(copies, "id", "left_anti").select("id", F.lit(None).cast("long").alias("matches"), F.lit(False).alias("done"))
    near = pairs.filter("jaccard < 1")
    while True:
        seen = near.join(state.select(F.col("id").alias("a"), F.col("matches").alias("m"), F.col("done").alias("d")), "a")
        told = seen.groupBy(F.col("b").alias("id")).agg(F.min(F.when(F.col("d") & F.col("m").isNull(), F.col("a"))).alias("hit"), F.min(F.when(~F.col("d"), F.col("a"))).alias("open"))
        x = state.join(told, "id", "left")
        settled = F.col("done") | F.col("open").isNull() | F.coalesce(F.col("hit") < F.col("open"), F.lit(False))
        state = sessions.cut(x.select("id", F.when(F.col("done"), F.col("matches")).when(settled, F.col("hit")).alias("matches"), settled.alias("done")))
        if state.filter("not done").isEmpty():
            break
    flagged = state.filter("matches is not null").select("id", "matches")
    followed = copies.join(flagged.select(F.col("id").alias("rep"), "matches"), "rep", "left").select("id", F.coalesce("matches", "rep").alias("matches"))
    return flagged.union(followed).select(F.col("id").alias(id), "matches")


def contaminated(runs: DataFrame, arm: str, id: str, status: str = "status") -> DataFrame:
    """(gate, id) of the runs that are not ok, a null status included; an arm with any must not be compared. The gate names the arm."""
    bad = runs.filter(~F.coalesce(F.col(status) == "ok", F.lit(False)))
    return bad.select(F.concat(F.lit("not_ok:"), F.coalesce(F.col(arm).cast("string"), F.lit(""))).alias("gate"), F.col(id).cast("string").alias("id"))


def coverage(runs: DataFrame, expected: DataFrame, id: str) -> DataFrame:
    """(gate, id) of expected ids that no run has, of runs that are not expected, and of ids that ran twice."""
    have, want = runs.select(id), expected.select(id).distinct()
    twice = have.groupBy(id).count().filter("count > 1")
    return _found(want.join(have, id, "left_anti"), "not_run", id).union(_found(have.join(want, id, "left_anti").distinct(), "not_expected", id)).union(_found(twice, "ran_twice", id))


def unequal(frozen: DataFrame, again: DataFrame, id: str, values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(gate, id) of every value that a recomputation gives otherwise: apart by more than tolerance, or null on one side only. The gate names the value."""
    x = frozen.alias("a").join(again.alias("b"), id)
    off = lambda v: ~F.coalesce(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) <= tolerance, F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")))
    wrong = F.explode(F.array(*(F.when(off(v), F.lit(v)) for v in values)))
    return x.select(id, wrong.alias("v")).filter("v is not null").select(F.concat(F.lit("unequal:"), "v").alias("gate"), F.col(id).cast("string").alias("id"))

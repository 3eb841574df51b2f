"""Exact dedup of texts by a heavy-hitter split, in DataFrame functions alone.

Texts are equal if they are once every run of white space ([\\x20\\x09-\\x0D]+) is one space;
they are told apart by the SHA-256 of that form.

1. Every task counts its digests in a Misra-Gries summary (Spark's frequent-items sketch: at most
   2 * TRACKED counters, all lowered together when they run out); summaries are merged, so
   what travels does not grow with the rows of a task. A digest of more than HOT_SHARE of all rows is
   always among the MOST that come out: a summary errs by less than 2.7e-5 of the rows, so at most
   1 / (HOT_SHARE - 2.7e-5) < MOST digests are estimated above HOT_SHARE.
2. Those candidates are counted exactly (one row for each task and candidate travels) and verified: the ones
   that do exceed HOT_SHARE, at most 1 / HOT_SHARE of them, are broadcast with the row that stays of each.
   Their copies are dropped where they lie.
3. The other digests go through an ordinary shuffle; no group there has more than HOT_SHARE of all rows.

Of equal texts the row of smallest doc_id stays. Null text counts as empty, so all null, empty and absent
texts are one group, white space alone is another. A null doc_id comes after all others. Of repeated
rows, and of equal texts with one doc_id, just one stays (the first as the table is read). An empty table gives
no rows. Very long texts are hashed whole, where they lie. Other columns, whatever their names, pass through `keep_one`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexroute.llm.sparkops import boxed, durable, quoted, unboxed

SPACES = r"[\x20\x09-\x0D]+"
#: Counters of a summary at least; share of rows from which a digest is hot; candidates that are looked at.
TRACKED, HOT_SHARE, MOST = 1 << 16, 1e-4, 1 << 14
#: Summaries are merged in so many groups first, then all together.
GROUPS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _digested(docs: DataFrame, text: str, id: str, *more: Column) -> DataFrame:
    """(doc_id, digest, at): at numbers the rows once they are stored."""
    digest = F.unhex(F.sha2(normalised(quoted(text)), 256))
    return durable(docs.select(quoted(id).cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("at"), *more))


def frequent(rows: DataFrame) -> DataFrame:
    """(key): the 64-bit hashes of the digests that a merged Misra-Gries summary holds as most frequent, at most MOST."""
    keyed = rows.select(F.xxhash64("digest").alias("key"), (F.spark_partition_id() % GROUPS).alias("part"))
    some = keyed.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("s"))
    # grouped by a constant: without a key, Spark 4.1 can't send on the summary of a task that met no row
    top = some.groupBy((F.col("part") * 0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {MOST})")).alias("x"))
    return top.select("x.item").toDF("key")


def _first() -> Column:
    """Smallest doc_id, nulls last, then the first row."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("at"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, n, first) of the digests that more than HOT_SHARE of all rows have, counted exactly."""
    total = rows.count()
    if not total:
        return durable(rows.limit(0).groupBy("digest").agg(F.count("*").alias("n"), F.min(_first()).alias("first")))
    seen = F.broadcast(frequent(rows))  # at most MOST rows
    held = rows.join(seen, F.xxhash64("digest") == F.col("key"), "left_semi").groupBy("digest").agg(F.count("*").alias("n"), F.min(_first()).alias("first"))
    return durable(held.filter(F.col("n") > HOT_SHARE * total))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of hot digests with n and first, and the rows of all others."""
    hot = winners(rows)  # at most 1 / HOT_SHARE rows
    return rows.join(F.broadcast(hot), "digest"), rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")


def _grouped(rest: DataFrame) -> DataFrame:
    alike = Window.partitionBy("digest")
    return rest.withColumns({"n": F.count("*").over(alike), "first": F.min(_first()).over(alike)})


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256."""
    near, rest = _split(_digested(docs, text, id))
    rest = _grouped(rest)
    return near.select(rest.columns).union(rest).select("doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("first.at")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs without later copies. Texts of hot groups do not travel; of the others only what is not unique is named, then left out."""
    rows = _digested(docs, text, id, boxed(docs).alias("row"))
    near, rest = _split(rows)
    later = durable(_grouped(rest.select("digest", "doc_id", "at")).filter("at <> first.at").select("at"))
    out = near.filter("at = first.at").select("row").union(rest.join(later, "at", "left_anti").select("row"))
    return unboxed(out, "row", docs.schema)

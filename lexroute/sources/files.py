"""Sources and sinks: manifests, JSON lines, flat exports, checked reads, upserts and resumable appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def manifest(spark: SparkSession, path: str, only_id: str | None = None, limit: int | None = None) -> DataFrame:
    """A JSON array of entries, one row each; optionally one id, or the first so many by id."""
    out = spark.read.option("multiLine", True).json(path)
    out = out if only_id is None else out.filter(F.col("id") == only_id)
    return out if limit is None else out.orderBy("id").limit(limit)


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a declared schema; a malformed line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines with native lists; nulls are written."""
    df.write.option("ignoreNullFields", False).json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A CSV with header; list columns are joined by line ends."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), "\n").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("quoteAll", True).csv(path)


def verified(df: DataFrame, content: Column, checksum: Column) -> DataFrame:
    """Rows whose content has the stated SHA-256; the comparison is null-safe, so missing content fails."""
    return df.filter(F.sha2(content, 256).eqNullSafe(checksum) & content.isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key new lacks; of repeated keys in new, the first by all columns."""
    order = [F.col(c).cast("string") for c in new.columns if c not in keys]
    once = new.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).filter("_rank = 1").drop("_rank")
    return old.join(once.select(*keys), keys, "left_anti").unionByName(once)


def misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct rows whose key the cache lacks."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted run has left to do."""
    return todo.join(done.select(key), key, "left_anti")

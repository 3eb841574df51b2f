"""Content-addressed caches as Parquet, and vectors as text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType


def embedding_key(text: Column, model: str, host: str, dimensions: int | None, normalize: bool, version: str) -> Column:
    """SHA-256 over everything that a vector depends on; null for null text."""
    return F.sha2(F.concat(F.lit(f"{version}|{model}|{host}|{dimensions}|{normalize}|"), F.sha2(text, 256)), 256)


def judge_key(prompt: str, model: str, query: Column, answer: Column, reference: Column) -> Column:
    """SHA-256 over the inputs of a judgement; null if one is."""
    return F.sha2(F.concat(F.lit(f"{prompt}|{model}|"), query, F.lit("|"), answer, F.lit("|"), reference), 256)


class Cache:
    """(key, value, put) rows in one Parquet folder: puts append, the newest put of a key holds.

    Appends never rewrite what is there; compact() does, into another folder. Two writers at once lose
    nothing; of equal times the larger value holds. `value` is any column type that can be ordered.
    """

    def __init__(self, spark: SparkSession, path: str, value: str):
        self.spark, self.path, self.schema = spark, path, f"key string, value {value}, put timestamp"

    def rows(self) -> DataFrame:
        """One row a key; none before the first put."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema).select("key", "value")
        every = self.spark.read.schema(self.schema).parquet(self.path)
        return every.groupBy("key").agg(F.max_by("value", F.struct("put", "value")).alias("value"))

    def put(self, rows: DataFrame) -> None:
        """Keeps (key, value) rows; those with a null key or value are left out."""
        fresh = rows.filter("key is not null and value is not null").select("key", "value", F.current_timestamp().alias("put"))
        fresh.write.mode("append").parquet(self.path)

    def count(self) -> int:
        return self.rows().count()

    def compact(self, path: str) -> Cache:
        """The same in a new folder, one row a key."""
        out = Cache(self.spark, path, self.schema.split("value ", 1)[1].rsplit(", put", 1)[0])
        out.put(self.rows())
        return out

    def through(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """wanted with value; compute gets one row of each key that is missing, and what it returns (key, value) is kept.

        compute runs once: its rows are written before they are joined. Rows with a null key have a null value.
        """
        missing = wanted.filter("key is not null").dropDuplicates(["key"]).join(self.rows().select("key"), "key", "left_anti")
        self.put(compute(missing))
        return wanted.join(self.rows(), "key", "left")


@F.pandas_udf(StringType())
def packed(vector: pd.Series) -> pd.Series:
    """A vector as base64 of little-endian 32-bit floats; null stays null."""
    from base64 import b64encode

    return vector.map(lambda v: None if v is None else b64encode(np.asarray(v, "<f4").tobytes()).decode())


@F.pandas_udf(ArrayType(FloatType()))
def unpacked(text: pd.Series) -> pd.Series:
    """What packed() wrote; null stays null, and what is no whole number of floats ends the job."""
    from base64 import b64decode

    return text.map(lambda t: None if t is None else np.frombuffer(b64decode(t, validate=True), "<f4"))


def embed(texts: list[str], call: Callable[[list[str]], list], batch: int, refuses: type[Exception]) -> list:
    """Vectors of texts, so many a call; a batch that is refused is cut in halves down to single texts, whose refusal ends the job."""
    out = []
    for k in range(0, len(texts), max(1, batch)):
        stack = [texts[k : k + max(1, batch)]]
        while stack:
            part = stack.pop()
            try:
                out += call(part)
            except refuses:
                if len(part) == 1:
                    raise
                stack += [part[len(part) // 2 :], part[: len(part) // 2]]
    return out


def dimension_checked(rows: DataFrame, column: str, dimension: int) -> DataFrame:
    """rows; one whose vector has another length, or is null, ends the job."""
    n = F.coalesce(F.size(column), F.lit(-1))
    wrong = F.raise_error(F.concat(F.lit(f"{column} needs {dimension} places, got "), n.cast("string"))).cast(rows.schema[column].dataType)
    return rows.withColumn(column, F.when(n == dimension, F.col(column)).otherwise(wrong))

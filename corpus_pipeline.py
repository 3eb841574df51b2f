"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet to the folder that all machines share and rereads it as
the next stage's docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexroute.llm import langid, neardup, packing, rules, substring
from lexroute.llm.sparkops import dropped, forget_at_exit, scratch, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or is probably bad by the weakly supervised ones."""
    return rules.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those below the calibrated score."""
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words that also stand elsewhere; n_chars follows the text."""
    out = substring.remove(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 ids."""
    return packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_rules, language_id, near_dedup, substring_dedup, best_fit_packing)]

#: Stages learn models and compare sets: not expressible in SQL, so tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        with scratch():  # what a stage stored on its way is not read again
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        docs.stored_at = f"{folder}/{k}-{name}"
        if before is None:
            forget_at_exit(spark, folder)
        else:
            dropped(before)
        before = docs
    return docs

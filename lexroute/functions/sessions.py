"""What a session tells about the cluster."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Shuffle files of a finished SQL execution are deleted at its end, not when the collector of garbage meets them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPLIT = "spark.sql.files.maxPartitionBytes"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it; one of our own in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="lexroute-")
    return _own[key]


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written or cut within the block leaves no shuffle files behind."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


@contextmanager
def splits_of(spark: SparkSession, most: int) -> Iterator[None]:
    """What is read from files within the block goes to tasks of at most so many bytes, or fewer if the session says so: what a task sorts, and spills, is bounded."""
    before = spark.conf.get(_SPLIT, None)
    spark.conf.set(_SPLIT, min(most, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SPLIT)
        else:
            spark.conf.set(_SPLIT, before)


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; the shuffle files it took are deleted."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    with shuffles_deleted(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, made under the switch

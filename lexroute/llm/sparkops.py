"""Spark helpers shared by the operators of this package."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a finished SQL execution are deleted at its end, not when the collector of garbage meets them.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it; one of our own in local mode alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexroute-"))


#: Frames stored within each scratch() that is open.
_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """For a caller that writes its result within the block: what durable() stored in it is deleted at its end."""
    _open.append([])
    try:
        yield
    finally:
        dropped(*_open.pop())


def _stored(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends, if nobody deletes it before."""
    where, fs = _stored(spark, path)
    fs.deleteOnExit(where)


def durable(df: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    Shuffle files of what came before are deleted as soon as it is written. The Parquet itself goes with
    dropped(), at the end of a scratch() around, or with the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    forget_at_exit(spark, path)
    if _open:
        _open[-1].append(out)
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what durable() wrote, once nothing reads it any more."""
    for df in frames:
        where, fs = _stored(df.sparkSession, df.stored_at)
        fs.delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of an id as text, modulo modulus (null: null)."""
    return F.crc32(F.col(column).cast("string")) % modulus


def width(df: DataFrame) -> int:
    """Shuffle partitions of the session, for repartition() by key."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quoted(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame):
    """All columns of docs as one struct, so that none can clash with an operator's own; unboxed() undoes it."""
    return F.struct(*(quoted(c) for c in docs.columns))


def unboxed(df: DataFrame, box: str, schema) -> DataFrame:
    return df.select(*(F.col(box).getField(f.name).alias(f.name, metadata=f.metadata) for f in schema.fields))


#: Links that one task may hold to join them by itself.
LOCAL_LINKS = 1 << 19


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the links (a, b) and the smallest one reachable from it."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[x], low[y])
        if (low[x] == m).all() and (low[y] == m).all():
            return ids, ids[low]
        np.minimum.at(low, low[x], m)
        np.minimum.at(low, low[y], m)
        while (low[low] != low).any():
            low = low[low]


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(id, component) of every id in the links (a, b): the smallest id reachable.

    Links are dealt to tasks of at most about `local` each; a task joins its own and returns
    one link for each end to the smallest of its part. If a single task had them all, these are
    the labels. Otherwise rounds follow that label each id with the smallest next to it and contract
    the links to their labels, until no link is left between different labels. The smallest
    id of a component always keeps its own label, so it is the one that remains.
    """

    def part(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            ids, low = joined(t.column(0).to_numpy(), t.column(1).to_numpy())
            for i in range(0, len(ids), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + (1 << 16)]), pa.array(low[i : i + (1 << 16)])], ["id", "component"])

    links = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    parts = max(1, math.ceil(links.count() / local))
    stars = durable((links.coalesce(1) if parts == 1 else links.repartition(parts, "a", "b")).mapInArrow(part, "id long, component long"))
    dropped(links)
    if parts == 1:
        return stars
    rest = durable(stars.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).distinct())
    dropped(stars)
    labels = None
    while True:
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = durable(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("low")))
        if labels is None:
            labels = low.withColumnRenamed("low", "component")
        else:
            labels = durable(labels.join(low.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("low", "component").alias("component")))
        ends = rest.join(low.select(F.col("id").alias("a"), F.col("low").alias("x")), "a").join(low.select(F.col("id").alias("b"), F.col("low").alias("y")), "b")
        after = durable(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        dropped(rest)
        rest = after
        if rest.isEmpty():
            return labels


#: Bits of a sieve at most, so what is broadcast is bounded (16 MB); a fuller sieve only lets more through.
SIEVE_BITS, SIEVE_SLOT = 1 << 27, 1 << 16


def _sieve_places(h: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and the two bits within it of each hash."""
    x = h * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return ((x >> np.uint64(36)) % np.uint64(slots)).astype(np.int64), (x & np.uint64(SIEVE_SLOT - 1)).astype(np.int64), ((x >> np.uint64(16)) & np.uint64(SIEVE_SLOT - 1)).astype(np.int64)


class Sieve:
    """Lets through all hashes of a set and few others, to spare them a shuffle; what is let through is joined exactly."""

    def __init__(self, keys: DataFrame, column: str = "h"):
        n = keys.count()
        self.slots = slots = int(min(SIEVE_BITS, max(1, n) * 10) // SIEVE_SLOT + 1)

        def dealt(batches):
            for batch in batches:
                s, i, j = _sieve_places(batch.column(0).to_numpy().view(np.uint64), slots)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array((i << 16 | j).astype(np.uint32).view(np.int32))], ["slot", "bits"])

        def fill(batches):
            made: dict[int, np.ndarray] = {}
            for batch in batches:
                s, x = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint32)
                order = np.argsort(s, kind="stable")
                s, x = s[order], x[order]
                for a, b in zip(e := np.flatnonzero(np.diff(s, prepend=-1)), np.append(e[1:], len(s))):
                    bits = made.setdefault(int(s[a]), np.zeros(SIEVE_SLOT, bool))
                    bits[x[a:b] >> np.uint32(16)] = True
                    bits[x[a:b] & np.uint32(0xFFFF)] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in made.values()], pa.binary())], ["slot", "bits"])

        rows = keys.select(column).mapInArrow(dealt, "slot long, bits int").repartition(min(width(keys), slots), "slot").mapInArrow(fill, "slot long, bits binary")
        table = np.zeros((slots, SIEVE_SLOT // 8), np.uint8)
        for batch in rows.toArrow().to_batches():  # at most SIEVE_BITS
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[s] = np.frombuffer(x, np.uint8)
        self.shared = keys.sparkSession.sparkContext.broadcast(table.ravel())

    def passes(self, h: np.ndarray) -> np.ndarray:
        table = self.shared.value
        s, i, j = _sieve_places(h, self.slots)
        base, ok = s * SIEVE_SLOT, np.ones(len(h), bool)
        for k in (i, j):
            bit = base + k
            ok &= (table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return ok


#: Share of all rows from which a key counts as hot: there can be at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1e-4


def join_by_count(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with keys, which has one row for each key and in n how many rows it has.

    Hot keys (at most 1 / HOT_SHARE) are broadcast, so their rows stay where they are; all others are
    shuffled. Both frames should be durable, as each is read twice.
    """
    hot, cold = keys.filter(F.col(n) > HOT_SHARE * total), keys.filter(F.col(n) <= HOT_SHARE * total)
    near = rows.join(F.broadcast(hot.drop(n)), on)
    far = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold.drop(n), on)
    return near.select(*far.columns).union(far)

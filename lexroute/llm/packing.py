"""Best-fit packing with exact-complement hashing.

Documents become pieces of at most CAPACITY ids. How to pack depends on the
histogram of piece lengths alone, which has CAPACITY entries whatever the
corpus: it is all that the driver sees.

Planning works on counts of lengths. For each length, longest first, the gap to
the capacity is looked up among the lengths (one filler), the pair sums and the
triple sums of lengths still available; a combination that fills the gap
exactly is used as often as its availability counts allow. What no exact
complement serves is best-fitted: longest first into the open sequences with
the smallest gap that still takes it. Each step empties a length or a class of
alike sequences, so the plan's size is bounded by the number of lengths, not by
that of the documents.

The plan says which ranks of each length go to which sequences. A piece's rank
is its index among the alike pieces of its task, recorded in the piece's
row and made durable with it, plus those of the tasks before.

Null text: empty, one piece of the closing id. Repeated rows and ids are packed
like any others. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexroute.llm.bpe import coder, default_path
from lexroute.llm.sparkops import durable
from lexroute.llm.textops import blocks

CAPACITY, CLOSING = 2048, 0


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids: full ones, a shorter one first."""
    if n <= capacity:
        return [n]
    rest = n % capacity
    return [rest] * bool(rest) + [capacity] * (n // capacity)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} is not in 1..{capacity}")
        left[n] = c
    done: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
            done.append((lengths, times))
        return times

    def one(gap: int, most: int):
        return [(gap,)] if 0 < gap <= most and left[gap] else []

    def two(gap: int, most: int):
        a = np.arange(max(1, gap - most), gap // 2 + 1)
        a = a[(left[a] > 0) & (left[gap - a] > 0)] if len(a) else a
        return [(gap - int(x), int(x)) for x in a[::-1]]

    for top in range(capacity, 0, -1):
        gap = capacity - top
        if not left[top]:
            continue
        if not gap:
            take((top,))
            continue
        for combos in (one, two):
            for rest in combos(gap, top):
                if not left[top]:
                    break
                take((top, *rest))
        # triples: the largest filler, then a pair for what remains
        for first in range(min(gap - 2, top), 0, -1):
            if not left[top]:
                break
            if left[first]:
                for rest in two(gap - first, first):
                    if not take((top, first, *rest)) and not (left[top] and left[first]):
                        break
    # best fit of the rest: open[g] are classes of alike sequences with a gap g
    open_: dict[int, list[list]] = defaultdict(list)
    gaps = np.zeros(capacity + 1, np.int64)
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            fit = np.flatnonzero(gaps[n:])
            if len(fit):
                g = n + int(fit[0])
                lengths, times = open_[g][-1]
                per, k = 1, min(todo, times)
                if g >= 2 * n and todo >= 2 * times:  # alike sequences take several each
                    per = min(g // n, todo // times)
                    k = times
                open_[g][-1][1] -= k
                gaps[g] -= k
                if not open_[g][-1][1]:
                    open_[g].pop()
                used = k * per
            else:
                g, lengths, per = capacity, (), min(capacity // n, todo)
                k = todo // per
                used = k * per
            rest = g - n * per
            if rest:
                open_[rest].append([lengths + (n,) * per, k])
                gaps[rest] += k
            else:
                done.append((lengths + (n,) * per, k))
            todo -= used
    for classes in open_.values():
        done += [(lengths, times) for lengths, times in classes if times]
    return done


def intervals(packing: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: ranks from lo on, of a length, go to sequence seq on, seq+1 and so on, at an offset."""
    rows, rank, seq = [], defaultdict(int), 0
    for lengths, times in packing:
        at = 0
        for n in lengths:
            rows.append((n, rank[n], seq, at))
            rank[n] += times
            at += n
        seq += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "lo": cols[1], "seq": cols[2], "at": cols[3]}


def encode_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, with the task that made them and the rank among its alike pieces."""
    path = path or default_path()

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        bpe, seen = coder(path), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                rows: list[list] = [[] for _ in range(6)]
                of = []
                ids, at = bpe.encode_block(data, off)
                raws, closing = ids.astype("<u4").tobytes(), np.array([CLOSING], "<u4").tobytes()
                for k, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist())):
                    raw, start = raws[4 * x : 4 * y] + closing, 0
                    for i, n in enumerate(cut_lengths(y - x + 1, capacity)):
                        of.append(a + k)
                        for out, x in zip(rows, (i, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), task, int(seen[n]))):
                            out.append(x)
                        seen[n] += 1
                        start += n
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(x, t) for x, t in zip(rows, kinds))], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: its ids' place in the document and in a sequence."""
    made = durable(encode_pieces(docs, path, capacity))
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    # at most one row for each task and length: a small table, summed up by length
    before = per_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = intervals(plan(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the number of lengths

    def place(batches):
        t = shared.value
        key = t["length"] << 40 | t["lo"]
        for batch in batches:
            n, rank = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "rank"))
            i = np.searchsorted(key, n << 40 | rank, "right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t["seq"][i] + rank - t["lo"][i]), pa.array(t["at"][i])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(before, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    kind = made.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Language-model scores from a log-frequency Bloom filter.

Training texts give counts of words and of word pairs (a text's start and end
count as context and token). A count n is quantised to its level, the number of
bounds 1, 2, 3, 4, 5, 7, 9, 12, ... (each BASE times the last, or one more) that it reaches,
and an n-gram of level q is put into the filter q times, as (n-gram, 1) to (n-gram, q). A reader
probes 1, 2, ... until one is missing and so recovers the level; a false positive can only
raise it. A level is read as the geometric mean of its counts; counts up to 5 are exact. A worker remembers
levels it has read, in PLACES of 9 bytes, as frequent n-grams take the most probes.

The filter is cut into slots of SLOT_BITS; an n-gram's bits all lie in one slot,
so slots are built apart, by the workers, and joined end to end. Its size
follows the n-grams put in, at BITS for each: all words and pairs, also those met once. Up to
BROADCAST_BYTES it is one broadcast. A larger one stays dealt to the workers in parts of
PART_BYTES: n-grams of each block of texts are sent to the parts that tell of them, once each, and
levels come back to the block. Work and traffic follow the text either way, and levels are the same.

The filter also holds, for each context h (by 28 bits of its hash), the number of its different
followers, and scores are by absolute discounting with D = DISCOUNT:

P(w | h) = max(0, n(h w) - D) / n(h) + D followers(h) / n(h) * P(w),  P(w) = (n(w) + 0.5) / (N + 0.5 (V + 1)),

the first term held to what the second leaves of 1. A context never met gives P(w) alone.

The plain unigram figure uses exact counts: those of the words with a share of HOT or more (so at most
1 / HOT words) travel to the workers, those of all others are joined. Words are told apart by 63-bit
hashes (a million words collide with a chance of 1 in 18 million).

Null and empty texts: one token, the end. Repeated rows are scored alike. Other
columns are ignored. With no training text N = V = 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import dropped, durable, width
from lexroute.llm.textops import LOWER, blocks, byte_prefix, mix, utf8, word_spans

BASE, DISCOUNT, BITS, PROBES, SLOT_BITS = 1.25, 0.75, 10, 4, 1 << 12
FOLLOW = 0x2FE94F82A
BROADCAST_BYTES, PART_BYTES, HOT, BLOCK, ASKED = 128 << 20, 4 << 20, 1e-6, 1 << 20, 1 << 22
#: N-grams probed together, so that what is probed stays near the processor, and the levels up to which they are.
TOGETHER, FIRST = 1 << 14, 8
#: Places of a worker's memory of levels, 9 bytes each, and the least level that is kept there.
PLACES, KEPT = 1 << 20, 4
_END, _START = np.uint64(0x1B873593CC9E2D50), np.uint64(0xE6546B64A1B2C3D4)


def bounds() -> np.ndarray:
    """The least count of each level."""
    out = [1]
    while out[-1] < 1 << 60:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * BASE)))
    return np.array(out, np.int64)


BOUNDS = bounds()
#: What a level is read as; level 0 as a count of none.
READ = np.concatenate([[0.0], np.sqrt(BOUNDS.astype(float) * (np.append(BOUNDS[1:], BOUNDS[-1] + 1) - 1))])
LEVELS = len(BOUNDS)


def level(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(BOUNDS, n, "right")


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (ends included), those of the tokens before them, and the text of each."""
    data = LOWER[data]
    s, e, first = word_spans(data, off)
    n = len(off) - 1
    at = first[1:] + np.arange(n)
    h = np.insert(single(byte_prefix(data).of(s, e)), first[1:], _END)
    prev = np.roll(h, 1)
    prev[np.concatenate([[0], at[:-1] + 1])[:n]] = _START
    return h, prev, np.repeat(np.arange(n), np.diff(first) + 1)


#: A pair's key: 28 bits of its context, 35 of the pair, a one. A word's key ends in a zero.
CONTEXT = np.uint64(0xFFFFFFF000000000)


def context_bits(prev: np.ndarray) -> np.ndarray:
    return mix(prev * np.uint64(0xC2B2AE3D27D4EB4F)) & CONTEXT


def pair(prev: np.ndarray, h: np.ndarray) -> np.ndarray:
    return context_bits(prev) | (mix(prev * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(28)) | np.uint64(1)


def single(h: np.ndarray) -> np.ndarray:
    return h & ~np.uint64(1)


def following(prev: np.ndarray) -> np.ndarray:
    """Key of the sum of a context's pairs."""
    return context_bits(prev) | np.uint64(FOLLOW)


def spread(h: np.ndarray) -> np.ndarray:
    return h * np.uint64(0xD6E8FEB86659FD93)


def bits_of(h: np.ndarray, lev: np.ndarray) -> np.ndarray:
    """A 64-bit number whose lowest fields name the PROBES bits of (n-gram, level) within their slot."""
    return mix(spread(h) + np.asarray(lev).astype(np.uint64))


def field(bits: np.ndarray, probe: int) -> np.ndarray:
    return ((bits >> np.uint64(12 * probe)) & np.uint64(SLOT_BITS - 1)).astype(np.int64)


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)) % np.uint64(slots)).astype(np.int64)


class Memory:
    """Levels that a worker has read from a filter, of n-grams met often: one n-gram a place, the last one stays."""

    def __init__(self):
        self.keys, self.levels = np.zeros(PLACES, np.uint64), np.zeros(PLACES, np.uint8)

    def place(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(3)) ^ (h >> np.uint64(28)) ^ (h >> np.uint64(45))).view(np.int64) & (PLACES - 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Their levels, 0 if not known."""
        at = self.place(h)
        return np.where(self.keys[at] == h, self.levels[at], 0).astype(np.int64)

    def keep(self, h: np.ndarray, levels: np.ndarray) -> None:
        on = np.flatnonzero(levels >= KEPT)
        at, h, levels = self.place(h[on]), h[on], levels[on]
        self.keys[at] = h
        same = self.keys[at] == h  # of several at one place, whichever was written last
        self.levels[at[same]] = levels[same]


_memories: list[tuple[np.ndarray, Memory]] = []


def memory_of(table: np.ndarray) -> Memory:
    """This worker's memory of a filter, kept for its next tasks."""
    if not _memories or _memories[0][0] is not table:
        _memories[:] = [(table, Memory())]
    return _memories[0][1]


def put(table: np.ndarray, base: np.ndarray, key: np.ndarray, q: int) -> np.ndarray:
    """Those whose bits of level q are all set, by number; base: the first byte of their slots, key: spread()."""
    bits, ok = mix(key + np.uint64(q)), None
    for p in range(PROBES):
        bit = field(bits, p)
        one = table[base + (bit >> 3)] >> (bit & 7).astype(np.uint8)
        ok = one if ok is None else ok & one
    return np.flatnonzero(ok & 1)


def levels_in(table: np.ndarray, slots: int, h: np.ndarray, first: int = 0, memory: Memory | None = None) -> np.ndarray:
    """The level of each n-gram, by probing until one is missing; 0 if the first is. The table starts at slot first.

    N-grams are probed in the order of their slots, so that memory is read from end to end. What a memory knows
    is not probed again: frequent n-grams have the most levels, and most probes were theirs.
    """
    if memory is not None:
        out = memory.of(h)
        new = np.flatnonzero(out == 0)
        asked = h[new]
        out[new] = found = levels_in(table, slots, asked, first)
        memory.keep(asked, found)
        return out
    slot = slot_of(h, slots) - first
    order = np.argsort(slot)
    base, key = slot[order] * (SLOT_BITS >> 3), spread(h[order])
    out, rest = np.zeros(len(h), np.int64), []

    def probed(x, levels):
        for q in levels:
            on = put(table, x[1], x[2], q)
            x = [y[on] for y in x]
            if not len(on):
                break
            out[x[0]] = q
        return x

    for a in range(0, len(h), TOGETHER):
        rest.append(probed([y[a : a + TOGETHER] for y in (order, base, key)], range(1, FIRST + 1)))
    if rest:
        probed([np.concatenate(y) for y in zip(*rest)], range(FIRST + 1, LEVELS + 1))
    return out


def gram_counts(docs: DataFrame, most: int = 1 << 22) -> DataFrame:
    """(h, n): keys of words, ends, starts and pairs with their counts."""

    def merged(held):
        h = np.concatenate([k for k, _ in held])
        order = np.argsort(h)
        h, n = h[order], np.concatenate([n for _, n in held])[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        h, n = h[at].view(np.int64), np.add.reduceat(n, at)
        for i in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)], pa.int64())], ["h", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in blocks(batch.column(0), BLOCK):
                h, prev, _ = tokens(data, off)
                held.append(np.unique(np.concatenate([h, np.full(len(off) - 1, _START), pair(prev, h)]), return_counts=True))
                size += len(data)
                if size >= most:
                    yield from merged(held)
                    held, size = [], 0
        if held:
            yield from merged(held)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def build(grams: DataFrame) -> tuple[DataFrame, int]:
    """The filter as (slot, bits), durable, and its number of slots."""
    context = F.col("h").bitwiseAND(F.lit(int(CONTEXT.view(np.int64))).cast("long"))
    follow = grams.filter("h & 1 = 1").groupBy(context.alias("context")).agg(F.count("*").alias("n"))
    follow = durable(follow.select(F.col("context").bitwiseOR(F.lit(FOLLOW).cast("long")).alias("h"), "n"))
    put = grams.union(follow)

    exact = int(np.flatnonzero(np.diff(BOUNDS) > 1)[0]) + 1  # counts up to here are levels of their own
    about = F.when(F.col("n") <= exact, F.col("n")).otherwise(exact + F.ceil(F.log(F.col("n") / exact) / math.log(BASE)))
    cost = put.agg(F.coalesce(F.sum(about), F.lit(0))).first()[0]
    slots = max(1, math.ceil(cost * BITS / SLOT_BITS))

    def dealt(batches):
        for batch in batches:
            h = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(slot_of(h.view(np.uint64), slots)), batch.column(0), pa.array(level(batch.column(1).to_numpy()), pa.int16())], ["slot", "h", "q"])

    def fill(batches):
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]  # about 4096 slots
        if held:
            slot, h, q = (np.concatenate(x) for x in zip(*held))
            names, at = np.unique(slot, return_inverse=True)
            rows = np.repeat(np.arange(len(h)), q)
            made = bits_of(h.view(np.uint64)[rows], np.arange(len(rows)) - np.repeat(np.cumsum(q, dtype=np.int64) - q, q) + 1)
            own = np.zeros(len(names) * SLOT_BITS, bool)
            for p in range(PROBES):
                own[at[rows] * SLOT_BITS + field(made, p)] = True
            packed = np.packbits(own, bitorder="little").reshape(len(names), -1)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([v.tobytes() for v in packed], pa.binary())], ["slot", "bits"])

    made = durable(put.mapInArrow(dealt, "slot long, h long, q short").repartition(max(width(grams), slots // 4096), "slot").mapInArrow(fill, "slot long, bits binary"))
    dropped(follow)
    return made, slots


def whole(made: DataFrame, slots: int) -> np.ndarray:
    """The filter as one array of at most BROADCAST_BYTES, fetched in slices."""
    table = np.zeros((slots, SLOT_BITS // 8), np.uint8)
    for first in range(0, slots, 1 << 14):
        for batch in made.filter(F.col("slot").between(first, first + (1 << 14) - 1)).toArrow().to_batches():
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[s] = np.frombuffer(x, np.uint8)
    return table.ravel()


class Block:
    """Tokens of a block of texts, and the n-grams whose levels its scores need."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.n = len(off) - 1
        h, prev, self.row = tokens(data, off)
        self.words, self.at = np.unique(h, return_inverse=True)
        self.first = np.searchsorted(self.row, np.arange(self.n))
        v = np.append(self.words, _START)
        self.grams = np.concatenate([v, following(v), pair(prev, h)])

    def columns(self, levels: np.ndarray, hot: np.ndarray, often: np.ndarray, norm: float) -> list[pa.Array]:
        """n_tokens, score, and of the base score: the part of hot words, their number, the other words and their numbers."""
        m = len(self.words) + 1
        of_word, followers, two = np.split(READ[levels], [m, 2 * m])
        context, seen = np.roll(of_word[self.at], 1), np.roll(followers[self.at], 1)
        context[self.first], seen[self.first] = of_word[-1], followers[-1]
        plain = (of_word[self.at] + 0.5) / norm
        met = (context > 0) & (seen > 0)
        context = np.maximum(context, 1)
        left = np.where(met, np.minimum(1.0, DISCOUNT * seen / context), 1.0)
        p = np.where(met, np.minimum(np.maximum(two - DISCOUNT, 0) / context, 1 - left), 0.0) + left * plain
        i = np.searchsorted(hot[:-1], self.words)
        c = np.where(hot[i] == self.words, often[i], 0)[self.at]
        known = c > 0
        logs = np.bincount(self.row[known], np.log10(c[known] + 0.5), self.n)
        cold, times = np.unique(self.row[~known] * len(self.words) + self.at[~known], return_counts=True)
        ends = pa.array(np.searchsorted(cold, np.arange(self.n + 1) * len(self.words)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(self.words[cold % max(1, len(self.words))].view(np.int64)), pa.array(times, pa.int64()))]
        size = np.bincount(self.row, minlength=self.n)
        return [pa.array(size), pa.array(np.bincount(self.row, np.log10(p), self.n)), pa.array(logs), pa.array(np.bincount(self.row[known], minlength=self.n)), *lists]


COLUMNS = ["key", "n_tokens", "score", "logs", "hits", "words", "times"]
SCHEMA = "key long, n_tokens long, score double, logs double, hits long, words array<long>, times array<long>"


def by_broadcast(rows: DataFrame, table: np.ndarray, slots: int, shared, norm: float) -> DataFrame:
    filter_ = rows.sparkSession.sparkContext.broadcast(table)  # at most BROADCAST_BYTES

    def run(batches):
        memory = memory_of(filter_.value)
        for batch in batches:
            for a, b, data, off in blocks(batch.column(2), BLOCK):
                block = Block(data, off)
                levels = levels_in(filter_.value, slots, block.grams, memory=memory)
                cols = block.columns(levels, *shared.value, norm)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols, batch.column(1).slice(a, b - a)], [*COLUMNS, "doc_id"])

    return rows.mapInArrow(run, f"{SCHEMA}, doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def by_parts(docs: DataFrame, made: DataFrame, slots: int, shared, norm: float, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same with a filter that stays dealt: n-grams of a block go to the parts, levels come back to the block."""
    each = max(1, part_bytes * 8 // SLOT_BITS)
    parts, kind = -(-slots // each), docs.schema["doc_id"].dataType.simpleString()

    def cut_up(batches):
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b, data, _ in blocks(batch.column(2), ASKED):
                if held and held + len(data) > ASKED:
                    block, held = block + 1, 0
                held += len(data)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(np.full(b - a, block))], ["key", "doc_id", "text", "block"])

    def blocks_of(batches):
        """The blocks, each whole."""
        held, now = [], None
        for batch in batches:
            block = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
            for i, j in zip(edges, [*edges[1:], len(block)]):
                if now is not None and block[i] != now:
                    yield now, pa.Table.from_batches(held)
                    held = []
                now = int(block[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield now, pa.Table.from_batches(held)

    def wanted(t: pa.Table):
        data, off = utf8(t.column("text"))
        block = Block(data, off)
        grams, at = np.unique(block.grams, return_inverse=True)
        part = slot_of(grams, slots) // each
        order = np.argsort(part, kind="stable")
        return block, grams[order], part[order], order, at

    def ask(batches):
        for block, t in blocks_of(batches):
            _, grams, part, _, _ = wanted(t.sort_by("key"))
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            raw = [g.tobytes() for g in np.split(grams, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(part[edges]), pa.array(np.ones(len(edges)), pa.int32()), pa.array(np.full(len(edges), block)), pa.array(raw, pa.binary())], ["part", "kind", "place", "bytes"])

    def answer(batches):
        now, table, out = None, np.zeros((each, SLOT_BITS // 8), np.uint8), []

        def told():
            size = np.cumsum([len(raw) // 8 for _, raw in out])
            levels = levels_in(table.ravel(), slots, np.frombuffer(b"".join(raw for _, raw in out), np.uint64), now * each).astype(np.uint8)
            cut = [x.tobytes() for x in np.split(levels, size[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array([place for place, _ in out]), pa.array([now] * len(out)), pa.array(cut, pa.binary())], ["block", "part", "levels"])
            out.clear()

        for batch in batches:
            for part, kind, place, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if out:
                        yield from told()
                    now = part
                    table[:] = 0
                if kind:
                    out.append((place, raw))
                else:
                    table[place - part * each] = np.frombuffer(raw, np.uint8)
            if out:
                yield from told()

    def finish(batches):
        for _, t in blocks_of(batches):
            told = t.filter(pc.is_null(t.column("key"))).sort_by("part")
            t = t.filter(pc.is_valid(t.column("key"))).sort_by("key").combine_chunks()
            block, _, _, order, at = wanted(t)
            levels = np.empty(len(order), np.int64)
            levels[order] = np.frombuffer(b"".join(told.column("levels").to_pylist()), np.uint8)
            yield from pa.Table.from_arrays([t.column("key"), *block.columns(levels[at], *shared.value, norm), t.column("doc_id")], [*COLUMNS, "doc_id"]).combine_chunks().to_batches()

    dealt = durable(docs.mapInArrow(cut_up, f"key long, doc_id {kind}, text string, block long"))
    asked = dealt.repartition(width(docs), "block").sortWithinPartitions("block").mapInArrow(ask, "part long, kind int, place long, bytes binary")
    slots_ = made.select(F.floor(F.col("slot") / each).cast("long").alias("part"), F.lit(0).alias("kind"), F.col("slot").alias("place"), F.col("bits").alias("bytes"))
    told = slots_.union(asked).repartition(max(width(docs), 4 * parts), "part").sortWithinPartitions("part", "kind").mapInArrow(answer, "block long, part long, levels binary")
    told = durable(told)
    both = dealt.select("block", "key", "doc_id", "text", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("levels"))
    both = both.union(told.select("block", F.lit(None).cast("long"), F.lit(None).cast(kind), F.lit(None).cast("string"), "part", "levels"))
    out = durable(both.repartition(width(docs), "block").sortWithinPartitions("block").mapInArrow(finish, f"{SCHEMA}, doc_id {kind}"))
    dropped(dealt, told)
    return out


def score(docs: DataFrame, where=None, broadcast_bytes: int = BROADCAST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score; trained on the rows that satisfy where."""
    train = docs.filter(where) if where is not None else docs
    spark = docs.sparkSession
    grams = durable(gram_counts(train))
    counts = grams.filter("h & 1 = 0").filter(F.col("h") != int(_START.view(np.int64)))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, distinct = sums["n"], sums["v"]
    top = counts.filter(F.col("n") >= HOT * n_all).toArrow()  # at most 1 / HOT words can have that share
    hot_key, hot_n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(hot_key)
    shared = spark.sparkContext.broadcast((np.append(hot_key[order], np.uint64(1)), np.append(hot_n[order], 0)))
    rare = durable(counts.filter(F.col("n") < HOT * n_all))
    made, slots = build(grams)
    dropped(grams)
    norm = n_all + 0.5 * (distinct + 1)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    if slots * SLOT_BITS // 8 <= broadcast_bytes:
        scored = durable(by_broadcast(rows, whole(made, slots), slots, shared, norm))
    else:
        scored = by_parts(rows, made, slots, shared, norm, part_bytes)
    dropped(made)
    rest = scored.select("key", F.explode(F.arrays_zip("words", "times")).alias("x")).select("key", F.col("x.words").alias("h"), F.col("x.times").alias("m"))
    joined = rest.join(rare, "h", "left").groupBy("key").agg(F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_logs"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("more_hits"))
    out = scored.drop("words", "times").join(joined, "key", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(norm)
    return out.select("doc_id", "n_tokens", (F.col("hits") + F.coalesce("more_hits", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

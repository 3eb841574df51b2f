"""Byte-level substring dedup with run-length indexes.

Removed is each byte of a WINDOW-byte string that also starts earlier (smaller
id, or the same document further left). No index of the whole corpus could be
built by one machine, so strings are dealt by content to many small indexes:

1. each window's *anchor* is the KMER of smallest hash in it (the leftmost, if
   tied), so equal windows have equal anchors. Neighbouring windows with one
   anchor form a segment. Anchors met once in the corpus drop out;
2. of equal segments (by a 64-bit hash) all but the first are repeats as a whole. The
   first travels with its bytes to the machine that has the anchor, if that
   anchor has other segments too;
3. there, segments of a batch of anchors are sorted by suffix, and the
   Burrows-Wheeler transform is cut into runs. Common prefixes are measured at
   run heads alone; inside a run a suffix shares one byte less with the suffix
   before it than its left neighbour in the text does, so one stream through
   the text gives the matching statistics of every place from those samples.
   Suffixes that agree in WINDOW bytes stand together; all but the first
   place of such a group are repeats.

An anchor with more than HOT_SEGMENTS different segments (a passage that stands
in many contexts) is trimmed first: windows whose hash is met once leave, in a
counting that splits by window, so what is left of the contexts coincides.

Among n segments of repeated anchors one is taken for a copy of another by its
hash with probability of about n / 2**64; the index compares bytes. Two texts of one id are ordered by a hash. Rows equal in id and
text are one document: judged once, each row with its result. Null text:
empty. A null id comes before all others. Texts shorter than WINDOW stay whole. Other columns
are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import Sieve, dropped, durable, join_by_count, quoted, width
from lexroute.llm.substring import _counts, _places, repeated_only, run_ends, text_key
from lexroute.llm.textops import blocks, byte_prefix

WINDOW, KMER = 100, 32
HOT_SEGMENTS, INDEX_BYTES, HELD_BYTES = 5000, 1 << 20, 1 << 24
SEGMENT = "m long, seg binary, ord long, key long, start int, n int"
NAMES = ["m", "seg", "ord", "key", "start", "n"]
_NONE = -(1 << 62)


def segments(data: np.ndarray, off: np.ndarray, window: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each segment of a block of texts."""
    total, w = len(data), window - kmer + 1
    if total < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(total - kmer + 1)
    h = byte_prefix(data).of(at, at + kmer)
    low, best, reach = h, np.arange(len(h), dtype=np.int32), 1
    while reach < w:  # the smallest of `reach` k-mers from each place on, doubling
        step = min(reach, w - reach)
        left = low[:-step] <= low[step:]
        low, best = np.where(left, low[:-step], low[step:]), np.where(left, best[:-step], best[step:])
        reach += step
    ok = np.zeros(total + 1, np.int32)
    size = np.diff(off)
    long = np.flatnonzero(size >= window)
    np.add.at(ok, off[long], 1)
    np.add.at(ok, off[long] + size[long] - window + 1, -1)
    ok = np.cumsum(ok[: total - window + 1]) > 0
    head = ok.copy()
    head[1:] &= ~ok[:-1] | (best[1:] != best[:-1])
    border = off[(off > 0) & (off < len(head))]
    head[border] = ok[border]
    first = np.flatnonzero(head)
    upto = np.concatenate([[0], np.cumsum(ok)])
    n = np.diff(upto[np.append(first, len(ok))])
    return first, n, low[first]


def suffix_order(text: np.ndarray, rem: np.ndarray, seg: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order, by doubling, and seven symbols packed at each place; ends differ by segment."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(7, np.int64)])
    packed = np.zeros(n, np.int64)
    for k in range(7):
        packed = packed << 9 | np.where(rem >= k, wide[k : k + n], 0)
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = packed[order]
    rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
    reach, most = 7, int(rem.max()) + 1
    done = False
    while not done:
        ahead = np.concatenate([rank[reach:], np.zeros(min(reach, n), np.int64)])[:n]
        key = rank * np.int64(count + n + 1) + np.where(rem < reach, seg, count + ahead)
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank[order] = np.cumsum(np.append(0, sorted_[1:] != sorted_[:-1]))
        done = reach > most or rank[order[-1]] == n - 1
        reach *= 2
    return order, packed


def shared(packed: np.ndarray, rem: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b."""
    most = np.minimum(rem[a], rem[b])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = packed[a[live] + out[live]], packed[b[live] + out[live]]
        same = x == y
        part, diff = live[~same], (x ^ y)[~same]
        for k in range(6, 0, -1):
            out[part] += (diff >> np.int64(9 * k)) == 0
        out[live[same]] += 7
        live = live[same]
        live = live[out[live] < most[live]]
    return np.minimum(out, most)


def run_length_repeats(segs: list[bytes], window: int) -> list[np.ndarray]:
    """For each segment the windows that also start in an earlier segment, or further left in it."""
    count = len(segs)
    size = np.array([len(s) for s in segs]) + 1
    stop = np.cumsum(size)
    text = np.frombuffer(b"\0".join(segs) + b"\0", np.uint8).astype(np.int64) + 1
    text[stop - 1] = 0
    seg = np.repeat(np.arange(count), size)
    rem = stop[seg] - 1 - np.arange(len(text))
    order, packed = suffix_order(text, rem, seg, count)
    bwt = text[order - 1]  # of a segment's first suffix: an end, which no other suffix has
    head = np.ones(len(text), bool)
    head[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
    at = np.flatnonzero(head)
    at = at[at > 0]
    sample = np.full(len(text), _NONE)
    sample[order[0]] = order[0]
    sample[order[at]] = shared(packed, rem, order[at], order[at - 1]) + order[at]
    statistics = np.maximum.accumulate(sample) - np.arange(len(text))
    new = statistics[order] < window
    new[0] = True
    start = np.flatnonzero(new)
    first = np.minimum.reduceat(order, start)[np.cumsum(new) - 1]
    repeat = np.zeros(len(text), bool)
    repeat[order] = first < order
    repeat &= rem >= window
    return [np.flatnonzero(repeat[a : a + n]) for a, n in zip((stop - size).tolist(), np.maximum(size - window, 0).tolist())]


def segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], NAMES)


class Copies:
    """Segments held by content; of equal ones the first goes on, the others are repeats as a whole."""

    def __init__(self):
        self.held, self.gone, self.bytes = {}, [], 0

    def add(self, m: int, seg: bytes, place: tuple, n: int) -> None:
        have = self.held.get((m, seg))
        if have is None:
            self.bytes += len(seg)
            self.held[m, seg] = place, n
        elif place < have[0]:
            self.held[m, seg] = place, n
            self.gone.append((*have[0], n))
        elif place > have[0]:
            self.gone.append((*place, n))

    def flush(self):
        """The rows so far, in batches of bounded size."""
        rows = [(m, s, *p, n) for (m, s), (p, n) in self.held.items()] + [(None, None, *r) for r in self.gone]
        self.__init__()
        for i in range(0, len(rows), 20000):
            yield segment_batch(rows[i : i + 20000])

    @property
    def full(self) -> bool:
        return self.bytes > HELD_BYTES or len(self.gone) > 200000


def keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(text_key(text, id).alias("key"), F.coalesce(quoted(id).cast("long"), F.lit(-(1 << 63))).alias("ord"), quoted(text).cast("string").alias("text"))


def candidates(rows: DataFrame, window: int, kmer: int) -> DataFrame:
    """Segments of repeated anchors; those without bytes are repeats already.

    A place is told a copy by the segment's hash. Bytes are cut out only for the
    first place of each content, and only if its anchor has other contents too:
    the windows of one segment all differ, as their anchor lies at different depths.
    """

    def anchors(batches):
        for batch in batches:
            for a, b, data, off in blocks(batch.column(2)):
                first, n, h = segments(data, off, window, kmer)
                fp = byte_prefix(data, 1).of(first, first + n - 1 + window)
                cut = np.searchsorted(first, off)
                row = np.repeat(np.arange(b - a), np.diff(cut))
                cols = [(first - off[row]).astype(np.int32), n.astype(np.int16), h, fp]
                packed = [[x[i:j].tobytes() for i, j in zip(cut.tolist(), cut[1:].tolist())] for x in cols]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(p, pa.binary()) for p in packed]], ["key", "ord", "start", "n", "h", "fp"])

    def flat(batch, kind, k):
        return np.frombuffer(b"".join(batch.column(k).to_pylist()), kind)

    def anchor_counts(batches):
        for batch in batches:
            yield _counts(flat(batch, np.uint64, 4))

    def anchor_places(sieve):
        def run(batches):
            for batch in batches:
                h = flat(batch, np.uint64, 4)
                on = np.flatnonzero(sieve.passes(h))
                size = [len(x) // 8 for x in batch.column(4).to_pylist()]
                row = np.repeat(np.arange(len(size)), size)[on]
                cols = [h.view(np.int64)[on], flat(batch, np.int64, 5)[on], *[batch.column(k).to_numpy()[row] for k in (0, 1)], flat(batch, np.int32, 2)[on], flat(batch, np.int16, 3)[on]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "fp", "key", "ord", "start", "n"])

        return found.mapInArrow(run, "h long, fp long, key long, ord long, start int, n short")

    def cut_out(batches):
        for batch in batches:
            out, held = [], 0
            for key, order, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for p in places:
                    out.append((p["h"], raw[p["start"] : p["start"] + p["n"] - 1 + window], order, key, p["start"], p["n"]))
                    held += len(out[-1][1])
                if held > HELD_BYTES:
                    yield segment_batch(out)
                    out, held = [], 0
            if out:
                yield segment_batch(out)

    # packed by text, so that the texts are read once for counts and places
    found = durable(rows.mapInArrow(anchors, "key long, ord long, start binary, n binary, h binary, fp binary"))
    often = durable(found.mapInArrow(anchor_counts, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"))
    # a few anchors met once pass the sieve too: alone they give no repeat
    near = durable(anchor_places(Sieve(often)))
    dropped(found, often)
    # of each content, the first place; texts of one id come in the order of their keys
    content = near.groupBy("fp").agg(F.min(F.struct("ord", "key", "start", "n", "h")).alias("first"), F.count("*").alias("c"))
    content = durable(content.select("fp", "c", "first.*"))
    seen = join_by_count(near, content.select("fp", "c", *(F.col(x).alias(f"first_{x}") for x in ("ord", "key", "start"))), ["fp"], "c", near.count())
    copies = durable(seen.filter("ord <> first_ord or key <> first_key or start <> first_start").select("key", "start", F.col("n").cast("int").alias("n")))
    mixed = content.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    mixed = durable(mixed)
    total = mixed.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    hits = join_by_count(content.select("h", "key", "start", "n"), mixed, ["h"], "k", total).groupBy("key").agg(F.collect_list(F.struct("start", "n", "h")).alias("places"))
    cut = durable(rows.join(hits, "key").select("key", "ord", "text", "places").mapInArrow(cut_out, SEGMENT))
    dropped(near, content, mixed)
    return cut.union(copies.selectExpr("cast(null as long) m", "cast(null as binary) seg", "cast(null as long) ord", "key", "start", "n"))


def trimmed(segs: DataFrame, window: int) -> DataFrame:
    """Segments cut down to their windows of repeated hash; equal contents meet again."""

    def windows(col):
        raw = col.to_pylist()
        size = np.array([len(s) for s in raw])
        base = np.cumsum(size) - size
        n = size - window + 1
        row = np.repeat(np.arange(len(raw)), n)
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at = base[row] + index
        return row, index, byte_prefix(np.frombuffer(b"".join(raw), np.uint8)).of(at, at + window)

    def counts(batches):
        for batch in batches:
            yield _counts(windows(batch.column(1))[2])

    def places(sieve):
        def run(batches):
            for batch in batches:
                row, index, h = windows(batch.column(1))
                on = sieve.passes(h)
                yield _places(h[on], batch.column(0).to_numpy()[row[on]], index[on])

        return slim.mapInArrow(run, "h long, key long, pos int")

    def cut_out(batches):
        copies = Copies()
        for batch in batches:
            for m, seg, order, key, start, pos in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in run_ends(np.unique(np.array(pos))).reshape(-1, 2).tolist():
                    copies.add(m, seg[a : b - 1 + window], (order, key, start + a), b - a)
                if copies.full:
                    yield from copies.flush()
        yield from copies.flush()

    named = segs.withColumn("sid", F.xxhash64("key", "start"))
    slim = named.select("sid", "seg")
    often = repeated_only(slim.mapInArrow(counts, "h long, n int"), places).withColumnRenamed("key", "sid")
    return durable(named.join(often, "sid").select("m", "seg", "ord", "key", "start", "pos").mapInArrow(cut_out, SEGMENT))


def repeats(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id", kmer: int = KMER, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(key, runs): per text, its runs of windows that also start earlier, as structs of start and n."""

    def index(batches):
        held, size, last = [], 0, None

        def solve():
            held.sort(key=lambda r: r[:3])
            once = [r for i, r in enumerate(held) if not i or r[:3] != held[i - 1][:3]]
            keys, start, n = [], [], []
            for (_, key, at, _), found in zip(once, run_length_repeats([r[3] for r in once], window)):
                for a, b in run_ends(found).reshape(-1, 2).tolist():
                    keys.append(key)
                    start.append(at + a)
                    n.append(b - a)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], ["key", "start", "n"])

        for batch in batches:
            for m, seg, order, key, start in zip(*(c.to_pylist() for c in batch.columns)):
                if m != last and size > INDEX_BYTES:
                    yield solve()
                    held, size = [], 0
                last = m
                held.append((order, key, start, seg))
                size += len(seg) + 1
        if held:
            yield solve()

    segs = candidates(keyed(docs, text, id), window, kmer)
    known = segs.filter("seg is null").select("key", "start", "n")
    live = segs.filter("seg is not null")
    hot = durable(live.groupBy("m").count().filter(F.col("count") > hot_segments).select("m"))
    if not hot.isEmpty():
        cut = trimmed(live.join(hot, "m", "left_semi"), window)
        known = known.union(cut.filter("seg is null").select("key", "start", "n"))
        live = live.join(hot, "m", "left_anti").select(*NAMES).union(cut.filter("seg is not null"))
    dealt = live.select("m", "seg", "ord", "key", "start").repartition(width(docs), "m").sortWithinPartitions("m")
    marks = dealt.mapInArrow(index, "key long, start int, n int").union(known)
    return durable(marks.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs")))


def covered(size: int, runs: list | None, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked windows cover."""
    out: list[tuple[int, int]] = []
    for a, n in sorted((r["start"], r["n"]) for r in runs or ()):
        b = min(size, a + n - 1 + window)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def spans(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id", kmer: int = KMER, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Per row: id, the number of bytes, the removed spans (flat int64 starts and ends) and the bytes that stay."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                size, gone, kept = [], [], []
                for value, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = (value or "").encode()
                    cut = covered(len(raw), runs, window)
                    edges = [0, *[x for c in cut for x in c], len(raw)]
                    size.append(len(raw))
                    gone.append([x for c in cut for x in c])
                    kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.list_(pa.int64())), pa.array(kept, pa.binary())], [id, "n_bytes", "removed", "kept"])

    found = repeats(docs, window, text, id, kmer, hot_segments)
    rows = docs.select(F.struct(quoted(id).alias("id")).alias("row"), quoted(text).cast("string").alias("text"), text_key(text, id).alias("key")).join(found, "key", "left")
    return rows.select("row.id", "text", "runs").mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, n_bytes long, removed array<long>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """Per document: bytes, bytes removed, spans removed, digest of what stays."""
    return spans(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("removed") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

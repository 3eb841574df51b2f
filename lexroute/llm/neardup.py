"""Near-dedup of texts by HyperMinHash.

A text is the set of its word shingles (A-Z lowered). Its sketch has REGISTERS
registers; a shingle's hash picks one, and each register holds the smallest of
the rest of the hashes as a leading-zero count (6 bits) and MANTISSA bits after
the leading one, 16 bits in all. Empty registers copy another at a place fixed by
their own, so short texts fill theirs too.

1. Texts with equal sets form one class, found by grouping on a digest of the set;
   from here on its member of smallest id stands for it.
2. Bands of the compressed registers are hashed; buckets of one text are dropped.
3. In each bucket all members are compared with one pivot, the member that shares
   most buckets with others (a copied original rather than one of its copies).
   Pairs whose collision-corrected estimate is far below the threshold go;
   the others are verified on their full sets, and links give components.
4. A bucket whose members are still of several components is compared further, but only members
   that share one of their rarest shingles too: of n, near sets have one of the rarest
   n - ceil(0.8 n) + 1 in common. There, those outside the largest component meet all members, on full
   sets in blocks of bounded size. A block returns a spanning forest of the links it finds between
   components, never its pairs. So a bucket of thousands of copies gives a few rows for each, one of
   thousands of texts that share a template and no more gives none, and no link between components is lost to a cap.

With REGISTERS = 128 and 25 bands of 5, a pair at the threshold of 0.8 shares a
bucket with probability 1 - (1 - 0.8**5)**25 = 0.99995.

Null, empty and wordless texts: no shingles, linked with nothing, kept. Texts
with fewer words than a shingle: their whole word sequence is the one shingle.
Rows that share an id are one document that has all their texts' links. A null id
is linked with nothing and kept. Other columns, whatever their names, pass through `keep_one`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import Sieve, boxed, components, dropped, durable, join_by_count, quoted, unboxed, width
from lexroute.llm.textops import LOWER, Prefix, blocks, byte_prefix, local_index, mix, utf8, word_spans

REGISTERS, MANTISSA, BANDS, BAND = 128, 10, 25, 5
SHINGLE, THRESHOLD, MARGIN, BLOCK, SLICE = 5, 80, 0.25, 256, 1 << 14
#: Pairs of one pivot that are dealt to one task.
PIVOT_ROWS = 512
#: Counters of shingles' frequencies.
COUNTERS = 1 << 22
#: Chance that two unequal minima give equal registers.
ACCIDENT = 2.0**-MANTISSA / 1.4

_rng = np.random.default_rng(5)
_TRIES = _rng.integers(0, REGISTERS, (48, REGISTERS))


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of each text, by row."""
    data = LOWER[data]
    s, e, first = word_spans(data, off)
    row, index = local_index(first, len(s))
    runs = Prefix(byte_prefix(data).of(s, e), 2)
    words = np.diff(first)
    at = np.flatnonzero(index + n <= words[row]) if len(row) else np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < n))
    rows = np.concatenate([row[at], short])
    h = np.concatenate([runs.of(at, at + n), runs.of(first[short], first[short + 1])])
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    return rows[new], h[new]


def sketch(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) of uint16: leading zeros and mantissa of each register's minimum."""
    h = mix(h + np.uint64(0x632BE59BD9B4E019))
    none = np.uint64(1 << 63)
    low = np.full(n * REGISTERS, none)
    np.minimum.at(low, rows * REGISTERS + (h & np.uint64(REGISTERS - 1)).astype(np.int64), h >> np.uint64(7))
    fraction, exponent = np.frexp(low.astype(float))
    zeros = np.where(low == 0, 63, np.clip(57 - exponent, 0, 62))
    registers = ((zeros << MANTISSA) | np.where(low == 0, 0, ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64))).astype(np.uint16).reshape(n, REGISTERS)
    filled = (low != none).reshape(n, REGISTERS)
    todo = np.flatnonzero(~filled.all(1) & filled.any(1))
    reg, fill = registers[todo], filled[todo]
    done = fill.copy()
    for t in _TRIES:
        take = ~done & fill[:, t]
        reg = np.where(take, reg[:, t], reg)
        done |= take
        if done.all():
            break
    left = np.flatnonzero(~done.all(1))
    if len(left):  # the next filled register, round the circle
        ahead = (np.arange(REGISTERS)[:, None] + np.arange(REGISTERS)) % REGISTERS
        for i in left:
            to = ahead[np.arange(REGISTERS), fill[i][ahead].argmax(1)]
            reg[i] = np.where(done[i], reg[i], reg[i][to])
    registers[todo] = reg
    return registers


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of paired rows of registers."""
    return ((a == b).mean(-1) - ACCIDENT) / (1 - ACCIDENT)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(id, n, c1, c2, registers) of every row of (id, text)."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                rows, h = shingles(data, off, shingle)
                n = b - a
                cut = np.searchsorted(rows, np.arange(n + 1))
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (h, mix(h ^ np.uint64(0xA0761D6478BD642F)))]
                c1, c2 = ((s[cut[1:]] - s[cut[:-1]]).view(np.int64) for s in sums)
                reg = sketch(rows, h, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.diff(cut)), pa.array(c1), pa.array(c2), pa.array([r.tobytes() for r in reg], pa.binary())], ["id", "n", "c1", "c2", "registers"])

    return docs.mapInArrow(run, "id long, n long, c1 long, c2 long, registers binary")


def bands(reps: DataFrame, sieve: Sieve | None = None) -> DataFrame:
    """(bucket, id) for each band of each sketch, or of those buckets that a sieve lets through."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS).astype(np.uint64)
            for k in range(BANDS):
                h = np.full(len(reg), k + 1, np.uint64)
                for j in range(k * BAND, k * BAND + BAND):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + reg[:, j])
                on = sieve.passes(h) if sieve else slice(None)
                yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(ids[on])], ["bucket", "id"])

    return reps.select("id", "registers").mapInArrow(run, "bucket long, id long")


def dealt_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (p, id) with a part for each PIVOT_ROWS of a pivot's pairs, and (p, parts): a hot pivot's pairs lie in many tasks."""
    degree = durable(pairs.groupBy("p").agg(F.count("*").alias("n")))
    parts = F.ceil(F.col("n") / PIVOT_ROWS).cast("int").alias("parts")
    total = pairs.count()
    with_parts = join_by_count(pairs, degree.select("p", "n", parts), ["p"], "n", total)
    return durable(with_parts.select("p", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))), degree.select("p", parts)


def verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """Of the pairs (p, id), as (a, b), those whose full sets meet the threshold, after the estimate has sorted out most others."""

    def near(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("rp", "ri"))
            n, m = (np.asarray(batch.column(c)) for c in ("np", "ni"))
            ok = (estimate(x, y) >= threshold / 100 - MARGIN) & (100 * np.minimum(n, m) >= threshold * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("p", "id", "part")], ["p", "id", "part"])

    def exact(batches):
        for batch in batches:
            ta, tb = utf8(batch.column("tp")), utf8(batch.column("ti"))
            n, at = batch.num_rows, 0
            while at < n:
                to = at + 1
                while to < n and ta[1][to + 1] - ta[1][at] + tb[1][to + 1] - tb[1][at] < 1 << 22:
                    to += 1
                keys, sizes = [], []
                for data, off in (ta, tb):
                    rows, h = shingles(data[off[at] : off[to]], off[at : to + 1] - off[at], shingle)
                    keys.append((rows, mix(h ^ mix(rows.astype(np.uint64)))))
                    sizes.append(np.bincount(rows, minlength=to - at))
                both = np.bincount(keys[0][0][np.isin(keys[0][1], keys[1][1])], minlength=to - at)
                ok = pa.array(100 * both >= threshold * (sizes[0] + sizes[1] - both))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, to - at).filter(ok) for c in ("p", "id")], ["a", "b"])
                at = to

    def of_pivot(df: DataFrame, *cols: str) -> DataFrame:
        """The pivot's side of a join, once for each part of its pairs."""
        both = df.select(F.col("id").alias("p"), *(F.col(c).alias(f"{c[0]}p") for c in cols)).join(parts, "p")
        return both.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def of_id(df: DataFrame, *cols: str) -> DataFrame:
        return df.select("id", *(F.col(c).alias(f"{c[0]}i") for c in cols))

    dealt, parts = dealt_pairs(pairs)
    close = dealt.join(of_id(reps, "registers", "n"), "id").join(of_pivot(reps, "registers", "n"), ["p", "part"])
    close = durable(close.mapInArrow(near, "p long, id long, part int"))
    dropped(dealt)
    return durable(close.join(of_id(texts, "text"), "id").join(of_pivot(texts, "text"), ["p", "part"]).mapInArrow(exact, "a long, b long"))


def sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, members binary): the sorted hashes of each text's shingles."""

    def run(batches):
        for batch in batches:
            for a, b, data, off in blocks(batch.column("text")):
                rows, h = shingles(data, off, shingle)
                cut = np.searchsorted(rows, np.arange(b - a + 1)).tolist()
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["id", "members"])

    return texts.select("id", "text").mapInArrow(run, "id long, members binary")


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets in x with all in y, by matrix products over slices of their common members."""
    out = np.zeros((len(x), len(y)), np.int64)
    flat = [np.concatenate(z) if z else np.zeros(0, np.uint64) for z in (x, y)]
    row = [np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (x, y)]
    common = np.intersect1d(*flat)
    at = [np.searchsorted(common, f) for f in flat]
    for k in range(2):
        ok = common[np.minimum(at[k], len(common) - 1)] == flat[k] if len(common) else np.zeros(len(flat[k]), bool)
        at[k], row[k] = at[k][ok], row[k][ok]
    for a in range(0, len(common), SLICE):
        m = []
        for k, z in enumerate((x, y)):
            here = (at[k] >= a) & (at[k] < a + SLICE)
            d = np.zeros((len(z), SLICE), np.float32)
            d[row[k][here], at[k][here] - a] = 1
            m.append(d)
        out += (m[0] @ m[1].T).astype(np.int64)
    return out


def forest(component: list, links: np.ndarray) -> list[int]:
    """Of links between rows (pairs of indices), those that join components not joined before."""
    parent: dict = {c: c for c in component}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    kept = []
    for k, (i, j) in enumerate(links):
        a, b = root(component[i]), root(component[j])
        if a != b:
            parent[a] = b
            kept.append(k)
    return kept


class Frequencies:
    """How many sets hold a shingle, at least: COUNTERS sums of it and of those that share its place (16 MB, whatever the input)."""

    def __init__(self, with_sets: DataFrame):
        def count(batches):
            total = np.zeros(COUNTERS, np.int64)
            for batch in batches:
                total += np.bincount(_counter(_flat(batch.column("members"))), minlength=COUNTERS)
            slots = [(k, np.flatnonzero(c), c) for k, c in enumerate(total.reshape(-1, 1 << 16))]
            slots = [(k, at.astype(np.uint16).tobytes(), c[at].tobytes()) for k, at, c in slots if len(at)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*slots) if slots else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()))], ["slot", "at", "counts"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, at, counts in zip(*(batch.column(c).to_pylist() for c in ("slot", "at", "counts"))):
                    sums.setdefault(k, np.zeros(1 << 16, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.int64)
            for k, c in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(c, (1 << 31) - 1).astype(np.int32).tobytes()], pa.binary())], ["slot", "counts"])

        parts = with_sets.mapInArrow(count, "slot int, at binary, counts binary").repartition(min(width(with_sets), COUNTERS >> 16), "slot")
        table = np.zeros((COUNTERS >> 16, 1 << 16), np.int32)
        for batch in parts.mapInArrow(add, "slot int, counts binary").toArrow().to_batches():  # COUNTERS numbers
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table[k] = np.frombuffer(c, np.int32)
        self.shared = with_sets.sparkSession.sparkContext.broadcast(table.ravel())

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.shared.value[_counter(h)]


def _flat(members: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(members.to_pylist()), np.uint64)


def _counter(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def prefixes(with_sets: DataFrame, frequencies: Frequencies, threshold: int) -> DataFrame:
    """(id, h): the rarest n - ceil(threshold * n) + 1 shingles of each set of n; near sets have one of them in common. Those of one set alone are left out."""

    def run(batches):
        for batch in batches:
            h = _flat(batch.column("members"))
            n = np.array([len(m) // 8 for m in batch.column("members").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            often = frequencies.of(h)
            order = np.lexsort((h, often, row))
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            first = order[(place < (n + (-threshold * n // 100) + 1)[row]) & (often[order] > 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[first])), pa.array(h[first].view(np.int64))], ["id", "h"])

    return with_sets.select("id", "members").mapInArrow(run, "id long, h long")


def still_open(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, total, bulk, strays, s, x, work) of the keys of (keys, id, component) whose rows are of several components.

    bulk is the largest component, strays are the rows of all others; s and x tell sets of members apart, work is the rows that blocks take.
    """
    held = durable(rows.groupBy(*keys, "component").agg(F.count("*").alias("k"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("s"), F.bit_xor(F.xxhash64("id", F.lit(5))).alias("x")))
    of = held.groupBy(*keys).agg(F.sum("k").alias("total"), F.count("*").alias("kinds"), F.max(F.struct("k", "component")).alias("most"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"))
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK)
    open_ = of.filter("kinds > 1").select(*keys, "total", F.col("most.component").alias("bulk"), (F.col("total") - F.col("most.k")).alias("strays"), "s", "x")
    open_ = durable(open_.withColumn("work", F.col("total") * blocks_of("strays") + F.col("strays") * blocks_of("total")))
    dropped(held)
    return open_


def meetings(members: DataFrame, rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, component) of who is to meet whom, and (key, total, bulk, strays) of those keys.

    members: (bucket, id, component) of open buckets, rare: (id, h). Members meet if they have a rare shingle in common. Either a bucket's shingles are the
    keys, or the bucket itself with the members that any of them has, whichever takes fewer rows; keys of the same members are one.
    """
    shared = durable(members.join(rare, "id").select("bucket", "h", "id", "component"))
    tokens = still_open(shared, "bucket", "h")
    tokens = durable(tokens.groupBy("bucket", "total", "bulk", "strays", "s", "x", "work").agg(F.min("h").alias("h")))
    n = tokens.agg(F.sum("total")).first()[0] or 0
    met = durable(join_by_count(shared, tokens.select("bucket", "h", "total"), ["bucket", "h"], "total", n))
    some = durable(met.select("bucket", "id", "component").distinct())
    whole = still_open(some, "bucket")
    cheap = tokens.groupBy("bucket").agg(F.sum("work").alias("by_token")).join(whole.select("bucket", "work"), "bucket").filter("work <= by_token").select("bucket")
    key_b, key_t, names = F.xxhash64("bucket", F.lit("bucket")).alias("key"), F.xxhash64("bucket", "h").alias("key"), ("total", "bulk", "strays", "s", "x")
    cheap = durable(cheap)
    groups = whole.join(cheap, "bucket").select(key_b, *names).union(tokens.join(cheap, "bucket", "left_anti").select(key_t, *names))
    groups = durable(groups.groupBy(*names).agg(F.min("key").alias("key")))
    rows = some.join(cheap, "bucket").select(key_b, "id", "component").union(met.join(cheap, "bucket", "left_anti").select(key_t, "id", "component"))
    out = durable(join_by_count(durable(rows), groups.select("key", "total"), ["key"], "total", groups.agg(F.sum("total")).first()[0] or 0))
    dropped(shared, tokens, met, some, whole, cheap)
    return out, groups


def rest_links(now: DataFrame, texts: DataFrame, shingle: int, threshold: int) -> DataFrame | None:
    """Links (a, b) between components that share a bucket, on full sets, in blocks of bounded size; None if no bucket is open.

    now: (bucket, id, component). Members of an open bucket meet if they also have one of their rarest
    shingles in common (see prefixes), which all near sets do: texts of one template that differ in the rest don't meet.
    Under a key the members of all components but the largest are compared with all
    members: copies of one text meet only the strays. Each block returns only links that join components, never all of its pairs.
    """
    buckets = still_open(now, "bucket")
    several = buckets.filter("total > 2").select("bucket", "total")  # a bucket of two was compared by its pivot
    rows = several.agg(F.sum("total")).first()[0]
    if not rows:
        dropped(buckets)
        return None
    members = durable(join_by_count(now, several, ["bucket"], "total", rows))
    with_sets = durable(sets(texts.join(members.select("id").distinct(), "id"), shingle))
    rare = durable(prefixes(with_sets, Frequencies(with_sets), threshold))
    met, groups = meetings(members, rare)
    dropped(buckets, members, rare)
    if groups.isEmpty():
        dropped(with_sets, met, groups)
        return None
    parts = F.ceil(F.col("total") / BLOCK).cast("int").alias("parts")
    members = durable(join_by_count(met, groups.select("key", "total", "bulk", parts, F.ceil(F.col("strays") / BLOCK).cast("int").alias("strays")), ["key"], "total", groups.agg(F.sum("total")).first()[0]))
    dropped(met, groups)
    all_ = members.select("key", "id", "component", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("strays") - 1)).alias("i"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("j"))
    strays = members.filter("component <> bulk").select("key", "id", "component", F.lit(0).alias("side"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("strays")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))

    def run(pdf):
        import pandas as pd

        x, y = (pdf[pdf["side"] == k].sort_values("id") for k in (0, 1))
        sx, sy = ([np.frombuffer(v, np.uint64) for v in z["members"]] for z in (x, y))
        both = intersections(sx, sy)
        union = np.array([len(v) for v in sx], np.int64)[:, None] + np.array([len(v) for v in sy], np.int64)[None, :] - both
        cx, cy = x["component"].to_numpy(), y["component"].to_numpy()
        links = np.argwhere((100 * both >= threshold * union) & (cx[:, None] != cy[None, :]))
        links[:, 1] += len(x)
        ids = np.concatenate([x["id"].to_numpy(), y["id"].to_numpy()])
        links = links[forest(np.concatenate([cx, cy]).tolist(), links)]
        return pd.DataFrame({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})

    found = durable(all_.union(strays).join(with_sets, "id").groupBy("key", "i", "j").applyInPandas(run, "a long, b long"))
    dropped(members, with_sets)
    return found


def only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text) of texts whose id is among ids (durable); a sieve spares all others a shuffle, whatever the number of ids."""
    sieve = Sieve(ids.select(F.xxhash64("id").alias("h")))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(sieve.passes(batch.column(2).to_numpy().view(np.uint64)))) for c in batch.columns[:2]], ["id", "text"])

    return texts.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(run, "id long, text string").join(ids, "id")


def class_components(classes: DataFrame, source: DataFrame, shingle: int, threshold: int) -> DataFrame | None:
    """(id, component) of the class representatives that are linked with another; None if no two share a bucket."""
    reps = classes.select(F.col("rep").alias("id"), "n", "registers")
    full = durable(bands(reps).groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1"))
    total = full.agg(F.sum("k")).first()[0]
    if not total:
        return None
    raw = durable(bands(reps, Sieve(full, "bucket")))
    members = durable(join_by_count(raw, full.withColumn("size", F.col("k")), ["bucket"], "k", total))
    dropped(raw, full)
    weight = members.groupBy("id").agg(F.sum("size").alias("w"))
    ranked = members.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("id")).alias("m"))).alias("top"), F.max("size").alias("k"))
    lead = durable(ranked.select("bucket", (-F.col("top.m")).alias("p"), "k"))
    pairs = durable(join_by_count(members, lead, ["bucket"], "k", total).filter("id <> p").select("p", "id").distinct())
    ids = durable(members.select("id").distinct())
    texts = durable(only(source, ids))
    links = verified(pairs, reps, texts, shingle, threshold)
    final = components(links)
    dropped(pairs, lead)
    now = durable(members.join(final, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")))
    more = rest_links(now, texts, shingle, threshold)
    dropped(texts, ids, now)
    return final if more is None or more.isEmpty() else components(links.union(more))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id) for every row: the class each document is in."""
    source = docs.select(quoted(id).cast("long").alias("id"), quoted(text).cast("string").alias("text"))
    drawn = durable(sketches(source, shingle))
    whole, key = drawn.filter("n > 0 and id is not null"), ["c1", "c2", "n"]
    classes = durable(whole.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("registers").alias("registers")))
    found = class_components(classes, source, shingle, threshold)
    if found is None:
        placed = classes.select(*key, "copies", F.col("rep").alias("component"))
    else:
        placed = classes.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select(*key, "copies", F.coalesce("component", "rep").alias("component"))
    # copies follow their class; an id of several texts ties their classes together
    by_id = durable(join_by_count(whole.select("id", *key), durable(placed), key, "copies", drawn.count()).select("id", "n", "component"))
    torn = durable(by_id.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b").select("a", "b"))
    alone = drawn.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    if not torn.isEmpty():
        tied = components(torn).select(F.col("id").alias("component"), F.col("component").alias("tied"))
        by_id = by_id.join(tied, "component", "left").select("id", "n", F.coalesce("tied", "component").alias("component"))
    return by_id.union(alone).select(F.col("id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs without the documents that are near copies of one of smaller id."""
    gone = near_duplicates(docs, shingle, threshold, text, id).filter("id <> component_id").select("id").distinct()
    rows = docs.select(boxed(docs).alias("row"), quoted(id).cast("long").alias("id"))
    return unboxed(rows.join(durable(gone), "id", "left_anti"), "row", docs.schema)

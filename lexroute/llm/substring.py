"""Substring dedup over words by difference-cover anchors.

Wanted are the windows of WINDOW words whose word sequence starts at another
place too. Let D be a difference cover modulo a period p: for any two positions
i and j some shift k < p puts both i+k and j+k on residues in D. Two equal
windows at i and j then have equal *anchors* (the WINDOW-p+1 words from i+k and
j+k on), so it is enough to hash anchors at cover positions (|D| of p words):

1. count anchor hashes over the corpus; those met once are of no use;
2. find the places of repeated anchors (a join with the repeated hashes);
3. extend: only windows that hold a repeated anchor at one of the p possible
   shifts are hashed whole, counted, and found again like the anchors.

Counting pre-aggregates in the worker and before the shuffle, so a passage of
many copies is a few rows; the joins are plain sort-merge joins that adaptive
execution may split at a hot hash. No pair of places is ever formed.

Windows and documents are told apart by 64-bit hashes: among n candidate
windows one is wrongly marked with probability of about n / 2**64 each.

Null text: no words. Texts shorter than the window keep all words. Repeated rows
count as separate texts, so all their windows repeat. Other columns, whatever
their names, pass through `remove` unchanged. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import Sieve, boxed, dropped, durable, join_by_count, quoted
from lexroute.llm.textops import Prefix, blocks, byte_prefix, local_index, word_spans

WINDOW, LEAST_ANCHOR = 35, 12
#: Perfect difference sets; every residue but 0 is a difference of just two members.
COVERS = {1: [0], 3: [0, 1], 7: [1, 2, 4], 13: [0, 1, 3, 9], 21: [3, 6, 7, 12, 14], 31: [1, 5, 11, 24, 25, 27]}


def cover_for(window: int) -> tuple[int, list[int]]:
    """The longest period whose anchors have LEAST_ANCHOR words (period 1: anchors are windows)."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= LEAST_ANCHOR)
    return period, COVERS[period]


class Words:
    """Word spans of a block of texts and hashes of their runs."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.start, self.end, self.first = word_spans(data, off)
        self.row, self.index = local_index(self.first, len(self.start))
        self.runs = Prefix(byte_prefix(data).of(self.start, self.end), 2)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors and their hashes."""
        period, cover = cover_for(window)
        size = window - period + 1
        on = np.zeros(period, bool)
        on[cover] = True
        at = np.flatnonzero(on[self.index % period])
        at = at[at + size <= self.first[self.row[at] + 1]]
        return at, self.runs.of(at, at + size)

    def windows_with(self, found: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows that hold a found anchor."""
        period, _ = cover_for(window)
        n = len(self.start)
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, np.maximum(found - period + 1, 0), 1)
        np.add.at(mark, found + 1, -1)
        at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        at = at[at + window <= self.first[self.row[at] + 1]]
        return at, self.runs.of(at, at + window)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _counts(h: np.ndarray) -> pa.RecordBatch:
    u, n = np.unique(h, return_counts=True)
    return pa.RecordBatch.from_arrays([_signed(u), pa.array(n, pa.int32())], ["h", "n"])


def _places(h: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_signed(h), pa.array(key), pa.array(pos, pa.int32())], ["h", "key", "pos"])


def text_key(text: str, id: str):
    """The hash of id and text that a text is known by."""
    return F.xxhash64(quoted(id), quoted(text).cast("string"))


def keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    return docs.select(text_key(text, id).alias("key"), quoted(text).cast("string").alias("text"))


def repeated_only(counts: DataFrame, places) -> DataFrame:
    """Per key, the positions of hashes that are met more than once.

    places: makes (h, key, pos) of the hashes that a sieve lets through, so few others are moved.
    """
    often = durable(counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    near = durable(places(Sieve(often)))
    out = durable(join_by_count(near, often, ["h"], "n", total).groupBy("key").agg(F.collect_list("pos").alias("pos")))
    dropped(often, near)
    return out


def repeated_windows(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(key, pos array<int>): starts of the repeated windows of each text that has any."""
    rows = keyed(docs, text, id)

    def anchor_counts(batches):
        for batch in batches:
            for _, _, data, off in blocks(batch.column(1)):
                yield _counts(Words(data, off).anchors(window)[1])

    def anchor_places(sieve):
        def run(batches):
            for batch in batches:
                keys = batch.column(0).to_numpy()
                for a, b, data, off in blocks(batch.column(1)):
                    w = Words(data, off)
                    at, h = w.anchors(window)
                    on = sieve.passes(h)
                    yield _places(h[on], keys[a:b][w.row[at[on]]], w.index[at[on]])

        return rows.mapInArrow(run, "h long, key long, pos int")

    def extended(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for a, b, data, off in blocks(batch.column(1)):
                w = Words(data, off)
                part = batch.column(2).slice(a, b - a)
                found = np.asarray(part.flatten()) + np.repeat(w.first[:-1], np.asarray(part.value_lengths()))
                at, h = w.windows_with(found, window)
                cut = np.searchsorted(w.row[at], np.arange(b - a + 1))
                pos = [run_ends(w.index[at[i:j]]).tobytes() for i, j in zip(cut.tolist(), cut[1:].tolist())]
                hashes = [h[i:j].tobytes() for i, j in zip(cut.tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(pos, pa.binary()), pa.array(hashes, pa.binary())], ["key", "pos", "hashes"])

    def flat(batch, kind, column):
        return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind)

    def window_counts(batches):
        for batch in batches:
            yield _counts(flat(batch, np.uint64, "hashes"))

    def window_places(sieve):
        def run(batches):
            for batch in batches:
                runs = flat(batch, np.int32, "pos").reshape(-1, 2)
                long = runs[:, 1] - runs[:, 0]
                pos = np.repeat(runs[:, 1] - np.cumsum(long), long) + np.arange(int(long.sum()))
                size = np.asarray(pc.binary_length(batch.column("hashes"))) // 8
                h = flat(batch, np.uint64, "hashes")
                on = sieve.passes(h)
                yield _places(h[on], np.repeat(batch.column("key").to_numpy(), size)[on], pos[on])

        return near.mapInArrow(run, "h long, key long, pos int")

    # the windows' hashes are made durable, packed by text, so the texts move once
    hits = repeated_only(rows.mapInArrow(anchor_counts, "h long, n int"), anchor_places)
    near = durable(rows.join(hits, "key").select("key", "text", "pos").mapInArrow(extended, "key long, pos binary, hashes binary"))
    out = repeated_only(near.mapInArrow(window_counts, "h long, n int"), window_places)
    dropped(hits, near)
    return out


def run_ends(index: np.ndarray) -> np.ndarray:
    """Rising integers as (first, end) of their runs, flat."""
    if not len(index):
        return np.zeros(0, np.int32)
    edge = np.flatnonzero(np.diff(index) != 1)
    return np.column_stack([index[np.append(0, edge + 1)], index[np.append(edge, len(index) - 1)] + 1]).astype(np.int32).ravel()


def covered_words(w: Words, pos: pa.Array, window: int) -> np.ndarray:
    """Which words of a block lie in a repeated window."""
    mark = np.zeros(len(w.start) + 1, np.int64)
    at = np.asarray(pos.flatten()) + np.repeat(w.first[:-1], np.asarray(pos.value_lengths().fill_null(0)))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + window, -1)
    return np.cumsum(mark[:-1]) > 0


def with_windows(docs: DataFrame, window: int, text: str, id: str) -> DataFrame:
    """(row, text, pos): all columns of docs as one struct, the text and the starts of its repeated windows."""
    found = repeated_windows(docs, window, text, id)
    rows = docs.select(boxed(docs).alias("row"), quoted(text).cast("string").alias("text"), text_key(text, id).alias("key"))
    return rows.join(found, "key", "left").select("row", "text", "pos")


def joined_words(data: np.ndarray, w: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of all texts, each followed by one space, and where each text's begin (n+1 values)."""
    s, size = w.start[keep], w.end[keep] - w.start[keep] + 1
    ends = np.cumsum(size)
    out = np.append(data, np.uint8(32))[np.repeat(s - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    out[ends - 1] = 32
    upto = np.concatenate([[0], np.cumsum(keep)])[w.first]
    return out.tobytes(), np.concatenate([[0], ends])[upto]


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, words removed, digest of the kept words joined by one space."""
    from hashlib import sha256

    def run(batches):
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                w = Words(data, off)
                gone = covered_words(w, batch.column(2).slice(a, b - a), window)
                raw, at = joined_words(data, w, ~gone)
                sha = [sha256(raw[i : max(i, j - 1)]).hexdigest() for i, j in zip(at.tolist(), at[1:].tolist())]
                removed = np.bincount(w.row[gone], minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = with_windows(docs.select("doc_id", "text"), window, "text", "doc_id")
    return found.select("row.doc_id", "text", "pos").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def cut(data: np.ndarray, w: Words, gone: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts without removed words and the white space after each; what is kept stays as it was."""
    drop = np.zeros(len(data) + 1, np.int64)
    k = np.flatnonzero(gone)
    following = np.append(w.start, len(data))[k + 1]
    stop = np.minimum(following, off[w.row[k] + 1])
    np.add.at(drop, w.start[k], 1)
    np.add.at(drop, stop, -1)
    keep = np.cumsum(drop[:-1]) == 0
    return data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[off]


def remove(docs: DataFrame, window: int = WINDOW, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with the words of repeated windows cut from the text; untouched texts stay byte for byte."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                w = Words(data, off)
                gone = covered_words(w, batch.column(2).slice(a, b - a), window)
                texts = batch.column(1).slice(a, b - a)
                if gone.any():
                    raw, at = cut(data, w, gone, off)
                    texts = pa.array([None if x else raw[i:j].decode() for x, i, j in zip(texts.is_null().to_pylist(), at.tolist(), at[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts], ["row", "text"])

    found = with_windows(docs, window, text, id)
    new = found.mapInArrow(run, found.select("row", "text").schema)
    kind = schema[text].dataType
    return new.select(*(F.col("text").cast(kind).alias(text) if f.name == text else F.col("row").getField(f.name).alias(f.name) for f in schema.fields))

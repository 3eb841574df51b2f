"""Byte-level BPE by forced-boundary splitting, and best-fit packing of its output into sequences.

Two neighbouring bytes that stand together inside no vocabulary token can never
be merged: every merge makes a token that would contain the pair. Such pairs
mark cuts, the fragments between cuts are encoded on their own (each distinct
one once for a worker), and the ids are concatenated.

The tokenizer first splits texts by a pattern with a little context, so a cut
is made only where that pattern gives the same pieces on either side:

* at a code point's edge, after a character that is not white space (a run of
  white space gives its last character to the next word, so its end is context);
* not before an apostrophe, unless an ASCII letter or digit stands before it
  (else a suffix like 's could begin where the whole text has none);
* around, never inside, the literal of an added token.

Null texts count as empty; an empty text has no ids and decodes to "". Repeated
rows give repeated results. Columns besides the id and the text are dropped
before any clash of names.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.textops import SPACE, blocks, utf8

#: Distinct fragments a worker remembers before it starts anew: bounds its memory.
CACHE_FRAGMENTS = 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encodes and decodes like the tokenizers file at path."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.core = Tokenizer.from_file(path)
        self.core.no_truncation()
        self.core.no_padding()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.literals = [x.encode() for x in added]
        byte = byte_of_char()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.raw = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        joined = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            b = bytes(byte[c] for c in token)
            self.raw[i] = b
            if len(b) > 1:
                v = np.frombuffer(b, np.uint8)
                joined[v[:-1], v[1:]] = True
        for token, i in added.items():
            self.raw[i] = token.encode()
        self.raw_pool = Ragged.of(self.raw)
        self.decimal_pool = Ragged.of([b"%d," % i for i in range(len(self.raw))])
        can = ~joined
        left = np.arange(256)
        can[:, (left & 0xC0) == 0x80] = False  # not inside a code point
        can[SPACE | ((left >= 0x1C) & (left <= 0x1F))] = False
        alnum = np.zeros(256, bool)
        alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        can[~alnum, 0x27] = False
        self.can = can.ravel()
        self.known, self.ids = Numbered(), Ragged(np.int32)

    def cuts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sorted positions at which fragments begin, each text's edges included."""
        if len(data) == 0:
            return np.zeros(1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = self.can[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        wide = wide_space_ends(data)
        cut[wide + 1] = False
        raw = None
        for literal in self.literals:
            raw = data.tobytes() if raw is None else raw
            at = raw.find(literal)
            while at >= 0:
                cut[at : at + len(literal) + 1] = False
                cut[[at, at + len(literal)]] = True
                at = raw.find(literal, at + len(literal))
        cut[off] = True
        return np.flatnonzero(cut)

    def encode_block(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after another, and n+1 offsets."""
        at = self.cuts(data, off)
        raw = data.tobytes()
        edges = at.tolist()
        if len(self.known) > CACHE_FRAGMENTS:
            self.known, self.ids = Numbered(), Ragged(np.int32)
        known = self.known
        which = np.fromiter(map(known.__getitem__, [raw[i:j] for i, j in zip(edges, edges[1:])]), np.int64, len(edges) - 1)
        new, known.new = known.new, []
        for a in range(0, len(new), 4096):
            self.ids.add([e.ids for e in self.core.encode_batch_fast([p.decode() for p in new[a : a + 4096]], add_special_tokens=False)])
        ids, ends = self.ids.gather(which)
        return ids, np.concatenate([[0], ends])[np.searchsorted(at, off)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.encode_block(*utf8(pa.array(texts, pa.large_string())))
        return [ids[a:b].tolist() for a, b in zip(at, at[1:])]

    def decode_bytes(self, ids) -> bytes:
        return self.raw_pool.gather(np.asarray(ids, np.int64))[0].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def written(self, ids) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimal_pool.gather(np.asarray(ids, np.int64))[0].tobytes()[:-1]


class Numbered(dict):
    """Numbers its keys from 0 as they are first asked for, and lists those that are new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Ragged:
    """Rows of varying length in one flat array that grows by doubling."""

    def __init__(self, kind):
        self.flat, self.used, self.ends, self.rows = np.zeros(1024, kind), 0, np.zeros(1024, np.int64), 0

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        out = cls(np.uint8)
        out.add([np.frombuffer(r, np.uint8) for r in rows])
        return out

    def add(self, rows: list) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter(chain.from_iterable(rows), self.flat.dtype, int(sizes.sum()))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(rows) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.ends[self.rows : self.rows + len(rows)] = self.used + np.cumsum(sizes)
        self.used += len(flat)
        self.rows += len(rows)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows asked for, one after another, and where each ends."""
        begin = np.where(which > 0, self.ends[which - 1], 0)
        size = self.ends[which] - begin
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(begin - (ends - size), size) + np.arange(total)], ends


def wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Positions of the last bytes of white space outside ASCII."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(lead):
        return lead
    d = np.concatenate([data, np.zeros(2, np.uint8)])
    b0, b1, b2 = d[lead], d[lead + 1], d[lead + 2]
    two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
    three = (
        ((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80))
        | ((b0 == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)))
        | ((b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F))
        | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))
    )
    return np.concatenate([lead[two] + 1, lead[three] + 2])


_coders: dict[str, ForcedBoundaryBPE] = {}


def coder(path: str) -> ForcedBoundaryBPE:
    """One for each worker process."""
    if path not in _coders:
        _coders[path] = ForcedBoundaryBPE(path)
    return _coders[path]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text."""
    path = path or default_path()

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                ids, at = bpe.encode_block(data, off)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to ""."""
    path = path or default_path()

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            texts = [bpe.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of what they decode to.

    Encoding and decoding share one pass, so the ids (about a third of the text's
    bytes) never leave the worker.
    """
    from hashlib import sha256

    path = path or default_path()

    def run(batches):
        bpe = coder(path)
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                n, x, y = [], [], []
                ids, at = bpe.encode_block(data, off)
                for i, j in zip(at.tolist(), at[1:].tolist()):
                    n.append(j - i)
                    x.append(sha256(bpe.written(ids[i:j])).hexdigest())
                    y.append(sha256(bpe.decode(ids[i:j]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

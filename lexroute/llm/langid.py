"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are runs of 2, 3 and 4 bytes of the text with A-Z lowered and everything that is
no letter turned into one space, so they see word edges. Each hashes to one of BUCKETS
embedding rows; a text is the mean of its rows, and a linear softmax reads it.
Both layers are trained together by stochastic gradient descent in numpy, on a
bounded sample (SAMPLE_PER_LANG whole texts of each language, drawn by a hash of the
id), each text also as a few short stretches so that short texts are met in training.

Because reading is linear, embedding and output layer fold into one table of
BUCKETS x languages before it is broadcast: its size depends on neither the
corpus nor the sample.

Part of the sample is left out of training. On it a temperature is fitted (so the
score is a probability) and the score below which a document is rejected: at
most REJECT of the calibration texts of known language fall below it, and never
a text with a score over one half.

Null text or text without a letter: lang_pred "und", score 0, rejected. Without any labelled
row all texts have lang_pred "und" and score 0, and only those without a letter are rejected.
Languages are all non-null labels. Every input row gives one row; other columns are ignored,
or pass through `keep_known`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import boxed, quoted, unboxed
from lexroute.llm.textops import LOWER, blocks

BUCKETS, DIM = 1 << 15, 16
SAMPLE_PER_LANG = 500
EPOCHS, RATE, REJECT = 8, 0.5, 0.002

_PLAIN = LOWER.copy()
_PLAIN[:0x41] = 0x20
_PLAIN[0x5B:0x61] = 0x20
_PLAIN[0x7B:0x80] = 0x20


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of all texts, and the text that it is of."""
    d = _PLAIN[data]
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != 0x20) | (d[:-1] != 0x20) | (text[1:] != text[:-1])
    d, text = d[keep].astype(np.uint32), text[keep]
    code, rows, of = d, [], []
    for n in (2, 3, 4):
        if len(d) < n:
            break
        code = (code[:-1] << np.uint32(8)) | d[n - 1 :]
        inside = text[n - 1 :] == text[: len(text) - n + 1]
        h = code ^ (code >> np.uint32(15))
        h = h * np.uint32(0x2C1B3C6D) + np.uint32(n)
        rows.append(((h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(17))[inside])
        of.append(text[: len(text) - n + 1][inside])
    if not rows:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(of)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares."""
    data = np.frombuffer(text.encode(), np.uint8)
    rows, _ = subwords(data, np.array([0, len(data)]))
    u, n = np.unique(rows, return_counts=True)
    return u.astype(np.int64), n / max(1, n.sum())


class Model:
    """Languages, and the folded table of what each bucket adds to each language's score."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, threshold: float):
        self.langs, self.table, self.bias, self.threshold = langs, table, bias, threshold

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows, of = subwords(data, off)
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)))
        count = np.bincount(of, minlength=n)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(of, self.table[:, k][rows], n)
        return out / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its probability."""
        z = self.logits(data, off)
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        k = p.argmax(1)
        return k, p[np.arange(len(k)), k]


def stretches(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and a few short stretches of it."""
    words = text.split()
    out = [text]
    for n in (3, 10, 40):
        if len(words) > n:
            a = int(rng.integers(0, len(words) - n))
            out.append(" ".join(words[a : a + n]))
    return out


def train(sample: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """Fits the model to (text, language) pairs; None if there are none."""
    sample = sorted((t, y) for t, y in sample if t and any(c.isalpha() for c in t))
    if not sample:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({y for _, y in sample})
    order = rng.permutation(len(sample))
    held = set(order[: len(sample) // 5].tolist()) if len(sample) >= 10 else set()
    fit = [(*bag(s), langs.index(y)) for i, (t, y) in enumerate(sample) if i not in held for s in stretches(t, rng)]
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(fit)):
            u, share, y = fit[i]
            if not len(u):
                continue
            h = share @ emb[u]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            # the mean spreads the gradient thinly; rows get it in proportion to their share
            emb[u] -= rate * 20 * share[:, None] * back
    model = Model(langs, emb @ out, bias, 0.0)
    check = [(t, langs.index(y)) for i, (t, y) in enumerate(sample) if i in held or not held]
    z = np.array([model.logits(*one(t))[0] for t, _ in check])
    y = np.array([k for _, k in check])
    best, scale = np.inf, 1.0
    for t in np.geomspace(0.05, 4, 60):
        q = z * t
        loss = np.mean(np.log(np.exp(q - q.max(1, keepdims=True)).sum(1)) + q.max(1) - q[np.arange(len(y)), y])
        if loss < best:
            best, scale = loss, t
    model.table, model.bias = model.table * scale, model.bias * scale
    top = np.sort([model.predict(*one(t))[1][0] for t, _ in check])
    model.threshold = float(min(0.5, top[int(REJECT * len(top))]))
    return model


def one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def fit(docs: DataFrame, where=None, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """Trains on a bounded sample of the labelled rows of docs that satisfy where."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    known = known.filter(where) if where is not None else known
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()  # a row for each language
    if not sizes:
        return None
    unit = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id"), F.xxhash64("text")), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, per_lang / r["n"]) * (1 << 30))) for r in sizes], "lang string, share long")
    rows = known.join(F.broadcast(shares), "lang").filter(unit < F.col("share")).select("text", "lang").collect()  # about per_lang of each language
    return train([(r["text"], r["lang"]) for r in rows])


def has_letter(col: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(len(data) + 1, np.int64)
    np.cumsum((LOWER[data] >= 97) & (LOWER[data] <= 122), out=ascii_letter[1:])
    has = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in col[int(i)].as_py() or "")
    return has


def identify(docs: DataFrame, model: Model | None, id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""
    out = judged(docs.select(F.struct(quoted(id).alias("doc_id")).alias("row"), F.col("text").cast("string").alias("text")), model)
    return out.select("row.doc_id", "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that are not rejected, with their own columns only."""
    out = judged(docs.select(boxed(docs).alias("row"), F.col("text").cast("string").alias("text")), model)
    return unboxed(out.filter("not rejected"), "row", docs.schema)


def judged(rows: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang_pred, score, rejected) of every (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, data, off in blocks(batch.column(1)):
                part = batch.slice(a, b - a)
                ok = has_letter(part.column(1), data, off)
                if m is None:
                    lang, score, no = ["und"] * (b - a), np.zeros(b - a), ~ok
                else:
                    k, score = m.predict(data, off)
                    lang = [m.langs[i] if f else "und" for i, f in zip(k, ok)]
                    score = np.where(ok, np.clip(score, 0, 1), 0.0)
                    no = ~ok | (score < m.threshold)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(no)], ["row", "lang_pred", "score", "rejected"])

    schema = rows.select("row").schema
    for n, t in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
        schema = schema.add(n, t)
    return rows.mapInArrow(run, schema)

"""Chunks that follow the sections of a document, one document at a time.

Elements (document, position, kind, level, text) are dealt by document. A chunk never crosses
a section; tables, figures and equations stay whole; a text over MOST tokens is cut at sentence
ends into parts of about TARGET; short neighbours of one section, or of one parent, are merged.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Token sizes.
MOST, TARGET, LEAST = 800, 500, 150
ATOMIC = {"table", "figure", "equation"}
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def rendered(kind: str, level: int | None, text: str) -> str:
    """An element as it stands in a chunk."""
    if kind == "heading":
        return "#" * min(level or 2, 4) + " " + text
    if kind == "equation":
        return f"\n$$\n{text}\n$$\n"
    return f"\n{text}\n" if kind in ("table", "figure") else text


def packed(units: list[str], most: int, extra: str = "") -> list[str]:
    """Consecutive units joined by spaces, a new group where the next would pass `most` tokens."""
    out: list[list[str]] = []
    size = 0
    for u in units:
        n = tokens(u + extra)
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(u)
        size += n
    return [" ".join(g) for g in out]


def parts_of(text: str, target: int = TARGET, most: int = MOST) -> list[str]:
    """A long text in parts: sentences packed to the target, sentences over the limit by words first."""
    units: list[str] = []
    for s in filter(str.strip, _SENTENCE.split(text)):
        units += [s] if tokens(s) <= most else packed(s.split(), most, " ")
    return packed(units, target)


def section_chunks(path: tuple[str, ...], elements: list[tuple[str, int | None, str]], target: int, most: int) -> list[dict]:
    out, held, size = [], [], 0

    def close():
        nonlocal held, size
        if held:
            out.append({"path": path, "body": "\n\n".join(held), "oversized": False})
        held, size = [], 0

    for kind, level, text in elements:
        body = rendered(kind, level, text)
        n = tokens(body)
        if n > most:
            close()
            for piece in [body] if kind in ATOMIC else parts_of(body, target, most):
                out.append({"path": path, "body": piece, "oversized": tokens(piece) > most})
            continue
        if size + n > most:
            close()
        held.append(body)
        size += n
    close()
    return out


def with_header(c: dict) -> str:
    return f"[{' > '.join(c['path'])}]\n{c['body']}" if c["path"] else c["body"]


def merged(chunks: list[dict], least: int = LEAST, most: int = MOST) -> list[dict]:
    """Short chunks joined with the next one of the same section or of a sibling, until nothing changes."""

    def common(a, b):
        p, q = a["path"], b["path"]
        return p if p and p == q else p[:-1] if len(p) >= 2 and len(q) >= 2 and p[:-1] == q[:-1] else None

    while True:
        out: list[dict] = []
        fresh = False  # the last of out is a pair made in this pass
        changed = False
        for c in chunks:
            path = common(out[-1], c) if out and not fresh else None
            if path is not None and tokens(with_header(out[-1])) < least and tokens(with_header(out[-1])) + tokens(with_header(c)) <= most:
                a = out.pop()
                out.append({"path": path, "body": "\n\n".join(t for t in (a["body"], c["body"]) if t.strip()), "oversized": a["oversized"] or c["oversized"]})
                fresh = changed = True
            else:
                out.append(c)
                fresh = False
        if not changed:
            return out
        chunks = out


def chunk(elements: DataFrame, id: str = "page_id", target: int = TARGET, most: int = MOST, least: int = LEAST) -> DataFrame:
    """(id, ordinal, section, n_tokens, oversized, text) from elements (id, position, kind, level, text)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str]] = []
        sections: list[tuple[tuple[str, ...], list]] = [((), [])]
        for kind, level, text in pdf.sort_values("position")[["kind", "level", "text"]].itertuples(index=False):
            text = text or ""
            if kind == "heading":
                level = int(level)
                stack = [h for h in stack if h[0] < level] + [(level, text)]
                sections.append((tuple(t for _, t in stack), []))
            if text.strip():
                sections[-1][1].append((kind, None if pd.isna(level) else int(level), text))
        made = merged([c for path, xs in sections for c in section_chunks(path, xs, target, most)], least, most)
        rows = [(pdf[id].iloc[0], i, " > ".join(c["path"]), tokens(with_header(c)), c["oversized"], with_header(c)) for i, c in enumerate(made, 1)]
        return pd.DataFrame(rows, columns=[id, "ordinal", "section", "n_tokens", "oversized", "text"])

    kind = elements.schema[id].dataType.simpleString()
    return elements.select(id, "position", "kind", F.col("level").cast("double").alias("level"), "text").groupBy(id).applyInPandas(one, f"{id} {kind}, ordinal int, section string, n_tokens int, oversized boolean, text string")

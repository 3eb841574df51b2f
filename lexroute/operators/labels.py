"""Section labels: which are damaged, and which heading a damaged one came from.

A splice appends prose to a heading that was complete, so the heading is a literal prefix of the
label's component. Components are matched by equality of their prefixes with the headings of
the same document (as many rows as a component has characters), never pair by pair.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Longest run without a space that can be a word, characters of a component compared with a heading, ratio of a fair guess.
LONGEST_WORD, HEADING_CHARS, FAIR = 20, 60, 0.8


def spliced(path: Column) -> Column:
    """Whether a component has a token too long for a word; genuine headings that are run together count too. Null path: null."""
    return F.exists(path, lambda part: F.exists(F.split(F.coalesce(part, F.lit("")), r"\s+"), lambda t: F.length(t) > LONGEST_WORD))


def _prefixes(paths: DataFrame, document: str, path: str) -> DataFrame:
    """(doc, prefix, n_paths, bad): every prefix of the distinct paths of a document, with how many paths it leads and whether one is spliced."""
    x = paths.select(F.col(document).alias("doc"), F.col(path).alias("p")).filter("doc is not null and size(p) > 0").distinct()
    x = x.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", 1, n))))
    return x.groupBy("doc", "prefix").agg(F.count("*").alias("n_paths"), F.max(spliced(F.col("p"))).alias("bad"))


def _components(labels: DataFrame, id: str, document: str, path: str) -> DataFrame:
    """(label, doc, size, pos, part): one row for each component."""
    x = labels.select(F.col(id).alias("label"), F.col(document).alias("doc"), F.size(path).alias("size"), F.posexplode(path).alias("pos", "part"))
    return x.filter("doc is not null")


def _headings(paths: DataFrame, document: str, path: str) -> DataFrame:
    """(doc, heading): the distinct components of the paths of a document, without empty ones."""
    x = paths.select(F.col(document).alias("doc"), F.explode(path).alias("heading"))
    return x.filter("doc is not null and heading <> ''").distinct()


def _proposed(parts: DataFrame) -> DataFrame:
    """(label, doc, proposal) of the labels whose components all have a match."""
    whole = parts.filter("match is not null").groupBy("label", "doc", "size").agg(F.array_sort(F.collect_list(F.struct("pos", "match"))).alias("m"))
    return whole.filter("size(m) = size").select("label", "doc", F.transform("m", lambda c: c["match"]).alias("proposal"))


def _longest(parts: DataFrame, headings: DataFrame) -> DataFrame:
    """parts with match: the longest heading of the document that the component begins with, or null."""
    begins = parts.withColumn("heading", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda n: F.left(F.col("part"), n))))
    found = begins.filter("length(part) > 0").join(headings, ["doc", "heading"]).groupBy("label", "pos").agg(F.max_by("heading", F.length("heading")).alias("match"))
    return parts.join(found, ["label", "pos"], "left")


def audit(labels: DataFrame, paths: DataFrame, id: str = "label_id", document: str = "document_id", path: str = "section_path") -> DataFrame:
    """(id, verdict) of every label: spliced, unresolved (no path of its document begins with it) or sound; empty and null labels resolve nothing."""
    known = _prefixes(paths, document, path).select(F.col("doc").alias(document), F.col("prefix").alias(path), F.lit(True).alias("known"))
    verdict = F.when(F.coalesce(spliced(F.col(path)), F.lit(False)), "spliced").when(F.col("known").isNull(), "unresolved").otherwise("sound")
    return labels.select(id, document, path).join(known, [document, path], "left").select(id, verdict.alias("verdict"))


def repair(labels: DataFrame, paths: DataFrame, id: str = "label_id", document: str = "document_id", path: str = "section_path") -> DataFrame:
    """(id, repaired, n_paths, verdict) of every label, from headings that are not spliced themselves.

    safe: the recovered path leads sound paths only. unverifiable: one that it leads is spliced.
    unrepairable: a component has no heading, or the recovered path leads none. Ids must be distinct.
    """
    headings = _headings(paths, document, path).filter(~spliced(F.array("heading")))
    proposed = _proposed(_longest(_components(labels, id, document, path), headings))
    known = _prefixes(paths, document, path).withColumnRenamed("prefix", "proposal")
    graded = proposed.join(known, ["doc", "proposal"]).select(F.col("label").alias(id), F.col("proposal").alias("repaired"), "n_paths", F.when(F.col("bad"), "unverifiable").otherwise("safe").alias("verdict"))
    return labels.select(id).join(graded, id, "left").withColumns({"n_paths": F.coalesce("n_paths", F.lit(0).cast("long")), "verdict": F.coalesce("verdict", F.lit("unrepairable"))})


@F.pandas_udf(StructType().add("heading", "string").add("ratio", "double"))
def _closest(part: pd.Series, headings: pd.Series) -> pd.DataFrame:
    """The most similar heading, the first in order of equals, and how similar it is."""
    out = []
    for p, hs in zip(part, headings):
        scored = [(SequenceMatcher(None, (p or "")[:HEADING_CHARS], h).ratio(), h) for h in sorted(hs if hs is not None else [])]
        best = max(scored, key=lambda s: s[0], default=(0.0, None))
        out.append((best[1] if best[0] > 0 else None, best[0]))
    return pd.DataFrame(out, columns=["heading", "ratio"])


def propose(labels: DataFrame, paths: DataFrame, id: str = "label_id", document: str = "document_id", path: str = "section_path") -> DataFrame:
    """(id, proposal, confidence) of every label, by prefix first and by likeness for components without one; the weakest component's confidence holds.

    high: a prefix; medium: a likeness of FAIR or more; low: less. none, without a proposal: a component is like
    nothing, or the path is none of its document's. Only components without a prefix meet all headings of their document.
    """
    headings = _headings(paths, document, path)
    parts = _longest(_components(labels, id, document, path), headings)
    listed = headings.groupBy("doc").agg(F.collect_set("heading").alias("all"))
    guessed = parts.filter("match is null").join(listed, "doc").select("label", "doc", "size", "pos", _closest("part", "all").alias("g"))
    guessed = guessed.select("label", "doc", "size", "pos", F.col("g.heading").alias("match"), F.when(F.col("g.ratio") >= FAIR, 1).otherwise(2).alias("doubt"))
    both = parts.filter("match is not null").select("label", "doc", "size", "pos", "match", F.lit(0).alias("doubt")).union(guessed)
    weakest = both.groupBy("label").agg(F.max("doubt").alias("doubt"))
    real = paths.select(F.col(document).alias("doc"), F.col(path).alias("proposal")).distinct()
    named = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), F.col("doubt") + 1)
    found = _proposed(both).join(real, ["doc", "proposal"]).join(weakest, "label").select(F.col("label").alias(id), "proposal", named.alias("confidence"))
    return labels.select(id).join(found, id, "left").withColumn("confidence", F.coalesce("confidence", F.lit("none")))

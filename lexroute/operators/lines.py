"""Typed elements of raw text: headings with level and number, captions, lists, equations, paragraphs, under their section paths.

Lines are told apart one by one, in expressions; what they are part of follows from the lines around them: a heading or a caption stands alone, other lines run on to the next of
those or to an empty line, and a paragraph is a list or an equation by its beginning and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: patterns, signs and shares that results depend on ---
ARABIC = r"^(\d{1,2}(?:\.\d{1,2})*)[\.\)]?\s+(\S.*)$"
ROMAN = r"^([IVX]{1,4})\.\s+([A-Z][a-z].*)$"
APPENDIX = r"^([A-Z])\.\s+([A-Z][a-z].*)$"
REFERENCE = r"^\[?\d{1,4}\]?\s*\(?(19|20)\d{2}[a-z]?[\.\)]?\s"
URLISH = r"(?i)(https?://|arxiv:|doi:|urlhttp)"
CAPTION = r"(?i)^(Figure|Fig\.|Table|Algorithm)\s*([0-9]+|[IVXLCDM]+)[:.]?\s*(.*)$"
MATH = "=≠≈±×÷∑∏∫√∂∇≤≥∈∉⊂⊃∪∩∧∨¬∀∃αβγδεζηθικλμνξπρστυφχψω"
FUNCTIONS = ["cos", "sin", "log", "||", "·"]
BULLETS = ["- ", "• ", "* "]
HEADING_CHARS, SHORT_CHARS, NUMERIC_SHARE, SINGLE_SHARE, FEWEST_WORDS, EQUATION_LINES = 100, 40, 0.45, 0.4, 3, 2
# --- end of fixed values ---

#: White space of any script; levels that a path can have (a heading of a deeper one counts as the deepest).
SPACE, LEVELS = r"[\s\p{Z}\x1C-\x1F\x85]", 8


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^{SPACE}+|{SPACE}+$", "")


def numeric_noise(text: Column) -> Column:
    """Whether digits and signs make up more of the text than words do; nothing but white space is noise too."""
    dense = F.regexp_replace(text, SPACE, "")
    odd = F.length(F.regexp_replace(dense, r"[\p{L}.,'\-]", ""))
    return (F.length(dense) == 0) | (odd / F.greatest(F.length(dense), F.lit(1)) > NUMERIC_SHARE)


def math_signs(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, MATH, ""))


def math_line(text: Column) -> Column:
    named = F.lit(False)
    for f in FUNCTIONS:
        named = named | F.contains(text, F.lit(f))
    return (math_signs(text) >= 2) | (F.contains(text, F.lit("=")) & named)


def single_letters(text: Column) -> Column:
    """Whether a run of lone letters, as along the axes of a figure."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lone = F.size(F.filter(words, lambda w: F.length(F.regexp_replace(w, r"^[.,:;()]+|[.,:;()]+$", "")) <= 1))
    return (F.size(words) >= FEWEST_WORDS) & (lone / F.greatest(F.size(words), F.lit(1)) > SINGLE_SHARE)


def heading(line: Column) -> Column:
    """struct(level, number) of a trimmed line that is a numbered heading, else null."""
    refused = (line == "") | (F.length(line) > HEADING_CHARS) | line.rlike(URLISH) | line.rlike(REFERENCE) | numeric_noise(line) | math_line(line) | single_letters(line)
    number = F.regexp_extract(line, ARABIC, 1)
    arabic = line.rlike(ARABIC) & F.regexp_extract(line, ARABIC, 2).rlike(r"^\p{Lu}")
    short = F.length(line) <= SHORT_CHARS
    of = lambda level, number: F.struct(level.cast("int").alias("level"), number.alias("number"))
    found = F.when(arabic, of(1 + F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))), number))
    for pattern in (ROMAN, APPENDIX):
        found = found.when(short & line.rlike(pattern), of(F.lit(1), F.regexp_extract(line, pattern, 1)))
    return F.when(~refused, found)


def dehyphenated(text: Column) -> Column:
    """White space as single spaces, words broken by a hyphen at a line's end joined."""
    return F.regexp_replace(trimmed(F.regexp_replace(text, f"{SPACE}+", " ")), "- +", "")


def listed(text: Column) -> Column:
    begins = F.lit(False)
    for b in BULLETS:
        begins = begins | text.startswith(b)
    return begins | text.rlike(r"^\p{Nd}[.)] ")


def typed_lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line, kind, level, number) of every line: blank, heading, caption or body. No shuffle."""
    x = docs.select(id, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("line_no", "raw"))
    x = x.select(id, "line_no", trimmed(F.col("raw")).alias("line")).withColumn("h", heading(F.col("line")))
    kind = F.when(F.col("line") == "", "blank").when(F.col("h").isNotNull(), "heading").when(F.col("line").rlike(CAPTION), "caption").otherwise("body")
    return x.select(id, "line_no", "line", kind.alias("kind"), F.when(F.col("h").isNotNull(), F.least("h.level", F.lit(LEVELS))).alias("level"), "h.number")


def elements(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, element, kind, level, number, text, section_path, n_lines) in reading order: headings, captions, lists, equations, paragraphs.

    The window of a document holds its lines, one document in one place; a document's text is one value already.
    """
    x = typed_lines(docs, id, text)
    order = Window.partitionBy(id).orderBy("line_no")
    alone = F.col("kind") != "body"
    start = alone | F.lag(alone, 1, True).over(order)
    x = x.withColumn("element", F.sum(start.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("level") == k, F.struct(F.col("line_no").alias("at"), F.col("line").alias("title"))), ignorenulls=True).over(upto) for k in range(1, LEVELS + 1)]
    x = x.withColumn("last", F.array(*last)).filter("kind <> 'blank'")
    # the last heading of a level stands in the path unless a higher one came after it
    higher = lambda k: F.coalesce(F.array_max(F.transform(F.slice("last", 1, k), lambda h: h["at"])), F.lit(-1))
    path = F.transform(F.filter("last", lambda h, k: h.isNotNull() & (h["at"] > higher(k))), lambda h: h["title"])
    rows = x.groupBy(id, "element").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"), F.first("kind").alias("kind"), F.first("level").alias("level"), F.first("number").alias("number"), F.max_by("last", "line_no").alias("last"))
    joined = F.array_join(F.transform("lines", lambda v: v["line"]), " ")
    y = rows.withColumn("text", joined)
    body = F.when(math_line(F.col("text")) & (F.size("lines") <= EQUATION_LINES), "equation").when(listed(F.col("text")), "list").otherwise("paragraph")
    return y.select(id, "element", F.when(F.col("kind") == "body", body).otherwise(F.col("kind")).alias("kind"), "level", "number", "text", path.alias("section_path"), F.size("lines").alias("n_lines"))

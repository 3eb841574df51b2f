"""Token and text expressions, all JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_map() -> tuple[str, str]:
    """Accented Latin letters and the base letters that compatibility decomposition leaves."""
    a, b = [], []
    for code in range(0xC0, 0x180):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        if len(base) == 1 and base != chr(code):
            a.append(chr(code))
            b.append(base)
    return "".join(a) + "".join(map(chr, range(0x300, 0x370))), "".join(b)


_FROM, _TO = _accent_map()


def index_tokens(text: Column) -> Column:
    """Folded, lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), _FROM, _TO), F.lit("([a-z0-9]+)"), 1)


def metric_tokens(text: Column) -> Column:
    """Like index_tokens without accent folding."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def citations(text: Column) -> Column:
    """Sorted distinct n of [Source n]."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[Source (\d+)\]"), 1), lambda x: x.cast("int"))))


def token_estimate(text: Column) -> Column:
    """At least one token, four characters each; empty text none."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def substring_coverage(terms: Column, haystack: Column) -> Column:
    """Share of terms that occur as substrings; 1 without terms."""
    return F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(haystack, t))) / F.size(terms))

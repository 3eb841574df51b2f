"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule looks at counts of one document and votes good (1), bad (-1) or
abstains (0). Expectation-maximisation over the histogram of vote patterns (at
most 3**len(RULES) rows, whatever the corpus) estimates how each rule votes on
good and on bad documents; a document's posterior probability of being good
then replaces the usual demand that it pass every rule. A rule that abstains adds nothing.

The rule on function words knows four languages only, so it votes good or abstains; the one on
word lengths abstains where letters of scripts without spaces abound.

Null text counts as empty: no words, base_failed, not kept. Every input row
gives one row, repeated ones too. An empty table gives no rows. Other columns, whatever their
names, pass through `keep_good` unchanged. Three-word
windows are told apart by 64-bit hashes within one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexroute.llm.sparkops import boxed, durable, quoted, unboxed

MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_lines", "n_upper", "n_letters", "n_stops", "n_marks", "n_unspaced"]
#: Letters of scripts that put no space between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = r"[^\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF]+"

#: Common function words of English, German, French and Spanish.
STOPS = (
    "the of and to in is was that for it with as on be at by this are or an "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als "
    "le la les de des et un une du que qui dans est pour sur au avec ne il "
    "el los las del que y en se por con para una su al lo como"
).split()

#: name, good if, bad if; over the counts above.
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words >= 60 and n_words <= 100000", "n_words < 20"),
    ("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words and 10 * n_unspaced < word_chars"),
    ("symbols", "50 * n_symbols < n_words", "10 * n_symbols > n_words"),
    ("repeats", "10 * n_repeat_words < n_words", "100 * n_repeat_words > 30 * n_words"),
    ("lines", "20 * n_dup_lines <= n_lines", "5 * n_dup_lines > n_lines"),
    ("capitals", "5 * n_upper < n_letters", "2 * n_upper > n_letters"),
    ("letters", "100 * n_letters >= 90 * word_chars", "100 * n_letters < 70 * word_chars"),
    ("stops", "20 * n_stops >= n_words", "false"),
    ("marks", "100 * n_marks < n_words", "20 * n_marks > n_words"),
]
#: Believed before any data is seen: P(vote | class) and how many documents that is worth.
PRIOR = {1: {1: 0.80, 0: 0.17, -1: 0.03}, 0: {1: 0.40, 0: 0.25, -1: 0.35}}
PRIOR_DOCS, PRIOR_GOOD, ROUNDS = 20.0, 0.8, 50


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, _q): the columns of docs as one struct, and all counts as another. No shuffle, no state across rows."""
    x = F.coalesce(quoted(text).cast("string"), F.lit(""))
    y = F.col("_t")
    # replace() scans bytes and copies nothing where a character is absent
    bytes_of = lambda chars: sum((F.octet_length(y) - F.octet_length(F.replace(y, F.lit(c), F.lit(""))) for c in chars), F.lit(0))
    out = docs.select(boxed(docs).alias("row"), x.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+", -1), ""))
    out = out.withColumn("_g", F.when(F.size("_w") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("i"))))))
    same = lambda a, i: F.coalesce(F.get("_g", i)["h"] == a["h"], F.lit(False))
    out = out.withColumn("_p", F.sort_array(F.transform(F.filter("_g", lambda a, i: same(a, i - 1) | same(a, i + 1)), lambda a: a["i"])))
    covered = F.aggregate("_p", F.struct(F.lit(-3).alias("p"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(p.alias("p"), (a["n"] + F.least(F.lit(3), p - a["p"])).alias("n")))["n"]
    out = out.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")))
    longs = {
        "n_words": F.size("_w"),
        "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)),
        "n_symbols": bytes_of(SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_lines": F.size("_l"),
        "n_upper": F.length(F.regexp_replace(y, "[^A-Z]+", "")),
        "n_letters": F.length(F.regexp_replace(y, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")),
        "n_stops": F.size(F.filter("_w", lambda w: F.lower(w).isin(sorted(set(STOPS))))),
        "n_marks": bytes_of("!?"),
        "n_unspaced": F.when(F.octet_length(y) == F.length(y), 0).otherwise(F.length(F.regexp_replace(y, UNSPACED, ""))),
    }
    return out.select("row", F.struct(*(c.cast("long").alias(n) for n, c in longs.items())).alias("_q"))


def base_failed(q: str = "_q.") -> Column:
    return F.expr(f"{q}n_words < {MIN_WORDS} or 100 * {q}n_repeat_words > 50 * {q}n_words")


def votes(q: str = "_q") -> list[Column]:
    """One column of -1, 0 or 1 for each rule."""
    def at(rule: str) -> str:
        for n in COUNTS + MORE_COUNTS:
            rule = rule.replace(n, f"{q}.{n}")
        return rule

    return [F.expr(f"case when {at(bad)} then -1 when {at(good)} then 1 else 0 end").cast("tinyint").alias(name) for name, good, bad in RULES]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """Expectation-maximisation: the prior log-odds of good, and per rule the log-odds that each vote adds.

    patterns: votes of a document, and how many documents vote so. No documents: the beliefs stated above.
    """
    n_rules = len(RULES)
    table = {y: [dict(PRIOR[y]) for _ in range(n_rules)] for y in (0, 1)}
    good = PRIOR_GOOD

    def odds() -> tuple[float, list[dict[int, float]]]:
        weight = [{v: math.log(table[1][r][v] / table[0][r][v]) for v in (-1, 1)} | {0: 0.0} for r in range(n_rules)]
        return math.log(good / (1 - good)), weight

    for _ in range(ROUNDS):
        bias, weight = odds()
        counts = {y: [{v: PRIOR_DOCS * PRIOR[y][v] for v in (-1, 1)} for _ in range(n_rules)] for y in (0, 1)}
        mass = {1: PRIOR_DOCS * PRIOR_GOOD, 0: PRIOR_DOCS * (1 - PRIOR_GOOD)}
        for pattern, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, bias + sum(weight[r][v] for r, v in enumerate(pattern))))))
            for y, share in ((1, p * n), (0, (1 - p) * n)):
                mass[y] += share
                for r, v in enumerate(pattern):
                    if v:
                        counts[y][r][v] += share
        good = mass[1] / (mass[0] + mass[1])
        table = {y: [{v: c / sum(counts[y][r].values()) for v, c in counts[y][r].items()} for r in range(n_rules)] for y in (0, 1)}
    return odds()


def patterns_of(counted: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """The histogram of votes among documents that pass the base rules."""
    names = [r[0] for r in RULES]
    rows = counted.filter(~base_failed()).select(*votes()).groupBy(*names).agg(F.count("*").alias("_n")).collect()  # at most 3**len(RULES)
    return [(tuple(r[n] for n in names), r["_n"]) for r in rows]


def posterior(model: tuple[float, list[dict[int, float]]], q: str = "_q") -> Column:
    bias, weights = model
    total = F.lit(bias)
    for v, w in zip(votes(q), weights):
        total = total + F.when(v == 1, w[1]).when(v == -1, w[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def judge(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """Per document: its id, the counts, base_failed, the posterior and the verdict."""
    counted = durable(with_counts(docs.select(quoted(id).alias("doc_id"), "text")).select("row.doc_id", "_q"))
    model = fit(patterns_of(counted))
    out = counted.select("doc_id", "_q.*", base_failed().alias("base_failed"), posterior(model).alias("quality_probability"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= 0.5))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the verdict keeps, with their own columns only."""
    counted = durable(with_counts(docs))
    model = fit(patterns_of(counted))
    return unboxed(counted.filter(~base_failed() & (posterior(model) >= 0.5)), "row", docs.schema)

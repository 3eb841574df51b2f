"""Section trees against plain prefixes, lines against hand-typed kinds."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import lines, sections  # noqa: E402


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    chunks = [(i, rng.randrange(4), [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for i in range(300)]
    relevant = {(q, rng.randrange(4)) for q in range(40) for _ in range(2)}
    refs = [(q, rng.randrange(4), [rng.choice("abcd") for _ in range(rng.randint(0, 3))]) for q in range(0, 40, 2) for _ in range(3)]
    results = [(q, c, r + 1) for q in range(41) for r, c in enumerate(rng.sample(range(310), 20))]
    return chunks, sorted(relevant), refs, results


@pytest.mark.parametrize("pooled", [True, False])
def test_relevance_by_sections(spark, corpus, pooled):
    chunks, relevant, refs, results = corpus
    c = spark.createDataFrame([*chunks, (900, None, ["a"]), (901, 1, None)], "chunk_id long, document_id long, section_path array<string>").repartition(5)
    docs, labels = spark.createDataFrame(relevant, "query_id long, document_id long"), spark.createDataFrame(refs, "query_id long, document_id long, prefix array<string>")
    nodes = sections.tree(c)
    found = sections.spans(docs, labels, nodes, pooled)
    judged = sections.judged(spark.createDataFrame(results, "query_id long, chunk_id long, rank int"), sections.numbered(c, nodes), found)
    got = {r["query_id"]: r for r in sections.scores(judged, sections.gold_sizes(docs, found)).collect()}
    assert sorted(got) == list(range(40))
    for q in range(40):
        mine = {d for x, d in relevant if x == q}
        own = [(d, p) for x, d, p in refs if x == q and d in mine]

        def ok(doc, path):
            if doc not in mine:
                return False
            prefixes = [p for d, p in own if pooled or d == doc]
            return not prefixes or any(path[: len(p)] == p for p in prefixes)

        gold = {i for i, d, p in chunks if ok(d, p)}
        hits = [r for x, i, r in results if x == q and i in gold]
        dcg, ideal = sum(1 / np.log2(r + 1) for r in hits if r <= 5), sum(1 / np.log2(k + 2) for k in range(min(len(hits), 5)))
        assert got[q]["n_gold"] == len(gold)
        assert got[q]["recall"] == (pytest.approx(sum(r <= 5 for r in hits) / len(gold)) if gold else None)
        assert got[q]["ndcg"] == pytest.approx(dcg / ideal if ideal else 0.0)


def test_tree_is_in_pre_order(spark):
    rows = [(1, ["a", "b"]), (1, ["a"]), (1, ["a", "b"]), (1, ["b"]), (1, []), (2, ["a", "c", "d"])]
    got = {(r["document_id"], *r["prefix"]): (r["low"], r["high"], r["n_chunks"]) for r in sections.tree(spark.createDataFrame(rows, "document_id long, section_path array<string>")).collect()}
    assert got == {(1,): (0, 3, 5), (1, "a"): (1, 2, 3), (1, "a", "b"): (2, 2, 2), (1, "b"): (3, 3, 1), (2,): (0, 0, 1), (2, "a"): (0, 0, 1), (2, "a", "c"): (0, 0, 1), (2, "a", "c", "d"): (0, 0, 1)}


HEADINGS = {
    "1 Introduction": (1, "1"), "2.3. Late Interaction": (2, "2.3"), "3) Results": (1, "3"), "IV. Related Work": (1, "IV"), "A. Proof details": (1, "A"), "10.2.1 Ablations": (3, "10.2.1"),
    "1 introduction": None, "12 34 56 78": None, "[12] 2019. Some paper title": None, "3 See https://x.org": None, "2 E = mc, cos of it": None, "1 R g B K": None, "": None, "H. Wallach, H. Larochelle, Y. Bengio and a lot of others": None,
    "4 " + "Long " * 30: None, "5 ≤ and ≥ Signs": None, "No number here": None, "123 Too many digits": None, "7 (a1) [b2] {c3} #4": None, "XL. Roman beyond reach": None,
}


def test_headings(spark):
    df = spark.createDataFrame([(k,) for k in HEADINGS], "line string").select("line", lines.heading(lines.trimmed(F.col("line"))).alias("h"))
    assert {r["line"]: (r["h"]["level"], r["h"]["number"]) if r["h"] else None for r in df.collect()} == HEADINGS


def test_elements_and_paths(spark):
    text = "\n".join(["preface", "runs on", "1 First", "A para-", "graph of text.", "", "- one", "- two", "1.1 Below", "Table 2: Numbers", "x = cos y", "", "a ≤ b ≥ c", "and", "more", "1.2 Beside", "  ", "2 Second", "3. item"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "1.1 Deep first\r\nbody")], "doc_id long, text string")
    got = [(r["doc_id"], r["kind"], r["text"], r["section_path"]) for r in lines.elements(docs).orderBy("doc_id", "element").collect()]
    one, sub, side = ["1 First"], ["1 First", "1.1 Below"], ["1 First", "1.2 Beside"]
    assert got == [
        (1, "paragraph", "preface runs on", []), (1, "heading", "1 First", one), (1, "paragraph", "A para- graph of text.", one), (1, "list", "- one - two", one), (1, "heading", "1.1 Below", sub),
        (1, "caption", "Table 2: Numbers", sub), (1, "equation", "x = cos y", sub), (1, "paragraph", "a ≤ b ≥ c and more", sub), (1, "heading", "1.2 Beside", side), (1, "heading", "2 Second", ["2 Second"]), (1, "list", "3. item", ["2 Second"]),
        (4, "heading", "1.1 Deep first", ["1.1 Deep first"]), (4, "paragraph", "body", ["1.1 Deep first"]),
    ]
    x = spark.createDataFrame([("A para- graph\n of  te- xt ",)], "t string").select(lines.dehyphenated(F.col("t")).alias("t")).first()
    assert x["t"] == "A paragraph of text"
    assert lines.elements(docs.limit(0)).count() == 0

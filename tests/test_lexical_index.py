"""The kept index: made once, found again, refused when the corpus has changed."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.functions import sessions  # noqa: E402
from lexroute.operators import lexical_index, retrieval  # noqa: E402

TEXTS = [(1, "Red fox, red den"), (2, "a fox"), (3, None), (4, ""), (5, "Éclair den den"), (None, "fox")]


def written(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_counts(spark):
    index = lexical_index.of(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    want = [(1, "red", 2, 4), (1, "fox", 1, 4), (1, "den", 1, 4), (2, "a", 1, 2), (2, "fox", 1, 2), (5, "eclair", 1, 3), (5, "den", 2, 3), (None, "fox", 1, 1)]
    assert rows(index.postings, "doc_id", "term", "tf", "dl") == sorted(want, key=str)
    assert rows(index.terms, "term", "df", "cf") == [("a", 1, 1), ("den", 2, 3), ("eclair", 1, 1), ("fox", 3, 3), ("red", 1, 2)]
    assert rows(index.stats, "n_docs", "n_tokens") == [(6, 10)]


def test_empty_corpus(spark):
    index = lexical_index.of(spark.createDataFrame([], "doc_id long, text string"))
    assert rows(index.stats, "n_docs", "n_tokens", "avgdl") == [(0, 0, None)]
    asked = spark.createDataFrame([(1, "fox")], "query_id long, query string")
    assert retrieval.bm25(index, asked).collect() == []


def test_kept_is_the_same_and_made_once(spark, tmp_path):
    docs = written(spark, f"{tmp_path}/docs", TEXTS)
    first, again = lexical_index.kept(docs), lexical_index.kept(docs)
    assert first.postings.inputFiles() and sorted(first.postings.inputFiles()) == sorted(again.postings.inputFiles())
    for table, columns in (("postings", ("doc_id", "term", "tf", "dl")), ("terms", ("term", "df", "cf")), ("stats", ("n_docs", "n_tokens", "avgdl"))):
        assert rows(getattr(first, table), *columns) == rows(getattr(lexical_index.of(docs), table), *columns)
    assert not [p for p in Path(sessions.shared_folder(spark)).glob("lexical-index-*/draft-*")]


def test_changed_corpus_is_indexed_anew(spark, tmp_path):
    docs = written(spark, f"{tmp_path}/docs", TEXTS)
    assert lexical_index.kept(docs).terms.filter("term = 'owl'").count() == 0
    docs = written(spark, f"{tmp_path}/docs", [*TEXTS, (9, "owl")])
    assert lexical_index.kept(docs).terms.filter("term = 'owl'").count() == 1


def same(spark, got, docs):
    fresh = lexical_index.of(docs)
    for table, columns in (("postings", ("doc_id", "term", "tf", "dl")), ("terms", ("term", "df", "cf")), ("stats", ("n_docs", "n_tokens", "avgdl"))):
        assert rows(getattr(got, table), *columns) == rows(getattr(fresh, table), *columns)
    asked = spark.createDataFrame([(1, "fox den"), (2, "w3 w7 owl"), (3, "nothing")], "query_id long, query string")
    assert rows(retrieval.bm25(got, asked), "query_id", "doc_id", "score", "rank") == rows(retrieval.bm25(fresh, asked), "query_id", "doc_id", "score", "rank")


def test_files_that_come_and_go(spark, tmp_path, monkeypatch):
    """Each change is one segment; scores stay those of a fresh index; old segments go."""
    monkeypatch.setattr(lexical_index, "MOST_SEGMENTS", 3)
    at = f"{tmp_path}/docs"
    add = lambda rows_: spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1).write.mode("append").parquet(at)
    read = lambda: spark.read.schema("doc_id long, text string").parquet(at)
    store = lambda: next(p for p in Path(sessions.shared_folder(spark)).glob("lexical-index-*") if p not in before)
    before = set(Path(sessions.shared_folder(spark)).glob("lexical-index-*"))
    read_texts, seen = lexical_index._postings, []
    monkeypatch.setattr(lexical_index, "_postings", lambda docs, *a: (seen.append(docs.count()), read_texts(docs, *a))[1])
    kept = lambda: lexical_index.kept(read())
    add(TEXTS)
    same(spark, kept(), read())
    add([(20 + i, f"w{i} w{i % 3} fox") for i in range(10)])
    seen.clear()
    index = kept()
    assert seen == [10]  # of the new file only
    same(spark, index, read())
    first = next(p for p in Path(at).glob("part-*.parquet") if spark.read.parquet(str(p)).filter("doc_id = 1").count())
    first.unlink()
    seen.clear()
    index = kept()
    assert seen == []
    same(spark, index, read())
    for i in range(4):
        add([(100 + i, f"owl w{i} den"), (200 + i, None)])
        same(spark, kept(), read())
    names = sorted(p.name.split("-")[0] for p in store().iterdir())
    assert names.count("generation") == 2 and names.count("segment") <= 2 * (3 + 1) and "draft" not in names
    index = kept()
    assert 0 < len(index.postings.inputFiles())
    for p in Path(at).glob("part-*.parquet"):
        p.unlink()
    assert kept().stats.first()["n_tokens"] in (None, 0) and retrieval.bm25(kept(), spark.createDataFrame([(1, "fox")], "query_id long, query string")).count() == 0


def test_a_search_reads_folders_and_pages_of_its_words(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 20), k -> concat('t', pmod(xxhash64(id, k), 5000)))) as text")
    docs.write.parquet(f"{tmp_path}/many")
    index = lexical_index.kept(spark.read.parquet(f"{tmp_path}/many"))
    asked = spark.createDataFrame([("t17",), ("t4242",)], "term string")
    some = index.postings_of(asked)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "EqualTo(h" in plan
    assert rows(some.join(asked, "term"), "doc_id", "term", "tf") == rows(index.postings.join(asked, "term"), "doc_id", "term", "tf")
    some.collect()
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    metric = lambda name: scan.metrics().apply(name).value()
    assert metric("numFiles") <= 8 and metric("numOutputRows") < 80_000 / 10  # two of 32 folders


def test_stale_index_is_refused(spark, tmp_path):
    docs = written(spark, f"{tmp_path}/docs", TEXTS)
    lexical_index.save(docs, f"{tmp_path}/index", "one")
    lexical_index.load(spark, f"{tmp_path}/index", "one")
    with pytest.raises(lexical_index.StaleIndex):
        lexical_index.load(spark, f"{tmp_path}/index", "two")


def test_second_writer_keeps_the_first(spark, tmp_path):
    docs = written(spark, f"{tmp_path}/docs", TEXTS)
    lexical_index.save(docs, f"{tmp_path}/index", "one")
    lexical_index.save(docs, f"{tmp_path}/index", "two")
    lexical_index.load(spark, f"{tmp_path}/index", "one")
    assert [p.name for p in tmp_path.glob("index*")] == ["index"]


def test_query_words_count_each_time(spark):
    index = lexical_index.of(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "den"), (2, "den den"), (3, "nothing"), (4, None)], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(index, asked).collect()}
    assert set(got) == {(1, 1), (1, 5), (2, 1), (2, 5)}
    assert got[2, 5] == pytest.approx(2 * got[1, 5], abs=2e-6)


def test_postings_are_dealt_by_document_once(spark, tmp_path, monkeypatch):
    """Words of queries travel to the postings: one shuffle of asked postings, none of their sums; more words are joined, with the same result."""
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 5} beta" if i % 3 else f"gamma w{i % 7}") for i in range(200)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha w3 w3"), (2, "gamma w1 w4"), (3, "nothing"), (4, "beta alpha")], "query_id long, query string")
    docs.write.parquet(f"{tmp_path}/docs")
    index = lexical_index.of(spark.read.parquet(f"{tmp_path}/docs"))
    sent = retrieval.bm25(index, queries)
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan and not any("doc_id#" in x.split("hashpartitioning(query_id#")[1].split(")")[0] for x in plan.split("\n") if "hashpartitioning(query_id#" in x)
    got = sorted(map(tuple, sent.select("query_id", "doc_id", "score", "rank").collect()))
    monkeypatch.setattr(retrieval, "SENT", 0)
    assert got == sorted(map(tuple, retrieval.bm25(index, queries).select("query_id", "doc_id", "score", "rank").collect())) and len(got) == 30

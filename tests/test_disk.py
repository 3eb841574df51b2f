"""What is shuffled stays far below the corpus: neither its postings, when the index is made, nor texts that are not asked for."""

import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.functions import sessions  # noqa: E402
from lexroute.operators import lexical_index, retrieval  # noqa: E402
from lexroute.plans import catalogue  # noqa: E402


def shuffled(spark, work):
    """Bytes and rows that the stages of work have dealt."""
    gateway = spark.sparkContext._gateway

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        each = [found.apply(k) for k in range(found.size())]
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteBytes(), s.shuffleWriteRecords()) for s in each}

    before = stages()
    work()
    new = [v for k, v in stages().items() if k not in before]
    return sum(b for b, _ in new), sum(n for _, n in new)


def test_postings_are_written_where_they_are_read(spark, tmp_path):
    words = "concat_ws(' ', transform(sequence(1, 30), k -> concat('t', pmod(xxhash64(id, k), 60))))"
    spark.range(4000).selectExpr("id as doc_id", f"{words} as text").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    _, rows = shuffled(spark, lambda: lexical_index.kept(docs))
    index, fresh = lexical_index.kept(docs), lexical_index.of(docs)
    assert rows < index.postings.count() / 20
    assert sorted(map(tuple, index.postings.select("doc_id", "term", "tf", "dl").collect())) == sorted(map(tuple, fresh.postings.collect()))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Long texts of words of their own, some of which hold a benchmark passage."""
    at = tmp_path_factory.mktemp("corpus")
    own = "concat_ws(' ', transform(sequence(1, 20), k -> sha2(concat(id, '/', k), 256)))"
    passage = "concat_ws(' ', transform(sequence(1, 12), k -> concat('p', pmod(id, 10), 'w', k)))"
    docs = spark.range(3000).selectExpr("id as doc_id", f"case when id % 100 < 10 and id < 300 then concat({own}, ' ', {passage}) else {own} end as text", "'en' as lang", "'web' as source")
    docs.withColumn("n_chars", F.length("text").cast("long")).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.range(10).selectExpr("id as item_id", f"{passage} as text").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    catalogue._index(spark, str(at))
    return str(at)


@pytest.mark.parametrize("name", ["trace_rows", "metric_means", "adaptive_results", "context_pack", "sufficiency", "rerank_top10"])
def test_texts_that_are_not_asked_for_are_not_shuffled(spark, folder, name):
    size = spark.read.parquet(f"{folder}/documents.parquet").agg(F.sum("n_chars")).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        rows = []
        sent, _ = shuffled(spark, lambda: rows.extend(catalogue.queries()[name](spark, folder).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows and sent < size / 5


def test_texts_in_passes_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (9, "f")], "doc_id long, text string")
    rows = spark.createDataFrame([(1, 7), (1, 8), (3, 7), (None, 7), (5, 7)], "doc_id long, q long")
    want = [(None, "e"), (1, "a"), (1, "b"), (3, "d")]
    for most in (1 << 20, 2, 1):
        monkeypatch.setattr(retrieval, "ASKED", most)
        assert sorted(map(tuple, retrieval.texts_of(docs, rows).collect()), key=lambda r: (r[0] or 0, r[1])) == want
    assert retrieval.texts_of(docs, rows.limit(0)).count() == 0


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_") and n.endswith(".data")}


def left_behind(spark, work):
    """Shuffle files of work that are there half a minute later; Spark deletes in the background."""
    before = shuffle_files(spark)
    work()
    for _ in range(60):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.5)
    return left


def test_index_and_cut_leave_no_shuffle_files(spark, tmp_path):
    spark.range(400).selectExpr("id as doc_id", "concat('a', id % 7, ' b', id % 11, ' c', id) as text").repartition(4).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    made = []
    tables = lexical_index.Segments(spark, f"{tmp_path}/index")
    assert not left_behind(spark, lambda: made.append(tables._added(docs, lexical_index.corpus_files(docs), None, "doc_id", "text")))
    assert not left_behind(spark, lambda: made.append(sessions.cut(docs.groupBy("doc_id").count())))
    assert made[1].count() == 400 and tables._read(made[0][0], "terms").count() == 418


@pytest.mark.parametrize("name", ["metric_means", "sufficiency", "bm25_top10", "bm25_filtered", "bm25_threshold"])
def test_postings_in_passes_give_the_same(spark, folder, monkeypatch, name):
    run = lambda: sorted(map(tuple, catalogue.queries()[name](spark, folder).collect()))
    want, cuts, cut = run(), [], sessions.cut
    monkeypatch.setattr(retrieval, "HITS", 60)  # of 360
    monkeypatch.setattr(retrieval, "TASK_HITS", 3)
    monkeypatch.setattr(sessions, "cut", lambda df: cuts.append(cut(df)) or cuts[-1])
    assert run() == want
    assert len(cuts) > 6 and sum("score" in x.columns and "rank" in x.columns for x in cuts) == 6


def test_a_pass_deals_its_share_of_postings(spark, folder, monkeypatch):
    most = []
    for hits in (1 << 24, 45):
        monkeypatch.setattr(retrieval, "HITS", hits)
        gateway, sc = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
        stages = lambda: (lambda s: {s.apply(k).stageId(): s.apply(k).shuffleWriteRecords() for k in range(s.size())})(sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))
        before = set(stages())
        catalogue.bm25_top10(spark, folder).collect()
        sc.listenerBus().waitUntilEmpty(30_000)
        most.append(max(n for k, n in stages().items() if k not in before))
    assert most[0] == 360 and most[1] < 130  # 120 words are asked for


def test_a_task_of_the_index_sorts_a_bounded_part_of_the_corpus(spark, tmp_path, monkeypatch):
    """One file of several row groups, in a session of large splits: postings are written by a task for each split of SPLIT at most."""
    words = "concat_ws(' ', transform(sequence(1, 30), k -> sha2(concat(id, '/', k), 256)))"
    docs = spark.range(2000).selectExpr("id as doc_id", f"{words} as text").coalesce(1)
    docs.write.options(**{"parquet.block.size": 1 << 17, "compression": "none"}).parquet(f"{tmp_path}/docs")
    docs, split = spark.read.parquet(f"{tmp_path}/docs"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert docs.rdd.getNumPartitions() == 1
    monkeypatch.setattr(lexical_index, "SPLIT", 1 << 19)
    index = lexical_index.kept(docs)
    assert len({Path(f).name.split("-")[1] for f in index.postings.inputFiles()}) > 3
    assert index.postings.count() == 60_000 and spark.conf.get("spark.sql.files.maxPartitionBytes") == split

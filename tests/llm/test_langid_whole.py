"""Every label is learned, and a corpus without labels is kept."""

import corpus_pipeline
from lexroute.llm import langid


def test_every_label_is_learned(spark):
    data = [(i, f"word{i % 230} of{i % 230} language{i % 230}", f"l{i % 230:03}") for i in range(460)]
    model = langid.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.langs) == 230


def test_pipeline_keeps_unlabelled_texts(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "\u6f22\u5b57", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [1, 4]

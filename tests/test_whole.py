"""Queries give all rows of their definition, also beyond any rank and at the edges."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.plans import catalogue  # noqa: E402


def test_qrels_has_every_holder(spark, tmp_path):
    words = [f"w{i}" for i in range(12)]
    passage = " ".join(words)
    texts = [f"{i} {passage} {i}" for i in range(70)] + ["x" + passage + "y", " ".join(f"v{i}" for i in range(20000)) + passage, passage.replace("w5", "w55"), "ab", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, passage), (1, "b"), (2, None), (3, "w3 w4"), (4, "no such words stand in any of the texts")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = sorted((q, d) for q, p in items for d, t in enumerate(texts) if p is not None and t is not None and p in t)
    assert len(want) > 140
    assert sorted(map(tuple, catalogue.qrels(spark, str(tmp_path)).collect())) == want

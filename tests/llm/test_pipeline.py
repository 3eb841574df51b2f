"""Stages keep the caller's columns, whatever their names; components by tasks and by rounds."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402
from lexroute.llm import sparkops  # noqa: E402

EXTRA = ["score", "rejected", "lang_pred", "_text", "_w", "_t", "_q", "_key", "_pos", "_gone", "row", "key", "id"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    texts = [*base, base[0], base[1] + " " + word(), base[2][:400], None, "", "12 34", base[3] + " " + " ".join(word() for _ in range(5000))]
    return [(i, t, "en" if i % 2 else "de", "s", 0, *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate(texts)]


def test_stages_keep_columns(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in EXTRA), name
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_components_by_tasks_and_by_rounds(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 90, (70, 2))] + [(i, i + 1) for i in range(200, 240)]
    parent = {x: x for p in pairs for x in p}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for p in pairs if p[0] != p[1] for x in p}
    edges = spark.createDataFrame(pairs, "a long, b long")
    for local in (1 << 19, 7):
        assert {r["id"]: r["component"] for r in sparkops.components(edges, local).collect()} == want


def test_nothing_is_left_but_the_last_stage(spark, rows, tmp_path):
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(sparkops.shared_folder(spark))
    before = set(shared.glob("*"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = sorted(p.name for folder in set(shared.glob("*")) - before for p in ([folder] if folder.name.startswith("stored-") else folder.iterdir()))
    assert left == ["4-best_fit_packing"] and out.count() > 0

"""Texts of one template meet only where they can be near; links among them are all found."""

import random

import numpy as np
import pytest

from lexroute.llm import neardup
from lexroute.llm.textops import words_of


def brute(rows, n=4, threshold=80):
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    low = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = [x if v == y else v for v in low]
    return {rows[i][0]: rows[low[i]][0] for i in range(len(rows))}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(6))
    texts = [f"read more about this {i}x" for i in range(120)]
    stem = [word() for _ in range(11)]
    texts += [" ".join([*stem[:8], word(), word(), word()]) for _ in range(60)]  # 5 of 8 shingles in common: not near
    texts += [" ".join([*stem, word()]) for _ in range(40)]  # 8 of 10: near, just
    for _ in range(12):  # pairs that are near in a crowd of the template
        own = [word() for _ in range(30)]
        texts += [" ".join(stem + own), " ".join(stem + own[:-1] + [word()])]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_links_of_templates(spark, rows):
    want = brute(rows)
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    assert got == want and 50 < len(set(want.values())) < len(want) - 40


def test_open_buckets_find_what_pivots_miss(spark, rows):
    """All texts in one bucket, each a component of its own: every link has to come from here."""
    texts = spark.createDataFrame(rows, "id long, text string")
    links = neardup.rest_links(texts.selectExpr("7L as bucket", "id", "id as component"), texts, 4, 80).collect()
    want, low = brute(rows), {i: i for i, _ in rows}
    for a, b in ((r["a"], r["b"]) for r in links):
        x, y = sorted((low[a], low[b]))
        low = {i: x if v == y else v for i, v in low.items()}
    assert low == want


def test_a_template_alone_makes_no_work(spark):
    texts = spark.createDataFrame([(i, f"read more about this {i}x") for i in range(500)], "id long, text string")
    assert neardup.rest_links(texts.selectExpr("7L as bucket", "id", "id as component"), texts, 4, 80) is None


def test_keys_by_shingle_or_by_bucket(spark):
    """Two crowds that share one shingle each in a large bucket, and a bucket whose members share many."""
    rows = [(1, i, i) for i in range(700)] + [(2, 1000 + i, 1000 + i) for i in range(4)] + [(3, 1000 + i, 1000 + i) for i in range(4)]
    rare = [(i, -(i // 2)) for i in range(600)] + [(1000 + i, h) for i in range(4) for h in range(50, 60) if (i + h) % 3]
    met, groups = neardup.meetings(spark.createDataFrame(rows, "bucket long, id long, component long"), spark.createDataFrame(rare, "id long, h long"))
    members = {}
    for r in met.collect():
        members.setdefault(r["key"], set()).add(r["id"])
    sizes = sorted((r["total"], r["strays"]) for r in groups.collect())
    assert sizes == [(2, 1)] * 300 + [(4, 3)]  # pairs by shingle, the second bucket whole, the third one the same members
    assert {frozenset(v) for v in members.values()} == {frozenset((2 * k, 2 * k + 1)) for k in range(300)} | {frozenset(range(1000, 1004))}


def test_prefixes_of_near_sets_meet(spark):
    rng = np.random.default_rng(2)
    made = [rng.choice(60, 10, replace=False).astype(np.uint64) for _ in range(150)]
    frame = spark.createDataFrame([(i, bytearray(np.sort(m).tobytes())) for i, m in enumerate(made)], "id long, members binary").repartition(3)
    frequencies = neardup.Frequencies(frame)
    counts = np.bincount(np.concatenate(made).astype(np.int64), minlength=60)
    assert (frequencies.of(np.arange(60, dtype=np.uint64)) >= counts).all()
    held: dict = {}
    for r in neardup.prefixes(frame, frequencies, 60).collect():
        held.setdefault(r["id"], set()).add(r["h"])
    for a in range(150):
        for b in range(a):
            x, y = set(made[a].tolist()), set(made[b].tolist())
            assert 100 * len(x & y) < 60 * len(x | y) or held.get(a, set()) & held.get(b, set())

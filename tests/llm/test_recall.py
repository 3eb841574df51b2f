"""Near vectors meet wherever their blocks lie."""

import math

import numpy as np
import pandas as pd

from lexroute.llm import embdup


def test_blocks_and_counts_together_keep_the_recall():
    p, n = embdup.inside(embdup.WIDTH), embdup.PROJECTIONS
    need = embdup.needed(recall=embdup.RECALL + 1 - embdup.inside(embdup.BLOCK_REACH))
    counted = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(need, n + 1))
    assert counted - (1 - embdup.inside(embdup.BLOCK_REACH)) >= embdup.RECALL


def test_near_vectors_of_distant_blocks_link(spark, monkeypatch):
    monkeypatch.setattr(embdup, "BLOCK", 1)
    first = embdup.directions(16)[:, 0]
    side = np.random.default_rng(1).normal(size=16)
    side -= side @ first * first
    side /= np.linalg.norm(side)
    v = [math.cos(a) * side + math.sin(a) * first for a in (-0.15, 0.15)]  # apart by 3.8 deviates on the first projection
    out = embdup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert v[0] @ v[1] >= 0.95 and [r["n_links"] for r in out] == [1, 1]


def test_every_pair_of_blocks_in_reach_meets():
    rng, reach = np.random.default_rng(3), embdup.BLOCK_REACH * math.sqrt(0.1 / 16)
    spans = []
    for dim in (16, 32):
        ends = np.sort(rng.normal(size=80)) / 4
        spans += [(dim, b, ends[2 * k], ends[2 * k + 1]) for k, b in enumerate(sorted(rng.choice(60, 40, replace=False).tolist()))]
    spans = pd.DataFrame(spans, columns=["dim", "block", "lo", "hi"]).sample(frac=1, random_state=1)
    last = {(r.dim, r.i): r.last for r in embdup.last_met(spans, 0.95).itertuples()}
    one = spans[spans["dim"] == 16]
    for s in one.itertuples():
        for t in one[one["block"] >= s.block].itertuples():
            assert (t.lo - s.hi <= reach) == (t.block <= last[16, s.block])


def test_lengths_blocks_and_empty_numbers(spark, monkeypatch):
    monkeypatch.setattr(embdup, "BLOCK", 16)
    rng, rows = np.random.default_rng(8), []
    for dim in (16, 24):
        for _ in range(60):
            v = rng.normal(size=dim)
            rows += [(len(rows), v), (len(rows) + 1, v + rng.normal(size=dim) * 0.15 * rng.random())]
    got = {r["vec_id"]: r for r in embdup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()}
    near = {i: {j for j, w in rows if j != i and len(v) == len(w) and embdup.unit(v) @ embdup.unit(w) >= 0.95} for i, v in rows}
    low = {i: i for i in near}
    for _ in rows:
        low = {i: min([low[i], *(low[j] for j in near[i])]) for i in near}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (len(near[i]), low[i]) for i in near}
    assert sum(map(len, near.values())) > 100

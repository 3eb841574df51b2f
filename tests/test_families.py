"""Families of comparisons against plain versions of every step."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import families, inference  # noqa: E402

METRICS = ["mrr", "recall_at_5", "total_latency_ms"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    arms = {"a": 0.0, "b": 0.1, "c": 0.0}
    rows = []
    for q in range(40):
        base = rng.normal(size=2)
        for arm, shift in arms.items():
            mrr = float(base[0] + shift + rng.normal() * 0.2)
            recall = [0.0, 0.5, 1.0][int(rng.integers(0, 3))]
            rows.append((f"q{q}", arm, mrr, recall if q != 3 or arm != "b" else None, float(np.exp(base[1] + shift * 30 + rng.normal()))))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "query_id string, system string, mrr double, recall_at_5 double, total_latency_ms double").repartition(4)


def plain(data, treatment, baseline, k):
    t, b = ({r[0]: r[k] for r in data if r[1] == a} for a in (treatment, baseline))
    d = np.array([t[q] - b[q] for q in t if t[q] is not None and b.get(q) is not None])
    z = d[d != 0]
    c = z - z.mean()
    skew, kurtosis = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3
    symmetric = len(z) >= 10 and abs(skew) <= 0.5 and abs(kurtosis) <= 2
    up, down = int((d > 0).sum()), int((d < 0).sum())
    if k == 4 or not symmetric:
        return d, symmetric, "signs", inference.sign_test(up, down)
    import pandas as pd

    rank = pd.Series(np.abs(z)).rank().to_numpy()
    _, times = np.unique(np.abs(z), return_counts=True)
    return d, symmetric, "signed ranks", inference.rank_law(len(z), min(rank[z > 0].sum(), rank[z < 0].sum()), float((times.astype(float) ** 3 - times).sum()))[0]


def test_all_pairs(frame, data):
    pairs = families.all_pairs(["a", "b", "c", "absent"])
    assert pairs == [("b", "a"), ("c", "a"), ("absent", "a"), ("c", "b"), ("absent", "b"), ("absent", "c")]
    got = {(r["metric"], r["treatment"], r["baseline"]): r for r in families.compare(frame, pairs, METRICS, rounds=200).collect()}
    assert len(got) == 18
    for k, m in enumerate(METRICS, 2):
        ps = []
        for t, b in pairs:
            r = got[m, t, b]
            if t == "absent":
                assert (r["n_pairs"], r["test"], r["p_value"], r["p_holm"], r["significant"], r["family_size"]) == (0, None, None, None, False, None)
                continue
            d, symmetric, test, p = plain(data, t, b, k)
            assert (r["n_pairs"], r["test"], r["symmetric"]) == (len(d), test, symmetric) and r["p_value"] == pytest.approx(p) and r["median_d"] == pytest.approx(np.median(d))
            assert r["ci_low"] <= r["median_d"] <= r["ci_high"] and r["n_queries"] == 40 and r["no_treatment"] + r["no_baseline"] == (m == "recall_at_5" and "b" in (t, b))
            ps.append((p, t, b))
        high = 0.0
        for i, (p, t, b) in enumerate(sorted(ps)):
            high = max(high, min(1.0, p * (len(ps) - i)))
            assert got[m, t, b]["p_holm"] == pytest.approx(high, abs=1e-6) and got[m, t, b]["family_size"] == 3 and got[m, t, b]["significant"] == (round(high, 6) < 0.05)
    assert got["total_latency_ms", "b", "a"]["significant"]


def test_families_with_a_missing_p_as_one(frame):
    out = families.compare(frame, families.against(["a", "b", "absent"], "a"), ["mrr"], rounds=50, missing="one").collect()
    assert {r["family_size"] for r in out} == {2} and {r["treatment"]: r["p_holm"] for r in out}["absent"] == 1.0
    runs = frame.filter("system <> 'c'").withColumn("system", F.concat(F.lit("before/"), "system")).union(frame.filter("system <> 'c'").withColumn("mrr", F.col("mrr") + 1).withColumn("system", F.concat(F.lit("after/"), "system")))
    out = families.compare(runs, families.before_and_after(["a", "b"]), ["mrr"], rounds=50).collect()
    assert [(r["wins"], r["mean_d"]) for r in out] == [(40, pytest.approx(1.0))] * 2


def test_arms_over_other_queries_are_refused(frame):
    with pytest.raises(families.PairingError, match="did not measure"):
        families.guarded(frame.filter("not (system = 'b' and query_id = 'q1')"), ["a", "b"])
    swapped = frame.withColumn("query_id", F.when((F.col("system") == "b") & (F.col("query_id") == "q1"), "q999").otherwise(F.col("query_id")))
    with pytest.raises(families.PairingError, match="did not measure"):
        families.guarded(swapped, ["a", "b"])
    with pytest.raises(families.PairingError, match="twice"):
        families.guarded(frame.union(frame), ["a", "b"])
    with pytest.raises(families.PairingError, match="named twice"):
        families.guarded(frame, ["a", "a"])
    assert families.guarded(frame, ["c", "nobody", "a"]) == ["c", "a"] and families.guarded(frame.limit(0), ["a"]) == []
    with pytest.raises(ValueError, match="unknown"):
        families.compare(frame, [("a", "b")], ["speed"])

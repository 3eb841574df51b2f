"""Queries on means of users don't depend on the order in which rows are added up."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.functions import totals  # noqa: E402
from lexroute.plans import catalogue  # noqa: E402

UP, DOWN = (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)  # as doubles their sums differ in the last bit


def folder(spark, tmp_path, rows):
    """events in one file, in this order."""
    x = [(i, u, t, v) for i, (u, t, v) in enumerate((u, t, v) for u, t, vs in rows for v in vs)]
    spark.createDataFrame(x, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_totals_in_any_order(spark):
    x = spark.createDataFrame([("a", v) for v in UP] + [("b", v) for v in DOWN] + [("c", 1e300), ("c", 2.0), ("d", 1e-30), ("d", 2e-30), ("e", float("inf")), ("f", None), ("g", 1e19), ("g", 1e19), ("g", 0.5), ("g", None)], "k string, v double")
    got = {r["k"]: (r["m"], r["s"]) for r in x.groupBy("k").agg(totals.mean(F.col("v")).alias("m"), F.expr(totals.total_sql("v")).alias("s")).collect()}
    assert got["a"] == got["b"] and got["a"][0] == 0.6 / 3
    assert got["c"] == (5e299, 1e300) and got["d"][0] == pytest.approx(1.5e-30) and got["e"] == (float("inf"), float("inf")) and got["f"] == (None, None)
    assert got["g"] == (2e19 / 3, 2e19)


def test_equal_signals_make_one_cut(spark, tmp_path):
    sf = folder(spark, tmp_path, [(u, t, UP if u % 2 else DOWN) for u in range(8) for t in ("view", "click", "purchase")])
    got = [r.asDict() for r in catalogue.rule_sweep(spark, sf).collect()]
    assert [(r["n"], r["cut"], r["rate"]) for r in got] == [(8, 0.2, 1.0)] * 2


def test_equal_means_win_together(spark, tmp_path):
    sf = folder(spark, tmp_path, [(1, "click", UP), (1, "view", DOWN)])
    assert {(r["s"], r["wins"], r["regret"]) for r in catalogue.queries()["gain_concentration"](spark, sf).collect()} == {("click", 1, 0.0), ("view", 1, 0.0)}


def test_equal_means_are_ties(spark, tmp_path):
    sf = folder(spark, tmp_path, [(1, "click", UP), (1, "view", DOWN), (2, "click", (3.0,)), (2, "view", (1.0,))])
    r = catalogue.queries()["paired_effect"](spark, sf).first()
    assert (r["n"], r["wins"], r["ties"], r["losses"], r["mean_d"]) == (2, 1, 1, 0, 1.0)

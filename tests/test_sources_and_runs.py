"""Sources, sinks, continuous runs and order scores on small frames."""

import random
from datetime import datetime

from lexroute.operators.text_scores import common_length, rouge_l
from lexroute.plans import catalogue
from lexroute.sources import files
from lexroute.streaming import runs

SF = "/root/testdata/sf0.001"


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not b else [0] + _next(row, x, b)
    return row[-1]


def _next(row, x, b):
    out = []
    for j, y in enumerate(b):
        out.append(row[j] + 1 if x == y else max(row[j + 1], out[-1] if out else 0))
    return out


def test_common_length_is_that_of_the_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert common_length(a, b) == plain_common(a, b)


def test_rouge_l(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["a"]), (None, None)], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(rouge_l("a", "b")).collect()] == [0.8, 0.0, 0.0]


def test_section_paths_follow_a_plain_stack(spark):
    want, heads = set(), {}
    for r in catalogue.html_elements(spark, SF).filter("kind like 'h%'").collect():
        heads.setdefault(r["page_id"], []).append((r["position"], int(r["kind"][1]), r["text"]))
    for page, hs in heads.items():
        stack = []
        for position, level, title in sorted(hs):
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            want.add((page, position, len(stack), tuple(x[1] for x in stack)))
    assert {(r["page_id"], r["position"], r["depth"], tuple(r["path"])) for r in catalogue.section_paths(spark, SF).collect()} == want


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], None), ("b", [], 2.0)], "id string, names array<string>, v double")
    files.export_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, files.json_lines(spark, f"{tmp_path}/j", df.schema).collect())) == sorted(map(tuple, df.collect()))
    files.export_csv(df, f"{tmp_path}/c")
    back = spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/c")
    assert {r["id"]: r["names"] or "" for r in back.collect()} == {"a": "x\ny", "b": ""}
    (tmp_path / "m.json").write_text('[{"id": "p1", "n": 1}, {"id": "p2", "n": 2}]')
    assert [r["n"] for r in files.manifest(spark, f"{tmp_path}/m.json", only_id="p2").collect()] == [2]
    assert [r["id"] for r in files.manifest(spark, f"{tmp_path}/m.json", limit=1).collect()] == ["p1"]


def test_upsert_misses_and_checks(spark):
    old, new = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (2, "c"), (3, "d")]))
    assert sorted(map(tuple, files.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert [tuple(r) for r in files.misses(new, old, "k").collect()] == [(3, "d")]
    assert [r["k"] for r in files.remaining(old, new, "k").collect()] == [1]
    good = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    x = spark.createDataFrame([("a", good), ("b", good), (None, None)], "c string, h string")
    assert files.verified(x, x["c"], x["h"]).count() == 1


def test_continuous_runs(spark, tmp_path):
    at = datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([(1, at, "ok"), (2, at, "ok"), (2, at, "ok"), (3, at, "failed")], "q int, t timestamp, s string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("q int, t timestamp, s string").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing left
        runs.run_batches(runs.once_each(stream, "q", "t"), lambda b: b.select("q"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r["q"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    q = runs.status_counts(stream, "t", "s").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["s"], r["n"]) for r in spark.sql("select * from counts").collect()} == {("ok", 3), ("failed", 1)}

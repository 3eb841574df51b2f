"""Exact dedup, fill-in-the-middle and whitening against plain definitions, with nulls, empties, ties, repeats, long texts and extra columns."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexroute.llm import exactdup, fim, queries, whiten

EXTRA = ["row", "at", "digest", "n", "first", "key", "text_sha256", "a.b", "form", "output"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [None, "", " ", "\n\t", "a", "Ab", "ab", "a  b", "a\tb", "a\x0bb", "a b", "é漢🎉 x<é>y", "say <P> now", "<S", "<S<M", "P><S", "1 2  3", "x" * 300, "é" * 40, "word " * 60_000, "<<<>>> PSM"]
    texts += ["".join(rng.choice("ab <PSM>é漢\n1") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    out = [(i, t, *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "Ab", *EXTRA), (None, "only here", *EXTRA), (900, "only here", *EXTRA), (901, "nobody", *EXTRA), (901, "nobody", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_groups(rows):
    flat = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    held = {}
    for r in rows:
        held.setdefault(flat(r[1]), []).append(r[0])
    return {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in held.items()}, flat


@pytest.mark.parametrize("share", [exactdup.HOT_SHARE, 0.01, 1.0])
def test_exact_dedup(spark, docs, rows, monkeypatch, share):
    monkeypatch.setattr(exactdup, "HOT_SHARE", share)  # all, some and none of the groups are hot
    want, flat = plain_groups(rows)
    got = exactdup.groups(docs).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == sorted(((r[0], *want[flat(r[1])], hashlib.sha256(flat(r[1]).encode()).hexdigest()) for r in rows), key=str)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in kept}) == len(want) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exactdup.keep_one(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    left = left.collect()
    assert sorted((flat(r["text"]), r["doc_id"]) for r in left if r["doc_id"] is not None) == sorted((t, i) for t, (i, _) in want.items() if i is not None)
    assert all(tuple(r) in rows for r in left)
    assert exactdup.groups(docs.limit(0)).count() == 0 and exactdup.keep_one(docs.limit(0)).count() == 0


def test_frequent_digests_are_found(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tasks without rows take part
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = spark.range(200_000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(F.col("id")).cast("string").cast("binary").alias("digest"), F.col("id").alias("at"), F.col("id").alias("doc_id"))
    hot = exactdup.winners(rows)
    got = {int(bytes(r["digest"])): (r["n"], r["first"]["doc_id"]) for r in hot.collect()}
    want = {}
    for i in range(200_000):
        k = i % 40 if i % 3 == 0 else i
        n, first = want.get(k, (0, i))
        want[k] = n + 1, min(first, i)
    assert got == {k: v for k, v in want.items() if v[0] > 20}


def plain_cut(text, id):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(docs, rows):
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted(((r[0], *plain_cut(r[1], r[0])) for r in rows), key=str)
    assert sorted(r["back"] for r in out) == sorted(r[1] or "" for r in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    boxed = fim.transform(docs, keep_columns=True)
    assert boxed.select("row.*").schema == docs.schema and all(r["row"]["form"] == (f"form{r['doc_id']}" if r["row"]["form"] != "form" else "form") for r in boxed.collect())
    assert fim.transform(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got, want = queries.queries()[name](spark, sf), con.sql(queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = want.fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in rows), key=str)


def exact_covariance(x):
    """Of distinct rows, as fractions."""
    fit = sorted({tuple(r) for r in x})
    n, d = len(fit), len(fit[0])
    s = [sum(r[i] for r in fit) for i in range(d)]
    mean = [Fraction(v, n) for v in s]
    return n, s, [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n for j in range(d)] for i in range(d)]


def test_whitening(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(200, 6)) * [3, 2, 1, 0.5, 0.1, 0.01] + [5, 0, 0, -90000, 0, 1]).astype(np.float32)
    v[150:] = v[:50]
    short = rng.normal(size=(9, 3)).astype(np.float32)
    data = [(i, [float(c) for c in x], "e") for i, x in enumerate([*v, *short])]
    odd = [(900, None, "e"), (901, [float("nan")] * 6, "e"), (902, [None] + [1.0] * 5, "e"), (903, [float("inf")] * 6, "e"), (904, [], "e"), (905, [-0.0, 7.0], "e"), (None, data[3][1], "e"), data[4]]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, `x` string").repartition(4)
    out = whiten.whiten(frame)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert {r["vec_id"] for r in got} == {None, *range(209)} and len(got) == 202 * 4 + 9 * 3
    for ids, rows in ((range(200), v), (range(200, 209), short)):
        x = [[int(np.floor(float(c) * 256)) for c in r] for r in rows]
        n, s, exact = exact_covariance(x)
        cov = np.array(exact, float)
        mean = np.array([float(Fraction(t, n)) for t in s])
        e, axes = np.linalg.eigh(cov)
        here = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] in ids}
        for k in range(1, min(4, len(mean)) + 1):
            want = (np.array(x) - mean) @ axes[:, -k] / np.sqrt(e[-k])
            z = np.array([here[i, k]["whitened"] for i in ids])
            assert np.allclose(z, want * np.sign(z @ want), atol=1e-8)
            for i, r in zip(ids, x):
                assert here[i, k]["deviation"] == sum((n * c - t) ** 2 for c, t in zip(r, s)) and here[i, k]["n"] == n
                assert here[i, k]["explained"] == pytest.approx(e[-k] / np.trace(cov), rel=1e-9) and here[i, k]["identity_error"] < 1e-9
    assert whiten.whiten(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whiten.whiten(same).count() == 0


def test_sums_are_exact_to_double_double():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 40), 1 << 40, (3000, 3))
    x[:, 1] = x[:, 0] + rng.integers(-2, 3, 3000)  # nearly the same: a plain sum of squares loses all digits
    n, s, exact = exact_covariance(x.tolist())
    mean = [Fraction(int(t), n) for t in s]
    hi = np.array([float(m) for m in mean])
    pair = hi, np.array([float(m - Fraction(float(h))) for m, h in zip(mean, hi)])
    total = (np.zeros((3, 3)),) * 2
    for k in range(0, 3000, 700):
        total = whiten.outer_sum(total, whiten.centred(x[k : k + 700], pair))
    for i in range(3):
        for j in range(3):
            got = Fraction(float(total[0][i, j])) + Fraction(float(total[1][i, j]))
            assert abs(got - exact[i][j] * n) <= Fraction(1, 1 << 90) * max(exact[a][a] for a in range(3)) * n


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 50, -(1 << 50)], [3, 4]])
    sums = [(1 << 50) + 3, 4 - (1 << 50)]
    assert whiten.deviations(x, 2, sums) == [None, None]
    assert whiten.deviations(x[1:], 2, [5, 9]) == [(6 - 5) ** 2 + (8 - 9) ** 2]

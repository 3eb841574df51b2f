"""The operators against plain definitions on small frames, with nulls, empties, ties, repeats and extra columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexroute.llm import bpe, embdup, langid, lm, neardup, packing, quality, rules, runindex, substring
from lexroute.llm.textops import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos string, id string, component string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(120)] for _ in range(6)]
    texts = [" ".join(b) for b in base]
    texts += [texts[0], " ".join(base[1][:100] + [word() for _ in range(3)] + base[1][100:]), " ".join(base[2][30:90] + [word() for _ in range(60)])]
    texts += [None, "", " \n\t ", "one", "a b c", texts[3].upper(), "é ü 　 漢字 🎉 <|endoftext|> x's", " ".join([word() for _ in range(3000)])]
    out = [(i, t, "en" if i % 2 else None, "s", None, "k", "p", "i", "c") for i, t in enumerate(texts)]
    return [*out, out[4], (None, texts[5], None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, rows, none):
    n = substring.WINDOW
    seen = Counter()
    for r in rows:
        w = words_of(r[1])
        seen.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = []
    for r in rows:
        w = words_of(r[1])
        gone = {k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        want.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert sorted(map(tuple, substring.digest(docs).collect()), key=str) == sorted(want, key=str)
    assert substring.digest(none).count() == 0
    cut = substring.remove(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)


def test_run_index_alone():
    rng = random.Random(5)
    for trial in range(60):
        w = rng.choice([3, 8, 20])
        segs = [bytes(rng.choice(b"ab\x00\xff" if trial % 2 else b"a") for _ in range(rng.randint(w, 60))) for _ in range(rng.randint(1, 12))]
        seen, want = set(), []
        for s in segs:
            hit = []
            for k in range(len(s) - w + 1):
                if s[k : k + w] in seen:
                    hit.append(k)
                seen.add(s[k : k + w])
            want.append(hit)
        assert [x.tolist() for x in runindex.run_length_repeats(segs, w)] == want


@pytest.mark.parametrize("hot", [1, 5000])
def test_run_index(docs, rows, none, hot):
    n = runindex.WINDOW
    seen, want, done = set(), [], {}
    for r in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        raw = (r[1] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - n + 1):
            if raw[k : k + n] in seen:
                gone[k : k + n] = b"\x01" * n
            seen.add(raw[k : k + n])
        done[r] = (r[0], len(raw), bytes(b for b, g in zip(raw, gone) if not g))
    want = [done[r[0], r[1]] for r in rows]
    got = runindex.spans(docs, hot_segments=hot).select("doc_id", "n_bytes", "kept").collect()
    assert sorted(((a, b, bytes(c)) for a, b, c in got), key=str) == sorted(want, key=str)
    assert runindex.digest(none).count() == 0


def test_bpe_is_the_library(docs, rows, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    for r in rows[:-1]:
        assert got[r[0]] == t.encode(r[1] or "", add_special_tokens=False).ids
        assert back[r[0]] == (r[1] or "")
    assert bpe.round_trip_digest(none).count() == 0


def test_packing(docs, none):
    out = packing.pack(docs).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= packing.CAPACITY
    assert packing.pack(none).count() == 0
    made = packing.plan({1000: 3, 1048: 3, 500: 2, 700: 1, 848: 1})
    assert sum(k for _, k in made) == 5 and sum(sum(x) * k for x, k in made) == 3 * 2048 + 2548


def brute_classes(rows, n, threshold):
    sets = {}
    for r in rows:
        w = words_of((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.setdefault(r[0], []).append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets if i is not None}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in parent:
        for b in parent:
            if a < b and any(x and y and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in parent}


def test_near_duplicates(docs, rows, none):
    want = brute_classes(rows, 4, 80)
    got = {r["id"]: r["component_id"] for r in neardup.near_duplicates(docs, 4, 80).collect()}
    assert got == want | {None: None}
    assert neardup.keep_one(docs).columns == docs.columns
    assert neardup.near_duplicates(none).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 16))
    v[100:200] = v[:100] + rng.normal(size=(100, 16)) * 0.08
    v[200] = v[7] * 3
    data = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1)]
    out = {r["vec_id"]: r for r in embdup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    assert [out[i]["n_links"] for i in range(300)] == (near.sum(1) - 1).tolist()
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in (900, 901, 902, 903))


def test_rules(docs, rows, none):
    got = rules.judge(docs)
    for r in got.collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        w = words_of(text)
        triples = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k in range(len(w) - 2) if triples[(w[k], w[k + 1], w[k + 2])] > 1 for j in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
    assert rules.judge(none).count() == 0 and rules.keep_good(docs).columns == docs.columns


def test_language_and_quality(spark, docs, none):
    model = langid.train([("der die das und nicht " * 5 + str(i), "de") for i in range(20)] + [("the of and to was " * 5 + str(i), "en") for i in range(20)])
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "und das nicht"), (2, "the was of"), (3, None), (4, "123 !")], "doc_id long, text string"), model).collect()}
    assert out == {1: "de", 2: "en", 3: "und", 4: "und"}
    assert langid.identify(docs, langid.fit(none)).filter("lang_pred <> 'und'").count() == 0
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(16)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, labels).filter("score between 0 and 1").count() == docs.count()
    assert quality.score(none, labels).count() == 0


def test_language_model(docs, rows, none):
    got = lm.score(docs).collect()
    counts = Counter(w for r in rows for w in [*words_of((r[1] or "").translate({c: c + 32 for c in range(65, 91)})), "\n"])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {n}
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        w = [*words_of((text or "").translate({c: c + 32 for c in range(65, 91)})), "\n"]
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) and r["n_tokens"] == len(w)
    assert lm.score(none).count() == 0

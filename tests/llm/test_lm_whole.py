"""The model's score: the same for a filter that is broadcast and one that stays dealt, and better than the base."""

import numpy as np
import pytest

from lexroute.llm import lm
from lexroute.llm.sparkops import fold, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").select("doc_id", "text")


def test_scores_do_not_depend_on_how_the_filter_is_dealt(docs):
    whole = sorted(map(tuple, lm.score(docs).collect()))
    for part_bytes in (1 << 11, 1 << 16):
        parts = sorted(map(tuple, lm.score(docs, broadcast_bytes=0, part_bytes=part_bytes).collect()))
        assert [r[:4] for r in parts] == [r[:4] for r in whole]
        assert [x for r in parts for x in r[4:]] == pytest.approx([x for r in whole for x in r[4:]])


def test_held_out_texts_are_scored_better_than_by_the_base(docs):
    rows = lm.score(docs, fold("doc_id", 5) != 1).join(docs.filter(fold("doc_id", 5) == 1).select("doc_id"), "doc_id").collect()
    assert sum(r["score"] for r in rows) > 0.95 * sum(r["base_score"] for r in rows)
    assert sum(r["score"] >= r["base_score"] for r in rows) > 0.6 * len(rows)
    assert all(r["score"] < 0 for r in rows)


def test_pairs_met_once_count(spark):
    once = spark.createDataFrame([(0, "these words stand here once"), (1, "and others stand there")], "doc_id long, text string")
    for r in lm.score(once).collect():
        assert r["score"] > r["base_score"] + 1


def filter_of(h, q, slots):
    """A filter with each n-gram h at levels 1 to q, bit by bit."""
    own = np.zeros(slots * lm.SLOT_BITS, bool)
    for k, n in zip(h, q):
        bits = lm.bits_of(np.full(n, k, np.uint64), np.arange(1, n + 1))
        for p in range(lm.PROBES):
            own[lm.slot_of(np.full(n, k, np.uint64), slots) * lm.SLOT_BITS + lm.field(bits, p)] = True
    return np.packbits(own, bitorder="little")


def test_levels_read_before_are_not_probed_again(monkeypatch):
    """Plain probing, in groups, with a memory and with one of a few places: the same levels, most of them with fewer probes."""
    rng = np.random.default_rng(5)
    h, slots = rng.integers(1, 1 << 63, 3000, np.uint64), 60
    q = rng.integers(0, 25, len(h)) * (rng.random(len(h)) < 0.8)
    table = filter_of(h, q, slots)

    def plain(k):
        base = lm.slot_of(np.array([k]), slots)[0] * lm.SLOT_BITS
        for n in range(1, lm.LEVELS + 1):
            bits = lm.bits_of(np.array([k]), [n])
            at = [base + lm.field(bits, p)[0] for p in range(lm.PROBES)]
            if not all(table[b >> 3] >> (b & 7) & 1 for b in at):
                return n - 1
        return lm.LEVELS

    want = np.array([plain(k) for k in h])
    assert (want >= q).all()
    monkeypatch.setattr(lm, "TOGETHER", 100)
    assert (lm.levels_in(table, slots, h) == want).all() and not len(lm.levels_in(table, slots, h[:0], memory=lm.Memory()))
    probed, put = [], lm.put
    monkeypatch.setattr(lm, "put", lambda table, base, *a: probed.append(len(base)) or put(table, base, *a))
    for places, share in ((1 << 20, 0.2), (64, 1)):
        monkeypatch.setattr(lm, "PLACES", places)
        memory, some = lm.Memory(), rng.permutation(np.repeat(np.arange(len(h)), 2))
        counts = []
        for _ in range(3):
            probed.clear()
            assert (lm.levels_in(table, slots, h[some], memory=memory) == want[some]).all()
            counts.append(sum(probed))
        assert counts[2] < share * counts[0]
    assert lm.memory_of(table) is lm.memory_of(table) and lm.memory_of(table.copy()) is not lm.memory_of(table)

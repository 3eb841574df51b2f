"""Damaged labels and their repair on documents with known headings."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.operators import labels  # noqa: E402

SCHEMA = "document_id string, section_path array<string>"
PROSE = "Offline Indexingwhichwasthenextendedbyothers"


@pytest.fixture(scope="module")
def paths(spark):
    rows = [("d", ["3 Method", "3.4 Offline Indexing"]), ("d", ["3 Method", "3.4"]), ("d", ["3 Method"]), ("d", ["3 Method", "3.4"]), ("d", ["5 Results", "5.1 Averyveryverylongfusedheading"]), ("e", ["1 Intro"]), (None, ["9 Lost"]), ("f", [])]
    return spark.createDataFrame(rows, SCHEMA)


def marked(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "label_id int, " + SCHEMA)


def test_audit(spark, paths):
    given = marked(spark, [("d", ["3 Method", "3.4"]), ("d", ["3 Method", "3.4 " + PROSE]), ("d", ["4 Absent"]), ("e", ["3 Method"]), ("d", []), ("d", None), (None, ["9 Lost"]), ("zz", ["1 Intro"]), ("d", ["5 Results"])])
    got = {r[0]: r[1] for r in labels.audit(given, paths).collect()}
    assert got == {0: "sound", 1: "spliced", 2: "unresolved", 3: "unresolved", 4: "unresolved", 5: "unresolved", 6: "unresolved", 7: "unresolved", 8: "sound"}
    assert labels.audit(given, paths.limit(0)).filter("verdict = 'sound'").count() == 0


def test_repair_takes_the_longest_sound_heading(spark, paths):
    given = marked(spark, [("d", ["3 Method", "3.4 " + PROSE]), ("d", ["3 Methodology"]), ("d", ["4 Absent"]), ("d", ["5 Resultsand"]), ("e", ["3 Method"]), ("d", []), ("d", None), ("d", ["3 Method", ""]), (None, ["9 Lost"]), ("d", ["3.4 Offline Indexing"]), ("d", ["5 Results", "5.1 Averyveryverylongfusedheading"])])
    got = {r["label_id"]: (r["repaired"], r["n_paths"], r["verdict"]) for r in labels.repair(given, paths).collect()}
    none = (None, 0, "unrepairable")
    assert got == {0: (["3 Method", "3.4 Offline Indexing"], 1, "safe"), 1: (["3 Method"], 3, "safe"), 2: none, 3: (["5 Results"], 1, "unverifiable"), 4: none, 5: none, 6: none, 7: none, 8: none, 9: none, 10: none}
    assert labels.repair(given, paths.limit(0)).count() == 11


def test_proposals_by_likeness(spark, paths):
    given = marked(spark, [("d", ["3 Method", "3.4 " + PROSE]), ("d", ["3 Metod", "3.4"]), ("d", ["Methods of 3"]), ("d", ["####"]), ("d", ["3.4", "3 Method"]), ("zz", ["1 Intro"]), ("d", None)])
    got = {r["label_id"]: (r["proposal"], r["confidence"]) for r in labels.propose(given, paths).collect()}
    assert got[0] == (["3 Method", "3.4 Offline Indexing"], "high") and got[1] == (["3 Method", "3.4"], "medium") and got[2] == (["3 Method"], "low")
    assert all(got[i] == (None, "none") for i in (3, 4, 5, 6))

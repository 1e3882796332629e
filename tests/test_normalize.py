import pytest

from chashma.operators import normalize as N

CASES = [
    ("Salom. ", "Salom.", "CHANGED_SAFE", []),
    ("Salom.  ", "Salom.  ", "UNCHANGED_REVIEW_REQUIRED", ["MULTIPLE_TRAILING_ASCII_SPACES"]),
    ("Salom.\t ", "Salom.\t ", "UNCHANGED_REVIEW_REQUIRED", ["WHITESPACE_BEFORE_TRAILING_ASCII_SPACE"]),
    (" ", " ", "UNCHANGED_REVIEW_REQUIRED", ["EMPTY_OR_WHITESPACE_TEXT", "LEADING_WHITESPACE"]),
    ("", "", "UNCHANGED_REVIEW_REQUIRED", ["EMPTY_OR_WHITESPACE_TEXT"]),
    ("Bu ma lumot muhim. ", "Bu ma lumot muhim.", "CHANGED_SAFE_REVIEW_REQUIRED", ["HIGH_CONFIDENCE_APOSTROPHE_GAP"]),
    ("bo lgan", "bo lgan", "UNCHANGED_REVIEW_REQUIRED", ["HIGH_CONFIDENCE_APOSTROPHE_GAP"]),
    ("ubo lgan", "ubo lgan", "UNCHANGED", []),
    ("o zbek", "o zbek", "UNCHANGED_REVIEW_REQUIRED", ["AMBIGUOUS_APOSTROPHE_GAP"]),
    ("Salom.\n", "Salom.\n", "UNCHANGED_REVIEW_REQUIRED", ["TRAILING_NEWLINE"]),
    ("Salom. ", "Salom. ", "UNCHANGED_REVIEW_REQUIRED", ["OTHER_TRAILING_WHITESPACE"]),
    (None, None, "INVALID_INPUT_REVIEW_REQUIRED", None),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id long, text string")


def test_cases(frame):
    got = {r.source_record_id: r for r in N.normalize(frame, "id", "text").collect()}
    for i, (_, text, status, flags) in enumerate(CASES):
        assert (got[i].normalized_text, got[i].normalization_status, got[i].review_flags) == (text, status, flags), CASES[i]


def test_twice_is_once(frame):
    once = N.normalize(frame, "id", "text")
    twice = N.normalize(once.select("source_record_id", "normalized_text"), "source_record_id", "normalized_text")
    assert not twice.where("operation_count > 0").count()


def test_contract(spark, frame):
    run = N.normalize(frame, "id", "text")
    assert all(r.failing == 0 for r in N.validate(frame, run, "id", "text").collect())
    damaged = run.withColumn("normalized_text", run.normalized_text.substr(1, 2))
    found = {r.problem: r.failing for r in N.validate(frame, damaged, "id", "text").collect()}
    assert found["normalized_hash_mismatch"] > 0 and found["invalid_trim_transformation"] > 0
    short = {r.problem: r.failing for r in N.validate(frame, run.where("source_record_id > 0"), "id", "text").collect()}
    assert short["missing_row"] == 1 and short["extra_row"] == 0
    assert all(r.status == "PASS" for r in N.run_checks(run, frame, "id", "text").collect())
    assert any(r.status == "FAIL" for r in N.run_checks(damaged, frame, "id", "text").collect())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert N.normalize(empty, "id", "text").count() == 0

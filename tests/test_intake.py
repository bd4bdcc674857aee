import datetime as dt

import pytest

from scoreflow import schemas as S
from scoreflow.sources import intake as K

FORM = "student_id string, name string, grade string, subjects array<struct<name: string, scores_text: string, max_score: double>>"


def forms(spark, *rows):
    return spark.createDataFrame(list(rows), FORM)


def errors(spark, *form):
    rejected = K.check_forms(forms(spark, form))[1].collect()
    return rejected[0].errors if rejected else []


def test_messages_in_form_order(spark):
    got = errors(spark, " ", "", "13", [(" ", "1", 100.0), ("Art", "1, x", 100.0), ("PE", " , ", 100.0)])
    assert got == [
        "Student ID is required.",
        "Student Name is required.",
        "Grade must be between 1 and 12.",
        "Subject 1 name is required.",
        "Subject 2 scores must be numbers (e.g. 85, 90, 78). Got: '1, x'",
        "Subject 3 (PE) has no scores.",
    ]
    assert errors(spark, "S1", "Ann", "ten", []) == ["Grade must be a number between 1 and 12."]
    assert errors(spark, "S1", "Ann", "10", []) == ["At least one subject with scores is required."]
    assert errors(spark, "S1", "Ann", "10", None) == ["At least one subject with scores is required."]
    assert errors(spark, None, "Ann", "12.0", [("Art", "1", 100.0)]) == [
        "Student ID is required.", "Grade must be a number between 1 and 12.",
    ]


def test_records_become_attempts(spark):
    records, _ = K.check_forms(forms(spark, (" S1 ", " Ann ", " 11 ", [(" Ma th", "85, 90.5,, 78 ", 50.0), ("Art", "7", None)])))
    rows = K.intake_attempts(records, dt.date(2024, 6, 1)).select(S.ATTEMPT_COLUMNS).orderBy("subject", "attempt_number").collect()
    day = dt.date(2024, 6, 1)
    assert [tuple(r) for r in rows] == [
        ("S1", "Ann", 11, "Art", "ART_MOCK_1", "mock", 1, 7.0, 100.0, day),
        ("S1", "Ann", 11, "Ma th", "MA__MOCK_1", "mock", 1, 85.0, 50.0, day),
        ("S1", "Ann", 11, "Ma th", "MA__MOCK_2", "mock", 2, 90.5, 50.0, day),
        ("S1", "Ann", 11, "Ma th", "MA__MOCK_3", "mock", 3, 78.0, 50.0, day),
    ]


def test_no_rows_is_an_error(spark):
    with pytest.raises(ValueError, match="nothing"):
        K.require_rows(spark.createDataFrame([], S.VALIDATED), "nothing")

import pytest

from helpers import table
from scoreflow import schemas as S
from scoreflow.operators import validation as V

GOOD = ("S1", "Ann", "5", "Math", "E1", "mock", "1", "80", "100", "2024-01-01")
AS_OF = "2025-01-01 12:00:00"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), S.RAW)


def changed(**cells):
    return tuple(cells.get(c, v) for c, v in zip(S.ATTEMPT_COLUMNS, GOOD))


@pytest.mark.parametrize(
    "cells, error",
    [
        ({}, None),
        ({"student_id": " "}, "student_id missing"),
        ({"student_id": None}, "student_id missing"),
        ({"grade": "0"}, "grade out of range"),
        ({"grade": "13"}, "grade out of range"),
        ({"grade": "12.9"}, None),
        ({"grade": "x"}, "grade out of range"),
        ({"subject": ""}, "invalid subject"),
        ({"exam_type": "Mock"}, "invalid exam_type"),
        ({"attempt_number": "0.5"}, "invalid attempt_number"),
        ({"attempt_number": ""}, "invalid attempt_number"),
        ({"attempt_number": "1e12"}, "invalid attempt_number"),
        ({"max_score": "0"}, "invalid max_score"),
        ({"score": "100.5"}, "score out of range"),
        ({"score": "-1"}, "score out of range"),
        ({"score": "100"}, None),
        ({"exam_date": "2024-02-30"}, "invalid exam_date"),
        ({"exam_date": "2025-01-01"}, None),
        ({"exam_date": "2025-01-02"}, "exam_date in future"),
        ({"grade": "99", "score": "-1", "student_id": ""}, "student_id missing"),
        ({"exam_type": None, "score": "-1"}, "invalid exam_type"),
    ],
)
def test_first_broken_rule(spark, cells, error):
    assert V.classify(raw(spark, changed(**cells)), AS_OF).first().error == error


def test_columns(spark):
    df = raw(spark, GOOD)
    with pytest.raises(ValueError, match=r"Missing required columns: \['Name', 'score'\]"):
        V.check_columns(df.drop("Name", "score").withColumnRenamed("grade", "grade"))
    with pytest.raises(ValueError, match=r"Unexpected columns found \(schema drift\): \['x'\]"):
        V.check_columns(df.selectExpr("*", "1 AS x"))
    shuffled = df.select(*reversed(df.columns))
    assert V.check_columns(shuffled) is shuffled


def test_strict_mode(spark):
    assert table(V.validate(raw(spark, GOOD), AS_OF))[0][:3] == ("S1", "Ann", 5)
    with pytest.raises(ValueError, match="Row validation failed.*score out of range"):
        V.validate(raw(spark, GOOD, changed(exam_id="E2", score="x")), AS_OF)
    with pytest.raises(ValueError, match="Duplicate exam attempts detected"):
        V.validate(raw(spark, GOOD, changed(score="70")), AS_OF)
    with pytest.raises(RuntimeError, match="is empty"):
        V.validate(spark.createDataFrame([], S.RAW), AS_OF)


def test_report_names_the_first_five(spark):
    rows = [(i, *changed(exam_id=f"E{i}", grade="0")) for i in range(9)]
    df = spark.createDataFrame(rows, "row_index int, " + ", ".join(f"{c} string" for c in S.ATTEMPT_COLUMNS))
    report = V.error_report(V.classify(df, AS_OF))
    assert [r["row_index"] for r in V.first_errors(report)] == [0, 1, 2, 3, 4]


def test_quarantine_keeps_every_row_somewhere(spark):
    rows = [GOOD, changed(score="70"), changed(exam_id="E2"), changed(exam_id="E3", grade="x")]
    good, rejected = V.split_rows(raw(spark, *rows), AS_OF)
    assert [r.exam_id for r in good.collect()] == ["E2"]
    assert sorted(r.error for r in rejected.collect()) == [V.DUPLICATE, V.DUPLICATE, "grade out of range"]


def test_gate(spark):
    assert tuple(V.gate(raw(spark, GOOD), AS_OF).first()) == (1, 0, 0, True)
    assert tuple(V.gate(raw(spark, GOOD, GOOD, changed(grade="x")), AS_OF).first()) == (3, 1, 1, False)
    assert tuple(V.gate(spark.createDataFrame([], S.RAW), AS_OF).first()) == (0, 0, 0, False)


def test_coercion_is_not_repeated_in_filters(spark):
    plan = V.accepted(V.classify(raw(spark, GOOD), AS_OF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 5


def test_chosen_students_match_trimmed(spark):
    ids = spark.createDataFrame([(" S1",), ("S9",)], "student_id string")
    df = raw(spark, changed(student_id="S1 "), changed(student_id="S2"))
    assert [r.student_id for r in V.of_students(df, ids).collect()] == ["S1"]

from helpers import table
from scoreflow import schemas as S
from scoreflow.operators import keyed as K
from scoreflow.operators import listings

USER = "id string, full_name string, email string, role string, student_id string"


def test_upsert_meets_text_and_number_keys_and_is_idempotent(spark):
    old = spark.createDataFrame([("S1", "1", "a"), ("S2", "1", "b"), (None, "1", "c")], "k string, n string, v string")
    new = spark.createDataFrame([("S1", 1, "new"), (None, 1, "blank"), ("S3", 1, "more")], "k string, n int, v string")
    once = K.upsert_rows(old, new, ["k", "n"])
    assert sorted(map(str, table(once.na.fill("")))) == sorted(
        map(str, [("S1", "1", "new"), ("S2", "1", "b"), ("", "1", "blank"), ("S3", "1", "more")])
    )
    assert table(K.upsert_rows(once, new, ["k", "n"]).na.fill("")) == table(once.na.fill(""))


def test_update_by_email(spark):
    users = spark.createDataFrame([("1", "A", " A@x ", "Student", ""), ("2", "B", "b@x", "Student", "S2")], USER)
    edits = spark.createDataFrame([("a@X", "S1", 1), ("a@x", " S9 ", 2), ("B@x", None, 1), ("c@x", "S3", 1)], "email string, student_id string, n int")
    assert {r.id: r.student_id for r in K.update_by_email(users, edits, "n").collect()} == {"1": "S9", "2": ""}
    plain = K.update_by_email(users.drop("student_id").selectExpr("*", "1 AS last"), edits, "n")
    assert plain.columns == ["id", "full_name", "email", "role", "student_id", "last"]


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("1", "A", "A@x ", "Student")], "id string, full_name string, email string, role string")
    new = spark.createDataFrame(
        [("5", "E", "a@X", "Student", 1), ("6", "F", "F@x", "Student", 2), ("7", "G", "f@x", "Teacher", 3)],
        "id string, full_name string, email string, role string, seq int",
    )
    full, rejected = K.insert_if_absent(old, new, "seq", S.USERS.names)
    assert full.columns == S.USERS.names
    assert sorted((r.id, r.email, r.student_id) for r in full.collect()) == [("1", "A@x ", ""), ("6", "f@x", "")]
    assert sorted(r.id for r in rejected.collect()) == ["5", "7"]


def test_linked_ids_look_up_by_email(spark):
    users = spark.createDataFrame(
        [("1", "A", "A@x", "Student", ""), ("2", "B", "b@x", "Student", "S2"), ("3", "C", "c@x", "Student", " "), ("4", "D", "d@x", "Admin", "")], USER
    )
    lookup = spark.createDataFrame([("a@x", "z@x", "S7 "), (None, "C@X", "S8"), ("q@x", "a@x", "S0")], "email string, Email2 string, StudentID string")
    got = {r.email: r.student_id for r in listings.linked_ids(users, lookup).collect()}
    assert got == {"A@x": "S7", "b@x": "S2", "c@x": ""}
    assert {r.email: r.student_id for r in listings.linked_ids(users, lookup.drop("StudentID")).collect()} == {"A@x": "", "b@x": "S2", "c@x": ""}


def test_report_list_and_accounts(spark):
    reports = spark.createDataFrame([(f"S{i:03}", "x" * 200, i) for i in range(60)], "student_id string, overall_summary string, other int")
    rows = listings.report_list(reports).collect()
    assert len(rows) == 50 and rows[0].asDict() == {"Student ID": "S000", "AI Summary (preview)": "x" * 120 + "…"}
    users = spark.createDataFrame([("1", "A", "a@x", " Student", None), ("2", "B", "b@x", "Admin", "S2")], USER)
    assert [tuple(r) for r in listings.student_accounts(users).collect()] == [("A", "a@x", "")]

"""JSON is read and written once per row, with the results of the single expressions."""

import io
import json
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from scoreflow import schemas as S
from scoreflow.functions import text as X
from scoreflow.operators import narrative as L
from scoreflow.operators import reports as R

CELLS = [
    None, "", "  ", "plain", " é\n\"x\\  ", '{"b": 1, "a": null}', "{broken}", "{", '"', '""', '"q"', '"q" "', "[]", "[1] [2]",
    "[1], [2]", "true", "null", "-0.50", "1e3", "05", "x {\"a\": 1} y", "}{", "[x {\"a\": true} ]", '{"a": 1, "a": 2}', "\x0b5\x0c",
    '{"a": 1}] {}', "{}", "x {} y", '{"a": {"k": [1.0, "x"]}}', '[{"a": 1}]', '"{\\"a\\": 1}"',
]


def frame(spark, cells=CELLS):
    return spark.createDataFrame(list(enumerate(cells)), "i int, x string")


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def test_recovery_in_steps_equals_the_expression(spark):
    df = frame(spark).withColumn("want", F.to_json(X.recover_json(F.col("x"))))
    rows = X.with_recovered_json(df, "x", "got").withColumn("got", F.to_json("got")).collect()
    assert len(rows) == len(CELLS) and [r.got for r in rows] == [r.want for r in rows]
    assert sum(r.got is not None for r in rows) > 10


def test_cells_in_steps_equal_the_expression(spark):
    df = frame(spark).withColumns({"want": F.to_json(X.normalize_cell(F.col("x"))), "y": F.col("x")})
    rows = X.with_cell_json(df, ["x", "y"]).collect()
    assert [(r.x, r.y) for r in rows] == [(r.want, r.want) for r in rows] and None not in [r.x for r in rows]


def test_json_strings_keep_null(spark):
    rows = X.with_json_strings(frame(spark), ["x"]).collect()
    assert [r.x if r.x is None else json.loads(r.x) for r in rows] == CELLS


def test_field_text_of_odd_fields(spark):
    told = ['{"a": "true"}', '{"a": false}', '{"a": null}', "{}", "[]", None, '{"a": [true]}', '{"a": 1e400}', '{"a": 10.50}']
    df = frame(spark, told).withColumn("v", F.try_parse_json("x"))
    rows = df.select(X.field_text(F.col("v"), "a", "low").alias("t"), X.field_text(F.col("v"), "a").alias("u")).collect()
    wanted = ["true", "False", "", "low", "low", "low", "[true]"]
    assert [r.t for r in rows][:7] == wanted and rows[8].t == "10.5"
    assert [r.u for r in rows][:7] == ["" if w == "low" else w for w in wanted]


def test_responses_are_parsed_in_compiled_steps(spark):
    given = spark.createDataFrame([("S1", 5, "Math", 1, '{"performance_summary": "x"}')], S.SUBJECT_RESPONSES)
    df = L.parse_responses(given.repartition(1), S.GROUP_KEY, S.SUMMARY_FIELDS)
    assert df.first().performance_summary == "x"
    text = plan(df).lower()
    assert "lambda" not in text and text.count("parsejson(concat(") == 2  # the whole text, the part in braces


def test_records_of_prompts_are_written_once(spark):
    odd = 'a\n"b" : null,\n  "c" : \\ } é '
    rows = spark.createDataFrame([([(odd, None, 1.5), (None, 3, 1e20)],)], "r array<struct<a string, b int, c double>>")
    df = rows.repartition(1).select(L.json_records(F.col("r"), ["b", "a", "c"]).alias("t"))
    assert plan(df).count("StructsToJsonEvaluator(") == 1
    want = [{"b": "", "a": odd, "c": 1.5}, {"b": 3, "a": "", "c": 1e20}]
    text = df.first().t
    assert json.loads(text) == want
    assert text.replace("1.0E20", "1e+20").lower() == json.dumps(want, indent=2).lower()
    assert rows.select(L.json_records(F.slice("r", 1, 0), ["a"])).first()[0] == "[\n\n]"


def test_plain_cells_of_reports_are_no_variants(spark):
    told = spark.createDataFrame(
        [("S1", None, "Art", "say \"é\"", '{"k": 1}', None, "low", "x", "why", '""', None, "f"),
         ("S1", 5, "Math", "a", "b", "c", "low", "x", None, None, None, None),
         ("S1", 6, None, "a", "b", "c", "low", "x", "why", "  ", "05", "5")],
        "student_id string, grade int, subject string, performance_summary string, improvement_plan string, motivation_note string, "
        "confidence_note string, llm_provider string, explanation_summary string, key_evidence_points string, "
        "confidence_in_insight string, recommended_focus_area string",
    )
    meta = spark.createDataFrame([("S1", None, None, "n")], "student_id string, student_name string, grade int, name string")
    analytics = spark.createDataFrame([("S1", 5, "Math", 1, 1.0, 1.0, 1.0, "t", 0.0, 0.0, "v", None, "b", "r", "c")], S.ANALYTICS)
    overall = spark.createDataFrame([("S1", 5, "all", "k", "a", '["p"]', "low", None)], S.CONSOLIDATED)
    df = R.documents(meta, analytics, told, overall)
    assert "as variant)" not in plan(df).lower() and "cast(performance_summary" not in plan(df).lower()
    common = {"confidence_note": "low", "llm_provider": "x", "student_id": "S1"}
    plain = {"performance_summary": "a", "improvement_plan": "b", "motivation_note": "c"}
    why = {"explanation_summary": "why"}
    assert json.loads(df.first().report) == {
        "student_id": "S1", "student_name": "", "overall_summary": "all", "recommended_next_steps": ["p"],
        "numerical_performance": [{"subject": "Math", "average_score": 1.0, "latest_score": 1.0, "trend": "t", "risk_flag": "r"}],
        "subject_summaries": [
            common | {"subject": "Art", "performance_summary": "say \"é\"", "improvement_plan": {"k": 1}, "motivation_note": "",
                      "explainability": why | {"key_evidence_points": "", "confidence_in_insight": "", "recommended_focus_area": "f"}},
            common | plain | {"grade": 5, "subject": "Math", "explainability": {}},
            common | plain | {"grade": 6, "explainability": why | {
                "key_evidence_points": [], "confidence_in_insight": "05", "recommended_focus_area": 5}},
        ],
        "mode": "cached", "llm_provider_used": "ollama",
    }

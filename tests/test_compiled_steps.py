"""Steps over every row stay compiled, and a bucket of the report tables does not grow with the data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import attempts, table
from scoreflow import schemas as S
from scoreflow.functions import text as X
from scoreflow.operators import consolidation, insights, metrics, reports
from scoreflow.plans import catalog, serving

#: The JVM interprets longer methods for good.
LONGEST = 8000


@pytest.fixture
def whole_plans(spark):
    """Plans that are generated whole before they run."""
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(key, value)
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def longest_method(spark, df):
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    assert parts.size() > 0
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


def exams(spark):
    rows = [(f"S{s}", 5, "Math", f"E{i}", kind, 1, 30 + s + i, "2024-01-01") for s in range(3) for i, kind in enumerate(("mock", "real"))]
    return attempts(spark, rows)


def test_figures_of_a_group_are_compiled(whole_plans):
    df = metrics.subject_analytics(exams(whole_plans).repartition(2))
    assert longest_method(whole_plans, df) < LONGEST
    states = metrics.group_states(exams(whole_plans)).repartition(2)
    assert longest_method(whole_plans, metrics.analytics_of_states(states)) < LONGEST


def test_reports_are_compiled(whole_plans, tmp_path):
    spark = whole_plans
    empty = [spark.createDataFrame([], s) for s in (S.VALIDATED, S.ANALYTICS, S.INSIGHTS, S.SUMMARIES, S.CONSOLIDATED)]
    served = serving.publish(spark, str(tmp_path / "served"), 2, *empty)
    assert longest_method(spark, served.report_documents()) < LONGEST


def test_evidence_lines_are_compiled(spark):
    analytics = spark.createDataFrame(metrics.subject_analytics(exams(spark)).collect(), S.ANALYTICS).repartition(1)
    df = insights.subject_insights(analytics)
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    points = spark.createDataFrame([("a", None, "b\n"), (None, None, None), (None, "", None)], "x string, y string, z string")
    assert [r[0] for r in points.select(X.bullet_lines(*map(F.col, "xyz"))).collect()] == ["- a\n- b\n", "", "- "]


def test_a_column_is_stripped_as_any_text(spark):
    odd = [None, "", " ", "a", " a", "a\x0b", "\x0ca\t\r\n", "a b", "\x01a\x01", "é", " é", "é\n", " a ", "\x00", "!a!", "a\x1f "]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").repartition(1).select("x", X.strip("x").alias("want"), X.strip_column("x").alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len(rows) == len(odd)


def test_json_of_an_only_field_is_cut_at_bytes(spark):
    rows = spark.createDataFrame([('é"\\}',), ("",), (None,), ("😀{",)], "x string").repartition(1)
    got = rows.select(F.to_json(F.struct("x")).alias("j")).select(X.only_field("j", "x")).collect()
    assert [r[0] for r in got] == ['"é\\"\\\\}"', '""', "", '"😀{"']
    strings = X.with_json_strings(rows, ["x"])
    assert [r.x for r in strings.collect()] == ['"é\\"\\\\}"', '""', None, '"😀{"']
    assert "substring(cast(_json_x" in strings._jdf.queryExecution().optimizedPlan().toString()


def test_names_and_metadata_in_one_pass(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (student, name, grade, "Math", f"E{n}", "mock", n, 1.0, 100.0, day)
        for student, n, name, grade in [
            ("S1", 1, None, 5), (" S1", 2, "Second", 6), ("S1 ", 3, "Third", 7), ("S2", 1, None, 5), ("S3", 2, "B", None),
            ("S3", 1, "A", 4), (None, 1, "Nobody", 3), ("", 1, "", 2),
        ]
    ]
    validated = spark.createDataFrame(rows, S.VALIDATED)
    want = reports.student_metadata(validated).join(consolidation.first_names(validated), "student_id", "left")
    got = reports.named_metadata(validated)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key) and got.columns == want.columns
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    assert serving.buckets_for(0, 8) == serving.buckets_for(8 * serving.BUCKET_ROWS, 8) == 8
    assert serving.buckets_for(90 * serving.BUCKET_ROWS + 1, 8) == 91
    spark.createDataFrame(
        [(i, i % 30, "F", 1e5, dt.datetime(2024, 1, 1), "LOW") for i in range(90)],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    few = table(catalog.QUERIES["served_documents"](spark, str(tmp_path)))
    monkeypatch.setattr(serving, "BUCKET_ROWS", 3)
    served = catalog._served(catalog.Stored(spark, str(tmp_path)))
    assert served.buckets == 10
    assert table(served.report_documents()) == few and few

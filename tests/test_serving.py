"""Report tables bucketed by student: equal results, no shuffle, one bucket for a lookup."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from helpers import attempts
from scoreflow import schemas as S
from scoreflow.operators import insights, metrics, reports, roster
from scoreflow.plans import serving


@pytest.fixture(scope="module")
def tables(spark):
    """120 students, one of them with a third of all attempts; ids with blanks; rows without a partner."""
    rows = [
        (f"{' ' * (s % 2)}S{s}", 5 + s % 3, subject, f"E{i}", kind, 1, 30 + (7 * s + 9 * i) % 60, f"2024-01-0{i + 1}")
        for s in range(120) for subject in ("Math", "Art") for i, kind in enumerate(("mock", "real"))
    ]
    rows += [("HOT", 6, "PE", f"H{i}", "mock", 1, i % 90, "2024-02-01") for i in range(240)]
    validated = attempts(spark, rows)
    analytics = metrics.subject_analytics(validated.filter("trim(student_id) <> 'S3'"))
    found = insights.subject_insights(analytics).filter("subject = 'Math'")
    summaries = analytics.filter("trim(student_id) <> 'S4'").select(
        "student_id", "grade", "subject", F.lit('["a"]').alias("performance_summary"), F.lit("p").alias("improvement_plan"),
        F.lit("").alias("motivation_note"), F.lit(None).cast("string").alias("confidence_note"), F.lit("x").alias("llm_provider"),
    )
    done = validated.filter("trim(student_id) <> 'S5'").groupBy("student_id", "grade").agg(F.lit("well").alias("overall_summary")).select(
        "student_id", "grade", "overall_summary", F.lit("s").alias("key_strengths"), F.lit("i").alias("areas_to_improve"),
        F.lit('{"do": "it"}').alias("recommended_next_steps"), F.lit("high").alias("confidence_note"), F.lit("m").alias("llm_provider"),
    )
    return validated, analytics, found, summaries, done.unionByName(done.limit(3))


@pytest.fixture(scope="module")
def path(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("served") / "it's here")
    serving.publish(spark, path, 4, *tables).close()
    return path


@pytest.fixture
def no_broadcast(spark):
    """Small test tables would be broadcast; large ones are not."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equals_the_reports_from_phase_tables(spark, tables, path):
    validated, analytics, _, _, done = tables
    served = serving.opened(spark, path)
    want = sorted(reports.report_documents(*tables).collect())
    assert sorted(served.report_documents().collect()) == want and len(want) == 118
    listed = sorted(roster.class_roster(analytics, validated, done).collect())
    assert sorted(served.class_roster().collect()) == listed and len(listed) == 120
    assert {r.student_id for r in listed if not r.processed} == {"S5"}


def test_no_exchange(no_broadcast, path):
    served = serving.opened(no_broadcast, path)
    for df in (served.report_documents(), served.class_roster()):
        text = plan(df)
        assert "Exchange" not in text and text.count("Bucketed: true") >= 3 and "SortMergeJoin" in text


def test_lookup_reads_one_bucket(no_broadcast, tables, path):
    served = serving.opened(no_broadcast, path)
    one = served.report_of(" S7 ")
    pruned = re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", one._jdf.queryExecution().explainString(
        no_broadcast._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    ))
    assert pruned and set(pruned) == {("1", "4")}
    assert [r.student_id for r in one.collect()] == ["S7"]
    assert served.report_of("nobody").collect() == []


def test_one_file_for_each_bucket(spark, path):
    for name in serving.SERVED:
        files = [r.path for r in spark.read.format("binaryFile").load(f"{path}/{name}").select("path").collect()]
        buckets = [re.search(r"_(\d+)\.c\d+", f).group(1) for f in files]
        assert len(buckets) == len(set(buckets)) == 4


def test_a_hot_student_is_one_row_of_metadata(spark, path):
    assert serving.opened(spark, path).table("meta").filter("student_id = 'HOT'").count() == 1


def test_empty_tables_and_unfinished_folder(spark, tables, path, tmp_path):
    empty = [t.limit(0) for t in tables]
    served = serving.publish(spark, str(tmp_path / "empty"), 4, *empty)
    assert served.report_documents().collect() == [] and served.class_roster().collect() == []
    with pytest.raises(AnalysisException):
        serving.opened(spark, str(tmp_path / "absent"))
    with pytest.raises(AnalysisException):
        serving.publish(spark, path, 4, *tables)
    assert sorted(f.name for f in serving.META.fields) == sorted(serving.opened(spark, path).table("meta").columns)
    assert S.ANALYTICS.names == serving.opened(spark, path).table("analytics").columns

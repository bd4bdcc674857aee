import pytest
from pyspark.sql import functions as F

from scoreflow.operators import insights as I

COLUMNS = (
    "student_id string, grade int, subject string, average_score double, trend string, volatility_level string, "
    "mock_vs_real_gap double, performance_band string, risk_flag string, data_confidence_level string"
)
# Three rows of a published sample with their expected insights.
SAMPLE = [
    ("S001", 11, "English", 80.0, "declining", "low", 6.0, "high", "medium", "medium"),
    ("S001", 11, "Math", 41.0, "stable", "low", -3.0, "low", "medium", "medium"),
    ("S001", 11, "Science", 77.33, "stable", "low", 1.0, "medium", "low", "medium"),
]
EXPECTED = [
    ("Performance regression", "None observed", "Inconsistent preparation or focus", "medium",
     "Structured revision and consistency building", "no", "high performer with medium risk"),
    ("Low overall performance", "None observed", "Weak foundational understanding", "medium",
     "Structured revision and consistency building", "no", "low performer with medium risk"),
    ("No major academic concern", "None observed", "Healthy learning pattern", "low",
     "Maintain current learning approach", "no", "medium performer with low risk"),
]


def derive(spark, *rows):
    return I.subject_insights(spark.createDataFrame(list(rows), COLUMNS))


def test_sample(spark):
    got = derive(spark, *SAMPLE).orderBy("subject").select(
        "primary_issue", "secondary_issue", "root_cause_category", "urgency_level", "recommended_focus_area",
        "teacher_intervention_needed", "summary_signal",
    )
    assert [tuple(r) for r in got.collect()] == EXPECTED


def test_high_urgency_and_all_evidence(spark):
    r = derive(spark, ("S", 1, "Art", 55.5, "declining", "high", -6.0, "low", "high", "low")).first()
    assert (r.urgency_level, r.teacher_intervention_needed) == ("high", "yes")
    assert r.secondary_issue == "Highly inconsistent performance"
    assert r.key_evidence_points.split("\n") == [
        "- Average score is 55.5, classified as low",
        "- Score trend is 'declining', indicating learning direction over time",
        "- Scores show high volatility, suggesting inconsistency",
        "- Mock scores significantly higher than real exam scores, indicating exam pressure",
        "- Academic risk flagged as 'high' with low confidence",
    ]
    assert (r.explanation_summary, r.confidence_in_insight) == (r.primary_issue, "low")


@pytest.mark.parametrize("gap, issue", [(-5.0, "None observed"), (-5.01, "Exam pressure affecting real exam performance"), (None, "None observed")])
def test_gap_limit(spark, gap, issue):
    assert derive(spark, ("S", 1, "Art", 70.0, "stable", "low", gap, "medium", "low", "low")).first().secondary_issue == issue


def test_text_numbers_and_missing_average(spark):
    df = spark.createDataFrame(list(SAMPLE), COLUMNS)
    text = df.select([F.col(c).cast("string") for c in df.columns])
    odd = text.withColumn("average_score", F.when(F.col("subject") == "Math", "n/a").otherwise(F.col("average_score")))
    assert sorted((r.subject, r.grade) for r in I.subject_insights(odd).collect()) == [("English", 11), ("Science", 11)]
    with pytest.raises(ValueError, match="Missing required columns in analytics data.*trend"):
        I.subject_insights(df.drop("trend"))


def test_no_shuffle(spark):
    plan = derive(spark, *SAMPLE)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

"""Phase 2: explainable insights. Row-wise expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions import rules
from scoreflow.functions.numbers import as_int, as_number
from scoreflow.functions.text import bullet_lines, filled_text
from scoreflow.schemas import DEFAULTS, INSIGHT_INPUT, INSIGHTS, Thresholds


def require_columns(df: DataFrame) -> DataFrame:
    missing = sorted(set(INSIGHT_INPUT) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns in analytics data: {missing}")
    return df


def usable_analytics(df: DataFrame) -> DataFrame:
    """Numbers coerced; rows without an average dropped."""
    return df.withColumns(
        {c: as_number(df, c) for c in ("average_score", "mock_vs_real_gap")}
    ).na.drop(subset=["average_score"])


def evidence_points(t: Thresholds = DEFAULTS) -> list[Column]:
    """Evidence sentences of an analytics row in fixed order (fixed texts), null where one does not apply."""
    return [
        filled_text(
            "Average score is %s, classified as %s",
            F.col("average_score").cast("string"),
            F.col("performance_band"),
        ),
        filled_text("Score trend is '%s', indicating learning direction over time", F.col("trend")),
        F.when(
            F.col("volatility_level") == "high", "Scores show high volatility, suggesting inconsistency"
        ),
        F.when(
            rules.under_pressure(F.col("mock_vs_real_gap"), t),
            "Mock scores significantly higher than real exam scores, indicating exam pressure",
        ),
        filled_text(
            "Academic risk flagged as '%s' with %s confidence",
            F.col("risk_flag"),
            F.col("data_confidence_level"),
        ),
    ]


def subject_insights(analytics: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """One insight row per analytics row."""
    rows = usable_analytics(require_columns(analytics)).withColumn(
        "f", rules.finding(F.col("average_score"), F.col("trend"), thresholds)
    )
    urgency = F.col("f.urgency_level")
    return rows.select(
        "student_id",
        as_int(rows, "grade").alias("grade"),
        "subject",
        F.col("f.primary_issue").alias("primary_issue"),
        rules.secondary_issue(F.col("volatility_level"), F.col("mock_vs_real_gap"), thresholds).alias(
            "secondary_issue"
        ),
        F.col("f.root_cause_category").alias("root_cause_category"),
        F.col("risk_flag").alias("academic_risk_level"),
        urgency.alias("urgency_level"),
        rules.focus_area(urgency).alias("recommended_focus_area"),
        F.when(urgency == "high", "yes").otherwise("no").alias("teacher_intervention_needed"),
        F.col("f.primary_issue").alias("explanation_summary"),
        bullet_lines(*evidence_points(thresholds)).alias("key_evidence_points"),
        F.col("data_confidence_level").alias("confidence_in_insight"),
        filled_text("%s performer with %s risk", F.col("performance_band"), F.col("risk_flag")).alias(
            "summary_signal"
        ),
    ).select(INSIGHTS.names)

"""Student dashboard: indicators per student, display fields per subject row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions import rules
from scoreflow.functions.numbers import as_number, round_tenth, steady_mean
from scoreflow.functions.text import split_list, strip_bullets

NO_RISK = "—"


def worst_risk(risk: Column) -> Column:
    """Aggregate: the risk text of the highest rank, a dash where there is none."""
    text = F.when(F.trim(risk) != "", F.trim(risk))
    return F.coalesce(F.max_by(text, F.when(text.isNotNull(), F.struct(rules.risk_rank(text), text))), F.lit(NO_RISK))


def modal_trend(trend: Column) -> Column:
    """Aggregate: most frequent trend colour; ties go to green, then red."""
    colour = rules.trend_colour(trend)
    green, red, amber = (F.count_if(colour == c) for c in ("green", "red", "amber"))
    return (
        F.when((green >= red) & (green >= amber), "green").when(red >= amber, "red").otherwise("amber")
    )


def dashboard(analytics: DataFrame) -> DataFrame:
    """Indicators of each student over their subjects."""
    score = as_number(analytics, "latest_score")
    per_student = analytics.groupBy("student_id").agg(
        F.coalesce(round_tenth(steady_mean(score)), F.lit(0.0)).alias("overall_average"),
        worst_risk(F.col("risk_flag")).alias("overall_risk"),
        modal_trend(F.col("trend")).alias("trend_colour"),
        F.count(F.lit(1)).alias("subject_count"),
    )
    risk = F.lower("overall_risk")
    word = (
        F.when(F.col("trend_colour") == "green", "Improving")
        .when(F.col("trend_colour") == "red", "Declining")
        .otherwise("Stable")
    )
    return per_student.withColumns(
        {
            "average_colour": rules.score_colour(F.col("overall_average")),
            "risk_colour": F.when(risk.isin("high", "critical"), "red")
            .when(risk == "medium", "amber")
            .otherwise("green"),
            "trend_word": word,
        }
    )


def subject_cards(analytics: DataFrame) -> DataFrame:
    """Per subject row: colour, trend caption and colour, progress in percent."""
    score = as_number(analytics, "latest_score")
    return analytics.select(
        "student_id", "grade", "subject", "latest_score", "average_score",
        rules.score_colour(score).alias("score_colour"),
        rules.trend_colour(F.col("trend")).alias("trend_colour"),
        rules.trend_caption(F.col("trend")).alias("trend_label"),
        rules.progress_percent(score).alias("progress"),
    )


def evidence_cards(insights: DataFrame) -> DataFrame:
    """Per insight row: evidence lines, confidence display and focus areas."""
    label = rules.confidence_label(F.col("confidence_in_insight"))
    return insights.select(
        "student_id", "grade", "subject",
        strip_bullets(F.coalesce("key_evidence_points", F.lit(""))).alias("evidence"),
        label.alias("confidence_label"),
        rules.confidence_percent(label).alias("confidence_percent"),
        split_list(F.coalesce("recommended_focus_area", F.lit(""))).alias("focus_areas"),
    )


def chart_series(analytics: DataFrame) -> DataFrame:
    """Chart points per student in subject order; the radar ring repeats its first point.

    The radar series is null for a student with fewer than two subjects.
    """
    zero = F.lit(0.0)
    point = F.struct(
        "subject",
        F.col("grade").alias("grade"),
        F.coalesce(as_number(analytics, "latest_score"), zero).alias("latest"),
        F.coalesce(as_number(analytics, "average_score"), zero).alias("average"),
    )
    points = analytics.groupBy("student_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    closed = F.concat("points", F.slice("points", 1, 1))
    return points.withColumn("radar", F.when(F.size("points") >= 2, closed))

"""Class roster: one row per student, class indicators, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions import rules
from scoreflow.functions.numbers import as_number, round_tenth, steady_mean
from scoreflow.functions.text import clean_id, strip
from scoreflow.operators.consolidation import first_names, processed_flags
from scoreflow.operators.dashboard import NO_RISK, worst_risk

TOP = 100


def roster_trend() -> Column:
    """Aggregate: any declining subject, else any improving one, else the first trend."""
    text = strip(F.col("trend"))
    first = F.min_by(F.when(text != "", text), F.when(text != "", F.struct("grade", "subject")))
    return (
        F.when(F.bool_or(rules.is_falling(text)), "Declining")
        .when(F.bool_or(rules.is_rising(text)), "Improving")
        .otherwise(F.coalesce(first, F.lit("Stable")))
    )


def class_roster(analytics: DataFrame, validated: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Name, first grade, average, worst risk, trend, subjects and processed flag per student."""
    rows = per_student(analytics.withColumn("student_id", clean_id(F.col("student_id"))))
    return listed(processed_flags(rows.join(first_names(validated), "student_id", "left"), consolidated))


def per_student(rows: DataFrame) -> DataFrame:
    """What the roster takes from analytics, ids trimmed."""
    return rows.groupBy("student_id").agg(
        F.coalesce(F.min("grade").cast("string"), F.lit(NO_RISK)).alias("grade"),
        F.coalesce(round_tenth(steady_mean(as_number(rows, "average_score"))), F.lit(0.0)).alias("overall_avg"),
        worst_risk(F.col("risk_flag")).alias("risk_level"),
        roster_trend().alias("trend"),
        F.array_sort(F.collect_set(strip(F.col("subject")))).alias("subjects"),
    )


def listed(rows: DataFrame) -> DataFrame:
    """The columns of the roster."""
    return rows.withColumn("name", F.coalesce("name", F.lit(NO_RISK))).select(
        "student_id", "name", "grade", "overall_avg", "risk_level", "trend", "subjects", "processed"
    )


def class_subjects(analytics: DataFrame) -> DataFrame:
    """Distinct subjects of the class, one per row."""
    return analytics.select(strip(F.col("subject")).alias("subject")).distinct()


def class_indicators(roster: DataFrame, analytics: DataFrame, list_subjects: bool = True) -> DataFrame:
    """One row: size, mean of positive averages, at-risk and processed counts, number of subjects.

    ``list_subjects`` adds all of them in one cell; :func:`class_subjects` has them as rows.

    Both parts are one-row aggregates; they are stacked and merged, not joined.
    """
    average = steady_mean(F.when(F.col("overall_avg") > 0, F.col("overall_avg")))
    counts = roster.agg(
        F.count(F.lit(1)).alias("total_students"),
        F.coalesce(round_tenth(average), F.lit(0.0)).alias("class_average"),
        F.count_if(F.lower("risk_level").isin("high", "critical")).alias("at_risk"),
        F.count_if("processed").alias("processed"),
    )
    listed = [F.array_sort(F.collect_list("subject")).alias("subjects")] if list_subjects else []
    subjects = class_subjects(analytics).agg(F.count(F.lit(1)).alias("subject_count"), *listed)
    stacked = counts.unionByName(subjects, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def search(roster: DataFrame, text: str) -> DataFrame:
    """Students whose id or name contains the text, letter case ignored; blank matches all."""
    wanted = text.strip().lower()
    if not wanted:
        return roster
    return roster.filter(F.lower("student_id").contains(wanted) | F.lower("name").contains(wanted))


def top_rows(roster: DataFrame, limit: int = TOP) -> DataFrame:
    """First rows by student id: a bounded top-k per task, then one merge."""
    return roster.orderBy("student_id").limit(limit)


def search_counts(roster: DataFrame, text: str) -> DataFrame:
    """Matching students out of all, in one pass."""
    wanted = F.lit(text.strip().lower())
    hit = F.lower("student_id").contains(wanted) | F.lower("name").contains(wanted)
    return roster.agg(F.count_if(hit).alias("visible"), F.count(F.lit(1)).alias("total"))

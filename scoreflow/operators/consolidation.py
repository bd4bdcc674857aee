"""Phase 4: per-student gathering, history and latest tables, lookups by subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import grows, own_shuffle
from scoreflow.functions.text import clean_id
from scoreflow.operators.metrics import attempt_order
from scoreflow.schemas import ANALYTICS, CONSOLIDATED, SUBJECT_KEY, SUMMARIES

EXPLANATION = [
    "explanation_summary", "key_evidence_points", "confidence_in_insight", "recommended_focus_area",
]
ANALYTICS_FIELDS = ANALYTICS.names
SUMMARY_COLUMNS = SUMMARIES.names


def ids_of(df: DataFrame) -> DataFrame:
    return df.select(clean_id(F.col("student_id")).alias("student_id")).filter("student_id is not null").distinct()


def ready_students(analytics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Students that have both analytics and summaries."""
    return ids_of(analytics).intersect(ids_of(summaries))


def record_list(names: list[str], order: list[str]) -> Column:
    """Records of a group as an array in table order.

    For per-subject tables only: a student has one row per grade and subject there.
    Attempts are never collected.
    """
    rest = [n for n in names if n not in order]
    return F.array_sort(F.collect_list(F.struct(*order, *rest)))


def gather_students(analytics: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per student with rows in both tables: first grade and the records of each table."""
    a = analytics.groupBy("student_id").agg(
        F.min("grade").alias("grade"),
        record_list(ANALYTICS_FIELDS, ["grade", "subject"]).alias("analytics"),
    )
    s = summaries.groupBy("student_id").agg(
        record_list(SUMMARY_COLUMNS, ["grade", "subject"]).alias("summaries")
    )
    return a.join(grows(s), "student_id")


def latest_from_history(history: DataFrame) -> DataFrame:
    """Most recent consolidated row of each student."""
    names = CONSOLIDATED.names
    rest = [n for n in names if n != "student_id"]
    latest = F.max_by(F.struct(*rest), F.struct("run_ts", "overall_summary")).alias("r")
    return history.groupBy("student_id").agg(latest).select("student_id", "r.*").select(names)


def explanations(insights: DataFrame) -> DataFrame:
    """One explanation per student and subject; of several grades the last wins."""
    fields = F.struct(*EXPLANATION)
    picked = insights.groupBy(*SUBJECT_KEY).agg(F.max_by(fields, F.struct("grade", fields)).alias("e"))
    return picked.select(*SUBJECT_KEY, "e.*")


def explained_summaries(summaries: DataFrame, insights: DataFrame) -> DataFrame:
    """Summaries with the explanation of their subject, null where there is none."""
    found = explanations(insights).withColumn("subject", own_shuffle(F.col("subject")))
    return summaries.join(found, SUBJECT_KEY, "left")


def processed_flags(students: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Rows of ``students`` with ``processed``: the id occurs in the consolidated table."""
    done = ids_of(consolidated).select(own_shuffle(F.col("student_id")).alias("student_id"), F.lit(True).alias("_done"))
    return students.join(done, "student_id", "left").withColumn(
        "processed", F.coalesce(F.col("_done"), F.lit(False))
    ).drop("_done")


def first_names(validated: DataFrame) -> DataFrame:
    """Name of the first attempt of each student."""
    named = validated.filter(F.col("Name").isNotNull())
    return named.groupBy(clean_id(F.col("student_id")).alias("student_id")).agg(
        F.min_by("Name", attempt_order()).alias("name")
    )

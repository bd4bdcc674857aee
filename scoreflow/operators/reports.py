"""Student reports: lookups, metadata, status, report documents for all students at once.

A single report is a filter on these frames; Spark pushes it down to the table scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import grows, own_shuffle
from scoreflow.functions.text import (
    clean_id, is_blank, match_id, normalize_cell, only_field, with_cell_json, with_json_strings,
)
from scoreflow.operators.consolidation import EXPLANATION, explained_summaries, ids_of
from scoreflow.operators.metrics import attempt_order
from scoreflow.schemas import CONSOLIDATED_FIELDS, GROUP_KEY, SUMMARIES

PERFORMANCE = ["subject", "average_score", "latest_score", "trend", "risk_flag"]


def load_tables(
    validated: DataFrame, analytics: DataFrame, insights: DataFrame, summaries: DataFrame, consolidated: DataFrame
) -> dict[str, DataFrame]:
    """The five tables the read side works on, ids trimmed. Nothing is read until used."""
    tables = {
        "validated_results": validated,
        "subject_analytics": analytics,
        "subject_insights": insights,
        "subject_summaries": summaries,
        "student_consolidated_latest": consolidated,
    }
    return {n: df.withColumn("student_id", clean_id(F.col("student_id"))) for n, df in tables.items()}


# --- lookups ------------------------------------------------------------------------


def rows_of_student(df: DataFrame, student_id: str, match: str = "trim") -> DataFrame:
    """Rows of one student; ``match`` is exact, trim or ci."""
    wanted = match_id(F.lit(student_id), match)
    return df.filter(match_id(F.col("student_id"), match) == wanted)


def rows_of_requests(df: DataFrame, requests: DataFrame, match: str = "trim") -> DataFrame:
    """Rows of every requested id (column ``requested``), for many lookups at once."""
    keyed = requests.select("requested", match_id(F.col("requested"), match).alias("_id")).distinct()
    keyed = keyed.withColumn("_id", own_shuffle(F.col("_id")))
    return keyed.join(df.withColumn("_id", match_id(F.col("student_id"), match)), "_id").drop("_id")


def first_consolidated(consolidated: DataFrame) -> DataFrame:
    """First consolidated row per student (the table may hold several)."""
    rest = [c for c in consolidated.columns if c != "student_id"]
    return (
        consolidated.groupBy(clean_id(F.col("student_id")).alias("student_id"))
        .agg(F.min(F.struct(*rest)).alias("r"))
        .select("student_id", "r.*")
    )


def student_metadata(validated: DataFrame) -> DataFrame:
    """Name and grade of the first attempt of each student."""
    first = F.min_by(F.struct("Name", "grade"), attempt_order()).alias("m")
    return (
        validated.groupBy(clean_id(F.col("student_id")).alias("student_id"))
        .agg(first)
        .select(
            "student_id",
            F.coalesce(F.col("m.Name"), F.lit("")).alias("student_name"),
            F.col("m.grade").alias("grade"),
        )
    )


def named_metadata(validated: DataFrame) -> DataFrame:
    """:func:`student_metadata` with ``name`` of :func:`consolidation.first_names`, null for a null id: one pass for both."""
    name = F.min_by("Name", F.when(F.col("Name").isNotNull(), attempt_order())).alias("name")
    first = F.min_by(F.struct("Name", "grade"), attempt_order()).alias("m")
    return (
        validated.groupBy(clean_id(F.col("student_id")).alias("student_id"))
        .agg(first, name)
        .select(
            "student_id",
            F.coalesce(F.col("m.Name"), F.lit("")).alias("student_name"),
            F.col("m.grade").alias("grade"),
            F.when(F.col("student_id").isNotNull(), F.col("name")).alias("name"),
        )
    )


def existence_flags(ids: DataFrame, validated: DataFrame, analytics: DataFrame) -> DataFrame:
    """Requested ids with: known from validated rows, known from analytics."""
    known = ids_of(validated).withColumn("_v", F.lit(True))
    analysed = ids_of(analytics).withColumn("_a", F.lit(True))
    return (
        ids_of(ids)
        .join(known, "student_id", "left")
        .join(analysed, "student_id", "left")
        .select(
            "student_id",
            F.coalesce("_v", F.lit(False)).alias("in_validated_results"),
            F.coalesce("_a", F.lit(False)).alias("in_subject_analytics"),
        )
    )


def report_status(
    ids: DataFrame, validated: DataFrame, analytics: DataFrame, summaries: DataFrame, consolidated: DataFrame
) -> DataFrame:
    """Status (fixed words) per requested id.

    ``NO_DATA`` for all while there are no validated rows, analytics or summaries; else ``ok``,
    ``NOT_FOUND:True`` (known, not processed) or ``NOT_FOUND:False``. Ids are matched without regard to
    letter case. All tables are stacked with a flag each and reduced by id in one exchange.
    """
    flags = {"_r": ids, "_v": validated, "_a": analytics, "_s": summaries, "_c": consolidated}
    stacked = None
    for flag, df in flags.items():
        marks = [F.lit(f == flag).alias(f) for f in flags]
        part = df.select(match_id(F.col("student_id"), "ci").alias("student_id"), *marks)
        stacked = part if stacked is None else stacked.unionByName(part)
    known = stacked.groupBy("student_id").agg(*[F.bool_or(f).alias(f) for f in flags]).filter("_r")
    complete = F.col("_a") & F.col("_s") & F.col("_c")
    return known.select(
        "student_id",
        F.when(_no_data(validated, analytics, summaries), "NO_DATA")
        .when(complete, "ok")
        .when(F.col("_v"), "NOT_FOUND:True")
        .otherwise("NOT_FOUND:False")
        .alias("status"),
    )


def _no_data(*tables: DataFrame) -> Column:
    """Whether one of the tables has no row: each is asked for one row by a scalar subquery."""
    empty = F.lit(False)
    for df in tables:
        empty = empty | (df.select(F.lit(1).alias("one")).limit(1).agg(F.count("one")).scalar() == 0)
    return empty


def base_status(analytics: DataFrame, summaries: DataFrame) -> str:
    """``NO_DATA`` while the pipeline has produced nothing, else ``ok``."""
    return "NO_DATA" if analytics.isEmpty() or summaries.isEmpty() else "ok"


# --- reports ------------------------------------------------------------------------


def numerical_performance(analytics: DataFrame) -> DataFrame:
    """Per student the five performance fields of each subject, sorted by subject."""
    return _performance(analytics.withColumn("student_id", clean_id(F.col("student_id"))))


def _performance(analytics: DataFrame) -> DataFrame:
    """The same for rows whose ids are trimmed."""
    rest = [c for c in PERFORMANCE if c != "subject"]
    rows = F.array_sort(F.collect_list(F.struct("subject", "grade", *rest)))
    trimmed = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in PERFORMANCE]))
    return analytics.groupBy("student_id").agg(trimmed.alias("numerical_performance"))


def report_rows(
    validated: DataFrame, analytics: DataFrame, insights: DataFrame, summaries: DataFrame, consolidated: DataFrame
) -> DataFrame:
    """Reports as flat rows, one per student and summarized subject.

    Holds any number of subjects per student; the document form is built per student.
    """
    meta = student_metadata(validated)
    overall = first_consolidated(consolidated).select(
        "student_id", "overall_summary", "recommended_next_steps", F.col("llm_provider").alias("llm_provider_used")
    )
    analysed = ids_of(analytics)
    return (
        trimmed_explained(summaries.drop("grade", "llm_provider"), insights)
        .join(overall, "student_id")
        .join(analysed, "student_id", "left_semi")
        .join(meta, "student_id", "left")
        .withColumn("mode", F.lit("cached"))
    )


def trimmed_explained(summaries: DataFrame, insights: DataFrame) -> DataFrame:
    """Summaries with explanations, ids of both sides trimmed."""
    trimmed = (df.withColumn("student_id", clean_id(F.col("student_id"))) for df in (summaries, insights))
    return explained_summaries(*trimmed)


def _object(fields: dict[str, Column]) -> Column:
    """JSON object text of fields given as JSON text; null ones are left out."""
    named = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *named), F.lit("}"))


def _explanation() -> Column:
    """Explanation of a row as JSON text, from its cells as JSON texts: ``{}`` where it has none."""
    cells = {c: F.col(c) for c in sorted(EXPLANATION)}
    cells["key_evidence_points"] = F.when(F.col("_no_points"), F.lit("[]")).otherwise(cells["key_evidence_points"])
    return F.when(F.col("_explained"), _object(cells)).otherwise(F.lit("{}"))


def report_documents(
    validated: DataFrame, analytics: DataFrame, insights: DataFrame, summaries: DataFrame, consolidated: DataFrame
) -> DataFrame:
    """One JSON report per student with analytics, summaries and a consolidated row.

    Every input is reduced per student on its own, so the joins of the reduced frames
    reuse the partitioning by student.
    """
    rows = analytics.withColumn("student_id", clean_id(F.col("student_id")))
    told = trimmed_explained(summaries, insights)
    return documents(student_metadata(validated), rows, told, first_consolidated(consolidated))


def documents(meta: DataFrame, analytics: DataFrame, told: DataFrame, overall: DataFrame) -> DataFrame:
    """Reports from frames with trimmed ids: metadata and consolidated row (one for each student), analytics,
    summaries with explanations. Inputs partitioned by student alone are not shuffled.
    """
    # Records are JSON texts that are put together, never parsed again.
    ids = {"_id": "student_id", "_subject": "subject"}
    texts = [c for c in SUMMARIES.names if c not in GROUP_KEY]
    rows = told.select(
        *GROUP_KEY, *[F.col(c).alias(n) for n, c in ids.items()], *texts, *EXPLANATION,
        F.col("explanation_summary").isNotNull().alias("_explained"), is_blank(F.col("key_evidence_points")).alias("_no_points"),
    )
    rows = with_json_strings(with_cell_json(rows, [*texts, *EXPLANATION]), list(ids))
    cells = {c: F.col(c) for c in texts} | {c: F.col(n) for n, c in ids.items()}
    cells |= {"grade": F.col("grade").cast("string"), "explainability": _explanation()}
    per_subject = rows.select(*GROUP_KEY, _object({c: cells[c] for c in sorted(cells)}).alias("json"))
    listed = per_subject.groupBy("student_id").agg(
        F.array_sort(F.collect_list(F.struct("grade", "subject", "json"))).alias("l")
    )
    summaries_json = listed.select(
        "student_id",
        F.concat(F.lit("["), F.array_join(F.transform("l", lambda r: r["json"]), ","), F.lit("]")).alias(
            "subject_summaries"
        ),
    )
    joined = (
        overall.withColumnRenamed("grade", "_grade")
        .join(grows(_performance(analytics)), "student_id")
        .join(grows(summaries_json), "student_id")
        .join(grows(meta), "student_id", "left")
    )
    rows = joined.select(
        "student_id", "grade", "overall_summary", "recommended_next_steps", "subject_summaries",
        F.col("student_id").alias("_id"),
        F.coalesce("student_name", F.lit("")).alias("_name"),
        F.coalesce("llm_provider", F.lit("ollama")).alias("_provider"),
        F.to_json(F.struct("numerical_performance")).alias("_figures"),
    )
    rows = with_json_strings(with_cell_json(rows, ["overall_summary", "recommended_next_steps"]), ["_id", "_name", "_provider"])
    document = {
        "student_id": F.col("_id"),
        "student_name": F.col("_name"),
        "grade": F.col("grade").cast("string"),
        "overall_summary": F.col("overall_summary"),
        "recommended_next_steps": F.col("recommended_next_steps"),
        "numerical_performance": only_field("_figures", "numerical_performance"),
        "subject_summaries": F.col("subject_summaries"),
        "mode": F.lit('"cached"'),
        "llm_provider_used": F.col("_provider"),
    }
    return rows.select("student_id", _object(document).alias("report"))


def live_reports(consolidated: DataFrame, validated: DataFrame) -> DataFrame:
    """Freshly consolidated rows in the report shape, marked ``live``."""
    return (
        consolidated.drop("grade")
        .join(student_metadata(validated), "student_id", "left")
        .select(
            *CONSOLIDATED_FIELDS,
            "student_id",
            F.coalesce("student_name", F.lit("")).alias("student_name"),
            "grade",
            F.lit("live").alias("mode"),
            F.col("llm_provider").alias("llm_provider_used"),
        )
    )


def record_export(df: DataFrame, free_text: list[str]) -> DataFrame:
    """Each row as one JSON object; cells of ``free_text`` are parsed where they hold JSON."""
    cells = [normalize_cell(F.col(c)).alias(c) if c in free_text else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*cells)).alias("record"))

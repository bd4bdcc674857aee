"""Phase 0: schema contract, coercion, ordered row rules, uniqueness, gate.

Row rules are one column expression, so the phase needs no shuffle; only the
uniqueness check exchanges keys, after counting them inside each task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scoreflow.functions.numbers import as_int, as_number, to_moment
from scoreflow.functions.rows import grows, own_shuffle, with_values
from scoreflow.functions.text import clean_id, is_blank
from scoreflow.schemas import ATTEMPT_COLUMNS, ATTEMPT_KEY, EXAM_TYPES, GROUP_KEY, VALIDATED
from scoreflow.sources.tables import conform

DUPLICATE = "Duplicate exam attempts detected"
INT_LIMIT = float(2**31)
# Messages of the row rules, in their order (fixed texts).
MESSAGES = [
    "student_id missing", "grade out of range", "invalid subject", "invalid exam_type", "invalid attempt_number",
    "invalid max_score", "score out of range", "invalid exam_date", "exam_date in future",
]


def check_columns(df: DataFrame, ignore: tuple[str, ...] = ("row_index",)) -> DataFrame:
    """The frame itself; raises on missing columns, then on unexpected ones."""
    found = set(df.columns) - set(ignore)
    missing = sorted(set(ATTEMPT_COLUMNS) - found)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    extra = sorted(found - set(ATTEMPT_COLUMNS))
    if extra:
        raise ValueError(f"Unexpected columns found (schema drift): {extra}")
    return df


def coerce_types(df: DataFrame) -> DataFrame:
    """Numbers to double and dates to timestamp; what cannot be read becomes null."""
    values = {c: as_number(df, c) for c in ("grade", "attempt_number", "score", "max_score")}
    is_text = df.schema["exam_date"].dataType.typeName() == "string"
    values["exam_date"] = to_moment(F.col("exam_date")) if is_text else F.col("exam_date").cast("timestamp")
    for name in ("student_id", "Name", "subject", "exam_id", "exam_type"):
        if df.schema[name].dataType.typeName() != "string":
            values[name] = F.col(name).cast("string")
    return with_values(df, values)


def row_error(as_of: Column) -> Column:
    """Message (fixed texts) of the first broken rule of a coerced row, null for a valid row."""
    grade, attempt = F.col("grade"), F.col("attempt_number")
    score, top, date = F.col("score"), F.col("max_score"), F.col("exam_date")

    def broken(test: Column, message: str) -> Column:
        return F.when(F.coalesce(test, F.lit(True)), F.lit(message))

    return F.coalesce(
        broken(is_blank(F.col("student_id")), "student_id missing"),
        broken((grade < 1) | (grade >= 13), "grade out of range"),
        broken(is_blank(F.col("subject")), "invalid subject"),
        broken(~F.col("exam_type").isin(EXAM_TYPES), "invalid exam_type"),
        broken((attempt < 1) | (attempt >= INT_LIMIT), "invalid attempt_number"),
        broken(top <= 0, "invalid max_score"),
        broken((score < 0) | (score > top), "score out of range"),
        F.when(date.isNull(), "invalid exam_date"),
        broken(date > as_of, "exam_date in future"),
    )


def moment(as_of: dt.datetime | dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def classify(raw: DataFrame, as_of) -> DataFrame:
    """Coerced rows with an ``error`` column; ``as_of`` stands for the time of the run."""
    return coerce_types(check_columns(raw)).withColumn("error", row_error(moment(as_of)))


def watched(classified: DataFrame) -> tuple[DataFrame, Observation]:
    """Classified rows and an observation that the next write of them fills: rows, rejects by kind, students.

    The numbers come with the write, so they cost no job of their own. ``students`` is a sketch (about 2 % off).
    """
    seen = Observation()
    error = F.col("error")
    kinds = [F.count_if(error == message).alias(message) for message in MESSAGES]
    total = [F.count(F.lit(1)).alias("rows"), F.count(error).alias("rejected")]
    students = F.approx_count_distinct("student_id", 0.02).alias("students")
    return classified.observe(seen, *total, *kinds, students), seen


def accepted(classified: DataFrame) -> DataFrame:
    """Valid rows in table types, the date without its time."""
    good = classified.filter(F.col("error").isNull())
    return conform(
        good.select(
            "student_id", "Name",
            F.col("grade").cast("int").alias("grade"),
            "subject", "exam_id", "exam_type",
            F.col("attempt_number").cast("int").alias("attempt_number"),
            "score", "max_score",
            F.to_date("exam_date").alias("exam_date"),
        ),
        VALIDATED,
    )


def error_report(classified: DataFrame) -> DataFrame:
    """Rejected rows: row_index (where the input has one), student_id, error."""
    index = ["row_index"] if "row_index" in classified.columns else []
    return classified.filter(F.col("error").isNotNull()).select(*index, "student_id", "error")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Attempt keys that occur more than once, with their row count."""
    counts = df.groupBy(*ATTEMPT_KEY).agg(F.count(F.lit(1)).alias("copies"))
    return counts.filter("copies > 1")


def split_rows(raw: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Quarantine mode: (valid rows with unique keys, report of all others)."""
    return split_classified(classify(raw, as_of))


def split_classified(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of classified rows; store them first, since both results read them."""
    good = accepted(classified)
    doubled = duplicate_keys(good).select(ATTEMPT_KEY).withColumn("exam_id", own_shuffle(F.col("exam_id")))
    same = [F.col(f"g.{k}").eqNullSafe(F.col(f"d.{k}")) for k in ATTEMPT_KEY]
    condition = same[0] & same[1] & same[2]
    unique = good.alias("g").join(grows(doubled.alias("d")), condition, "left_anti")
    repeated = classified.filter(F.col("error").isNull()).withColumn(
        "attempt_number", F.col("attempt_number").cast("int")
    )
    repeated = (
        repeated.alias("g").join(grows(doubled.alias("d")), condition, "left_semi").withColumn("error", F.lit(DUPLICATE))
    )
    return unique, error_report(classified).unionByName(error_report(repeated))


def gate(raw: DataFrame, as_of) -> DataFrame:
    """One row: rows, rejected rows, repeated keys and whether the batch may pass."""
    classified = classify(raw, as_of)
    zero = F.lit(0).cast("bigint")
    rows = classified.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("error").isNotNull()).alias("rejected_rows"),
        zero.alias("repeated_keys"),
    )
    repeats = duplicate_keys(accepted(classified)).agg(
        zero.alias("total_rows"), zero.alias("rejected_rows"), F.count(F.lit(1)).alias("repeated_keys")
    )
    names = ["total_rows", "rejected_rows", "repeated_keys"]
    ok = (F.col("total_rows") > 0) & (F.col("rejected_rows") == 0) & (F.col("repeated_keys") == 0)
    return rows.unionByName(repeats).agg(*[F.sum(c).alias(c) for c in names]).withColumn("passed", ok)


def first_errors(report: DataFrame, limit: int = 5) -> list[dict]:
    """A sample of the report; the report itself is a table of any size."""
    order = [c for c in ("row_index", "student_id", "error") if c in report.columns]
    return [r.asDict() for r in report.orderBy(*order).limit(limit).collect()]


def raise_rejected(report: DataFrame, where: str = "", sample: int = 5) -> None:
    """Total, the place of the full report and a few rows of it."""
    place = f", all in {where}" if where else ""
    raise ValueError(f"Row validation failed: {report.count()} rows{place}; first {first_errors(report, sample)}")


def raise_if_repeated(validated: DataFrame, sample: int = 5) -> None:
    repeated = duplicate_keys(validated)
    some = [r.asDict() for r in repeated.limit(sample).collect()]
    if some:
        raise ValueError(f"{DUPLICATE}: {repeated.count()} keys; first {some}")


def validate(raw: DataFrame, as_of) -> DataFrame:
    """Strict mode: the validated rows, or an error for the whole batch."""
    if raw.isEmpty():
        raise RuntimeError("raw_student_scores is empty")
    classified = classify(raw, as_of)
    report = error_report(classified)
    if not report.isEmpty():
        raise_rejected(report)
    rows = accepted(classified)
    raise_if_repeated(rows)
    return rows


def canonical_order(df: DataFrame) -> DataFrame:
    """Full sort by the attempt key, for exports of rows whose keys are unique."""
    return df.orderBy(*ATTEMPT_KEY)


def of_students(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the students in ``ids``; ids are compared trimmed and stored trimmed."""
    wanted = ids.select(clean_id(F.col("student_id")).alias("student_id"))
    trimmed = df.withColumn("student_id", clean_id(F.col("student_id")))
    return trimmed.join(grows(wanted), "student_id", "left_semi").select(df.columns)


def usable_attempts(df: DataFrame) -> DataFrame:
    """Date and score coerced again; rows without id, subject, grade, score or date dropped."""
    kind = df.schema["exam_date"].dataType.typeName()
    date = F.to_date(to_moment(F.col("exam_date"))) if kind == "string" else F.to_date("exam_date")
    typed = df.withColumns(
        {
            "exam_date": F.col("exam_date") if kind == "date" else date,
            "score": as_number(df, "score"),
            "grade": as_int(df, "grade"),
            "attempt_number": as_int(df, "attempt_number"),
        }
    )
    # Separate conditions reach the scan as pushed filters.
    for column in (*GROUP_KEY, "score", "exam_date"):
        typed = typed.filter(F.col(column).isNotNull())
    return typed

"""Exam data derived row by row from the driver's tables. No grouping, no windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.schemas import ATTEMPT_COLUMNS, VALIDATED
from scoreflow.sources.tables import conform

AS_OF = "2030-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def student(number: Column) -> Column:
    return F.concat(F.lit("S"), number.cast("string"))


def school_mail(number: Column) -> Column:
    return F.concat(F.lit("c"), number.cast("string"), F.lit("@school.test"))


def _attempts_of_orders(spark: SparkSession, sf_dir: str, student_id: Column, grades: int, score: Column) -> DataFrame:
    customer, order = F.col("o_custkey"), F.col("o_orderkey")
    pending = F.when(F.col("o_orderstatus") == "P", " P.").otherwise("")
    return conform(
        table(spark, sf_dir, "orders").select(
            student_id.alias("student_id"),
            F.concat(F.lit("Student "), customer.cast("string"), pending).alias("Name"),
            (1 + customer % grades).alias("grade"),
            F.col("o_orderpriority").alias("subject"),
            order.cast("string").alias("exam_id"),
            F.when(F.col("o_orderstatus") == "F", "real").otherwise("mock").alias("exam_type"),
            (1 + order % 4).alias("attempt_number"),
            score.alias("score"),
            F.lit(100.0).alias("max_score"),
            F.to_date("o_orderdate").alias("exam_date"),
        ),
        VALIDATED,
    )


def attempts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is an exam attempt of its customer in the subject of its priority."""
    score = F.floor(F.col("o_totalprice") / 5000).cast("double")
    return _attempts_of_orders(spark, sf_dir, student(F.col("o_custkey")), 12, score)


def decimal_attempts_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts with two-decimal scores; customers share 25 students, so groups are large."""
    shared = F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string"))
    return _attempts_of_orders(spark, sf_dir, shared, 5, F.rint(F.col("o_totalprice") / 50) / 100)


def attempts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is an attempt of its user in the subject of its type; many attempts per group."""
    user, event = F.col("user_id"), F.col("event_id")
    return conform(
        table(spark, sf_dir, "events").select(
            student(user).alias("student_id"),
            F.concat(F.lit("User "), user.cast("string")).alias("Name"),
            (1 + user % 12).alias("grade"),
            F.col("event_type").alias("subject"),
            event.cast("string").alias("exam_id"),
            F.when(event % 2 == 0, "mock").otherwise("real").alias("exam_type"),
            (1 + event % 5).alias("attempt_number"),
            F.least(F.floor("value"), F.lit(100)).cast("double").alias("score"),
            F.lit(100.0).alias("max_score"),
            F.to_date("ts").alias("exam_date"),
        ),
        VALIDATED,
    )


def _spoil(value: Column, every: int, faults: dict[int, str]) -> Column:
    rest = F.col("event_id") % every
    for at, text in reversed(faults.items()):
        value = F.when(rest == at, F.lit(text)).otherwise(value)
    return value


# Planned faults: column -> (divisor of the event id, {remainder: text}).
FAULTS = {
    "student_id": (41, {0: "", 1: "  "}),
    "grade": (29, {1: "0", 2: "13", 3: "abc", 4: "12.9"}),
    "subject": (37, {5: " "}),
    "exam_type": (31, {6: "quiz", 7: "MOCK"}),
    "attempt_number": (23, {8: "0", 9: ""}),
    "max_score": (59, {10: "0", 11: "1,000"}),
    "score": (19, {11: "150", 12: "-1", 13: "1.5d"}),
    "exam_date": (47, {14: "2024-02-30", 15: "2024-02", 16: "2999-01-01"}),
}


def dirty_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text attempts with planned faults; ``row_index`` is the event id."""
    user, event = F.col("user_id"), F.col("event_id")
    clean = {
        "student_id": student(user),
        "Name": F.concat(F.lit("User "), user.cast("string")),
        "grade": (1 + user % 12).cast("string"),
        "subject": F.col("event_type"),
        # Events of one user, type and day share an exam, so some keys repeat.
        "exam_id": F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyyMMdd")),
        "exam_type": F.when(event % 2 == 0, "mock").otherwise("real"),
        "attempt_number": (1 + event % 5).cast("string"),
        "score": F.least(F.floor("value"), F.lit(100)).cast("string"),
        "max_score": F.lit("100"),
        "exam_date": F.date_format("ts", "yyyy-MM-dd"),
    }
    cells = {c: _spoil(v, *FAULTS[c]) if c in FAULTS else v for c, v in clean.items()}
    return table(spark, sf_dir, "events").select(
        event.alias("row_index"), *[cells[c].alias(c) for c in ATTEMPT_COLUMNS]
    )


def users_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with e-mails in mixed case and spacing; some without a linked id."""
    key = F.col("c_custkey")
    mail = school_mail(key)
    written = F.when(key % 3 == 0, F.upper(mail)).when(key % 3 == 1, F.concat(F.lit("  "), mail)).otherwise(mail)
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("full_name"),
        written.alias("email"),
        F.lit("").alias("password_hash"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Teacher").otherwise("Student").alias("role"),
        F.when(F.col("c_acctbal") < 3000, "").otherwise(student(key)).alias("student_id"),
        F.lit("2024-01-01").alias("created_at"),
        F.lit("").alias("last_login"),
        F.lit("true").alias("is_active"),
    )


def link_updates_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of linked ids, several per account in the order of ``seq``; some are blank."""
    order = F.col("o_orderkey")
    linked = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit(" N"), order.cast("string"), F.lit(" ")))
    return table(spark, sf_dir, "orders").select(
        F.upper(school_mail(F.col("o_custkey"))).alias("email"), linked.alias("student_id"), order.alias("seq")
    )


def registrations_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups with repeated e-mails, in the order of ``seq``."""
    key = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("Student "), key.cast("string")).alias("full_name"),
        F.concat(F.upper(school_mail(key)), F.lit(" ")).alias("email"),
        F.lit("Student").alias("role"),
        F.col("o_orderkey").alias("seq"),
    )


def forms_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake forms with text fields, two subjects each, some with faults."""
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    score = F.floor(F.col("o_totalprice") / 5000).cast("string")
    other = F.floor(F.col("o_totalprice") / 7000).cast("string")
    scores = (
        F.when(order % 11 == 3, F.concat(score, F.lit(", abc")))
        .when(order % 11 == 4, F.lit(" , "))
        .otherwise(F.concat(score, F.lit(", "), other, F.lit(",, "), score, F.lit(".5")))
    )
    grade = F.when(order % 13 == 5, "14").when(order % 13 == 6, "ten").otherwise((1 + key % 12).cast("string"))
    subjects = F.array(
        F.struct(
            F.col("o_orderpriority").alias("name"), scores.alias("scores_text"), F.lit(100.0).alias("max_score")
        ),
        F.struct(
            F.when(order % 17 == 7, " ").otherwise(" Ma th ").alias("name"),
            other.alias("scores_text"),
            F.lit(100.0).alias("max_score"),
        ),
    )
    return table(spark, sf_dir, "orders").select(
        F.when(order % 19 == 8, " ").otherwise(F.concat(F.lit(" "), student(key))).alias("student_id"),
        F.when(order % 23 == 9, "").otherwise(F.concat(F.lit("Student "), key.cast("string"))).alias("name"),
        grade.alias("grade"),
        F.when(order % 29 == 10, F.slice(subjects, 1, 0)).otherwise(subjects).alias("subjects"),
        order.alias("form_id"),
    )


def _subject_tries() -> Column:
    """Three scripted tries for a subject prompt, not all of them usable."""
    told = F.format_string(
        '{"performance_summary": "%s in grade %s", "improvement_plan": "Plan for %s", '
        '"motivation_note": "Keep going", "confidence_note": "medium"}',
        F.col("subject"), F.col("grade").cast("string"), F.col("student_id"),
    )
    short = F.format_string('{"performance_summary": "Short note on %s"}', F.col("subject"))
    first = (
        F.when(F.col("grade") % 3 == 0, "No report today.")
        .when(F.col("grade") % 3 == 1, "{}")
        .otherwise(F.concat(F.lit("Here it is: "), told, F.lit(" Done.")))
    )
    second = F.when(F.col("grade") % 4 == 0, "still nothing").when(F.col("grade") % 4 == 1, short).otherwise(told)
    third = F.when(F.col("grade") % 12 == 0, "").otherwise(told)
    return F.array(first, second, third)


def subject_response(asked: DataFrame) -> DataFrame:
    """Scripted model for tests: the try of the prompt's ``attempt``."""
    return asked.select("student_id", "grade", "subject", F.get(_subject_tries(), F.col("attempt") - 1).alias("response"))


def subject_responses(prompts: DataFrame) -> DataFrame:
    """Scripted model for tests: all three tries of each subject prompt."""
    tries = F.posexplode(_subject_tries()).alias("place", "response")
    return prompts.select("student_id", "grade", "subject", tries).select(
        "student_id", "grade", "subject", (F.col("place") + 1).alias("attempt"), "response"
    )


def student_responses(prompts: DataFrame) -> DataFrame:
    """Scripted model for tests: one try per student prompt."""
    told = F.format_string(
        '{"overall_summary": "Overall view of %s", "key_strengths": ["steady", "curious"], '
        '"areas_to_improve": null, "recommended_next_steps": {"read": "daily", "train": "weekly"}, '
        '"confidence_note": "high"}',
        F.col("student_id"),
    )
    response = F.when(F.col("grade") == 11, "I cannot do that").otherwise(told)
    return prompts.select("student_id", F.lit(1).alias("attempt"), response.alias("response"))

"""Lists of reports and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import own_shuffle
from scoreflow.functions.text import email_key, strip

REPORT_LIMIT = 50
PREVIEW = 120
# Captions of the report list (fixed values).
REPORT_CAPTIONS = {
    "student_id": "Student ID",
    "student_name": "Name",
    "grade": "Grade",
    "overall_summary": "AI Summary (preview)",
    "llm_provider": "Provider",
}
ID_COLUMNS = ["student_id", "Student ID", "StudentID", "id", "ID"]
EMAIL_COLUMNS = ["email", "Email"]


def report_list(reports: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """First reports by student id with captions and a preview of the summary.

    Columns are pruned before the sort and the preview is cut after the limit.
    """
    shown = [c for c in REPORT_CAPTIONS if c in reports.columns]
    top = reports.select(shown).orderBy("student_id").limit(limit)
    if "overall_summary" in shown:
        text = F.coalesce(F.col("overall_summary").cast("string"), F.lit(""))
        top = top.withColumn("overall_summary", F.concat(F.substring(text, 1, PREVIEW), F.lit("…")))
    return top.withColumnsRenamed({c: REPORT_CAPTIONS[c] for c in shown})


def report_total(reports: DataFrame) -> DataFrame:
    """How many reports the list shows of how many there are."""
    total = F.count(F.lit(1))
    return reports.agg(F.least(total, F.lit(REPORT_LIMIT).cast("bigint")).alias("shown"), total.alias("total"))


def student_accounts(users: DataFrame) -> DataFrame:
    """Accounts with the role Student: name, e-mail and linked id."""
    linked = F.coalesce("student_id", F.lit("")) if "student_id" in users.columns else F.lit("")
    return users.filter(strip(F.col("role")) == "Student").select(
        F.col("full_name").alias("Name"), F.col("email").alias("Email"), linked.alias("Student ID")
    )


def linked_ids(users: DataFrame, students: DataFrame) -> DataFrame:
    """Student id of each student account: its own, else that of the lookup table by e-mail.

    The lookup table may name its columns in several ways; the first known name counts.
    """
    ids = [c for c in ID_COLUMNS if c in students.columns]
    mails = [c for c in EMAIL_COLUMNS if c in students.columns]
    own = strip(F.coalesce("student_id", F.lit("")))
    accounts = users.filter(strip(F.col("role")) == "Student").withColumn("_email", email_key(F.col("email")))
    if not ids or not mails:
        return accounts.select("email", own.alias("student_id"))
    found = strip(F.col(f"`{ids[0]}`").cast("string"))
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(m).alias("mail")) for i, m in enumerate(mails)]))
    lookup = (
        students.select(named.alias("m"), found.alias("_found"))
        .groupBy(email_key(F.col("m.mail")).alias("_email"))
        .agg(F.min_by("_found", F.struct("m.at", "_found")).alias("_found"))
        .withColumn("_email", own_shuffle(F.col("_email")))
    )
    return accounts.join(lookup, "_email", "left").select(
        "email", F.coalesce(F.nullif(own, F.lit("")), F.col("_found"), F.lit("")).alias("student_id")
    )

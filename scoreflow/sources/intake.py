"""New-record intake: form checks and nested records to attempt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.numbers import to_number
from scoreflow.functions.rows import once, with_values
from scoreflow.functions.text import is_blank, present, split_list, strip


def parse_scores(text: Column) -> Column:
    """Comma-separated scores to doubles; null where a token is not a number."""
    tokens = split_list(F.coalesce(text, F.lit("")))
    numbers = F.transform(tokens, to_number)
    return once(numbers, lambda all_: F.when(~F.exists(all_, lambda n: n.isNull()), all_))


def _subject_error(subject: Column, index: Column) -> Column:
    label = F.concat(F.lit("Subject "), (index + 1).cast("string"))
    text = F.coalesce(subject["scores_text"], F.lit(""))
    wrong = F.concat(label, F.lit(" scores must be numbers (e.g. 85, 90, 78). Got: '"), text, F.lit("'"))
    none = F.concat(label, F.lit(" ("), subject["name"], F.lit(") has no scores."))
    by_scores = once(parse_scores(text), lambda s: F.when(s.isNull(), wrong).when(F.size(s) == 0, none))
    return F.when(is_blank(subject["name"]), F.concat(label, F.lit(" name is required."))).otherwise(by_scores)


def form_errors(forms: DataFrame) -> Column:
    """All messages (fixed texts) of a form row, in the order of the form.

    Columns: student_id, name, grade (text) and
    subjects array<struct<name, scores_text, max_score>>.
    """
    grade = strip(F.coalesce(F.col("grade"), F.lit("")))
    number = F.when(grade.rlike(r"^[+-]?\d+$"), grade.try_cast("int"))
    subjects = F.coalesce(F.col("subjects"), F.array().cast(forms.schema["subjects"].dataType))
    heads = present(
        F.when(is_blank(F.col("student_id")), "Student ID is required."),
        F.when(is_blank(F.col("name")), "Student Name is required."),
        F.when(number.isNull(), "Grade must be a number between 1 and 12.").when(
            ~number.between(1, 12), "Grade must be between 1 and 12."
        ),
    )
    found = F.concat(heads, F.array_compact(F.transform(subjects, _subject_error)))
    alone = F.array(F.lit("At least one subject with scores is required."))
    no_subject = F.size(subjects) == 0
    return once(found, lambda e: F.when((F.size(e) == 0) & no_subject, alone).otherwise(e))


def check_forms(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split forms into nested intake records and rejected forms with their messages."""
    checked = with_values(forms, {"errors": form_errors(forms)})
    subjects = F.transform(
        F.col("subjects"),
        lambda s: F.struct(
            strip(s["name"]).alias("name"),
            parse_scores(s["scores_text"]).alias("scores"),
            s["max_score"].cast("double").alias("max_score"),
        ),
    )
    records = checked.filter(F.size("errors") == 0).select(
        strip(F.col("student_id")).alias("student_id"),
        strip(F.col("name")).alias("name"),
        strip(F.col("grade")).cast("int").alias("grade"),
        subjects.alias("subjects"),
    )
    return records, checked.filter(F.size("errors") > 0)


def intake_attempts(records: DataFrame, exam_date) -> DataFrame:
    """One attempt row per score of a nested record, all dated ``exam_date``."""
    per_subject = records.select(
        strip(F.col("student_id")).alias("student_id"),
        strip(F.col("name")).alias("Name"),
        F.col("grade").cast("int").alias("grade"),
        F.explode("subjects").alias("s"),
    )
    subject = strip(F.col("s.name"))
    per_score = per_subject.select(
        "student_id", "Name", "grade",
        subject.alias("subject"),
        F.replace(F.upper(F.left(subject, F.lit(3))), F.lit(" "), F.lit("_")).alias("prefix"),
        F.coalesce(F.col("s.max_score"), F.lit(100.0)).alias("max_score"),
        F.posexplode("s.scores").alias("position", "score"),
    )
    attempt = (F.col("position") + 1).cast("int")
    return per_score.select(
        "student_id", "Name", "grade", "subject",
        F.concat("prefix", F.lit("_MOCK_"), attempt.cast("string")).alias("exam_id"),
        F.lit("mock").alias("exam_type"),
        attempt.alias("attempt_number"),
        F.col("score").cast("double").alias("score"),
        "max_score",
        F.lit(exam_date).cast("date").alias("exam_date"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself; raises when it holds no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df

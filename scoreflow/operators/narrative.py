"""Phase 3 and the text half of phase 4: prompt tables out, response tables back in.

The model call itself is not part of the engine: a caller reads the prompt table,
obtains texts and hands them back as rows of (key, attempt, response).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import grows, once
from scoreflow.functions.text import field_text, filled_text, is_filled_object, with_recovered_json
from scoreflow.schemas import CONSOLIDATED_FIELDS, GROUP_KEY, SUMMARIES, SUMMARY_FIELDS

MAX_ATTEMPTS = 3
DEFAULT_PROVIDER = "ollama"

# Instruction and prompt texts, fallback texts.
SUBJECT_INSTRUCTIONS = (
    "You are a senior academic mentor writing faculty-grade feedback.\n"
    "Your tone must be calm, encouraging, and constructive.\n"
    "Write in complete, well-structured paragraphs.\n"
    "Explain performance clearly without inventing data.\n"
    "Avoid short or robotic sentences.\n"
    "Assume the output will be read by students, parents, and teachers.\n"
    "Return ONLY valid JSON.\n"
)
STUDENT_INSTRUCTIONS = (
    "You are a senior academic advisor.\n"
    "Generate a consolidated academic assessment across subjects.\n"
    "Use ONLY provided data.\n"
    "Identify cross-subject patterns.\n"
    "Be concrete, structured, and professional.\n"
    "Return ONLY valid JSON.\n"
)
SUBJECT_PROMPT = """
Student Academic Context
------------------------
Grade: %s
Subject: %s

Interpretable Insights
---------------------
Primary issue: %s
Secondary issue: %s
Root cause category: %s
Academic risk level: %s
Urgency level: %s
Recommended focus area: %s
Teacher intervention needed: %s

Instructions
------------
Write a detailed but readable academic summary.

Return ONLY valid JSON in the following structure:
{
  "performance_summary": "2–4 sentences explaining current performance and pattern",
  "improvement_plan": "Concrete, actionable steps written as guidance, not commands",
  "motivation_note": "Encouraging message focused on confidence and growth mindset",
  "confidence_note": "high | medium | low"
}
"""
SUBJECT_PROMPT_FIELDS = [
    "grade", "subject", "primary_issue", "secondary_issue", "root_cause_category",
    "academic_risk_level", "urgency_level", "recommended_focus_area",
    "teacher_intervention_needed",
]
STUDENT_PROMPT = """Student ID: %s
Grade: %s

Numerical subject analytics:
%s

Subject-level AI summaries:
%s

Return JSON ONLY in this exact schema:
{
  "overall_summary": "...",
  "key_strengths": "...",
  "areas_to_improve": "...",
  "recommended_next_steps": "...",
  "confidence_note": "high | medium | low"
}"""
FALLBACK = {
    "performance_summary": (
        "Based on the available academic signals, the student's performance pattern has been "
        "analyzed, though a detailed AI narrative could not be generated at this time."
    ),
    "improvement_plan": (
        "Continue reviewing core concepts regularly and seek clarification on challenging topics "
        "to strengthen understanding."
    ),
    "motivation_note": (
        "Progress is built through consistency. With steady effort and support, meaningful "
        "improvement is achievable."
    ),
    "confidence_note": "low",
}
KEY_DEFAULTS = {"confidence_note": "low"}


# --- prompts ------------------------------------------------------------------------


def first_rows(insights: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows in table order; all rows without a limit."""
    return insights if limit is None else insights.orderBy(*GROUP_KEY).limit(limit)


def subject_prompts(insights: DataFrame, limit: int | None = None) -> DataFrame:
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SUBJECT_PROMPT_FIELDS]
    return first_rows(insights, limit).select(*GROUP_KEY, filled_text(SUBJECT_PROMPT, *fields).alias("prompt"))


def json_records(records: Column, names: list[str]) -> Column:
    """Array of structs as JSON text with an indent of two, non-ASCII characters escaped; null as empty text.

    All records are written at once, a field to a line. Strings hold no raw line breaks and no bare quotes, so the patterns,
    which start or end with one, never meet the inside of a string. They start with fixed texts of four characters or
    more, which Java looks for by leaps.
    """
    options = {"pretty": "true", "ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}
    lines = F.to_json(F.transform(records, lambda r: F.struct(*[r[n].alias(n) for n in names])), options)
    lines = F.regexp_replace(lines, r'\n  "([^"]+)" : ', '\n    "$1": ')
    lines = F.regexp_replace(lines, r'": null(,?)\n', '": ""$1\n')
    lines = F.regexp_replace(lines, r"\n}, \{\n", "\n  },\n  {\n")
    start, end = len("[ {"), len("\n} ]")

    def framed(text: Column) -> Column:
        inner = F.substring(text.cast("binary"), F.lit(start + 1), F.octet_length(text) - (start + end)).cast("string")
        return F.concat(F.lit("[\n  {"), inner, F.lit("\n  }\n]"))

    return F.when(F.size(records) == 0, "[\n\n]").otherwise(once(lines, framed))


def student_prompts(gathered: DataFrame, analytics: list[str], summaries: list[str]) -> DataFrame:
    """Prompt per gathered student; the lists name the fields of the two record arrays."""
    return gathered.select(
        "student_id",
        "grade",
        filled_text(
            STUDENT_PROMPT,
            F.col("student_id"),
            F.col("grade").cast("string"),
            json_records(F.col("analytics"), analytics),
            json_records(F.col("summaries"), summaries),
        ).alias("prompt"),
    )


# --- responses ----------------------------------------------------------------------


def parse_responses(responses: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Usable responses with their fields as text.

    Usable means a JSON object with at least one key; absent keys get their default.
    """
    parsed = with_recovered_json(responses, "response", "parsed")
    return parsed.filter(is_filled_object(F.col("parsed"))).select(
        *keys,
        "attempt",
        "response",
        *[field_text(F.col("parsed"), f, KEY_DEFAULTS.get(f, "")).alias(f) for f in fields],
    )


def first_usable(
    responses: DataFrame, keys: list[str], fields: list[str], max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Fields of the first usable response of each key among its first ``max_attempts`` attempts."""
    tries = responses.filter(F.col("attempt").between(1, max_attempts))
    usable = parse_responses(tries, keys, fields)
    return (
        usable.groupBy(*keys)
        .agg(F.min_by(F.struct("attempt", *fields), F.struct("attempt", "response")).alias("r"))
        .select(*keys, F.col("r.attempt").alias("attempt"), *[F.col(f"r.{f}").alias(f) for f in fields])
    )


def subject_summaries(
    prompts: DataFrame, responses: DataFrame, provider: str = DEFAULT_PROVIDER
) -> DataFrame:
    """One summary per prompt; fallback texts where no usable response exists."""
    answers = first_usable(responses, GROUP_KEY, SUMMARY_FIELDS)
    filled = prompts.join(grows(answers), GROUP_KEY, "left").withColumns(
        {f: F.coalesce(F.col(f), F.lit(FALLBACK[f])) for f in SUMMARY_FIELDS}
    )
    return filled.withColumn("llm_provider", F.lit(provider)).select(SUMMARIES.names)


def consolidated_rows(
    students: DataFrame, responses: DataFrame, provider: str = DEFAULT_PROVIDER
) -> tuple[DataFrame, DataFrame]:
    """(consolidated row per answered student, students without a usable response)."""
    answers = first_usable(responses, ["student_id"], CONSOLIDATED_FIELDS).drop("attempt")
    base = students.select("student_id", "grade")
    done = base.join(grows(answers), "student_id").withColumn("llm_provider", F.lit(provider))
    return done, unanswered(base, answers)


def unanswered(students: DataFrame, answered: DataFrame) -> DataFrame:
    """Students without a consolidated row, as error rows."""
    missing = students.select("student_id", "grade").join(grows(answered), "student_id", "left_anti")
    return missing.withColumn("error", F.lit("LLM failed to produce valid JSON"))

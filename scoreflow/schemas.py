"""Table schemas, value domains and thresholds shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    """Schema of ``name type`` pairs; unlike a DDL parse it needs no running session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


# Names of columns and values that tables share with other programs.
ATTEMPT_COLUMNS = [
    "student_id", "Name", "grade", "subject", "exam_id", "exam_type",
    "attempt_number", "score", "max_score", "exam_date",
]
ATTEMPT_KEY = ["student_id", "exam_id", "attempt_number"]
GROUP_KEY = ["student_id", "grade", "subject"]
# A refresh replaces all rows of a student and subject, whatever the grade.
SUBJECT_KEY = ["student_id", "subject"]

# Raw tables hold text only; nothing is inferred.
RAW = _schema(", ".join(f"{c} string" for c in ATTEMPT_COLUMNS))

VALIDATED = _schema(
    "student_id string, Name string, grade int, subject string, exam_id string, "
    "exam_type string, attempt_number int, score double, max_score double, exam_date date"
)
ANALYTICS = _schema(
    "student_id string, grade int, subject string, attempt_count bigint, "
    "average_score double, latest_score double, recent_avg_score double, trend string, "
    "improvement_velocity double, consistency_score double, volatility_level string, "
    "mock_vs_real_gap double, performance_band string, risk_flag string, "
    "data_confidence_level string"
)
# One row per group: integer sums, first attempt, last attempts, sums of very large scores.
_ATTEMPT = _schema("exam_date date, attempt_number int, exam_id string, score double")
_WIDE = _schema(
    "kind string, unit int, n bigint, high bigint, low bigint, hh_high bigint, hh_low bigint, "
    "hl_high bigint, hl_low bigint, ll_high bigint, ll_low bigint"
)
_SUM_NAMES = ["n", "w", "f", "g", *[f"{c}_{kind}" for kind in ("mock", "real") for c in ("n", "w", "f", "g")]]
_SUM_NAMES += [f"{c}_{limb}" for c in ("ww", "wf", "ff") for limb in ("high", "low")]
STATES = T.StructType(
    [
        *_schema("student_id string, grade int, subject string").fields,
        *[T.StructField(name, T.LongType()) for name in _SUM_NAMES],
        T.StructField("first", _ATTEMPT),
        T.StructField("last", T.ArrayType(_ATTEMPT)),
        T.StructField("wide", T.ArrayType(_WIDE)),
    ]
)
MALFORMED = _schema("file string, text string")

INSIGHTS = _schema(
    "student_id string, grade int, subject string, primary_issue string, "
    "secondary_issue string, root_cause_category string, academic_risk_level string, "
    "urgency_level string, recommended_focus_area string, "
    "teacher_intervention_needed string, explanation_summary string, "
    "key_evidence_points string, confidence_in_insight string, summary_signal string"
)
SUMMARIES = _schema(
    "student_id string, grade int, subject string, performance_summary string, "
    "improvement_plan string, motivation_note string, confidence_note string, "
    "llm_provider string"
)
CONSOLIDATED = _schema(
    "student_id string, grade int, overall_summary string, key_strengths string, "
    "areas_to_improve string, recommended_next_steps string, confidence_note string, "
    "llm_provider string"
)
HISTORY = T.StructType([*CONSOLIDATED.fields, T.StructField("run_ts", TYPES["timestamp"])])
REJECTS = _schema("row_index bigint, student_id string, error string")
FAILED = _schema("student_id string, grade int, error string")
USERS = _schema(
    "id string, full_name string, email string, password_hash string, role string, "
    "student_id string, created_at string, last_login string, is_active string"
)
INTAKE_SUBJECT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("max_score", T.DoubleType()),
    ]
)
INTAKE = T.StructType(
    [
        *_schema("student_id string, name string, grade int").fields,
        T.StructField("subjects", T.ArrayType(INTAKE_SUBJECT)),
    ]
)
SUBJECT_RESPONSES = _schema(
    "student_id string, grade int, subject string, attempt int, response string"
)
STUDENT_RESPONSES = _schema("student_id string, attempt int, response string")

# Columns an analytics table must have before insights can be derived from it.
INSIGHT_INPUT = [
    "student_id", "grade", "subject", "average_score", "trend", "volatility_level",
    "risk_flag", "data_confidence_level", "performance_band", "mock_vs_real_gap",
]
SUMMARY_FIELDS = ["performance_summary", "improvement_plan", "motivation_note", "confidence_note"]
CONSOLIDATED_FIELDS = [
    "overall_summary", "key_strengths", "areas_to_improve", "recommended_next_steps",
    "confidence_note",
]

EXAM_TYPES = ["mock", "real"]


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the metric and insight rules (fixed values)."""

    low_score: float = 60.0
    high_score: float = 80.0
    trend_delta: float = 5.0
    low_std: float = 5.0
    medium_std: float = 10.0
    pressure_gap: float = -5.0
    medium_confidence: int = 3
    high_confidence: int = 5


DEFAULTS = Thresholds()

"""The driver queries as SQL, for checking results on the driver's tables."""

from __future__ import annotations

from scoreflow.operators.narrative import FALLBACK, STUDENT_PROMPT, SUBJECT_PROMPT, SUBJECT_PROMPT_FIELDS
from scoreflow.operators.validation import MESSAGES
from scoreflow.schemas import ANALYTICS, SUMMARIES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, parts: list[str]) -> str:
    """SQL concatenation for a template with %s places."""
    texts = [quoted(t) for t in template.split("%s")]
    pieces = [texts[0]]
    for part, text in zip(parts, texts[1:]):
        pieces += [part, text]
    return " || ".join(pieces)


def even(x: str, digits: int) -> str:
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


def mean(x: str) -> str:
    return f"(CAST(sum(CAST({x} AS DECIMAL(30,10))) AS DOUBLE) / count({x}))"


UNIT = "CAST(round_even(score * 1000000, 0) AS HUGEINT)"
DEVIATION = (
    f"sqrt(CAST(count(*) * sum({UNIT} * {UNIT}) - sum({UNIT}) * sum({UNIT}) AS DOUBLE)) / (count(*) * CAST(1000000 AS DOUBLE))"
)
GAP = f"""{mean("CASE WHEN exam_type = 'real' THEN score END")} - {mean("CASE WHEN exam_type = 'mock' THEN score END")}"""


def tenth(x: str) -> str:
    """One decimal from the exact binary value, ties to even; ``x`` is a plain column."""
    t = f"(CAST(({x} - floor({x})) * 72057594037927936 AS BIGINT) * 10)"
    digit, rest = f"({t} >> 56)", f"({t} & 72057594037927935)"
    up = f"CASE WHEN {rest} > 36028797018963968 OR ({rest} = 36028797018963968 AND {digit} % 2 = 1) THEN 1 ELSE 0 END"
    return f"CAST(CAST(floor({x}) AS BIGINT) * 10 + {digit} + {up} AS DOUBLE) / 10"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ATTEMPTS = """attempts AS (
  SELECT 'S' || o_custkey AS student_id,
    'Student ' || o_custkey || CASE WHEN o_orderstatus = 'P' THEN ' P.' ELSE '' END AS "Name",
    CAST(1 + o_custkey % 12 AS INTEGER) AS grade, o_orderpriority AS subject,
    CAST(o_orderkey AS VARCHAR) AS exam_id,
    CASE WHEN o_orderstatus = 'F' THEN 'real' ELSE 'mock' END AS exam_type,
    CAST(1 + o_orderkey % 4 AS INTEGER) AS attempt_number,
    CAST(floor(o_totalprice / 5000) AS DOUBLE) AS score, CAST(100 AS DOUBLE) AS max_score,
    CAST(o_orderdate AS DATE) AS exam_date
  FROM orders)"""

EVENT_ATTEMPTS = """event_attempts AS (
  SELECT 'S' || user_id AS student_id, 'User ' || user_id AS "Name",
    CAST(1 + user_id % 12 AS INTEGER) AS grade, event_type AS subject,
    CAST(event_id AS VARCHAR) AS exam_id,
    CASE WHEN event_id % 2 = 0 THEN 'mock' ELSE 'real' END AS exam_type,
    CAST(1 + event_id % 5 AS INTEGER) AS attempt_number,
    CAST(least(floor(value), 100) AS DOUBLE) AS score, CAST(100 AS DOUBLE) AS max_score,
    CAST(ts AS DATE) AS exam_date
  FROM events)"""

# Scores with two decimals, all customers of a nation in one group.
DECIMAL_ATTEMPTS = ATTEMPTS.replace("attempts AS", "decimal_attempts AS").replace(
    "'S' || o_custkey AS student_id", "'N' || o_custkey % 25 AS student_id"
).replace("1 + o_custkey % 12", "1 + o_custkey % 5").replace(
    "CAST(floor(o_totalprice / 5000) AS DOUBLE)", "round_even(o_totalprice / 50, 0) / 100"
)

# A fifth of the scores times 2**50, a fifth times 2**70.
WIDE_ATTEMPTS = ATTEMPTS.replace("attempts AS", "wide_attempts AS").replace(
    "CAST(floor(o_totalprice / 5000) AS DOUBLE)",
    "CAST(floor(o_totalprice / 5000) AS DOUBLE) * CASE o_orderkey % 5 WHEN 0 THEN 1125899906842624::DOUBLE "
    "WHEN 1 THEN 1180591620717411303424::DOUBLE ELSE 1 END",
)


def far(x: str) -> str:
    """Two decimals, ties to even; numbers without a fraction as they are."""
    return f"CASE WHEN abs({x}) >= 4503599627370496 THEN {x} ELSE {even(x, 2)} END"


def whole(x: str) -> str:
    """Mean of whole numbers of any size."""
    return f"(CAST(sum(CAST({x} AS HUGEINT)) AS DOUBLE) / count({x}))"


DIRTY = """dirty AS (
  SELECT event_id AS row_index,
    CASE event_id % 41 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE 'S' || user_id END AS student_id,
    'User ' || user_id AS "Name",
    CASE event_id % 29 WHEN 1 THEN '0' WHEN 2 THEN '13' WHEN 3 THEN 'abc' WHEN 4 THEN '12.9'
      ELSE CAST(1 + user_id % 12 AS VARCHAR) END AS grade,
    CASE event_id % 37 WHEN 5 THEN ' ' ELSE event_type END AS subject,
    event_type || '-' || strftime(ts, '%Y%m%d') AS exam_id,
    CASE event_id % 31 WHEN 6 THEN 'quiz' WHEN 7 THEN 'MOCK'
      ELSE CASE WHEN event_id % 2 = 0 THEN 'mock' ELSE 'real' END END AS exam_type,
    CASE event_id % 23 WHEN 8 THEN '0' WHEN 9 THEN '' ELSE CAST(1 + event_id % 5 AS VARCHAR) END AS attempt_number,
    CASE event_id % 19 WHEN 11 THEN '150' WHEN 12 THEN '-1' WHEN 13 THEN '1.5d'
      ELSE CAST(CAST(least(floor(value), 100) AS BIGINT) AS VARCHAR) END AS score,
    CASE event_id % 59 WHEN 10 THEN '0' WHEN 11 THEN '1,000' ELSE '100' END AS max_score,
    CASE event_id % 47 WHEN 14 THEN '2024-02-30' WHEN 15 THEN '2024-02' WHEN 16 THEN '2999-01-01'
      ELSE strftime(ts, '%Y-%m-%d') END AS exam_date
  FROM events)"""


def _number(c: str) -> str:
    return (
        rf"CASE WHEN regexp_matches({c}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') "
        f"THEN TRY_CAST(trim({c}) AS DOUBLE) END AS {c}"
    )


COERCED = f"""coerced AS (
  SELECT row_index, student_id, "Name", {_number('grade')}, subject, exam_id, exam_type,
    {_number('attempt_number')}, {_number('score')}, {_number('max_score')},
    try_strptime(exam_date, '%Y-%m-%d') AS exam_date
  FROM dirty)"""

CLASSIFIED = """classified AS (
  SELECT *, CASE
    WHEN coalesce(trim(student_id), '') = '' THEN 'student_id missing'
    WHEN grade IS NULL OR trunc(grade) NOT BETWEEN 1 AND 12 THEN 'grade out of range'
    WHEN coalesce(trim(subject), '') = '' THEN 'invalid subject'
    WHEN exam_type NOT IN ('mock', 'real') THEN 'invalid exam_type'
    WHEN attempt_number IS NULL OR trunc(attempt_number) < 1 THEN 'invalid attempt_number'
    WHEN max_score IS NULL OR max_score <= 0 THEN 'invalid max_score'
    WHEN score IS NULL OR score < 0 OR score > max_score THEN 'score out of range'
    WHEN exam_date IS NULL THEN 'invalid exam_date'
    WHEN exam_date > TIMESTAMP '2030-01-01' THEN 'exam_date in future' END AS error
  FROM coerced)"""

ACCEPTED = """accepted AS (
  SELECT student_id, "Name", CAST(trunc(grade) AS INTEGER) AS grade, subject, exam_id, exam_type,
    CAST(trunc(attempt_number) AS INTEGER) AS attempt_number, score, max_score, CAST(exam_date AS DATE) AS exam_date
  FROM classified WHERE error IS NULL)"""

REPEATED = """repeated AS (
  SELECT student_id, exam_id, attempt_number, count(*) AS copies FROM accepted
  GROUP BY student_id, exam_id, attempt_number HAVING count(*) > 1)"""

CHECKED = (DIRTY, COERCED, CLASSIFIED)


def analytics(source: str = "attempts", name: str = "analytics", k: int = 2) -> str:
    keys = "student_id, grade, subject"
    return f"""{name} AS (
  SELECT {keys}, attempt_count, average_score, latest_score, recent_avg_score, trend,
    CASE WHEN attempt_count < 2 THEN 0.0::DOUBLE ELSE {even('(latest_score - first_score) / attempt_count', 2)} END AS improvement_velocity,
    CASE WHEN attempt_count < 2 THEN 1.0::DOUBLE ELSE {even('1.0::DOUBLE / (1 + std)', 3)} END AS consistency_score,
    CASE WHEN attempt_count < 2 THEN 'unknown' WHEN std < 5 THEN 'low' WHEN std < 10 THEN 'medium' ELSE 'high' END AS volatility_level,
    mock_vs_real_gap,
    CASE WHEN average_score < 60 THEN 'low' WHEN average_score < 80 THEN 'medium' ELSE 'high' END AS performance_band,
    CASE WHEN average_score < 60 AND trend = 'declining' THEN 'high'
      WHEN average_score < 60 OR trend = 'declining' THEN 'medium' ELSE 'low' END AS risk_flag,
    CASE WHEN attempt_count >= 5 THEN 'high' WHEN attempt_count >= 3 THEN 'medium' ELSE 'low' END AS data_confidence_level
  FROM (
    SELECT *, CASE WHEN attempt_count < 2 THEN 'insufficient_data' WHEN latest_score - first_score > 5 THEN 'improving'
      WHEN latest_score - first_score < -5 THEN 'declining' ELSE 'stable' END AS trend
    FROM (
      SELECT {keys}, count(*) AS attempt_count, {even(mean('score'), 2)} AS average_score,
        max(score) FILTER (WHERE newest = 1) AS latest_score, max(score) FILTER (WHERE oldest = 1) AS first_score,
        {even(mean(f'CASE WHEN newest <= {k} THEN score END'), 2)} AS recent_avg_score,
        round({DEVIATION}, 9) AS std,
        {even(GAP, 2)} AS mock_vs_real_gap
      FROM (
        SELECT *,
          row_number() OVER (PARTITION BY {keys} ORDER BY exam_date, attempt_number, exam_id) AS oldest,
          row_number() OVER (PARTITION BY {keys} ORDER BY exam_date DESC, attempt_number DESC, exam_id DESC) AS newest
        FROM {source}
        WHERE student_id IS NOT NULL AND grade IS NOT NULL AND subject IS NOT NULL
          AND score IS NOT NULL AND exam_date IS NOT NULL)
      GROUP BY {keys})))"""


def insights(source: str = "analytics", name: str = "insights") -> str:
    return f"""{name} AS (
  SELECT student_id, grade, subject, primary_issue,
    CASE WHEN volatility_level = 'high' THEN 'Highly inconsistent performance'
      WHEN mock_vs_real_gap < -5 THEN 'Exam pressure affecting real exam performance'
      ELSE 'None observed' END AS secondary_issue,
    CASE primary_issue
      WHEN 'Consistently low and declining performance' THEN 'Conceptual gaps with poor reinforcement'
      WHEN 'Low overall performance' THEN 'Weak foundational understanding'
      WHEN 'Performance regression' THEN 'Inconsistent preparation or focus'
      ELSE 'Healthy learning pattern' END AS root_cause_category,
    risk_flag AS academic_risk_level, urgency AS urgency_level,
    CASE urgency WHEN 'high' THEN 'Immediate concept revision and guided practice'
      WHEN 'medium' THEN 'Structured revision and consistency building'
      ELSE 'Maintain current learning approach' END AS recommended_focus_area,
    CASE WHEN urgency = 'high' THEN 'yes' ELSE 'no' END AS teacher_intervention_needed,
    primary_issue AS explanation_summary,
    concat_ws(chr(10),
      '- Average score is ' || average_score || ', classified as ' || performance_band,
      '- Score trend is ''' || trend || ''', indicating learning direction over time',
      CASE WHEN volatility_level = 'high' THEN '- Scores show high volatility, suggesting inconsistency' END,
      CASE WHEN mock_vs_real_gap < -5
        THEN '- Mock scores significantly higher than real exam scores, indicating exam pressure' END,
      '- Academic risk flagged as ''' || risk_flag || ''' with ' || data_confidence_level || ' confidence'
    ) AS key_evidence_points,
    data_confidence_level AS confidence_in_insight,
    performance_band || ' performer with ' || risk_flag || ' risk' AS summary_signal
  FROM (
    SELECT *,
      CASE WHEN average_score < 60 AND trend = 'declining' THEN 'Consistently low and declining performance'
        WHEN average_score < 60 THEN 'Low overall performance'
        WHEN trend = 'declining' THEN 'Performance regression' ELSE 'No major academic concern' END AS primary_issue,
      CASE WHEN average_score < 60 AND trend = 'declining' THEN 'high'
        WHEN average_score < 60 OR trend = 'declining' THEN 'medium' ELSE 'low' END AS urgency
    FROM {source}))"""


def _summary(told: str, short: str, field: str) -> str:
    return f"CASE answer WHEN 'told' THEN {told} WHEN 'short' THEN {short} ELSE {quoted(FALLBACK[field])} END AS {field}"


SUMMARIES_SQL = f"""summaries AS (
  SELECT student_id, grade, subject,
    {_summary("subject || ' in grade ' || grade", "'Short note on ' || subject", 'performance_summary')},
    {_summary("'Plan for ' || student_id", "''", 'improvement_plan')},
    {_summary("'Keep going'", "''", 'motivation_note')},
    {_summary("'medium'", "'low'", 'confidence_note')},
    'ollama' AS llm_provider
  FROM (
    SELECT *, CASE WHEN grade % 3 = 2 THEN 'told' WHEN grade % 4 = 1 THEN 'short' WHEN grade % 4 <> 0 THEN 'told'
      WHEN grade % 12 <> 0 THEN 'told' ELSE 'none' END AS answer
    FROM insights))"""

STUDENTS = "students AS (SELECT student_id, min(grade) AS grade FROM analytics GROUP BY student_id)"

CONSOLIDATED = """consolidated AS (
  SELECT student_id, grade, 'Overall view of ' || student_id AS overall_summary,
    '["steady","curious"]' AS key_strengths, '' AS areas_to_improve,
    '{"read":"daily","train":"weekly"}' AS recommended_next_steps, 'high' AS confidence_note, 'ollama' AS llm_provider
  FROM students WHERE grade <> 11)"""

META = """meta AS (
  SELECT student_id, "Name" AS student_name, grade FROM (
    SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY exam_date, attempt_number, exam_id) AS place FROM attempts)
  WHERE place = 1)"""

EXPLAINED = """explained AS (
  SELECT student_id, subject, explanation_summary, key_evidence_points, confidence_in_insight, recommended_focus_area
  FROM (SELECT *, row_number() OVER (PARTITION BY student_id, subject ORDER BY grade DESC) AS place FROM insights)
  WHERE place = 1)"""

MAIL = "CASE c_custkey % 3 WHEN 0 THEN upper('c' || c_custkey || '@school.test') WHEN 1 THEN '  c' || c_custkey || '@school.test' ELSE 'c' || c_custkey || '@school.test' END"

USERS = f"""users AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS full_name, {MAIL} AS email, '' AS password_hash,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Teacher' ELSE 'Student' END AS role,
    CASE WHEN c_acctbal < 3000 THEN '' ELSE 'S' || c_custkey END AS student_id,
    '2024-01-01' AS created_at, '' AS last_login, 'true' AS is_active
  FROM customer)"""

SIGNUPS = """signups AS (
  SELECT 'r' || o_orderkey AS id, 'Student ' || o_custkey AS full_name,
    upper('c' || o_custkey || '@school.test') || ' ' AS email, 'Student' AS role, o_orderkey AS seq,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place,
    'c' || o_custkey || '@school.test' IN (SELECT lower(trim(email)) FROM users WHERE student_id = '') AS taken
  FROM orders)"""

REQUESTS = """requests AS (
  SELECT CASE c_custkey % 3 WHEN 0 THEN ' S' || c_custkey WHEN 1 THEN 's' || c_custkey ELSE 'S' || c_custkey END AS requested
  FROM customer)"""

FORMS = """forms AS (
  SELECT o_orderkey AS form_id,
    CASE WHEN o_orderkey % 19 = 8 THEN ' ' ELSE ' S' || o_custkey END AS student_id,
    CASE WHEN o_orderkey % 23 = 9 THEN '' ELSE 'Student ' || o_custkey END AS name,
    CASE o_orderkey % 13 WHEN 5 THEN '14' WHEN 6 THEN 'ten' ELSE CAST(1 + o_custkey % 12 AS VARCHAR) END AS grade,
    o_orderkey % 29 = 10 AS empty_form, o_orderkey % 17 = 7 AS unnamed, o_orderpriority,
    CAST(floor(o_totalprice / 5000) AS BIGINT) AS a, CAST(floor(o_totalprice / 7000) AS BIGINT) AS b,
    o_orderkey % 11 AS kind
  FROM orders)"""

FORM_ERRORS = """form_errors AS (
  SELECT *, concat_ws('|',
    CASE WHEN trim(student_id) = '' THEN 'Student ID is required.' END,
    CASE WHEN name = '' THEN 'Student Name is required.' END,
    CASE grade WHEN '14' THEN 'Grade must be between 1 and 12.'
      WHEN 'ten' THEN 'Grade must be a number between 1 and 12.' END,
    CASE WHEN empty_form THEN NULL
      WHEN kind = 3 THEN 'Subject 1 scores must be numbers (e.g. 85, 90, 78). Got: ''' || a || ', abc'''
      WHEN kind = 4 THEN 'Subject 1 (' || o_orderpriority || ') has no scores.' END,
    CASE WHEN NOT empty_form AND unnamed THEN 'Subject 2 name is required.' END) AS found
  FROM forms)"""

SUBJECT_SCORES = """subject_scores AS (
  SELECT form_id, 0 AS place, CASE kind WHEN 3 THEN NULL WHEN 4 THEN []::DOUBLE[]
    ELSE [a::DOUBLE, b::DOUBLE, a::DOUBLE + 0.5] END AS scores FROM forms WHERE NOT empty_form
  UNION ALL SELECT form_id, 1, [b::DOUBLE] FROM forms WHERE NOT empty_form)"""

ROSTER = f"""roster AS (
  SELECT s.student_id, coalesce(m.student_name, '—') AS name, s.grade, {tenth('s.mean')} AS overall_avg,
    s.risk_level, s.trend, s.subjects, c.student_id IS NOT NULL AS processed
  FROM (
    SELECT student_id, CAST(min(grade) AS VARCHAR) AS grade, {mean('average_score')} AS mean,
      arg_max(risk_flag, CASE risk_flag WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS risk_level,
      CASE WHEN bool_or(trend = 'declining') THEN 'Declining' WHEN bool_or(trend = 'improving') THEN 'Improving'
        ELSE arg_min(trend, (grade, subject)) END AS trend,
      string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects
    FROM analytics GROUP BY student_id) s
  LEFT JOIN meta m ON m.student_id = s.student_id
  LEFT JOIN consolidated c ON c.student_id = s.student_id)"""

BASE = (ATTEMPTS, analytics())
FOUND = (*BASE, insights())
TOLD = (*FOUND, SUMMARIES_SQL)
DONE = (*TOLD, STUDENTS, CONSOLIDATED)
RANKED = (*DONE, META, ROSTER)


def _json_line(name: str, text_value: bool, nullable: bool = False) -> str:
    value = f"'\"' || {name} || '\"'" if text_value else f"CAST({name} AS VARCHAR)"
    if nullable:
        value = f"coalesce({value}, '\"\"')"
    return f"'    \"{name}\": ' || {value}"


def _records(names: list[str], numbers: set[str]) -> str:
    lines = (" || ',' || chr(10) || ").join(_json_line(n, n not in numbers, n == "mock_vs_real_gap") for n in names)
    one = f"'  {{' || chr(10) || {lines} || chr(10) || '  }}'"
    return f"'[' || chr(10) || string_agg({one}, ',' || chr(10) ORDER BY grade, subject) || chr(10) || ']'"


_NUMBERS = {
    "grade", "attempt_count", "average_score", "latest_score", "recent_avg_score", "improvement_velocity",
    "consistency_score", "mock_vs_real_gap",
}
STUDENT_PROMPTS = f"""student_prompts AS (
  SELECT a.student_id, a.grade, {filled(STUDENT_PROMPT, ['a.student_id', 'a.grade', 'a.records', 's.records'])} AS prompt
  FROM (SELECT student_id, min(grade) AS grade, {_records(ANALYTICS.names, _NUMBERS)} AS records
        FROM analytics GROUP BY student_id) a
  JOIN (SELECT student_id, {_records(SUMMARIES.names, _NUMBERS)} AS records FROM summaries GROUP BY student_id) s
    ON a.student_id = s.student_id)"""


def _escaped(x: str) -> str:
    return f"'\"' || replace({x}, chr(10), '\\n') || '\"'"


DOCUMENT = f"""'{{"student_id":"' || c.student_id || '","student_name":"' || m.student_name || '","grade":' || m.grade
    || ',"overall_summary":"' || c.overall_summary || '","recommended_next_steps":' || c.recommended_next_steps
    || ',"numerical_performance":[' || p.performance || '],"subject_summaries":[' || t.told
    || '],"mode":"cached","llm_provider_used":"' || c.llm_provider || '"}}'"""
TOLD_JSON = f"""'{{"confidence_note":"' || s.confidence_note || '","explainability":{{"confidence_in_insight":"'
      || e.confidence_in_insight || '","explanation_summary":"' || e.explanation_summary || '","key_evidence_points":'
      || {_escaped('e.key_evidence_points')} || ',"recommended_focus_area":"' || e.recommended_focus_area || '"}},"grade":' || s.grade
      || ',"improvement_plan":"' || s.improvement_plan || '","llm_provider":"' || s.llm_provider
      || '","motivation_note":"' || s.motivation_note || '","performance_summary":"' || s.performance_summary
      || '","student_id":"' || s.student_id || '","subject":"' || s.subject || '"}}'"""
PERFORMANCE_JSON = """'{"subject":"' || subject || '","average_score":' || average_score || ',"latest_score":' || latest_score
      || ',"trend":"' || trend || '","risk_flag":"' || risk_flag || '"}'"""

COLOUR = "CASE WHEN trend = 'improving' THEN 'green' WHEN trend = 'declining' THEN 'red' ELSE 'amber' END"


def score_colour(x: str) -> str:
    return f"CASE WHEN {x} >= 70 THEN 'green' WHEN {x} >= 50 THEN 'amber' ELSE 'red' END"


NEW_RECORDS = """records AS (
  SELECT 'E' || event_id AS student_id, 'User ' || user_id AS "Name", CAST(1 + user_id % 12 AS INTEGER) AS grade,
    event_type AS subject, upper(event_type[1:3]) || '_MOCK_' || i AS exam_id, 'mock' AS exam_type,
    CAST(i AS INTEGER) AS attempt_number, CAST(least(floor(value / (CASE i WHEN 1 THEN 5 ELSE 7 END)), 100) AS DOUBLE) AS score,
    CAST(100 AS DOUBLE) AS max_score, DATE '2024-06-01' AS exam_date
  FROM events, (SELECT unnest([1, 2]) AS i))"""

ORACLES: dict[str, str] = {
    # tables
    "csv_roundtrip": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents",
    "overwrite_roundtrip": "SELECT event_id, event_type, CASE WHEN event_id % 50 IN (0, 1) THEN NULL ELSE value END AS value FROM events",
    "append_history": with_(ATTEMPTS) + "SELECT * FROM attempts",
    "upsert_latest": with_(
        ATTEMPTS,
        "reals AS (SELECT * FROM attempts WHERE exam_type = 'real')",
        "mocks AS (SELECT * FROM attempts WHERE exam_type = 'mock')",
        analytics("reals", "old"),
        analytics("mocks", "new"),
    )
    + "SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.student_id = old.student_id AND new.subject = old.subject) UNION ALL SELECT * FROM new",
    "keyed_update": with_(
        USERS,
        """last AS (SELECT 'c' || o_custkey || '@school.test' AS mail,
          arg_max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'N' || o_orderkey END, o_orderkey) AS linked FROM orders GROUP BY o_custkey)""",
    )
    + "SELECT u.* REPLACE (coalesce(l.linked, u.student_id) AS student_id) FROM users u LEFT JOIN last l ON lower(trim(u.email)) = l.mail",
    "insert_if_absent": with_(USERS, SIGNUPS)
    + """SELECT * REPLACE (CASE WHEN student_id = '' THEN email ELSE 'old.' || email END AS email) FROM users UNION ALL
      SELECT id, full_name, lower(trim(email)), '', role, '', '', '', '' FROM signups WHERE place = 1 AND NOT taken""",
    "registration_rejects": with_(USERS, SIGNUPS)
    + "SELECT id, full_name, email, role, seq FROM signups WHERE place > 1 OR taken",
    "aligned_users": """SELECT 'r' || o_orderkey AS id, 'Student ' || o_custkey AS full_name,
      upper('c' || o_custkey || '@school.test') || ' ' AS email, '' AS password_hash, 'Student' AS role, '' AS student_id,
      '' AS created_at, '' AS last_login, '' AS is_active, o_orderkey AS seq FROM orders""",
    "shared_tables": with_(*DONE)
    + " UNION ALL ".join(
        f"SELECT '{label}' AS table_name, student_id, count(*) AS row_count FROM {source} GROUP BY student_id"
        for label, source in (
            ("validated_results", "attempts"), ("subject_analytics", "analytics"), ("subject_insights", "insights"),
            ("subject_summaries", "summaries"), ("student_consolidated_latest", "consolidated"),
        )
    ),
    # intake
    "intake_rows": with_(FORMS, FORM_ERRORS)
    + """, good AS (SELECT * FROM form_errors WHERE found = '' AND NOT empty_form),
      per_subject AS (
        SELECT *, o_orderpriority AS subject, [a::DOUBLE, b::DOUBLE, a::DOUBLE + 0.5] AS scores FROM good
        UNION ALL SELECT *, 'Ma th' AS subject, [b::DOUBLE] AS scores FROM good),
      placed AS (SELECT *, unnest(scores) AS score, unnest(range(1, len(scores) + 1)) AS i FROM per_subject)
      SELECT trim(student_id) AS student_id, name AS "Name", CAST(grade AS INTEGER) AS grade, subject,
        replace(upper(subject[1:3]), ' ', '_') || '_MOCK_' || i AS exam_id, 'mock' AS exam_type,
        CAST(i AS INTEGER) AS attempt_number, score, CAST(100 AS DOUBLE) AS max_score, DATE '2024-06-01' AS exam_date
      FROM placed""",
    "score_list_parse": with_(FORMS, SUBJECT_SCORES)
    + """SELECT form_id, place, CASE WHEN scores IS NOT NULL THEN coalesce(array_to_string(scores, ','), '') END AS scores,
      CASE WHEN scores IS NULL THEN NULL ELSE CAST(len(scores) AS INTEGER) END AS score_count FROM subject_scores""",
    "intake_errors": with_(FORMS, FORM_ERRORS)
    + """SELECT form_id, CASE WHEN found = '' THEN 'At least one subject with scores is required.' ELSE found END AS errors
      FROM form_errors WHERE found <> '' OR empty_form""",
    # validation
    "coerced_rows": with_(DIRTY, COERCED)
    + "SELECT row_index, grade, attempt_number, score, max_score, CAST(exam_date AS DATE) AS exam_date FROM coerced",
    "row_errors": with_(*CHECKED) + "SELECT row_index, student_id, error FROM classified WHERE error IS NOT NULL",
    "first_errors": with_(*CHECKED)
    + "SELECT row_index, student_id, error FROM classified WHERE error IS NOT NULL ORDER BY row_index LIMIT 5",
    "error_histogram": with_(*CHECKED)
    + "SELECT error, count(*) AS row_count FROM classified WHERE error IS NOT NULL GROUP BY error",
    "validated_rows": with_(*CHECKED, ACCEPTED) + "SELECT * FROM accepted",
    "duplicate_attempts": with_(*CHECKED, ACCEPTED, REPEATED) + "SELECT * FROM repeated",
    "quarantine_report": with_(*CHECKED, ACCEPTED, REPEATED)
    + """SELECT row_index, student_id, error FROM classified WHERE error IS NOT NULL UNION ALL
      SELECT c.row_index, c.student_id, 'Duplicate exam attempts detected' FROM classified c
      JOIN repeated r ON c.student_id = r.student_id AND c.exam_id = r.exam_id AND c.attempt_number = r.attempt_number
      WHERE c.error IS NULL""",
    "quarantine_rows": with_(*CHECKED, ACCEPTED, REPEATED)
    + """SELECT a.* FROM accepted a WHERE NOT EXISTS (SELECT 1 FROM repeated r WHERE a.student_id = r.student_id
      AND a.exam_id = r.exam_id AND a.attempt_number = r.attempt_number)""",
    "gate_report": with_(*CHECKED, ACCEPTED, REPEATED)
    + """SELECT *, total_rows > 0 AND rejected_rows = 0 AND repeated_keys = 0 AS passed FROM (
      SELECT count(*) AS total_rows, count(error) AS rejected_rows, (SELECT count(*) FROM repeated) AS repeated_keys FROM classified)""",
    "observed_rejects": with_(*CHECKED) + "SELECT 'rows' AS kind, count(*) AS n FROM classified UNION ALL SELECT 'rejected', count(error) FROM classified"
    + "".join(f" UNION ALL SELECT '{m}', count(*) FILTER (error = '{m}') FROM classified" for m in MESSAGES),
    "chosen_students": with_(ATTEMPTS)
    + "SELECT * FROM attempts WHERE student_id IN (SELECT 'S' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "usable_attempts": with_(DIRTY, COERCED)
    + """SELECT row_index, student_id, CAST(trunc(grade) AS INTEGER) AS grade, subject, score, CAST(exam_date AS DATE) AS exam_date,
      CAST(trunc(attempt_number) AS INTEGER) AS attempt_number FROM coerced
      WHERE student_id IS NOT NULL AND grade IS NOT NULL AND subject IS NOT NULL AND score IS NOT NULL AND exam_date IS NOT NULL""",
    # metrics and insights
    "subject_analytics": with_(*BASE) + "SELECT * FROM analytics",
    "subject_analytics_events": with_(EVENT_ATTEMPTS, analytics("event_attempts")) + "SELECT * FROM analytics",
    "subject_analytics_decimals": with_(DECIMAL_ATTEMPTS, analytics("decimal_attempts")) + "SELECT * FROM analytics",
    "merged_analytics": with_(*BASE) + "SELECT * FROM analytics",
    "subject_analytics_wide": with_(WIDE_ATTEMPTS) + f"""SELECT student_id, grade, subject, attempt_count, average_score, latest_score, recent_avg_score, trend,
      CASE WHEN attempt_count < 2 THEN 0.0::DOUBLE ELSE {far('(latest_score - first_score) / attempt_count')} END AS improvement_velocity,
      CASE WHEN attempt_count < 2 OR low = high THEN 1.0::DOUBLE WHEN high > 1000 THEN 0.0::DOUBLE
        ELSE {even('1.0::DOUBLE / (1 + std)', 3)} END AS consistency_score,
      CASE WHEN attempt_count < 2 THEN 'unknown' WHEN low = high OR std < 5 THEN 'low' WHEN high > 1000 OR std >= 10 THEN 'high'
        ELSE 'medium' END AS volatility_level, mock_vs_real_gap,
      CASE WHEN average_score < 60 THEN 'low' WHEN average_score < 80 THEN 'medium' ELSE 'high' END AS performance_band,
      CASE WHEN average_score < 60 AND trend = 'declining' THEN 'high'
        WHEN average_score < 60 OR trend = 'declining' THEN 'medium' ELSE 'low' END AS risk_flag,
      CASE WHEN attempt_count >= 5 THEN 'high' WHEN attempt_count >= 3 THEN 'medium' ELSE 'low' END AS data_confidence_level
    FROM (SELECT student_id, grade, subject, attempt_count, latest_score, first_score, low, high, std,
      {far('m')} AS average_score, {far('m2')} AS recent_avg_score, {far('gap')} AS mock_vs_real_gap,
      CASE WHEN attempt_count < 2 THEN 'insufficient_data' WHEN latest_score - first_score > 5 THEN 'improving'
        WHEN latest_score - first_score < -5 THEN 'declining' ELSE 'stable' END AS trend
    FROM (
      SELECT student_id, grade, subject, count(*) AS attempt_count, min(score) AS low, max(score) AS high,
        max(score) FILTER (newest = 1) AS latest_score, max(score) FILTER (oldest = 1) AS first_score,
        {whole('score')} AS m, {whole('CASE WHEN newest <= 2 THEN score END')} AS m2,
        {whole("CASE WHEN exam_type = 'real' THEN score END")} - {whole("CASE WHEN exam_type = 'mock' THEN score END")} AS gap,
        CASE WHEN max(score) < 1000 THEN round(stddev_pop(CASE WHEN score < 1000 THEN score END), 9) END AS std
      FROM (SELECT *, row_number() OVER (PARTITION BY student_id, grade, subject ORDER BY exam_date, attempt_number, exam_id) AS oldest,
        row_number() OVER (PARTITION BY student_id, grade, subject ORDER BY exam_date DESC, attempt_number DESC, exam_id DESC) AS newest
        FROM wide_attempts)
      GROUP BY ALL))""",
    "recent_average_k3": with_(EVENT_ATTEMPTS, analytics("event_attempts", k=3))
    + "SELECT student_id, grade, subject, latest_score, recent_avg_score FROM analytics",
    "mock_real_gap": with_(*BASE) + "SELECT student_id, grade, subject, mock_vs_real_gap FROM analytics",
    "phase_counters": with_(*BASE) + "SELECT count(DISTINCT student_id) AS students, count(*) AS records FROM analytics",
    "subject_insights": with_(*FOUND) + "SELECT * FROM insights",
    "evidence_text": with_(EVENT_ATTEMPTS, analytics("event_attempts"), insights())
    + "SELECT student_id, grade, subject, key_evidence_points FROM insights",
    # narrative
    "prompt_text": with_(*FOUND)
    + f"SELECT student_id, grade, subject, {filled(SUBJECT_PROMPT, SUBJECT_PROMPT_FIELDS)} AS prompt FROM insights",
    "prompt_first_rows": with_(*FOUND)
    + f"""SELECT student_id, grade, subject, {filled(SUBJECT_PROMPT, SUBJECT_PROMPT_FIELDS)} AS prompt FROM insights
      ORDER BY student_id, grade, subject LIMIT 200""",
    "student_prompts": with_(*TOLD, STUDENT_PROMPTS) + "SELECT * FROM student_prompts",
    "json_recovery": """SELECT event_id, event_id % 6 IN (0, 1, 5) AS usable,
      CASE WHEN event_id % 6 IN (0, 1) THEN json_extract_string(props, '$.k') WHEN event_id % 6 = 5 THEN event_type END AS k FROM events""",
    "attempt_selection": """SELECT 'S' || o_custkey AS student_id, CAST(1 + o_custkey % 12 AS INTEGER) AS grade, o_orderpriority AS subject,
      CAST(1 + o_orderkey % 5 AS INTEGER) AS attempt, 'order ' || o_orderkey AS performance_summary, '' AS improvement_plan,
      '' AS motivation_note, 'low' AS confidence_note
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
              ORDER BY o_orderkey % 5, CAST(o_orderkey AS VARCHAR) || '"') AS place
            FROM orders WHERE o_orderkey % 5 < 3 AND o_orderkey % 3 <> 0)
      WHERE place = 1""",
    "subject_summaries": with_(*TOLD) + "SELECT * FROM summaries",
    "retry_rounds": with_(*TOLD)
    + """SELECT *, CASE WHEN grade % 3 = 2 THEN 1 WHEN grade % 4 <> 0 THEN 2 ELSE 3 END::BIGINT AS times_asked FROM summaries""",
    "nested_to_text": """SELECT event_id, CAST(event_id AS VARCHAR) AS f_n, event_type AS f_s, '[' || user_id || ',"a"]' AS f_l,
      '{"p":' || replace(props, ' ', '') || '}' AS f_o, 'True' AS f_t, '' AS f_z, 'low' AS f_absent FROM events""",
    "consolidated_rows": with_(*DONE) + "SELECT * FROM consolidated",
    "consolidation_failures": with_(*BASE, STUDENTS)
    + "SELECT student_id, grade, 'LLM failed to produce valid JSON' AS error FROM students WHERE grade = 11",
    # consolidation
    "ready_students": with_(ATTEMPTS, EVENT_ATTEMPTS)
    + "SELECT student_id FROM attempts INTERSECT SELECT student_id FROM event_attempts",
    "student_gather": with_(*TOLD)
    + """SELECT a.student_id, a.grade, a.averages, s.plans FROM
      (SELECT student_id, min(grade) AS grade, string_agg(CAST(average_score AS VARCHAR), '|' ORDER BY grade, subject) AS averages
       FROM analytics GROUP BY student_id) a JOIN
      (SELECT student_id, string_agg(subject || ':' || improvement_plan, '|' ORDER BY grade, subject) AS plans
       FROM summaries GROUP BY student_id) s ON a.student_id = s.student_id""",
    "latest_from_history": with_(ATTEMPTS)
    + """SELECT student_id, grade, 'Report ' || exam_id AS overall_summary, subject AS key_strengths, '' AS areas_to_improve,
      '' AS recommended_next_steps, 'low' AS confidence_note, 'ollama' AS llm_provider FROM (
        SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY CAST(exam_id AS BIGINT) DESC) AS place FROM attempts)
      WHERE place = 1""",
    "explained_summaries": with_(*TOLD)
    + """SELECT s.*, e.explanation_summary, e.key_evidence_points, e.confidence_in_insight, e.recommended_focus_area
      FROM summaries s LEFT JOIN insights e ON s.student_id = e.student_id AND s.subject = e.subject AND e.grade % 3 <> 0""",
    "processed_flags": with_(*DONE)
    + "SELECT a.student_id, a.exam_id, c.student_id IS NOT NULL AS processed FROM attempts a LEFT JOIN consolidated c ON a.student_id = c.student_id",
    "first_names": with_(ATTEMPTS, META) + "SELECT student_id, student_name AS name FROM meta",
    # reports
    "id_match_modes": with_(*BASE, REQUESTS)
    + """SELECT 'exact' AS mode, requested, student_id, subject FROM requests JOIN analytics ON requested = student_id UNION ALL
      SELECT 'trim', requested, student_id, subject FROM requests JOIN analytics ON trim(requested) = student_id UNION ALL
      SELECT 'ci', requested, student_id, subject FROM requests JOIN analytics ON upper(trim(requested)) = student_id""",
    "table_lookups": with_(*DONE)
    + """SELECT a.student_id, a.n AS summaries, a.n AS insights, a.n AS analytics, c.overall_summary
      FROM (SELECT student_id, count(*) AS n FROM analytics GROUP BY student_id) a LEFT JOIN consolidated c ON a.student_id = c.student_id""",
    "student_metadata": with_(ATTEMPTS, META) + "SELECT * FROM meta",
    "report_rows": with_(*DONE, META, EXPLAINED)
    + """SELECT s.student_id, s.subject, s.performance_summary, s.improvement_plan, s.motivation_note, s.confidence_note,
      e.explanation_summary, e.key_evidence_points, e.confidence_in_insight, e.recommended_focus_area,
      c.overall_summary, c.recommended_next_steps, c.llm_provider AS llm_provider_used, m.student_name, m.grade, 'cached' AS mode
      FROM summaries s JOIN explained e ON s.student_id = e.student_id AND s.subject = e.subject
      JOIN consolidated c ON s.student_id = c.student_id JOIN meta m ON s.student_id = m.student_id""",
    "report_documents": with_(*DONE, META, EXPLAINED)
    + f"""SELECT c.student_id, {DOCUMENT} AS report FROM consolidated c JOIN meta m ON c.student_id = m.student_id
      JOIN (SELECT student_id, string_agg({PERFORMANCE_JSON}, ',' ORDER BY subject) AS performance FROM analytics GROUP BY student_id) p
        ON c.student_id = p.student_id
      JOIN (SELECT s.student_id, string_agg({TOLD_JSON}, ',' ORDER BY s.grade, s.subject) AS told FROM summaries s
            JOIN explained e ON s.student_id = e.student_id AND s.subject = e.subject GROUP BY s.student_id) t
        ON c.student_id = t.student_id""",
    "live_reports": with_(*DONE, META)
    + """SELECT c.overall_summary, c.key_strengths, c.areas_to_improve, c.recommended_next_steps, c.confidence_note, c.student_id,
      m.student_name, m.grade, 'live' AS mode, c.llm_provider AS llm_provider_used
      FROM consolidated c JOIN meta m ON c.student_id = m.student_id""",
    "numerical_performance": with_(*BASE)
    + """SELECT student_id, string_agg(concat_ws(';', subject, average_score, latest_score, trend, risk_flag), '|' ORDER BY subject)
      AS performance FROM analytics GROUP BY student_id""",
    "existence_flags": with_(ATTEMPTS, EVENT_ATTEMPTS, REQUESTS)
    + """SELECT student_id, student_id IN (SELECT student_id FROM attempts) AS in_validated_results,
      student_id IN (SELECT student_id FROM event_attempts) AS in_subject_analytics
      FROM (SELECT DISTINCT trim(requested) AS student_id FROM requests)""",
    "report_status": with_(*DONE, REQUESTS)
    + """SELECT student_id, CASE WHEN student_id IN (SELECT student_id FROM attempts WHERE grade % 3 <> 0)
        AND student_id IN (SELECT student_id FROM consolidated) THEN 'ok'
      WHEN student_id IN (SELECT student_id FROM attempts) THEN 'NOT_FOUND:True' ELSE 'NOT_FOUND:False' END AS status
      FROM (SELECT DISTINCT upper(trim(requested)) AS student_id FROM requests)""",
    "report_status_no_data": with_(REQUESTS)
    + "SELECT DISTINCT upper(trim(requested)) AS student_id, 'NO_DATA' AS status FROM requests",
    "cell_normalizer": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '"' || event_type || '"' WHEN 1 THEN replace(props, ' ', '')
      WHEN 2 THEN '[' || user_id || ']' ELSE '""' END AS cell FROM events""",
    "record_export": """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || '}'
      AS record FROM events""",
    "id_normalization": with_(REQUESTS) + "SELECT trim(requested) AS student_id, count(*) AS requests FROM requests GROUP BY trim(requested)",
    "next_steps": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'do: ' || event_type || '|then: ' || user_id
        WHEN 1 THEN event_type || '|' || user_id WHEN 2 THEN 'Read ' || event_type ELSE '' END AS steps,
      CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS step_count FROM events""",
    # dashboard and roster
    "dashboard_kpis": with_(*BASE)
    + f"""SELECT *, {score_colour('overall_average')} AS average_colour,
      CASE overall_risk WHEN 'high' THEN 'red' WHEN 'medium' THEN 'amber' ELSE 'green' END AS risk_colour,
      CASE trend_colour WHEN 'green' THEN 'Improving' WHEN 'red' THEN 'Declining' ELSE 'Stable' END AS trend_word
      FROM (SELECT student_id, {tenth('mean')} AS overall_average, overall_risk,
        CASE WHEN green >= red AND green >= amber THEN 'green' WHEN red >= amber THEN 'red' ELSE 'amber' END AS trend_colour, subject_count
        FROM (SELECT student_id, {mean('latest_score')} AS mean,
          arg_max(risk_flag, CASE risk_flag WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS overall_risk,
          count_if({COLOUR} = 'green') AS green, count_if({COLOUR} = 'red') AS red, count_if({COLOUR} = 'amber') AS amber,
          count(*) AS subject_count FROM analytics GROUP BY student_id))""",
    "subject_cards": with_(*BASE)
    + f"""SELECT student_id, grade, subject, latest_score, average_score, {score_colour('latest_score')} AS score_colour,
      {COLOUR} AS trend_colour, CASE trend WHEN 'improving' THEN '↑ Improving' WHEN 'declining' THEN '↓ Declining' ELSE '— Stable' END
      AS trend_label, least(latest_score, 100) AS progress FROM analytics""",
    "evidence_cards": with_(*FOUND)
    + """SELECT student_id, grade, subject, replace(key_evidence_points[3:], chr(10) || '- ', '|') AS evidence,
      upper(confidence_in_insight[1]) || confidence_in_insight[2:] AS confidence_label,
      CASE confidence_in_insight WHEN 'high' THEN 100 WHEN 'medium' THEN 60 ELSE 30 END AS confidence_percent,
      recommended_focus_area AS focus_areas FROM insights""",
    "chart_series": with_(*BASE)
    + """SELECT student_id, points, CASE WHEN n >= 2 THEN points || '|' || string_split(points, '|')[1] END AS radar FROM (
      SELECT student_id, count(*) AS n, string_agg(concat_ws(';', subject, latest_score, average_score), '|' ORDER BY subject, grade) AS points
      FROM analytics GROUP BY student_id)""",
    "class_roster": with_(*RANKED) + "SELECT * FROM roster",
    "class_kpis": with_(*RANKED)
    + f"""SELECT total_students, {tenth('mean')} AS class_average, at_risk, processed, subject_count, subjects FROM (
      SELECT count(*) AS total_students, {mean('CASE WHEN overall_avg > 0 THEN overall_avg END')} AS mean,
        count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS at_risk, count(*) FILTER (WHERE processed) AS processed,
        (SELECT count(DISTINCT subject) FROM analytics) AS subject_count,
        (SELECT string_agg(DISTINCT subject, ',' ORDER BY subject) FROM analytics) AS subjects FROM roster)""",
    "class_subjects": with_(*BASE) + "SELECT DISTINCT subject FROM analytics",
    "roster_search": with_(*RANKED)
    + """SELECT student_id, name, overall_avg, risk_level FROM roster
      WHERE contains(lower(student_id), 's12') OR contains(lower(name), 's12') ORDER BY student_id LIMIT 100""",
    "roster_search_counts": with_(*RANKED)
    + "SELECT count(*) FILTER (WHERE contains(lower(student_id), 's12') OR contains(lower(name), 's12')) AS visible, count(*) AS total FROM roster",
    "report_list": """SELECT CAST(doc_id AS VARCHAR) AS "Student ID", text[1:120] || '…' AS "AI Summary (preview)", source AS "Provider"
      FROM documents ORDER BY CAST(doc_id AS VARCHAR) LIMIT 50""",
    "report_list_total": "SELECT least(count(*), 50) AS shown, count(*) AS total FROM documents",
    "student_accounts": with_(USERS)
    + """SELECT full_name AS "Name", email AS "Email", student_id AS "Student ID" FROM users WHERE role = 'Student'""",
    "linked_ids": with_(USERS)
    + """SELECT u.email, CASE WHEN u.student_id <> '' THEN u.student_id WHEN c.c_acctbal < 1000 THEN 'L' || u.id ELSE '' END AS student_id
      FROM users u JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = u.id WHERE u.role = 'Student'""",
    "csv_mixed_headers": "SELECT COLUMNS(*)::VARCHAR FROM customer",
    # refresh jobs
    "full_refresh": with_(*DONE) + "SELECT * FROM consolidated",
    "keyed_refresh": with_(
        *BASE,
        "firsts AS (SELECT * REPLACE (CASE WHEN exam_type = 'mock' THEN 'M' || student_id ELSE student_id END AS student_id) FROM attempts)",
        analytics("firsts", "old"),
        "chosen AS (SELECT 'S' || c_custkey AS student_id FROM customer WHERE c_mktsegment = 'BUILDING')",
    )
    + """SELECT * FROM old WHERE student_id NOT IN (SELECT student_id FROM chosen) UNION ALL
      SELECT * FROM analytics WHERE student_id IN (SELECT student_id FROM chosen)""",
    "keyed_refresh_quarantine": with_(
        ATTEMPTS, "good AS (SELECT * FROM attempts WHERE CAST(exam_id AS BIGINT) % 7 <> 0)", analytics("good")
    )
    + "SELECT * FROM analytics",
    "intake_repeat": with_(
        NEW_RECORDS,
        """twice AS (SELECT * REPLACE (exam_id || '@first' AS exam_id) FROM records
          UNION ALL SELECT * REPLACE (exam_id || '@second' AS exam_id) FROM records)""",
        analytics("twice"),
    )
    + "SELECT * FROM analytics",
    "intake_refresh": with_(NEW_RECORDS, analytics("records")) + "SELECT * FROM analytics",
    "stream_refresh": with_(NEW_RECORDS, analytics("records")) + "SELECT * FROM analytics",
    "stream_repeats": with_(NEW_RECORDS, analytics("records")) + "SELECT * FROM analytics",
}

# The same results from tables laid out by student.
ORACLES["served_documents"] = ORACLES["report_documents"]
ORACLES["served_roster"] = ORACLES["class_roster"]

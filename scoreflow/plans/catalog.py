"""Driver queries: every operator on the driver's whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow import schemas as S
from scoreflow.functions import text as X
from scoreflow.functions.rows import grows, with_values
from scoreflow.operators import (
    consolidation, dashboard, insights, keyed, listings, metrics, narrative, reports, roster, validation,
)
from scoreflow.plans import refresh as R
from scoreflow.plans import serving
from scoreflow.plans.asking import ask_in_rounds
from scoreflow.sources import adapters as A
from scoreflow.sources import intake
from scoreflow.sources import tables as TB
from scoreflow.streaming.intake_stream import record_stream, start_intake

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
INTAKE_DAY = "2024-06-01"
# Local folders live as long as the process, since query results read them later.
LOCAL_FOLDERS: list[tempfile.TemporaryDirectory] = []


def query(build: Callable[["Data"], DataFrame]) -> Callable[["Data"], DataFrame]:
    """Register a query under its function name."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Data(spark, sf_dir))
    return build


def stored_query(build: Callable[["Data"], DataFrame]) -> Callable[["Data"], DataFrame]:
    """Register a query that reads the phase tables several times: they are stored first."""
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Stored(spark, sf_dir))
    return build


def scratch_root(spark: SparkSession) -> str:
    """New folder on the shared storage the cluster names; a local one only where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/scoreflow-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.TemporaryDirectory(prefix="scoreflow-")
    LOCAL_FOLDERS.append(folder)
    return folder.name


class Data:
    """Frames that several queries start from, built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return A.table(self.spark, self.sf_dir, name)

    @cached_property
    def store(self) -> TB.TableStore:
        return TB.TableStore(self.spark, scratch_root(self.spark), parts=int(self.spark.conf.get("spark.scoreflow.parts", "8")))

    @cached_property
    def attempts(self) -> DataFrame:
        return A.attempts_from_orders(self.spark, self.sf_dir)

    @cached_property
    def event_attempts(self) -> DataFrame:
        return A.attempts_from_events(self.spark, self.sf_dir)

    @cached_property
    def dirty(self) -> DataFrame:
        return A.dirty_from_events(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return A.users_from_customers(self.spark, self.sf_dir)

    @cached_property
    def forms(self) -> DataFrame:
        return A.forms_from_orders(self.spark, self.sf_dir)

    @cached_property
    def analytics(self) -> DataFrame:
        return metrics.subject_analytics(self.attempts)

    @cached_property
    def insights(self) -> DataFrame:
        return insights.subject_insights(self.analytics)

    @cached_property
    def summaries(self) -> DataFrame:
        prompts = narrative.subject_prompts(self.insights)
        return narrative.subject_summaries(prompts, A.subject_responses(prompts))

    @cached_property
    def gathered(self) -> DataFrame:
        return consolidation.gather_students(self.analytics, self.summaries)

    @cached_property
    def answered(self) -> tuple[DataFrame, DataFrame]:
        """Consolidated rows and failures; the scripted model needs id and grade only."""
        students = self.analytics.groupBy("student_id").agg(F.min("grade").alias("grade"))
        return narrative.consolidated_rows(students, A.student_responses(students))

    @cached_property
    def consolidated(self) -> DataFrame:
        return self.answered[0]

    @cached_property
    def roster(self) -> DataFrame:
        return roster.class_roster(self.analytics, self.attempts, self.consolidated)

    @cached_property
    def requests(self) -> DataFrame:
        """Requested ids as typed by people: every customer, in mixed case and spacing."""
        key = F.col("c_custkey")
        sid = A.student(key)
        typed = F.when(key % 3 == 0, F.concat(F.lit(" "), sid)).when(key % 3 == 1, F.lower(sid)).otherwise(sid)
        return self.table("customer").select(typed.alias("requested"))

    def run(self, run_id: str, **settings) -> R.Run:
        return R.Run(A.AS_OF, A.subject_responses, A.student_responses, run_id, **settings)


class Stored(Data):
    """The same frames with the phase tables written and read back, as a refresh does."""

    @cached_property
    def analytics(self) -> DataFrame:
        return self.store.scratch(R.ANALYTICS, metrics.subject_analytics(self.attempts))

    @cached_property
    def insights(self) -> DataFrame:
        return self.store.scratch(R.INSIGHTS, insights.subject_insights(self.analytics))

    @cached_property
    def summaries(self) -> DataFrame:
        prompts = narrative.subject_prompts(self.insights)
        told = narrative.subject_summaries(prompts, A.subject_responses(prompts))
        return self.store.scratch(R.SUMMARIES, told)


def joined(column: str, separator: str = "|"):
    return F.array_join(column, separator).alias(column)


# --- tables -------------------------------------------------------------------------


@query
def csv_mixed_headers(d: Data) -> DataFrame:
    """Customers in two sets of files whose columns stand in another order."""
    path, rows = f"{d.store.root}/mixed_csv", d.table("customer")
    TB.write_csv(rows.filter("c_custkey % 2 = 0"), f"{path}/a")
    TB.write_csv(rows.filter("c_custkey % 2 = 1").select(*reversed(rows.columns)), f"{path}/b")
    return TB.read_csv(d.spark, path)


@query
def csv_roundtrip(d: Data) -> DataFrame:
    path = f"{d.store.root}/documents_csv"
    TB.write_csv(d.table("documents"), path)
    return TB.read_csv(d.spark, path, multiline=True)


@query
def overwrite_roundtrip(d: Data) -> DataFrame:
    rest = F.col("event_id") % 50
    value = F.when(rest == 0, F.lit(float("nan"))).when(rest == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    d.store.overwrite("t", d.table("events").select("event_id", "event_type", value.alias("value")))
    return d.store.read("t")


@query
def append_history(d: Data) -> DataFrame:
    for kind in ("real", "mock", "real"):
        d.store.append("t", d.attempts.filter(F.col("exam_type") == kind), S.VALIDATED, kind)
    return d.store.read("t", S.VALIDATED)


@query
def upsert_latest(d: Data) -> DataFrame:
    old = metrics.subject_analytics(d.attempts.filter("exam_type = 'real'"))
    new = metrics.subject_analytics(d.attempts.filter("exam_type = 'mock'"))
    return keyed.upsert_rows(old, new, S.SUBJECT_KEY)


@query
def keyed_update(d: Data) -> DataFrame:
    return keyed.update_by_email(d.users, A.link_updates_from_orders(d.spark, d.sf_dir), "seq")


def _registered(d: Data) -> tuple[DataFrame, DataFrame]:
    """Accounts with an id have changed their e-mail, so only the others are known already."""
    email = F.when(F.col("student_id") == "", F.col("email")).otherwise(F.concat(F.lit("old."), "email"))
    existing = d.users.withColumn("email", email)
    return keyed.insert_if_absent(
        existing, A.registrations_from_orders(d.spark, d.sf_dir), "seq", S.USERS.names
    )


@query
def insert_if_absent(d: Data) -> DataFrame:
    return _registered(d)[0]


@query
def registration_rejects(d: Data) -> DataFrame:
    return _registered(d)[1]


@query
def aligned_users(d: Data) -> DataFrame:
    return keyed.align_columns(A.registrations_from_orders(d.spark, d.sf_dir), S.USERS.names)


@stored_query
def shared_tables(d: Data) -> DataFrame:
    loaded = reports.load_tables(
        d.attempts, d.analytics, d.insights, d.summaries, d.consolidated
    )
    parts = [
        df.groupBy("student_id").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "*")
        for n, df in loaded.items()
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked


# --- intake -------------------------------------------------------------------------


@query
def intake_rows(d: Data) -> DataFrame:
    return intake.intake_attempts(intake.check_forms(d.forms)[0], INTAKE_DAY)


@query
def score_list_parse(d: Data) -> DataFrame:
    per_subject = d.forms.select("form_id", F.posexplode("subjects").alias("place", "s"))
    parsed = with_values(per_subject, {"scores": intake.parse_scores(F.col("s.scores_text"))})
    text = F.array_join(F.transform("scores", lambda n: n.cast("string")), ",")
    return parsed.select("form_id", "place", text.alias("scores"), F.size("scores").alias("score_count"))


@query
def intake_errors(d: Data) -> DataFrame:
    return intake.check_forms(d.forms)[1].select("form_id", joined("errors"))


# --- validation ---------------------------------------------------------------------


@query
def coerced_rows(d: Data) -> DataFrame:
    day = F.to_date("exam_date").alias("exam_date")
    return validation.coerce_types(d.dirty).select("row_index", "grade", "attempt_number", "score", "max_score", day)


@query
def row_errors(d: Data) -> DataFrame:
    return validation.error_report(validation.classify(d.dirty, A.AS_OF))


@query
def first_errors(d: Data) -> DataFrame:
    return row_errors(d).orderBy("row_index").limit(5)


@query
def error_histogram(d: Data) -> DataFrame:
    return row_errors(d).groupBy("error").agg(F.count(F.lit(1)).alias("row_count"))


@query
def validated_rows(d: Data) -> DataFrame:
    return validation.accepted(validation.classify(d.dirty, A.AS_OF))


@query
def duplicate_attempts(d: Data) -> DataFrame:
    return validation.duplicate_keys(validation.accepted(validation.classify(d.dirty, A.AS_OF)))


@query
def quarantine_report(d: Data) -> DataFrame:
    return validation.split_rows(d.dirty, A.AS_OF)[1]


@query
def quarantine_rows(d: Data) -> DataFrame:
    return validation.canonical_order(validation.split_rows(d.dirty, A.AS_OF)[0])


@query
def gate_report(d: Data) -> DataFrame:
    return validation.gate(d.dirty, A.AS_OF)


@query
def observed_rejects(d: Data) -> DataFrame:
    """Rows and rejects by kind, taken while the classified rows are written."""
    rows, seen = validation.watched(validation.classify(d.dirty, A.AS_OF))
    d.store.scratch("classified", rows)
    kinds = ["rows", "rejected", *validation.MESSAGES]
    return d.spark.createDataFrame([(k, seen.get[k]) for k in kinds], "kind string, n bigint")


@query
def chosen_students(d: Data) -> DataFrame:
    busy = d.table("customer").filter("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit(" "), A.student(F.col("c_custkey"))).alias("student_id")
    )
    return validation.of_students(d.attempts, busy)


@query
def usable_attempts(d: Data) -> DataFrame:
    rows = validation.usable_attempts(d.dirty)
    return rows.select("row_index", "student_id", "grade", "subject", "score", "exam_date", "attempt_number")


# --- metrics and insights -----------------------------------------------------------


@query
def subject_analytics(d: Data) -> DataFrame:
    return d.analytics


@query
def subject_analytics_events(d: Data) -> DataFrame:
    return metrics.subject_analytics(d.event_attempts)


@query
def subject_analytics_decimals(d: Data) -> DataFrame:
    """Scores with two decimals in groups of many attempts."""
    return metrics.subject_analytics(A.decimal_attempts_from_orders(d.spark, d.sf_dir))


@query
def merged_analytics(d: Data) -> DataFrame:
    """States of three disjoint sets of attempts, merged one after the other, then the metrics."""
    share = F.pmod(F.xxhash64("exam_id"), F.lit(3))
    states = [metrics.group_states(d.attempts.filter(share == i)) for i in range(3)]
    return metrics.analytics_of_states(metrics.merge_states([metrics.merge_states(states[:2]), states[2]]))


@query
def subject_analytics_wide(d: Data) -> DataFrame:
    """Every fifth order has a score times 2**50, another fifth times 2**70."""
    rest = F.col("exam_id").cast("bigint") % 5
    factor = F.when(rest == 0, float(1 << 50)).when(rest == 1, float(1 << 70)).otherwise(1.0)
    return metrics.subject_analytics(d.attempts.withColumn("score", F.col("score") * factor))


@query
def recent_average_k3(d: Data) -> DataFrame:
    return metrics.recent_average(d.event_attempts, 3)


@query
def mock_real_gap(d: Data) -> DataFrame:
    return metrics.mock_real_gap(d.attempts)


@query
def phase_counters(d: Data) -> DataFrame:
    return metrics.phase_counters(d.analytics)


@query
def subject_insights(d: Data) -> DataFrame:
    return d.insights


@query
def evidence_text(d: Data) -> DataFrame:
    found = insights.subject_insights(metrics.subject_analytics(d.event_attempts))
    return found.select(*S.GROUP_KEY, "key_evidence_points")


# --- narrative ----------------------------------------------------------------------


@query
def prompt_text(d: Data) -> DataFrame:
    return narrative.subject_prompts(d.insights)


@query
def prompt_first_rows(d: Data) -> DataFrame:
    return narrative.subject_prompts(d.insights, 200)


@stored_query
def student_prompts(d: Data) -> DataFrame:
    return narrative.student_prompts(
        d.gathered, consolidation.ANALYTICS_FIELDS, consolidation.SUMMARY_COLUMNS
    )


@query
def json_recovery(d: Data) -> DataFrame:
    rest = F.col("event_id") % 6
    props = F.col("props")
    told = (
        F.when(rest == 0, props)
        .when(rest == 1, F.concat(F.lit("Sure, here: "), props, F.lit(" as asked.")))
        .when(rest == 2, F.lit("no json at all"))
        .when(rest == 3, F.concat(F.lit("{broken "), props))
        .when(rest == 4, F.lit("{}"))
        .otherwise(F.concat(F.lit('x {"k": "'), F.col("event_type"), F.lit('"} y')))
    )
    parsed = with_values(d.table("events").select("event_id", told.alias("told")), {"parsed": X.recover_json(F.col("told"))})
    value = F.col("parsed")
    return parsed.select(
        "event_id",
        X.is_filled_object(value).alias("usable"),
        F.try_variant_get(value, "$.k", "string").alias("k"),
    )


@query
def attempt_selection(d: Data) -> DataFrame:
    """Orders as model tries: their key says which try it is and whether it can be parsed."""
    order = F.col("o_orderkey")
    told = F.format_string('{"performance_summary": "order %s"}', order.cast("string"))
    response = F.when(order % 3 == 0, "garbage").otherwise(F.concat(F.lit("ok "), told))
    tries = d.table("orders").select(
        A.student(F.col("o_custkey")).alias("student_id"),
        (1 + F.col("o_custkey") % 12).cast("int").alias("grade"),
        F.col("o_orderpriority").alias("subject"),
        (1 + order % 5).cast("int").alias("attempt"),
        response.alias("response"),
    )
    return narrative.first_usable(tries, S.GROUP_KEY, S.SUMMARY_FIELDS)


@query
def subject_summaries(d: Data) -> DataFrame:
    return d.summaries


@stored_query
def retry_rounds(d: Data) -> DataFrame:
    """Subject prompts asked in rounds: how often each was asked, and the answer that ended it."""
    prompts = narrative.subject_prompts(d.insights)
    told, _ = ask_in_rounds(d.store, "rounds", prompts, A.subject_response, S.GROUP_KEY, S.SUMMARY_FIELDS)
    asked = told.groupBy(S.GROUP_KEY).agg(F.count("*").alias("times_asked"))
    return narrative.subject_summaries(prompts, told).join(asked, S.GROUP_KEY)


@query
def nested_to_text(d: Data) -> DataFrame:
    """Values of several JSON shapes built from the event's fields."""
    told = F.format_string(
        '{"n": %s, "s": "%s", "l": [%s, "a"], "o": {"p": %s}, "t": true, "z": null}',
        F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), F.col("props"),
    )
    value = F.try_parse_json(told)
    fields = [X.field_text(value, k).alias(f"f_{k}") for k in ("n", "s", "l", "o", "t", "z")]
    return d.table("events").select("event_id", *fields, X.field_text(value, "absent", "low").alias("f_absent"))


@stored_query
def consolidated_rows(d: Data) -> DataFrame:
    asked = student_prompts(d)
    return narrative.consolidated_rows(asked, A.student_responses(asked))[0]


@query
def consolidation_failures(d: Data) -> DataFrame:
    return d.answered[1]


# --- consolidation ------------------------------------------------------------------


@query
def ready_students(d: Data) -> DataFrame:
    return consolidation.ready_students(d.analytics, metrics.subject_analytics(d.event_attempts))


@stored_query
def student_gather(d: Data) -> DataFrame:
    averages = F.transform("analytics", lambda r: r["average_score"].cast("string"))
    plans = F.transform("summaries", lambda r: F.concat(r["subject"], F.lit(":"), r["improvement_plan"]))
    return d.gathered.select(
        "student_id", "grade", F.array_join(averages, "|").alias("averages"), F.array_join(plans, "|").alias("plans")
    )


def _history(d: Data) -> DataFrame:
    """Each attempt as a past report of its student, stamped by its order."""
    stamp = F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(exam_id as bigint))")
    return d.attempts.select(
        "student_id", "grade",
        F.concat(F.lit("Report "), F.col("exam_id")).alias("overall_summary"),
        F.col("subject").alias("key_strengths"),
        F.lit("").alias("areas_to_improve"),
        F.lit("").alias("recommended_next_steps"),
        F.lit("low").alias("confidence_note"),
        F.lit("ollama").alias("llm_provider"),
        stamp.alias("run_ts"),
    )


@query
def latest_from_history(d: Data) -> DataFrame:
    return consolidation.latest_from_history(_history(d))


@stored_query
def explained_summaries(d: Data) -> DataFrame:
    """Insights of every third grade name another subject, so their summaries lack an explanation."""
    subject = F.when(F.col("grade") % 3 == 0, F.concat("subject", F.lit(" (old)"))).otherwise(F.col("subject"))
    return consolidation.explained_summaries(d.summaries, d.insights.withColumn("subject", subject))


@query
def processed_flags(d: Data) -> DataFrame:
    return consolidation.processed_flags(d.attempts.select("student_id", "exam_id"), d.consolidated)


@query
def first_names(d: Data) -> DataFrame:
    return consolidation.first_names(d.attempts)


# --- reports ------------------------------------------------------------------------


@stored_query
def id_match_modes(d: Data) -> DataFrame:
    parts = [
        reports.rows_of_requests(d.analytics, d.requests, mode).select(
            F.lit(mode).alias("mode"), "requested", "student_id", "subject"
        )
        for mode in ("exact", "trim", "ci")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@stored_query
def table_lookups(d: Data) -> DataFrame:
    """Per student: the first consolidated row and how many rows the other tables hold."""
    counts = [
        t.groupBy("student_id").agg(F.count(F.lit(1)).alias(n))
        for n, t in (("summaries", d.summaries), ("insights", d.insights), ("analytics", d.analytics))
    ]
    first = reports.first_consolidated(d.consolidated).select("student_id", "overall_summary")
    return counts[0].join(counts[1], "student_id").join(counts[2], "student_id").join(first, "student_id", "left")


@query
def student_metadata(d: Data) -> DataFrame:
    return reports.student_metadata(d.attempts)


@stored_query
def report_rows(d: Data) -> DataFrame:
    return reports.report_rows(d.attempts, d.analytics, d.insights, d.summaries, d.consolidated)


@stored_query
def report_documents(d: Data) -> DataFrame:
    return reports.report_documents(d.attempts, d.analytics, d.insights, d.summaries, d.consolidated)


def _served(d: Data) -> serving.Served:
    """The report tables of the scratch store, laid out by student."""
    tables = d.attempts, d.analytics, d.insights, d.summaries, d.consolidated
    buckets = serving.buckets_for(d.analytics.count(), d.store.parts)
    return serving.publish(d.spark, f"{scratch_root(d.spark)}/served", buckets, *tables)


@stored_query
def served_documents(d: Data) -> DataFrame:
    return _served(d).report_documents()


@query
def live_reports(d: Data) -> DataFrame:
    return reports.live_reports(d.consolidated, d.attempts)


@query
def numerical_performance(d: Data) -> DataFrame:
    rows = F.transform(
        "numerical_performance",
        lambda r: F.concat_ws(
            ";", r["subject"], r["average_score"].cast("string"), r["latest_score"].cast("string"), r["trend"], r["risk_flag"]
        ),
    )
    return reports.numerical_performance(d.analytics).select("student_id", F.array_join(rows, "|").alias("performance"))


@query
def existence_flags(d: Data) -> DataFrame:
    ids = d.requests.select(F.col("requested").alias("student_id"))
    return reports.existence_flags(ids, d.attempts, metrics.subject_analytics(d.event_attempts))


@stored_query
def report_status(d: Data) -> DataFrame:
    ids = d.requests.select(F.col("requested").alias("student_id"))
    moved = F.when(F.col("grade") % 3 == 0, F.concat(F.lit("X"), "student_id")).otherwise(F.col("student_id"))
    return reports.report_status(ids, d.attempts, d.analytics.withColumn("student_id", moved), d.summaries, d.consolidated)


@stored_query
def report_status_no_data(d: Data) -> DataFrame:
    """The same while no summary has been written: all of them lack their text."""
    ids = d.requests.select(F.col("requested").alias("student_id"))
    none = d.summaries.filter(F.col("performance_summary").isNull())
    return reports.report_status(ids, d.attempts, d.analytics, none, d.consolidated)


@query
def cell_normalizer(d: Data) -> DataFrame:
    rest = F.col("event_id") % 4
    cell = (
        F.when(rest == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
        .when(rest == 1, F.col("props"))
        .when(rest == 2, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]")))
    )
    return d.table("events").select("event_id", F.to_json(X.normalize_cell(cell)).alias("cell"))


@query
def record_export(d: Data) -> DataFrame:
    rows = d.table("events").select("event_id", "event_type", "props")
    return reports.record_export(rows, ["props"])


@query
def id_normalization(d: Data) -> DataFrame:
    ids = d.requests.select(X.clean_id(F.concat(F.lit("\t"), "requested", F.lit("\n"))).alias("student_id"))
    return ids.groupBy("student_id").agg(F.count(F.lit(1)).alias("requests"))


@query
def next_steps(d: Data) -> DataFrame:
    rest = F.col("event_id") % 6
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    told = (
        F.when(rest == 0, F.format_string('{"do": "%s", "then": "%s"}', kind, user))
        .when(rest == 1, F.format_string('["%s", "%s"]', kind, user))
        .when(rest == 2, F.concat(F.lit("Read "), kind))
        .when(rest == 3, F.lit(""))
        .when(rest == 4, user)
    )
    rows = with_values(d.table("events").select("event_id", told.alias("told")), {"steps": X.next_steps(F.col("told"))})
    return rows.select("event_id", joined("steps"), F.size("steps").alias("step_count"))


# --- dashboard and roster -----------------------------------------------------------


@query
def dashboard_kpis(d: Data) -> DataFrame:
    return dashboard.dashboard(d.analytics)


@query
def subject_cards(d: Data) -> DataFrame:
    return dashboard.subject_cards(d.analytics)


@query
def evidence_cards(d: Data) -> DataFrame:
    return dashboard.evidence_cards(d.insights).withColumns(
        {c: F.array_join(c, "|") for c in ("evidence", "focus_areas")}
    )


@query
def chart_series(d: Data) -> DataFrame:
    def text(points: str):
        one = lambda p: F.concat_ws(";", p["subject"], p["latest"].cast("string"), p["average"].cast("string"))
        return F.array_join(F.transform(points, one), "|").alias(points)

    return dashboard.chart_series(d.analytics).select("student_id", text("points"), text("radar"))


@stored_query
def class_roster(d: Data) -> DataFrame:
    return d.roster.withColumn("subjects", F.array_join("subjects", ","))


@stored_query
def served_roster(d: Data) -> DataFrame:
    return _served(d).class_roster().withColumn("subjects", F.array_join("subjects", ","))


@stored_query
def class_kpis(d: Data) -> DataFrame:
    return roster.class_indicators(d.roster, d.analytics).withColumn("subjects", F.array_join("subjects", ","))


@query
def class_subjects(d: Data) -> DataFrame:
    return roster.class_subjects(d.analytics)


@stored_query
def roster_search(d: Data) -> DataFrame:
    return roster.top_rows(roster.search(d.roster, " S12 ")).select("student_id", "name", "overall_avg", "risk_level")


@stored_query
def roster_search_counts(d: Data) -> DataFrame:
    return roster.search_counts(d.roster, "s12")


@query
def report_list(d: Data) -> DataFrame:
    return listings.report_list(_stored_reports(d))


@query
def report_list_total(d: Data) -> DataFrame:
    return listings.report_total(_stored_reports(d))


def _stored_reports(d: Data) -> DataFrame:
    return d.table("documents").select(
        F.col("doc_id").cast("string").alias("student_id"),
        F.col("text").alias("overall_summary"),
        F.col("source").alias("llm_provider"),
    )


@query
def student_accounts(d: Data) -> DataFrame:
    return listings.student_accounts(d.users)


@query
def linked_ids(d: Data) -> DataFrame:
    key = F.col("c_custkey")
    mail = F.when(F.col("c_acctbal") < 1000, A.school_mail(key)).otherwise(F.concat(F.lit("old."), A.school_mail(key)))
    lookup = d.table("customer").select(
        mail.alias("Email"), F.concat(F.lit("L"), key.cast("string")).alias("Student ID")
    )
    return listings.linked_ids(d.users, lookup)


# --- refresh jobs -------------------------------------------------------------------


@query
def full_refresh(d: Data) -> DataFrame:
    R.full_refresh(d.store, TB.as_text(d.attempts), d.run("all"))
    return d.store.read(R.LATEST, S.CONSOLIDATED)


def _chosen_refresh(d: Data, first: DataFrame, then: DataFrame, **settings) -> DataFrame:
    """A full refresh, then one of the building-segment students.

    Customers without orders are not asked for: an unknown id raises.
    """
    R.full_refresh(d.store, TB.as_text(first), d.run("all", **settings))
    segment = d.table("customer").select(
        A.student(F.col("c_custkey")).alias("student_id"), (F.col("c_mktsegment") == "BUILDING").alias("wanted")
    )
    ids = d.attempts.join(grows(segment), "student_id").filter("wanted").select("student_id").distinct()
    R.keyed_refresh(d.store, TB.as_text(then), ids, d.run("some", **settings))
    return d.store.read(R.ANALYTICS, S.ANALYTICS)


@query
def keyed_refresh(d: Data) -> DataFrame:
    """First with real exams, for everybody; then all exams of the building-segment students."""
    mocks_first = F.when(F.col("exam_type") == "mock", F.concat(F.lit("M"), "student_id")).otherwise(F.col("student_id"))
    return _chosen_refresh(d, d.attempts.withColumn("student_id", mocks_first), d.attempts)


@query
def keyed_refresh_quarantine(d: Data) -> DataFrame:
    """Every seventh exam has a score above its maximum and goes to the rejects."""
    score = F.when(F.col("exam_id").cast("bigint") % 7 == 0, 101.0).otherwise(F.col("score"))
    bad = d.attempts.withColumn("score", score)
    return _chosen_refresh(d, bad, bad, quarantine=True)


def _event_records(d: Data) -> DataFrame:
    """Every event as the intake record of a new student."""
    value, event = F.col("value"), F.col("event_id")
    scores = F.array(*[F.least(F.floor(value / n), F.lit(100)).cast("double") for n in (5, 7)])
    subject = F.struct(F.col("event_type").alias("name"), scores.alias("scores"), F.lit(100.0).alias("max_score"))
    return d.table("events").select(
        F.concat(F.lit("E"), event.cast("string")).alias("student_id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("name"),
        (1 + F.col("user_id") % 12).cast("int").alias("grade"),
        F.array(subject).alias("subjects"),
    )


@query
def intake_refresh(d: Data) -> DataFrame:
    R.intake_refresh(d.store, _event_records(d), INTAKE_DAY, d.run("day"))
    return d.store.read(R.ANALYTICS, S.ANALYTICS)


@query
def intake_repeat(d: Data) -> DataFrame:
    """A second series of scores for every student and subject, and one repeated run."""
    for label in ("first", "second", "second"):
        R.intake_refresh(d.store, _event_records(d), INTAKE_DAY, d.run(label))
    return d.store.read(R.ANALYTICS, S.ANALYTICS)


@query
def stream_refresh(d: Data) -> DataFrame:
    folder = f"{d.store.root}/incoming"
    _event_records(d).write.json(folder)
    stream = start_intake(
        d.store, record_stream(d.spark, folder), f"{d.store.root}/stream", d.run("s"), INTAKE_DAY
    )
    stream.awaitTermination()
    return d.store.read(R.ANALYTICS, S.ANALYTICS)


@query
def stream_repeats(d: Data) -> DataFrame:
    """Every record is sent twice, the second time after a restart of the stream, and counts once."""
    folder = f"{d.store.root}/incoming"
    for _ in range(2):
        _event_records(d).write.mode("append").json(folder)
        stream = start_intake(
            d.store, record_stream(d.spark, folder), f"{d.store.root}/stream", d.run("s"), INTAKE_DAY, repeats_within="1 day"
        )
        stream.awaitTermination()
    return d.store.read(R.ANALYTICS, S.ANALYTICS)

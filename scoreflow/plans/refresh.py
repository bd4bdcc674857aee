"""Refresh jobs: all phases for everybody, for chosen students, or for new records.

Every phase ends in a table on shared storage, and the next phase starts from it. That
cuts the lineage, so a lost executor costs at most one phase, and texts returned by a
model are stored before they are used, so no retry asks the model again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreflow import schemas as S
from scoreflow.functions.rows import grows
from scoreflow.functions.text import clean_id
from scoreflow.operators import consolidation, insights, metrics, narrative, validation
from scoreflow.plans.asking import ask_in_rounds
from scoreflow.sources.intake import intake_attempts, require_rows
from scoreflow.sources.tables import TableStore, as_text, conform

Model = Callable[[DataFrame], DataFrame]

RAW = "raw_student_scores"
VALIDATED = "validated_results"
REJECTED = "rejected_rows"
STATES = "attempt_states"
ANALYTICS = "subject_analytics"
INSIGHTS = "subject_insights"
SUMMARIES = "subject_summaries"
LATEST = "student_consolidated_latest"
HISTORY = "student_consolidated_history"
FAILURES = "consolidation_failures"
MALFORMED = "malformed_records"


@dataclass(frozen=True)
class Run:
    """Settings of one refresh.

    The models turn prompt rows into response rows: (key, attempt, response). With ``rounds`` they get the
    number of the attempt with each prompt and answer that attempt only; what has no usable answer is asked again.
    """

    as_of: dt.datetime | dt.date | str
    subject_model: Model
    student_model: Model
    run_id: str
    provider: str = narrative.DEFAULT_PROVIDER
    row_limit: int | None = None
    quarantine: bool = False
    strict_consolidation: bool = False
    rounds: bool = False
    window: int = 2
    thresholds: S.Thresholds = S.DEFAULTS

    def work(self, name: str) -> str:
        """Name of a work table of this run; runs do not share them."""
        return f"work-{self.run_id}/{name}"


def _require(store: TableStore, name: str, schema, message: str) -> DataFrame:
    return require_rows(store.read(name, schema), message)


def _reports(df: DataFrame) -> DataFrame:
    """Rejected rows in the columns of their table."""
    index = F.col("row_index").cast("bigint") if "row_index" in df.columns else F.lit(None).cast("bigint")
    return df.select(index.alias("row_index"), "student_id", "error")


def _file_rejects(store: TableStore, rejected: DataFrame, run: Run, ids: DataFrame | None) -> DataFrame:
    """Store the rejects of this run: as the whole table, or in place of those of the students in ``ids``."""
    if ids is None:
        store.overwrite(REJECTED, _reports(rejected), ["student_id"])
        return store.read(REJECTED, S.REJECTS)
    own = store.scratch(run.work("rejected"), _reports(rejected))
    store.upsert(REJECTED, own, S.REJECTS, ["student_id"], ["student_id"], gone=ids)
    return own


def _classified(store: TableStore, raw: DataFrame, run: Run, empty: Exception | None = None) -> tuple[DataFrame, dict]:
    """Stored classified rows, parsed once, and the counts that came with the write. ``empty`` is raised where there is no row."""
    rows, seen = validation.watched(validation.classify(raw, run.as_of))
    stored = store.scratch(run.work("classified"), rows)
    if not seen.get["rows"]:
        raise empty or RuntimeError(f"{RAW} is empty")
    return stored, seen.get


def _valid(store: TableStore, classified: DataFrame, counts: dict, run: Run, ids: DataFrame | None) -> DataFrame:
    """The valid rows. Strict: raises unless every row is valid.

    Quarantine: all other rows go to the rejects, repeated keys included. Without rejects, and without
    earlier ones to replace, nothing is written.
    """
    if run.quarantine:
        good, rejected = validation.split_classified(classified)
        _file_rejects(store, rejected, run, ids)
        return good
    if counts["rejected"] or store.exists(REJECTED):
        report = _file_rejects(store, validation.error_report(classified), run, ids)
        if counts["rejected"]:
            validation.raise_rejected(report, REJECTED)
    return validation.accepted(classified)


def _staged_valid(
    store: TableStore, classified: DataFrame, counts: dict, run: Run, ids: DataFrame | None
) -> tuple[DataFrame, str]:
    """Valid rows as a version of their table that is not shown yet, and its label.

    They are written once: staged, checked for repeated keys, read by the later steps, then shown.
    """
    version = store.stage(VALIDATED, _valid(store, classified, counts, run, ids), S.ATTEMPT_KEY)
    good = store.read_version(VALIDATED, version, S.VALIDATED)
    try:
        if not run.quarantine:
            validation.raise_if_repeated(good)
    except ValueError:
        store.discard(VALIDATED, version)
        raise
    return good, version


def _consolidate(
    store: TableStore, run: Run, analytics: DataFrame, summaries: DataFrame, everybody: bool, parts: list[int] | None = None
) -> None:
    gathered = consolidation.gather_students(analytics, summaries)
    prompts = narrative.student_prompts(gathered, consolidation.ANALYTICS_FIELDS, consolidation.SUMMARY_COLUMNS)
    asked = store.scratch(run.work("student_prompts"), prompts)
    told = _told(store, run, "student", asked, run.student_model, ["student_id"], S.CONSOLIDATED_FIELDS)
    done, _ = narrative.consolidated_rows(asked, told, run.provider)
    stamped = done.withColumn("run_ts", F.lit(str(run.as_of)).cast("timestamp"))
    store.append(HISTORY, stamped, S.HISTORY, run.run_id)
    latest = store.read_batch(HISTORY, run.run_id, S.HISTORY).drop("run_ts")
    store.upsert(LATEST, latest, S.CONSOLIDATED, ["student_id"], ["student_id"], parts=parts)
    failed = store.scratch(run.work("failures"), narrative.unanswered(asked, latest))
    if everybody:
        store.overwrite(FAILURES, failed, ["student_id"])
    else:
        store.upsert(FAILURES, failed, S.FAILED, ["student_id"], ["student_id"], gone=asked, parts=parts)
    if run.strict_consolidation and not failed.isEmpty():
        raise RuntimeError("LLM failed to produce valid JSON")


def _told(
    store: TableStore, run: Run, name: str, asked: DataFrame, model: Model, keys: list[str], fields: list[str]
) -> DataFrame:
    """Stored responses of the model to stored prompts."""
    if run.rounds:
        return ask_in_rounds(store, run.work(name), asked, model, keys, fields)[0]
    return store.scratch(run.work(f"{name}_responses"), model(asked))


def _answered(store: TableStore, prompts: DataFrame, run: Run) -> DataFrame:
    asked = store.scratch(run.work("subject_prompts"), prompts)
    told = _told(store, run, "subject", asked, run.subject_model, S.GROUP_KEY, S.SUMMARY_FIELDS)
    return narrative.subject_summaries(asked, told, run.provider)


def full_refresh(store: TableStore, raw: DataFrame, run: Run) -> dict:
    """All phases over the whole raw table. Returns the counts of the validation (see ``validation.watched``).

    Every output is replaced but the history, which grows, and the latest reports, which are upserted:
    a student who is no longer in the raw table keeps the last report.
    """
    try:
        classified, counts = _classified(store, raw, run)
        store.publish(VALIDATED, _staged_valid(store, classified, counts, run, None)[1])
        validated = _require(store, VALIDATED, S.VALIDATED, f"{RAW} has no valid row")
        store.overwrite(STATES, metrics.group_states(validated, run.window), S.GROUP_KEY)
        states = store.read(STATES, S.STATES)
        store.overwrite(ANALYTICS, metrics.analytics_of_states(states, run.window, run.thresholds), S.GROUP_KEY)
        analytics = _require(store, ANALYTICS, S.ANALYTICS, "Phase 1 produced no analytics records")

        store.overwrite(INSIGHTS, insights.subject_insights(analytics, run.thresholds), S.GROUP_KEY)
        found = _require(store, INSIGHTS, S.INSIGHTS, "Phase 2 failed: no insights generated")

        prompts = narrative.subject_prompts(found, run.row_limit)
        store.overwrite(SUMMARIES, _answered(store, prompts, run), S.GROUP_KEY)
        summaries = _require(store, SUMMARIES, S.SUMMARIES, "Phase 3 produced no summaries")

        _consolidate(store, run, analytics, summaries, everybody=True)
        return counts
    finally:
        store.drop(run.work("")[:-1])


def keyed_refresh(store: TableStore, raw: DataFrame, ids: DataFrame, run: Run) -> None:
    """All phases for the given students; the rows of all others stay as they are.

    Only the table parts of these students are read and rewritten. In quarantine mode the rejects
    of these students replace those of their runs before.
    """
    try:
        _keyed(store, raw, ids, run)
    finally:
        store.drop(run.work("")[:-1])


def _keyed(store: TableStore, raw: DataFrame, ids: DataFrame, run: Run, filed: bool = False) -> None:
    """``filed``: the raw table is known to hold rows of all the students."""
    ids = store.scratch(run.work("ids"), consolidation.ids_of(ids))
    parts = store.parts_of(ids)
    chosen = validation.of_students(raw, ids)
    if not filed:
        unknown = ids.join(grows(consolidation.ids_of(chosen)), "student_id", "left_anti")
        some = unknown.limit(5).collect()
        if some:
            names = [r.student_id for r in some]
            raise ValueError(f"No raw data found for student {names} in {RAW}; {unknown.count()} students in all")
    classified, counts = _classified(store, chosen, run)
    fresh, version = _staged_valid(store, classified, counts, run, ids)
    store.admit(VALIDATED, version, S.VALIDATED, S.ATTEMPT_KEY, S.ATTEMPT_KEY, parts=parts)
    # Without rejects all students have valid rows.
    good = store.scratch(run.work("good_ids"), consolidation.ids_of(fresh)) if run.quarantine else ids
    if good.isEmpty():
        return
    rows = validation.of_students(store.read_parts(VALIDATED, S.VALIDATED, parts), good)
    version = store.stage(STATES, metrics.group_states(rows, run.window), S.GROUP_KEY)
    _later_phases(store, run, version, good, parts, S.SUBJECT_KEY)


def _later_phases(
    store: TableStore, run: Run, staged: str, students: DataFrame, parts: list[int], keys: list[str]
) -> None:
    """States, analytics, insights, summaries of the groups in the staged version of the states, then the reports of
    their students.

    Every delta is written once, as a version of its table. The states are split by student, and what follows from
    them row by row stays split as they are.
    """

    def current(name: str, schema, delta: DataFrame) -> DataFrame:
        rows = store.read_parts(name, schema, parts)
        if rows.count() == delta.count():
            # The parts hold the rows of the delta and no others.
            return rows.withColumn("student_id", clean_id(F.col("student_id")))
        return validation.of_students(rows, students)

    def put(name: str, df: DataFrame, schema, placed: bool) -> DataFrame:
        version = store.stage(name, conform(df, schema), S.GROUP_KEY, placed=placed)
        delta = store.read_version(name, version, schema)
        try:
            require_rows(delta, f"no rows for {name}")
        except ValueError:
            store.discard(name, version)
            raise
        store.admit(name, version, schema, keys, S.GROUP_KEY, parts=parts)
        return delta

    states = store.read_version(STATES, staged, S.STATES)
    store.admit(STATES, staged, S.STATES, keys, S.GROUP_KEY, parts=parts)
    analytics = put(ANALYTICS, metrics.analytics_of_states(states, run.window, run.thresholds), S.ANALYTICS, True)
    found = put(INSIGHTS, insights.subject_insights(analytics, run.thresholds), S.INSIGHTS, True)
    told = put(SUMMARIES, _answered(store, narrative.subject_prompts(found), run), S.SUMMARIES, False)
    everything = current(ANALYTICS, S.ANALYTICS, analytics), current(SUMMARIES, S.SUMMARIES, told)
    _consolidate(store, run, *everything, everybody=False, parts=parts)


def _touched(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of the groups in ``groups`` (null keys compare equal)."""
    wanted = groups.select(S.GROUP_KEY)
    condition = [rows[k].eqNullSafe(wanted[k]) for k in S.GROUP_KEY]
    return rows.join(grows(wanted), condition[0] & condition[1] & condition[2], "left_semi")


def _known(store: TableStore, good: DataFrame, parts: list[int]) -> tuple[bool, int]:
    """Whether an attempt of the batch is stored already, or attempts are stored without their states; and the number of
    the mark of the table in which that was looked up."""
    seen = store.number(VALIDATED)
    if not store.exists(VALIDATED):
        return False, seen
    if not store.exists(STATES):
        return True, seen
    old = store.read_parts(VALIDATED, S.VALIDATED, parts)
    same = [old[k].eqNullSafe(good[k]) for k in S.ATTEMPT_KEY]
    return not good.join(grows(old), same[0] & same[1] & same[2], "left_semi").isEmpty(), seen


def intake_refresh(store: TableStore, records: DataFrame, exam_date, run: Run) -> None:
    """Add nested intake records to the raw table, then refresh their students.

    The batch is validated before anything is filed: strict mode raises and files nothing, quarantine
    mode files the good rows and stores the others as rejects. Subject and run id are part of the exam
    id, so a second series of a student and subject stands beside the first, and repeating a run
    replaces its rows.

    The rows are parsed and validated once. New attempts are merged into the stored states of their groups, so
    the students' earlier attempts are not read for their metrics, and only the groups concerned go through the
    later phases. A repeated run, whose attempts are stored already, refreshes its students from all of their rows.
    """
    rows = intake_attempts(records, exam_date)
    exam = F.concat_ws("@", "exam_id", "subject", F.lit(run.run_id))
    rows = rows.withColumn("exam_id", exam).select(S.ATTEMPT_COLUMNS)
    checking = replace(run, run_id=f"{run.run_id}-intake")
    try:
        nothing = ValueError("No exam records to write: no subject has scores")
        classified, counts = _classified(store, rows, checking, nothing)
        ids = store.scratch(checking.work("ids"), consolidation.ids_of(classified))
        parts = store.parts_of(ids)
        good, version = _staged_valid(store, classified, counts, checking, ids)
        store.append(RAW, as_text(good).select(S.ATTEMPT_COLUMNS), S.RAW, run.run_id, S.ATTEMPT_KEY, placed=True)
        if good.isEmpty():
            store.discard(VALIDATED, version)
            return
        known, seen = _known(store, good, parts)
        if known:
            store.discard(VALIDATED, version)
            _again(store, ids, parts, checking, run)
            return
        store.admit(VALIDATED, version, S.VALIDATED, S.ATTEMPT_KEY, S.ATTEMPT_KEY, parts=parts, unmet=seen)
        # Without rejects all students of the batch have valid rows.
        students = store.scratch(checking.work("students"), consolidation.ids_of(good)) if run.quarantine else ids
        states = metrics.group_states(good, run.window)
        if store.exists(STATES):
            added = store.scratch(checking.work("added"), states)
            before = _touched(store.read_parts(STATES, S.STATES, parts), added)
            states = metrics.merge_states([before, added], run.window)
        _later_phases(store, run, store.stage(STATES, conform(states, S.STATES), S.GROUP_KEY), students, parts, S.GROUP_KEY)
    finally:
        store.drop(checking.work("")[:-1])
        store.drop(run.work("")[:-1])


def _again(store: TableStore, ids: DataFrame, parts: list[int], checking: Run, run: Run) -> None:
    """Refresh the students of a repeated batch from all rows filed for them; its rejects stay."""
    kept = store.exists(REJECTED)
    rejected = store.scratch(checking.work("kept"), store.read_parts(REJECTED, S.REJECTS, parts)) if kept else None
    added = store.read_batch(RAW, run.run_id, S.RAW)
    _keyed(store, store.read_parts(RAW, S.RAW, store.parts_of(added)), added, run, filed=True)
    if not kept:
        return
    # The refresh has judged filed rows only: the rejects of this batch stay beside its own.
    own = validation.of_students(rejected, ids)
    later = validation.of_students(store.read_parts(REJECTED, S.REJECTS, parts), ids)
    both = store.scratch(checking.work("both"), own.unionByName(later).distinct())
    store.upsert(REJECTED, both, S.REJECTS, ["student_id"], ["student_id"], gone=ids)

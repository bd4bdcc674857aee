import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from helpers import attempts, table
from scoreflow import schemas as S
from scoreflow.operators import metrics, narrative
from scoreflow.plans import refresh as R
from scoreflow.plans.asking import ask_in_rounds
from scoreflow.sources import adapters as A
from scoreflow.sources.tables import TableStore, as_text
from scoreflow.streaming.intake_stream import record_stream, start_intake

OUTPUTS = {
    R.VALIDATED: S.VALIDATED, R.ANALYTICS: S.ANALYTICS, R.INSIGHTS: S.INSIGHTS, R.SUMMARIES: S.SUMMARIES, R.LATEST: S.CONSOLIDATED,
}


def run(run_id, **settings):
    return R.Run("2030-01-01", A.subject_responses, A.student_responses, run_id, **settings)


def raw(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        student = rng.randrange(12)
        rows.append(
            (f"S{student}", 1 + student, rng.choice(["Art", "Math"]), f"E{i}", rng.choice(["mock", "real"]), 1,
             rng.randrange(101), str(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(60))))
        )
    return as_text(attempts(spark, rows))


def state(store):
    return {n: sorted(map(str, map(tuple, store.read(n, s).collect()))) for n, s in OUTPUTS.items()}


def test_keyed_refresh_of_all_equals_full_refresh_and_repeats(spark, tmp_path):
    data = raw(spark)
    whole, some = TableStore(spark, f"{tmp_path}/a", 4), TableStore(spark, f"{tmp_path}/b", 4)
    R.full_refresh(whole, data, run("r1"))
    ids = data.select("student_id").distinct()
    R.keyed_refresh(some, data, ids, run("r1"))
    assert state(some) == state(whole)
    R.keyed_refresh(some, data, ids.filter("student_id in ('S1', 'S2')"), run("r2"))
    assert state(some) == state(whole)
    # Students of grade 11 get no usable student response.
    failures = [r.student_id for r in whole.read(R.FAILURES).collect()]
    assert failures == ["S10"] and "S10" not in {r.student_id for r in whole.read(R.LATEST, S.CONSOLIDATED).collect()}
    history = some.read(R.HISTORY, S.HISTORY).groupBy("student_id").count().collect()
    assert {r["count"] for r in history if r.student_id in ("S1", "S2")} == {2}


def test_failed_batch_leaves_tables_and_names_rows(spark, store):
    data = raw(spark, 30)
    R.full_refresh(store, data, run("r1"))
    before = state(store)
    bad = data.withColumn("score", F.when(F.col("exam_id") == "E3", "x").otherwise(F.col("score")))
    with pytest.raises(ValueError, match="Row validation failed.*score out of range"):
        R.full_refresh(store, bad, run("r2"))
    with pytest.raises(ValueError, match="Duplicate exam attempts.*1 keys"):
        R.full_refresh(store, data.union(data.limit(1)), run("r3"))
    with pytest.raises(RuntimeError, match="is empty"):
        R.full_refresh(store, data.limit(0), run("r4"))
    with pytest.raises(ValueError, match="No raw data found for student \\['S99'\\].*1 students"):
        R.keyed_refresh(store, data, spark.createDataFrame([("S99",)], "student_id string"), run("r5"))
    assert state(store) == before


def test_quarantine_keeps_going(spark, store):
    data = raw(spark, 30)
    bad = data.withColumn("score", F.when(F.col("exam_id") == "E3", "x").otherwise(F.col("score")))
    R.full_refresh(store, bad, run("r1", quarantine=True))
    assert store.read(R.VALIDATED, S.VALIDATED).count() == 29
    assert [r.error for r in store.read(R.REJECTED).collect()] == ["score out of range"]


def test_strict_consolidation(spark, store):
    rows = attempts(spark, [("S1", 11, "Art", "E1", "mock", 1, 50, "2024-01-01")])
    with pytest.raises(RuntimeError, match="valid JSON"):
        R.full_refresh(store, as_text(rows), run("r1", strict_consolidation=True))


def test_intake_stream_refreshes_the_named_students(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drop(name, student, scores):
        subject = {"name": "Math", "scores": scores, "max_score": 100}
        (folder / name).write_text(json.dumps({"student_id": student, "name": "N", "grade": 5, "subjects": [subject]}))

    def process():
        start_intake(store, record_stream(spark, str(folder), 1), f"{tmp_path}/check", run("s"), "2024-06-01").awaitTermination()

    drop("a.json", "S1", [50, 60])
    drop("b.json", "S2", [70])
    process()
    got = {r.student_id: (r.attempt_count, r.average_score) for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()}
    assert got == {"S1": (2, 55.0), "S2": (1, 70.0)}
    drop("c.json", "S3", [10, 20, 30])
    process()
    got = {r.student_id: r.attempt_count for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()}
    assert got == {"S1": 2, "S2": 1, "S3": 3}
    assert store.read(R.RAW, S.RAW).count() == 6


def test_repeated_intake_run_adds_nothing(spark, store):
    subject = [("Math", [50.0, 60.0], 100.0)]
    records = spark.createDataFrame([("S1", "N", 5, subject)], S.INTAKE)
    for _ in range(2):
        R.intake_refresh(store, records, "2024-06-01", run("same"))
    assert store.read(R.RAW, S.RAW).count() == 2
    assert table(store.read(R.ANALYTICS, S.ANALYTICS))[0][3] == 2


def record(student, *subjects):
    return (student, "N", 5, [(name, [float(x) for x in scores], 100.0) for name, scores in subjects])


def records(spark, *rows):
    return spark.createDataFrame(list(rows), S.INTAKE)


def counts(store):
    return {(r.student_id, r.subject): r.attempt_count for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()}


def test_subjects_that_share_a_prefix(spark, store):
    R.intake_refresh(store, records(spark, record("S1", ("Physics", [50]), ("Physical Education", [60, 70]))), "2024-06-01", run("a"))
    assert counts(store) == {("S1", "Physics"): 1, ("S1", "Physical Education"): 2}


def test_second_series_of_a_student_and_subject(spark, store):
    R.intake_refresh(store, records(spark, record("S1", ("Math", [50, 60]))), "2024-06-01", run("a"))
    R.intake_refresh(store, records(spark, record("S1", ("Math", [70])), record("S3", ("Art", [10]))), "2024-06-02", run("b"))
    R.intake_refresh(store, records(spark, record("S1", ("Art", [80]))), "2024-06-03", run("c"))
    assert counts(store) == {("S1", "Math"): 3, ("S3", "Art"): 1, ("S1", "Art"): 1}


def test_bad_record_in_a_batch(spark, store):
    batch = records(spark, record("S1", ("Math", [50, 170])), record("S2", ("Math", [60])))
    with pytest.raises(ValueError, match="Row validation failed: 1 rows, all in rejected_rows"):
        R.intake_refresh(store, batch, "2024-06-01", run("a"))
    assert store.read(R.RAW, S.RAW).isEmpty()
    for _ in range(2):
        R.intake_refresh(store, batch, "2024-06-01", run("a", quarantine=True))
    assert counts(store) == {("S1", "Math"): 1, ("S2", "Math"): 1}
    assert [(r.student_id, r.error) for r in store.read(R.REJECTED, S.REJECTS).collect()] == [("S1", "score out of range")]
    R.intake_refresh(store, records(spark, record("S4", ("Math", [500]))), "2024-06-01", run("b", quarantine=True))
    assert sorted(r.student_id for r in store.read(R.REJECTED, S.REJECTS).collect()) == ["S1", "S4"]


def test_stream_goes_on_after_a_bad_record(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drop(name, student, scores):
        subject = {"name": "Math", "scores": scores, "max_score": 100}
        (folder / name).write_text(json.dumps({"student_id": student, "name": "N", "grade": 5, "subjects": [subject]}))

    def process():
        settings = run("s", quarantine=True)
        start_intake(store, record_stream(spark, str(folder), 1), f"{tmp_path}/check", settings, "2024-06-01").awaitTermination()

    drop("a.json", "S1", [170])
    process()
    drop("b.json", "S2", [70])
    process()
    process()
    assert counts(store) == {("S2", "Math"): 1}
    assert [r.student_id for r in store.read(R.REJECTED, S.REJECTS).collect()] == ["S1"]


def test_all_errors_of_a_keyed_run_are_kept(spark, store):
    bad = attempts(spark, [("S1", 5, "Math", f"E{i}", "mock", 1, 150, "2024-01-01") for i in range(150)])
    ids = spark.createDataFrame([("S1",)], "student_id string")
    with pytest.raises(ValueError, match="Row validation failed: 150 rows"):
        R.keyed_refresh(store, as_text(bad), ids, run("r"))
    assert store.read(R.REJECTED, S.REJECTS).count() == 150


def test_rejects_and_failures_of_others_stay(spark, store):
    data = as_text(attempts(spark, [
        (s, g, "Art", f"E{s}{i}", "mock", 1, v, "2024-01-01") for s, g in (("S1", 11), ("S2", 11), ("S3", 5)) for i, v in enumerate((50, 150))
    ]))
    R.full_refresh(store, data, run("r1", quarantine=True))
    assert sorted(r.student_id for r in store.read(R.FAILURES).collect()) == ["S1", "S2"]
    R.keyed_refresh(store, data, spark.createDataFrame([("S3",)], "student_id string"), run("r2", quarantine=True))
    assert sorted(r.student_id for r in store.read(R.FAILURES).collect()) == ["S1", "S2"]
    assert sorted(r.student_id for r in store.read(R.REJECTED, S.REJECTS).collect()) == ["S1", "S2", "S3"]
    good = data.filter("cast(score as double) < 100 or student_id <> 'S2'").withColumn("grade", F.when(F.col("student_id") == "S2", "5").otherwise(F.col("grade")))
    R.keyed_refresh(store, good, spark.createDataFrame([("S2",)], "student_id string"), run("r3", quarantine=True))
    assert sorted(r.student_id for r in store.read(R.FAILURES).collect()) == ["S1"]
    assert sorted(r.student_id for r in store.read(R.REJECTED, S.REJECTS).collect()) == ["S1", "S3"]


def test_work_tables_go(spark, store, tmp_path):
    R.full_refresh(store, raw(spark, 20), run("r1"))
    assert not [d for d in (tmp_path / "tables").iterdir() if d.name.startswith("work")]


def test_thresholds_and_window_of_a_run(spark, store):
    data = as_text(attempts(spark, [("S1", 5, "Art", f"E{i}", "mock", 1, v, f"2024-01-0{i + 1}") for i, v in enumerate((10, 40, 70))]))
    R.full_refresh(store, data, run("r", window=3, thresholds=S.Thresholds(low_score=30.0, high_score=35.0)))
    r = store.read(R.ANALYTICS, S.ANALYTICS).first()
    assert (r.recent_avg_score, r.performance_band) == (40.0, "high")


@pytest.mark.parametrize("quarantine", [False, True])
def test_a_very_large_valid_score_stops_no_refresh(spark, store, tmp_path, quarantine):
    """Full, keyed, intake and stream refresh with scores up to 1e300; the other students go on."""
    data = raw(spark, 40).withColumn("max_score", F.lit("1e308")).withColumn(
        "score", F.expr("case exam_id when 'E3' then '1e21' when 'E7' then '1e300' when 'E9' then '1e14' else score end")
    )
    R.full_refresh(store, data, run("r1", quarantine=quarantine))
    whole = state(store)
    assert store.read(R.VALIDATED, S.VALIDATED).count() == 40
    assert store.read(R.ANALYTICS, S.ANALYTICS).agg(F.max("average_score")).first()[0] > 1e299
    R.keyed_refresh(store, data, data.select("student_id").distinct(), run("r2", quarantine=quarantine))
    assert state(store)[R.ANALYTICS] == whole[R.ANALYTICS]
    big = spark.createDataFrame([("S1", "N", 5, [("Math", [1e21, 50.0], 1e30)]), ("S50", "N", 5, [("Art", [70.0], 100.0)])], S.INTAKE)
    R.intake_refresh(store, big, "2024-06-01", run("r3", quarantine=quarantine))
    folder = tmp_path / "in"
    folder.mkdir()
    subject = {"name": "Math", "scores": [1e300, 2], "max_score": 1e301}
    (folder / "a.json").write_text(json.dumps({"student_id": "S60", "name": "N", "grade": 5, "subjects": [subject]}))
    start_intake(
        store, record_stream(spark, str(folder)), f"{tmp_path}/check", run("s", quarantine=quarantine), "2024-06-01"
    ).awaitTermination()
    got = {(r.student_id, r.subject, r.grade): r.average_score for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()}
    assert got[("S1", "Math", 5)] == 5e20 and got[("S50", "Art", 5)] == 70.0 and got[("S60", "Math", 5)] == pytest.approx(5e299)


def recomputed(store):
    return table(metrics.subject_analytics(store.read(R.VALIDATED, S.VALIDATED)).na.fill(-99.0))


def test_intake_merges_states_and_equals_a_recompute(spark, store, monkeypatch):
    data = raw(spark, 150).withColumn("score", F.expr("cast(cast(score as double) / 7 as string)"))
    R.full_refresh(store, data, run("r0"))
    read, asked = [], []
    kept = metrics.group_states
    monkeypatch.setattr(metrics, "group_states", lambda df, window: (read.append(df.count()), kept(df, window))[1])

    def model(prompts):
        asked.append(prompts.count())
        return A.subject_responses(prompts)

    for i in range(3):
        batch = records(spark, record("S1", ("Math", [50 + i / 3, 60])), record("S2", ("Art", [i])), record(f"N{i}", ("Art", [1, 2, 3])))
        R.intake_refresh(store, batch, f"2024-0{7 + i}-01", R.Run("2030-01-01", model, A.student_responses, f"i{i}"))
    assert table(store.read(R.ANALYTICS, S.ANALYTICS).na.fill(-99.0)) == recomputed(store)
    assert read == [6, 6, 6]  # the new attempts only
    assert asked == [3, 3, 3]  # the groups concerned only
    states = store.read(R.STATES, S.STATES)
    assert table(states.drop("last", "wide", "first")) == table(kept(store.read(R.VALIDATED, S.VALIDATED)).drop("last", "wide", "first"))


def test_intake_without_stored_states_and_with_earlier_ones(spark, store):
    R.intake_refresh(store, records(spark, record("S1", ("Math", [10, 20]))), "2024-06-01", run("a"))
    store.drop(R.STATES)
    R.intake_refresh(store, records(spark, record("S1", ("Math", [30]))), "2024-06-02", run("b"))
    assert counts(store) == {("S1", "Math"): 3}
    R.intake_refresh(store, records(spark, record("S1", ("Math", [40]))), "2024-06-03", run("c"))
    assert counts(store) == {("S1", "Math"): 4}
    assert table(store.read(R.ANALYTICS, S.ANALYTICS).na.fill(-99.0)) == recomputed(store)


def test_one_student_in_two_grades(spark, store):
    R.intake_refresh(store, records(spark, record("S1", ("Math", [10]))), "2024-06-01", run("a"))
    later = spark.createDataFrame([("S1", "N", 6, [("Math", [90.0], 100.0)])], S.INTAKE)
    R.intake_refresh(store, later, "2024-06-02", run("b"))
    assert sorted((r.grade, r.average_score) for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()) == [(5, 10.0), (6, 90.0)]


def test_malformed_lines_of_the_stream_are_kept_and_the_rest_goes_on(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = json.dumps({"student_id": "S1", "name": "N", "grade": 5, "subjects": [{"name": "Math", "scores": [50], "max_score": 100}]})
    (folder / "a.json").write_text(good + "\n{\"student_id\": \"S2\", \"na\n" + good.replace("S1", "S3") + "\n")
    (folder / "b.json").write_text("[1, 2\n" + good.replace("S1", "S4").replace("5,", "\"five\",") + "\n")
    start_intake(store, record_stream(spark, str(folder)), f"{tmp_path}/check", run("s"), "2024-06-01").awaitTermination()
    assert counts(store) == {("S1", "Math"): 1, ("S3", "Math"): 1}
    lost = {(r.file.split("/")[-1], r.text[:12]) for r in store.read(R.MALFORMED, S.MALFORMED).collect()}
    assert lost == {("a.json", '{"student_id'), ("b.json", "[1, 2"), ("b.json", '{"student_id')}


def test_only_malformed_lines(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("nothing\n")
    start_intake(store, record_stream(spark, str(folder)), f"{tmp_path}/check", run("s"), "2024-06-01").awaitTermination()
    assert [r.text for r in store.read(R.MALFORMED, S.MALFORMED).collect()] == ["nothing"]
    assert not store.exists(R.VALIDATED)


def test_counts_come_with_the_write(spark, store):
    """A full refresh reports rows, rejects by kind and students, and writes no rejects where there are none."""
    data = raw(spark, 60)
    seen = R.full_refresh(store, data, run("r1"))
    assert (seen["rows"], seen["rejected"], seen["students"]) == (60, 0, data.select("student_id").distinct().count())
    assert not store.exists(R.REJECTED)
    bad = data.withColumn("score", F.when(F.col("exam_id").isin("E3", "E4"), "x").otherwise(F.col("score")))
    bad = bad.withColumn("subject", F.when(F.col("exam_id") == "E5", " ").otherwise(F.col("subject")))
    seen = R.full_refresh(store, bad, run("r2", quarantine=True))
    assert {k: v for k, v in seen.items() if v} == {
        "rows": 60, "rejected": 3, "score out of range": 2, "invalid subject": 1, "students": seen["students"]
    }
    R.full_refresh(store, data, run("r3"))
    assert store.read(R.REJECTED, S.REJECTS).isEmpty()


def test_valid_rows_are_written_once(spark, store, tmp_path):
    R.full_refresh(store, raw(spark, 20), run("r1"))
    versions = [d.name for d in (tmp_path / "tables" / R.VALIDATED).iterdir() if d.name.startswith("v=")]
    assert len(versions) == 1
    data = raw(spark, 20)
    with pytest.raises(ValueError, match="Duplicate"):
        R.full_refresh(store, data.union(data.limit(1)), run("r2"))
    assert [d.name for d in (tmp_path / "tables" / R.VALIDATED).iterdir() if d.name.startswith("v=")] == versions


def test_rounds_ask_only_what_has_no_usable_answer(spark, store):
    """Counts of prompts asked in each round, and the summaries of the table form."""
    data = raw(spark, 200)
    R.full_refresh(store, data, run("r1"))
    prompts = narrative.subject_prompts(store.read(R.INSIGHTS, S.INSIGHTS))
    asked = []

    def model(rows):
        asked.append(sorted((r.student_id, r.subject) for r in rows.collect()))
        return A.subject_response(rows)

    told, counts = ask_in_rounds(store, "rounds", prompts, model, S.GROUP_KEY, S.SUMMARY_FIELDS)
    grades = {(r.student_id, r.subject): r.grade for r in prompts.collect()}
    second = sorted(k for k, g in grades.items() if g % 3 != 2)
    third = [k for k in second if grades[k] % 4 == 0]
    assert asked == [sorted(grades), second, third] and counts == [len(grades), len(second), len(third)]
    whole = narrative.subject_summaries(prompts, A.subject_responses(prompts))
    assert table(narrative.subject_summaries(prompts, told)) == table(whole)
    # All answered in the first round: nothing is asked again.
    easy = prompts.filter("grade % 3 = 2")
    assert ask_in_rounds(store, "easy", easy, A.subject_response, S.GROUP_KEY, S.SUMMARY_FIELDS)[1] == [easy.count()]
    assert ask_in_rounds(store, "none", prompts.limit(0), A.subject_response, S.GROUP_KEY, S.SUMMARY_FIELDS)[1] == [0]


def test_refresh_in_rounds_equals_the_table_form(spark, tmp_path):
    data = raw(spark)
    whole, rounds = TableStore(spark, f"{tmp_path}/a", 4), TableStore(spark, f"{tmp_path}/b", 4)
    R.full_refresh(whole, data, run("r1"))
    R.full_refresh(rounds, data, R.Run("2030-01-01", A.subject_response, A.student_responses, "r1", rounds=True))
    assert state(rounds) == state(whole)


def test_repeated_records_of_a_stream_count_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def send(name, *scores, student="S1", tail=""):
        subject = {"name": "Math", "scores": list(scores), "max_score": 100}
        text = json.dumps({"student_id": student, "name": "N", "grade": 5, "subjects": [subject]})
        (folder / name).write_text(f"{text}\n{tail}")
        records = record_stream(spark, str(folder))
        start_intake(store, records, f"{tmp_path}/check", run("s"), "2024-06-01", repeats_within="1 hour").awaitTermination()
        return counts(store)

    assert send("a.json", 50, 60, tail="broken\nbroken\n") == {("S1", "Math"): 2}
    assert send("b.json", 50, 60, tail="broken\n") == {("S1", "Math"): 2}  # after a restart
    assert send("c.json", 50, 61) == {("S1", "Math"): 4}
    assert send("d.json", 50, 60, student="S2") == {("S1", "Math"): 4, ("S2", "Math"): 2}
    assert store.read(R.RAW, S.RAW).count() == 6
    assert sorted(r.file.split("/")[-1] for r in store.read(R.MALFORMED, S.MALFORMED).collect()) == ["a.json", "b.json"]


def test_memory_of_repeats_expires(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, score in enumerate((50, 60, 50)):
        subject = {"name": "Math", "scores": [score], "max_score": 100}
        record = {"student_id": "S1", "name": "N", "grade": 5, "subjects": [subject]}
        (folder / f"{i}.json").write_text(json.dumps(record))
        records = record_stream(spark, str(folder))
        start_intake(store, records, f"{tmp_path}/check", run("s"), "2024-06-01", repeats_within="1 second").awaitTermination()
        time.sleep(2)
    assert counts(store) == {("S1", "Math"): 3}

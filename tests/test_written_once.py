"""Deltas of a refresh are written once, lie where their source lies, and replace old rows without shuffling them whole."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import attempts, table
from scoreflow import schemas as S
from scoreflow.operators import metrics, narrative
from scoreflow.plans import refresh as R
from scoreflow.sources import adapters as A
from scoreflow.sources.tables import TableStore
from scoreflow.streaming.intake_stream import record_stream, start_intake

SCHEMA = "student_id string, n int, x string"


def run(run_id, **settings):
    return R.Run("2030-01-01", A.subject_responses, A.student_responses, run_id, **settings)


def records(spark, *rows):
    return spark.createDataFrame([(s, "N", 5, [(name, [float(x) for x in scores], 100.0)]) for s, name, scores in rows], S.INTAKE)


@pytest.fixture
def staged(monkeypatch):
    """Names of the tables that versions are written of."""
    names, stage = [], TableStore.stage

    def counted(self, name, *rest, **more):
        names.append(name)
        return stage(self, name, *rest, **more)

    monkeypatch.setattr(TableStore, "stage", counted)
    return names


def test_an_intake_writes_every_delta_once(spark, store, staged):
    first = records(spark, ("S1", "Math", [50, 60]), ("S2", "Art", [70]))
    for label in ("a", "b", "b"):
        staged.clear()
        R.intake_refresh(store, first, "2024-06-01", run(label))
        # A repeated run stages the batch first and finds it stored.
        once = {R.STATES, R.ANALYTICS, R.INSIGHTS, R.SUMMARIES, R.HISTORY, R.LATEST, R.RAW} | (set() if staged.count(R.VALIDATED) == 2 else {R.VALIDATED})
        assert {name: staged.count(name) for name in once} == dict.fromkeys(once, 1)
        assert not [n for n in staged if "/" in n and n.split("/")[-1] in {R.STATES, R.ANALYTICS, R.INSIGHTS, R.SUMMARIES, "rows", "valid"}]
    got = {(r.student_id, r.subject): (r.attempt_count, r.average_score) for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()}
    assert got == {("S1", "Math"): (4, 55.0), ("S2", "Art"): (2, 70.0)}
    assert store.read(R.VALIDATED, S.VALIDATED).count() == store.read(R.RAW, S.RAW).count() == 6


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def seen(store):
    schema = T.StructType.fromDDL(SCHEMA)
    return sorted(map(tuple, store.read("t", schema).collect()), key=str)


def test_rows_that_are_all_replaced_are_not_written_again(spark, store, staged):
    old = rows(spark, *[(f"S{i}", i, "old") for i in range(20)], (None, None, "old"))
    store.upsert("t", old, old.schema, ["student_id", "n"], ["student_id"])
    new = old.withColumn("x", F.lit("new"))
    staged.clear()
    store.upsert("t", new, new.schema, ["student_id", "n"], ["student_id"])
    assert staged == ["t"]
    assert {r[2] for r in seen(store)} == {"new"} and len(seen(store)) == 21


def test_as_many_new_rows_with_other_keys(spark, store):
    """Repeated and null keys among them; rows that are not met stay."""
    old = rows(spark, ("S1", 1, "old"), ("S1", 1, "old too"), ("S2", 2, "old"), (None, None, "old"))
    store.upsert("t", old, old.schema, ["student_id", "n"], ["student_id"])
    new = rows(spark, ("S1", 1, "new"), ("S3", 3, "new"), (None, None, "new"), ("S2", 9, "new"), ("S3", 3, "new too"))
    store.upsert("t", new, new.schema, ["student_id", "n"], ["student_id"])
    assert seen(store) == sorted([("S2", 2, "old"), *map(tuple, new.collect())], key=str)
    store.upsert("t", new.limit(0), new.schema, ["student_id", "n"], ["student_id"], gone=new)
    assert seen(store) == [("S2", 2, "old")]
    store.upsert("t", new.limit(0), new.schema, ["student_id", "n"], ["student_id"], gone=old)
    assert seen(store) == []
    store.upsert("t", new, new.schema, ["student_id", "n"], ["student_id"])
    assert len(seen(store)) == 5


def test_new_keys_are_added_and_parts_of_many_folders_put_together(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), parts=1)
    for i in range(20):
        df = rows(spark, (f"S{i}", i, "x"))
        version = store.stage("t", df, ["student_id"])
        store.admit("t", version, df.schema, ["student_id"], ["student_id"], unmet=store.number("t"))
        assert len(store._folders("t")) <= store.FOLDERS
    assert seen(store) == sorted([(f"S{i}", i, "x") for i in range(20)], key=str)


def test_a_key_that_came_meanwhile_is_replaced(spark, store):
    df = rows(spark, ("S1", 1, "mine"))
    version, number = store.stage("t", df, ["student_id"]), store.number("t")
    store.append("t", rows(spark, ("S1", 1, "other"), ("S2", 2, "other")), df.schema, "b", ["student_id"])
    store.admit("t", version, df.schema, ["student_id"], ["student_id"], unmet=number)
    assert seen(store) == [("S1", 1, "mine"), ("S2", 2, "other")]


def test_rows_that_lie_by_part_are_not_shuffled(spark, store):
    data = rows(spark, *[(f" S{i} ", i, "x") for i in range(50)])
    version = store.stage("t", data, ["student_id"])
    source = store.read_version("t", version, data.schema)
    later = store.stage("u", source.withColumn("n", F.col("n") * 2), ["student_id"], placed=True)
    store.publish("u", later)
    assert sorted(r.n for r in store.read("u").collect()) == [2 * i for i in range(50)]
    assert [r.n for r in store.read_student("u", data.schema, "S7").collect()] == [14]
    assert {d for d in os.listdir(f"{store.root}/u/{later}") if d.startswith("part=")} == {
        d for d in os.listdir(f"{store.root}/t/{version}") if d.startswith("part=")
    }


def test_analytics_of_states_join_nothing(spark):
    """Wide sums stand in the rows: one group of large scores, one of both, one of small ones."""
    data = attempts(spark, [
        (s, 5, "Math", f"E{i}", kind, 1, score, "2024-01-01")
        for s, scores in (("S1", (1e21, 3e21)), ("S2", (50, 1e14, 60)), ("S3", (50, 60, 70)))
        for i, (score, kind) in enumerate(zip(scores, ("mock", "real", "mock")))
    ])
    out = metrics.analytics_of_states(metrics.group_states(data).localCheckpoint())
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert table(out.na.fill(-1.0)) == table(metrics.subject_analytics(data).na.fill(-1.0))


@pytest.mark.parametrize("window", [1, 2, 5])
def test_last_attempts_of_a_state(spark, window):
    """Nulls come last, and a hot group spread over tasks keeps its last attempts only."""
    data = spark.range(0, 4000, 1, 8).select(
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("S"), F.col("id").cast("string"))).otherwise("HOT").alias("student_id"),
        F.lit("N").alias("Name"), F.lit(5).alias("grade"), F.lit("Math").alias("subject"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("exam_id"), F.lit("mock").alias("exam_type"),
        F.when(F.col("id") % 5 > 0, F.lit(1)).alias("attempt_number"), (F.col("id") % 101).cast("double").alias("score"),
        F.lit(100.0).alias("max_score"), F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").alias("exam_date"),
    )
    got = {r.student_id: [tuple(a) for a in r["last"]] for r in metrics.group_states(data, window).collect()}
    own = [(r.exam_date, r.attempt_number, r.exam_id, r.score) for r in data.filter("student_id = 'HOT'").collect()]
    rank = lambda a: (a[0], a[1] is not None, a[1] or 0, a[2] is not None, a[2] or "", a[3])
    assert got["HOT"] == sorted(own, key=rank, reverse=True)[:window]
    assert len(got) == 1001 and all(len(v) == 1 for k, v in got.items() if k != "HOT")


def test_prompt_texts_are_put_together_in_compiled_code(spark):
    df = spark.createDataFrame([("S1", 5, "Math %s")], "student_id string, grade int, subject string")
    fields = [F.lit(None).cast("string").alias(c) for c in narrative.SUBJECT_PROMPT_FIELDS if c not in df.columns]
    prompts = narrative.subject_prompts(df.select("*", *fields))
    assert "format_string" not in prompts._jdf.queryExecution().optimizedPlan().toString()
    assert "Subject: Math %s\n" in prompts.first().prompt and "Primary issue: \n" in prompts.first().prompt


def test_a_batch_of_a_stream_is_read_once(spark, store, tmp_path):
    """What the refresh and the look for malformed lines read is stored, so repeats are looked for once."""
    folder, plans = tmp_path / "in", []
    folder.mkdir()
    subject = {"name": "Math", "scores": [50, 60], "max_score": 100}
    text = json.dumps({"student_id": "S1", "name": "N", "grade": 5, "subjects": [subject]})
    (folder / "a.json").write_text(f"{text}\nbroken\n{text}\n")

    def refresh(store, batch, day, run):
        plans.append(batch._jdf.queryExecution().executedPlan().toString())
        R.intake_refresh(store, batch, day, run)

    stream = start_intake(
        store, record_stream(spark, str(folder)), f"{tmp_path}/check", run("s"), "2024-06-01", refresh, repeats_within="1 hour"
    )
    stream.awaitTermination()
    assert len(plans) == 1 and "parquet" in plans[0] and "Deduplicate" not in plans[0] and "JSON" not in plans[0]
    assert [(r.student_id, r.attempt_count) for r in store.read(R.ANALYTICS, S.ANALYTICS).collect()] == [("S1", 2)]
    assert [r.text for r in store.read(R.MALFORMED, S.MALFORMED).collect()] == ["broken"]
    assert not [d for d in os.listdir(store.root) if d.startswith("work")]

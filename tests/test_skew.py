"""Plans and results where one key holds a third of all rows."""

import pytest
from pyspark.sql import functions as F

from helpers import table
from scoreflow import schemas as S
from scoreflow.operators import consolidation as C
from scoreflow.operators import keyed, narrative, validation
from scoreflow.plans import refresh


@pytest.fixture
def sort_merge(spark):
    """Small test tables would be broadcast; force the plan that large ones get."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, name, rows=30000):
    """A third of the rows under one key; spread over several map tasks."""
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), (n % 997).cast("string")))
    return spark.range(0, rows, 1, 8).select(key.alias(name), n.alias("row"), F.sha2(n.cast("string"), 256).alias("load"))


def test_chosen_students_split_a_hot_student(sort_merge):
    df = skewed(sort_merge, "student_id")
    ids = sort_merge.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("student_id")).union(
        sort_merge.createDataFrame([("HOT",)], "student_id string")
    )
    out = validation.of_students(df, ids)
    assert "skew=true" in final_plan(out)
    assert out.count() == df.filter("student_id = 'HOT' or cast(substr(student_id, 2) as int) < 500").count()


def test_email_update_splits_a_hot_account(sort_merge):
    users = skewed(sort_merge, "email").withColumn("role", F.lit("Student")).withColumn("student_id", F.lit("old"))
    edits = sort_merge.createDataFrame([("hot", "new", 1), ("K5", "five", 1)], "email string, student_id string, n int")
    out = keyed.update_by_email(users, edits, "n")
    assert "skew=true" in final_plan(out)
    counts = {r.student_id: r["count"] for r in out.groupBy("student_id").count().collect()}
    assert counts["new"] == 10000 and counts["five"] == users.filter("email = 'k5'").count() and sum(counts.values()) == 30000


def test_upsert_splits_a_hot_key(sort_merge):
    old = skewed(sort_merge, "k")
    new = sort_merge.createDataFrame([("HOT", -1, "x"), ("k7", -1, "x")], "k string, row bigint, load string")
    out = keyed.upsert_rows(old, new, ["k"])
    assert "skew=true" in final_plan(out)
    assert out.count() == old.filter("k not in ('HOT', 'k7')").count() + 2


def test_repeated_key_with_a_third_of_the_rows(sort_merge):
    n = F.col("row")
    raw = skewed(sort_merge, "exam_id").select(
        F.lit("S1").alias("student_id"), F.sha2(n.cast("string"), 256).alias("Name"), F.lit("5").alias("grade"), F.lit("Math").alias("subject"),
        F.when(F.col("exam_id") == "HOT", "HOT").otherwise(n.cast("string")).alias("exam_id"),
        F.lit("mock").alias("exam_type"), F.lit("1").alias("attempt_number"), F.lit("50").alias("score"),
        F.lit("100").alias("max_score"), F.lit("2024-01-01").alias("exam_date"),
    )
    good, rejected = validation.split_rows(raw, "2025-01-01")
    assert "skew=true" in final_plan(good)
    assert (good.count(), rejected.count()) == (20000, 10000)


def test_sign_ups_of_a_hot_email(sort_merge):
    new = skewed(sort_merge, "email").withColumn("id", F.col("row").cast("string")).drop("load")
    existing = sort_merge.createDataFrame([("1", "K5")], "id string, email string")
    full, rejected = keyed.insert_if_absent(existing, new, "row", S.USERS.names)
    assert (full.count(), rejected.count()) == (998 - 1 + 1, 30000 - 997)


def test_processed_flags(sort_merge):
    df = skewed(sort_merge, "student_id")
    out = C.processed_flags(df, sort_merge.createDataFrame([("HOT",)], "student_id string"))
    assert "skew=true" in final_plan(out)
    assert table(out.groupBy("processed").count()) == [(False, 20000), (True, 10000)]


def test_stored_keys_are_never_broadcast(spark, store):
    """Files of short keys look small to the planner however many rows they hold."""
    rows = store.scratch("rows", skewed(spark, "student_id").withColumn("subject", F.lit("Art")).withColumn("grade", F.lit(5)))
    ids = store.scratch("ids", C.ids_of(rows))
    asked = rows.select(*S.GROUP_KEY).distinct().withColumn("prompt", F.lit("?"))
    prompts = store.scratch("asked", asked)
    told = store.scratch("told", prompts.select(*S.GROUP_KEY, F.lit(1).alias("attempt"), F.lit('{"a": 1}').alias("response")))
    frames = {
        "of_students": validation.of_students(rows, ids),
        "without_keys": keyed.without_keys(rows, ids, ["student_id"]),
        "touched": refresh._touched(rows, prompts),
        "summaries": narrative.subject_summaries(prompts, told),
        "unanswered": narrative.unanswered(prompts, ids),
    }
    for name, df in frames.items():
        assert "Broadcast" not in final_plan(df), name

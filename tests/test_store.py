import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import attempts, table
from scoreflow import schemas as S
from scoreflow.sources import tables as TB


def rows(spark, *students):
    return attempts(spark, [(s, 5, "Math", "E1", "mock", 1, 50, "2024-01-01") for s in students])


def test_overwrite_from_itself(spark, store):
    store.overwrite("t", rows(spark, "S1", "S2"))
    store.overwrite("t", store.read("t", S.VALIDATED).filter("student_id = 'S1'"))
    assert [r.student_id for r in store.read("t", S.VALIDATED).collect()] == ["S1"]


def test_absent_table_is_a_typed_empty_frame(spark, store):
    assert store.read("none", S.VALIDATED).schema == S.VALIDATED and store.read("none", S.VALIDATED).isEmpty()
    with pytest.raises(LookupError):
        store.read("none")


def test_staged_rows_are_hidden_until_published(spark, store):
    store.overwrite("t", rows(spark, "S1"))
    version = store.stage("t", rows(spark, "S2"))
    assert [r.student_id for r in store.read("t", S.VALIDATED).collect()] == ["S1"]
    store.publish("t", version)
    assert [r.student_id for r in store.read("t", S.VALIDATED).collect()] == ["S2"]


def test_append_replays_and_checks_the_header(spark, store):
    for batch, student in (("a", "S1"), ("b", "S2"), ("a", "S1")):
        store.append("t", rows(spark, student), S.VALIDATED, batch)
    assert sorted(r.student_id for r in store.read("t", S.VALIDATED).collect()) == ["S1", "S2"]
    with pytest.raises(ValueError, match="header differs"):
        store.append("t", rows(spark, "S3").withColumn("x", F.lit(1)), S.VALIDATED, "c")
    assert store.read("t", S.VALIDATED).count() == 2


def test_upsert_rewrites_only_the_parts_it_names(spark, store):
    everybody = [f"S{i}" for i in range(40)]
    store.overwrite("t", rows(spark, *everybody), S.ATTEMPT_KEY)
    before = set(store._folders("t"))
    assert len(before) == 4
    new = rows(spark, "S7").withColumn("score", F.lit(99.0))
    store.upsert("t", new, S.VALIDATED, S.ATTEMPT_KEY, S.ATTEMPT_KEY)
    assert len(before & set(store._folders("t"))) == 3
    got = {r.student_id: r.score for r in store.read("t", S.VALIDATED).collect()}
    assert got == {**{s: 50.0 for s in everybody}, "S7": 99.0}
    assert table(store.read_student("t", S.VALIDATED, " S7 "))[0][7] == 99.0


def test_lookup_prunes_parts(spark, store):
    store.overwrite("t", rows(spark, *[f"S{i}" for i in range(40)]), S.ATTEMPT_KEY)
    plan = store.read_student("t", S.VALIDATED, "S7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "part#" in plan.split("PartitionFilters")[1]


def scanned_rows(df):
    """Rows that the file scan of a frame gave out when it was run."""
    df.collect()
    plan, scans = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            scans.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(scans)


def test_lookup_reads_few_rows_of_a_part(spark, tmp_path):
    store = TB.TableStore(spark, str(tmp_path / "t"), parts=1)
    data = spark.range(60000).select(
        F.concat(F.lit(" S"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(" ")).alias("student_id"), F.col("id").alias("row_index"),
        F.lit("text").alias("error"),
    )
    store.overwrite("t", data, ["student_id"])
    found = store.read_student("t", S.REJECTS, "S012345 ")
    assert [r.row_index for r in found.collect()] == [12345] and found.columns == S.REJECTS.names
    assert scanned_rows(found) == 20000  # one page of the sorted file
    assert store.read_student("t", S.REJECTS, "S099999").collect() == [] and scanned_rows(store.read_student("t", S.REJECTS, "S012345x")) == 0
    assert sorted(store.read("t").columns) == sorted(S.REJECTS.names)


def test_lookup_in_a_table_not_split_by_student(spark, store):
    store.overwrite("t", rows(spark, "S1", " S7 ").select("student_id", "score"))
    schema = S.VALIDATED["student_id"], S.VALIDATED["score"]
    assert [r.student_id for r in store.read_student("t", T.StructType(list(schema)), "S7").collect()] == [" S7 "]


def test_sanitized_numbers(spark, store):
    bad = rows(spark, "S1").withColumn("score", F.lit(float("nan"))).withColumn("max_score", F.lit(float("inf")))
    store.overwrite("t", bad)
    r = store.read("t", S.VALIDATED).first()
    assert (r.score, r.max_score) == (None, None)


def test_csv_round_trip(spark, tmp_path):
    cells = [('a "quoted", one', " padded ", "line\nbreak"), ("", None, "x")]
    path = os.path.join(tmp_path, "csv")
    TB.write_csv(spark.createDataFrame(cells, "a string, b string, c string"), path)
    got = TB.read_csv(spark, path, multiline=True)
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [cells[0], (None, None, "x")]))


def test_header_only_csv_has_columns_and_no_rows(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("student_id,score\n")
    df = TB.read_csv(spark, str(path))
    assert df.columns == ["student_id", "score"] and df.isEmpty()


def test_conform(spark):
    with pytest.raises(ValueError, match="missing \\['exam_id'\\]"):
        TB.conform(rows(spark, "S1").drop("exam_id"), S.VALIDATED)


def test_broken_mark_raises_and_nothing_is_lost(spark, store, tmp_path):
    store.overwrite("t", rows(spark, "S1"))
    (tmp_path / "tables" / "t" / "_mark.2").write_text("")
    for action in (lambda: store.read("t", S.VALIDATED), lambda: store.upsert("t", rows(spark, "S2"), S.VALIDATED, S.ATTEMPT_KEY, S.ATTEMPT_KEY)):
        with pytest.raises(RuntimeError, match="mark 2 of table t .* is broken"):
            action()
    (tmp_path / "tables" / "t" / "_mark.2").unlink()
    assert [r.student_id for r in store.read("t", S.VALIDATED).collect()] == ["S1"]


def test_two_writers_of_one_version(spark, store):
    store.overwrite("t", rows(spark, "S1"), S.ATTEMPT_KEY)
    seen, folders = store._current("t")
    store.append("t", rows(spark, "S2"), S.VALIDATED, "b", S.ATTEMPT_KEY)
    with pytest.raises(TB.ChangedTable):
        store._show("t", folders, seen)
    assert sorted(r.student_id for r in store.read("t", S.VALIDATED).collect()) == ["S1", "S2"]


def test_an_upsert_that_loses_the_race_starts_again(spark, store, monkeypatch):
    store.overwrite("t", rows(spark, "S1"), S.ATTEMPT_KEY)
    stage, raced = store.stage, []

    def slow(name, df, *rest, **more):
        version = stage(name, df, *rest, **more)
        if name == "t" and not raced:
            raced.append(1)
            store.append("t", rows(spark, "S3"), S.VALIDATED, "other", S.ATTEMPT_KEY)
        return version

    monkeypatch.setattr(store, "stage", slow)
    store.upsert("t", rows(spark, "S2"), S.VALIDATED, S.ATTEMPT_KEY, S.ATTEMPT_KEY)
    assert sorted(r.student_id for r in store.read("t", S.VALIDATED).collect()) == ["S1", "S2", "S3"]


def test_a_repeated_label_leaves_earlier_readers_their_rows(spark, store):
    store.append("t", rows(spark, "S1"), S.VALIDATED, "a")
    before = store.read("t", S.VALIDATED)
    store.append("t", rows(spark, "S2"), S.VALIDATED, "a")
    assert [r.student_id for r in before.collect()] == ["S1"]
    assert [r.student_id for r in store.read("t", S.VALIDATED).collect()] == ["S2"]
    assert [r.student_id for r in store.read_batch("t", "a", S.VALIDATED).collect()] == ["S2"]


def test_retention_and_compaction(spark, tmp_path):
    store = TB.TableStore(spark, f"{tmp_path}/r", 2, retain=1)
    for n in range(3):
        store.overwrite("t", rows(spark, f"S{n}"))
    assert len([d for d in os.listdir(tmp_path / "r" / "t") if d.startswith("v=")]) == 1
    store.append("h", rows(spark, "S1"), S.VALIDATED, "a")
    store.append("h", rows(spark, "S2"), S.VALIDATED, "b")
    store.compact("h", S.VALIDATED)
    assert len(store._folders("h")) == 1 and store.read("h", S.VALIDATED).count() == 2
    store.drop("h")
    assert not store.exists("h")


def csv_files(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_files_with_another_column_order_are_aligned_by_name(spark, tmp_path):
    path = csv_files(tmp_path, a="student_id,score\nS1,70\n", b="score,student_id\n80,S2\n,S3\n", c="﻿score,student_id\n\"9,5\",S4\n", d="")
    df = TB.read_csv(spark, path)
    assert df.columns == ["student_id", "score"]
    assert sorted(tuple(r) for r in df.collect()) == [("S1", "70"), ("S2", "80"), ("S3", None), ("S4", "9,5")]
    assert TB.read_csv(spark, path, columns=["score", "student_id"]).columns == ["score", "student_id"]


@pytest.mark.parametrize("header, said", [
    ("student_id,score,extra", "unexpected \\['extra'\\]"), ("student_id", "missing \\['score'\\]"),
    ("student_id,score,score", "repeated \\['score'\\]"),
])
def test_a_file_with_other_columns_is_named(spark, tmp_path, header, said):
    path = csv_files(tmp_path, a="student_id,score\nS1,70\n", b="score,student_id\n80,S2\n", c=f"{header}\nS3,1,2\n")
    with pytest.raises(ValueError, match=f"c.csv differs: .*{said}"):
        TB.read_csv(spark, path)


def test_headers_read_in_several_jobs(spark, tmp_path):
    path = csv_files(tmp_path, **{f"f{i}": f"{'x,y' if i % 2 else 'y,x'}\n{i},{i}\n" for i in range(7)})
    headers = TB.csv_headers(spark, path, at_once=3)
    assert len(headers) == 7 and set(headers.values()) == {("x", "y"), ("y", "x")}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "a.csv").write_text("")
    with pytest.raises(ValueError, match="no CSV header"):
        TB.read_csv(spark, str(tmp_path / "empty"))


def test_a_lost_try_of_an_upsert_leaves_no_folder(spark, store, tmp_path, monkeypatch):


    schema = "student_id string, n int"
    store.overwrite("t", spark.createDataFrame([("S1", 1)], schema), ["student_id"])
    show, tries = TB.TableStore._show, []

    def lose(self, name, folders, seen):
        tries.append(name)
        if len(tries) < 3:
            raise TB.ChangedTable("another run was faster")
        return show(self, name, folders, seen)

    monkeypatch.setattr(TB.TableStore, "_show", lose)
    df = spark.createDataFrame([("S1", 2)], schema)
    store.upsert("t", df, df.schema, ["student_id"], ["student_id"])
    assert [tuple(r) for r in store.read("t", df.schema).collect()] == [("S1", 2)]
    assert len([d for d in (tmp_path / "tables" / "t").iterdir() if d.name.startswith("v=")]) == 2


def test_csv_headers_of_files_that_are_read_in_splits(spark, tmp_path):
    """The header is the first line of the file, not of a later split."""
    for name, columns in (("a", ["id", "name"]), ("b", ["name", "id"])):
        made = spark.range(20000).select(F.col("id").cast("string"), F.concat(F.lit("line\n"), "id").alias("name"))
        TB.write_csv(made.select(*columns).coalesce(1), f"{tmp_path}/t/{name}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        # Splits of a file would reach the limit in any order on a cluster.
        assert all(TB.file_lines(spark, f).rdd.getNumPartitions() == 1 for f in TB.csv_headers(spark, f"{tmp_path}/t"))
        assert set(TB.csv_headers(spark, f"{tmp_path}/t").values()) == {("id", "name"), ("name", "id")}
        got = TB.read_csv(spark, f"{tmp_path}/t", multiline=True)
        assert got.distinct().count() == 20000 and got.filter("name = concat('line\n', id)").count() == 40000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)

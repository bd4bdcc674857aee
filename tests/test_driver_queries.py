import pytest

import __spark_entry__ as entry_points
import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return compare.connect(SF)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    statement = entry_points.oracle_sql()[name]
    df = entry_points.queries()[name](spark, SF)
    assert compare.spark_result(df) == compare.sql_result(sql, statement)
    assert compare.types(df, sql.sql(statement)) == {}


def test_class_indicators_name_every_subject(spark):
    found = entry_points.queries()["class_kpis"](spark, SF).first()
    subjects = sorted(r.subject for r in entry_points.queries()["class_subjects"](spark, SF).collect())
    assert found.subjects == ",".join(subjects) and found.subject_count == len(subjects)

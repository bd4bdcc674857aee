"""Report tables laid out by student: bucketed once after a refresh, then joined without a shuffle.

``publish`` reduces the phase tables to what the read side joins, one shuffle each, and writes them as
Parquet tables bucketed and sorted by student. Reports and rosters of all students then read bucket by bucket:
no exchange on the student id, whatever the number of readers.

A bucket holds whole students. Attempts, of which one student may have very many, are reduced to a row of
metadata before they are written, with partial aggregates; the other tables have one row per student, grade and subject.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreflow import schemas as S
from scoreflow.functions.text import clean_id
from scoreflow.operators import consolidation, reports, roster
from scoreflow.sources.tables import conform

_TEXT = T.StringType()
META = T.StructType(
    [T.StructField("student_id", _TEXT), T.StructField("student_name", _TEXT), T.StructField("grade", T.IntegerType()),
     T.StructField("name", _TEXT)]
)
TOLD = T.StructType([*S.SUMMARIES.fields, *[T.StructField(c, _TEXT) for c in consolidation.EXPLANATION]])
SERVED = {"meta": META, "analytics": S.ANALYTICS, "told": TOLD, "overall": S.CONSOLIDATED}
LAYOUT = "layout"
#: Rows of the largest table in a bucket: some hundred megabytes of reports.
BUCKET_ROWS = 200_000


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


@dataclass(frozen=True)
class Served:
    """Published tables under ``path``, each in ``buckets`` buckets by student."""

    spark: SparkSession
    path: str
    buckets: int

    @cached_property
    def _names(self) -> dict[str, str]:
        """Catalog entries of the tables. They point at the files and last as long as the session's catalog."""
        prefix = f"served_{uuid.uuid4().hex}"
        for table, schema in SERVED.items():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(
                f"CREATE TABLE {prefix}_{table} ({columns}) USING parquet CLUSTERED BY (student_id) SORTED BY (student_id) "
                f"INTO {self.buckets} BUCKETS LOCATION '{_quoted(self.path)}/{table}'"
            )
        return {table: f"{prefix}_{table}" for table in SERVED}

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._names[name])

    def close(self) -> None:
        """Remove the catalog entries; the files stay."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def report_documents(self) -> DataFrame:
        """As :func:`reports.report_documents`, without a shuffle."""
        return reports.documents(*[self.table(n) for n in SERVED])

    def report_of(self, student_id: str) -> DataFrame:
        """Report of one student (id compared trimmed): one bucket of each table is read."""
        wanted = student_id.strip()
        return reports.documents(*[self.table(n).filter(F.col("student_id") == wanted) for n in SERVED])

    def class_roster(self) -> DataFrame:
        """As :func:`roster.class_roster`, without a shuffle."""
        names = self.table("meta").select("student_id", "name")
        done = self.table("overall").select("student_id", F.lit(True).alias("_done"))
        rows = roster.per_student(self.table("analytics")).join(names, "student_id", "left").join(done, "student_id", "left")
        return roster.listed(rows.withColumn("processed", F.coalesce("_done", F.lit(False))))


def buckets_for(rows: int, least: int) -> int:
    """Buckets for report tables whose largest has ``rows`` rows: a bucket, and so a task, does not grow with the data."""
    return max(least, -(-rows // BUCKET_ROWS))


def publish(
    spark: SparkSession, path: str, buckets: int,
    validated: DataFrame, analytics: DataFrame, insights: DataFrame, summaries: DataFrame, consolidated: DataFrame,
) -> Served:
    """Write the tables to the new folder ``path`` on shared storage.

    The layout is written last, so :func:`opened` never sees a part of them. Choose ``buckets`` so that a bucket
    of the largest table is some hundred megabytes; all four tables take the same number.
    """
    frames = {
        "meta": reports.named_metadata(validated),
        "analytics": analytics.withColumn("student_id", clean_id(F.col("student_id"))),
        "told": reports.trimmed_explained(summaries, insights),
        "overall": reports.first_consolidated(consolidated),
    }
    staging = f"writing_{uuid.uuid4().hex}"
    for name, df in frames.items():
        # One task for each bucket, hence one file.
        placed = conform(df.select(SERVED[name].names), SERVED[name]).repartition(buckets, "student_id")
        writer = placed.write.format("parquet").bucketBy(buckets, "student_id").sortBy("student_id")
        writer.option("path", f"{path}/{name}").mode("error").saveAsTable(f"{staging}_{name}")
        spark.sql(f"DROP TABLE {staging}_{name}")  # the entry only: a table with a path keeps its files
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("error").parquet(f"{path}/{LAYOUT}")
    return Served(spark, path, buckets)


def opened(spark: SparkSession, path: str) -> Served:
    """Tables published by any session; raises where ``publish`` did not end."""
    return Served(spark, path, spark.read.parquet(f"{path}/{LAYOUT}").head().buckets)

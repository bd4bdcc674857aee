"""New intake records as a stream: each micro-batch refreshes the students it names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from scoreflow.plans.refresh import MALFORMED, Run, intake_refresh
from scoreflow.schemas import INTAKE
from scoreflow.schemas import MALFORMED as MALFORMED_COLUMNS
from scoreflow.sources.tables import TableStore

BROKEN = "_malformed"
FORM = "_form"
ARRIVED = "_arrived"


def _with_broken(reader):
    schema = T.StructType([*INTAKE.fields, T.StructField(BROKEN, T.StringType())])
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested intake records of JSON files with the text of malformed lines and their file."""
    return _with_broken(spark.read).json(path).withColumn("_file", F.col("_metadata.file_path"))


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The same of JSON files that arrive in a folder."""
    stream = _with_broken(spark.readStream).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return stream.withColumn("_file", F.col("_metadata.file_path"))


def split_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Records that could be read, malformed lines as file and text). A line counts as malformed where it is
    no JSON object or a field has another type."""
    good = rows.filter(F.col(BROKEN).isNull()).select(INTAKE.names)
    # Spark refuses to read the column of malformed lines alone from a file.
    bad = rows.filter(F.col(BROKEN).isNotNull()).select(
        F.col("_file").alias("file"), F.coalesce(BROKEN, F.to_json(F.struct(INTAKE.names))).alias("text")
    )
    return good, bad


def first_seen(rows: DataFrame, within: str) -> DataFrame:
    """A stream's rows without repeats of a record that came at most ``within`` earlier, e.g. "7 days".

    The state store keeps a digest of each record for that time, counted from its first arrival, over batches and
    restarts from the same checkpoint. Time is that of the batch, so no record is late. Two malformed
    lines are repeats only within one file.
    """
    names = [c for c in rows.columns if c != "_file"]
    file = F.when(F.col(BROKEN).isNotNull(), F.col("_file")) if BROKEN in names and "_file" in rows.columns else F.lit(None)
    digest = F.sha2(F.to_json(F.struct(*names, file.cast("string").alias("_of"))), 256)
    marked = rows.withColumn(FORM, digest).withColumn(ARRIVED, F.current_timestamp()).withWatermark(ARRIVED, within)
    return marked.dropDuplicatesWithinWatermark([FORM]).drop(FORM, ARRIVED)


def start_intake(
    store: TableStore,
    records: DataFrame,
    checkpoint: str,
    run: Run,
    exam_date,
    refresh: Callable = intake_refresh,
    repeats_within: str | None = None,
) -> StreamingQuery:
    """Process what has arrived and stop.

    A replayed batch carries the same id, so it replaces its own rows. Malformed lines go to a
    table of their own with their file, and the rest of the batch goes on. With ``repeats_within`` a record
    that is sent again within that time counts once (see ``first_seen``); a checkpoint is used with one setting.
    """
    if repeats_within:
        records = first_seen(records, repeats_within)

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = replace(run, run_id=f"{run.run_id}-{batch_id}")
        arrived = replace(own, run_id=f"{own.run_id}-arrived")
        try:
            # Every look at the batch itself would read its files, and look for its repeats, once more.
            batch = store.scratch(arrived.work("records"), batch)
            if BROKEN in batch.columns:
                batch, bad = split_records(batch)
                if not bad.isEmpty():
                    store.append(MALFORMED, bad, MALFORMED_COLUMNS, own.run_id)
            if not batch.isEmpty():
                refresh(store, batch, exam_date, own)
        finally:
            store.drop(arrived.work("")[:-1])

    return (
        records.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

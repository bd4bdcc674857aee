"""Keyed writes as joins: upsert, keyed column update, insert-if-absent.

No side is forced to be broadcast: keys that replace stored rows are always merged (see ``rows.grows``), other
sides are broadcast only below the planner's size threshold. Skewed partitions of a merge join are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreflow.functions.rows import grows, own_shuffle
from scoreflow.functions.text import email_key, strip


def align_columns(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Canonical columns first, then the others; missing ones filled with a constant."""
    known = [F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns]
    return df.select(*known, *[F.col(c) for c in df.columns if c not in columns])


def typed_like(df: DataFrame, keys: list[str], target: DataFrame) -> DataFrame:
    """Keys cast to the target's types, so that text 1 and number 1 meet."""
    kinds = {k: target.schema[k].dataType for k in keys}
    return df.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})


def without_keys(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key tuple does not occur in ``new`` (null keys compare equal).

    The keys are not made distinct first: the anti join does not need it, and a side that
    comes straight from its shuffle lets the planner split a hot key of the other side.
    """
    replaced = typed_like(new, keys, existing).select(keys)
    same = [existing[k].eqNullSafe(replaced[k]) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return existing.join(grows(replaced), condition, "left_anti")


def upsert_rows(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` plus the existing rows with other keys."""
    kept = without_keys(existing, new, keys)
    return kept.unionByName(typed_like(new, keys, existing), allowMissingColumns=True)


def _with_column_after(df: DataFrame, name: str, after: str) -> DataFrame:
    if name in df.columns:
        return df
    columns = list(df.columns)
    columns.insert(columns.index(after) + 1 if after in columns else len(columns), name)
    return df.withColumn(name, F.lit("")).select(columns)


def update_by_email(
    users: DataFrame, updates: DataFrame, order: str | None = None, column: str = "student_id"
) -> DataFrame:
    """Set ``column`` of the users whose e-mail occurs in ``updates``.

    With several updates for one e-mail the last by ``order`` wins; a blank value clears the cell.
    """
    value = strip(F.coalesce(F.col(column), F.lit("")))
    position: Column = F.col(order) if order else value
    last = (
        updates.select(email_key(F.col("email")).alias("_email"), position.alias("_at"), value.alias("_value"))
        .filter(F.col("_email").isNotNull())
        .groupBy("_email")
        .agg(F.max_by("_value", F.struct("_at", "_value")).alias("_value"))
    )
    full = _with_column_after(users, column, "role")
    keyed = full.withColumn("_email", email_key(F.col("email")))
    return (
        keyed.join(last.withColumn("_email", own_shuffle(F.col("_email"))), "_email", "left")
        .withColumn(column, F.coalesce("_value", column))
        .select(full.columns)
    )


def insert_if_absent(
    existing: DataFrame, new: DataFrame, order: str, columns: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Register new rows by e-mail: (table with the accepted rows, rejected rows).

    A row is rejected when its e-mail is taken, by the table or by an earlier new row.
    """
    keyed = new.withColumn("_email", email_key(F.col("email")))
    taken = existing.select(email_key(F.col("email")).alias("_email")).distinct()
    first = keyed.groupBy("_email").agg(F.min(order).alias("_first"))
    winner = (
        first.join(taken.withColumn("_taken", F.lit(True)), "_email", "left")
        .select("_email", F.when(F.col("_taken").isNull(), F.col("_first")).alias("_first"))
    )
    judged = keyed.join(winner.withColumn("_email", own_shuffle(F.col("_email"))), "_email", "left").withColumn(
        "_ok", F.coalesce(F.col(order) == F.col("_first"), F.lit(False))
    )
    names = [c for c in new.columns if c != order or c in columns]
    accepted = judged.filter("_ok").withColumn("email", F.col("_email")).select(names)
    rejected = judged.filter(~F.col("_ok")).select(new.columns)
    old = align_columns(existing, columns)
    return old.unionByName(align_columns(accepted, columns), allowMissingColumns=True), rejected

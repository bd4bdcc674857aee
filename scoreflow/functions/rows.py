"""Row helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Spark limits row numbers on the map side up to this many rows of a group
#: (``spark.sql.optimizer.windowGroupLimitThreshold``).
MAP_SIDE_LIMIT = 1000


def with_values(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add or replace columns whose expressions are costly and used several times below.

    The optimizer copies the expression of a plain column into every filter on it. The
    columns of a generator are not copied, so each value is computed once per row.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select(*kept, F.inline(F.array(row)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for a costly value that is needed several times inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def own_shuffle(key: Column) -> Column:
    """Text key of an aggregated join side, written so that the join shuffles that side again.

    The adaptive planner splits a skewed key of the other side only where both sides come
    straight from a shuffle of the join. The aggregated side is the small one.
    """
    return F.concat(key, F.lit(""))


def grows(side: DataFrame) -> DataFrame:
    """Side of a join that grows with the data: it is shuffled and merged, never sent whole to every task.

    The planner takes the compressed size of files for the size of stored rows, so it would broadcast
    millions of short keys through the driver.
    """
    return side.hint("merge")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, place: str, salts: int = 64) -> DataFrame:
    """The first ``k`` rows of each group in the total ``order``, numbered in column ``place``.

    Up to ``MAP_SIDE_LIMIT`` rows Spark keeps only a task's first ``k`` before the exchange. For a larger ``k``
    the rows of a group are dealt to ``salts`` parts, the first ``k`` of each part go on, and the group is put
    together from those: no task sorts a whole group, whatever its size.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if k > MAP_SIDE_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in keys]), F.lit(salts)).alias("_salt")
        salted = df.select("*", salt)
        part = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
        df = salted.withColumn("_part", part).filter(F.col("_part") <= k).drop("_part", "_salt")
    whole = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(place, whole).filter(F.col(place) <= k)

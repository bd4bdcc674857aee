"""Phase 1: per (student, grade, subject) metrics over the attempts in date order.

Both branches shrink before they shuffle, so a group that holds a large share of all
attempts reaches its reducer as a few rows per map task:

* counts, sums and first score are partial aggregates over integer buffers of fixed size;
* the last ``k`` attempts go through ``row_number() <= k``, which Spark turns into a
  group limit on the map side (a larger ``k`` is taken in two levels).

Both are hash-partitioned by the same keys, so joining them adds no exchange. All sums are
exact for every finite score, so no order of rows or tasks moves a result. Scores from
2**20 on are summed apart; a scan of a stored table skips that branch by its statistics.

The same sums are also kept as a state for each group (:func:`group_states`). States of disjoint sets of
attempts merge into the state of all of them, so new attempts need no second look at the old ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from scoreflow.functions import numbers as N
from scoreflow.functions import rules
from scoreflow.functions.rows import grows, top_rows, with_values
from scoreflow.operators.validation import usable_attempts
from scoreflow.schemas import ANALYTICS, DEFAULTS, EXAM_TYPES, GROUP_KEY, STATES, Thresholds

# Total order of attempts; ties on the day are common.
ATTEMPT_ORDER = ["exam_date", "attempt_number", "exam_id"]
SUMS = [f.name for f in STATES.fields if f.name not in {*GROUP_KEY, "first", "last", "wide"}]


def attempt_order() -> Column:
    return F.struct(*ATTEMPT_ORDER)


def _scored_attempt() -> Column:
    return F.struct(*ATTEMPT_ORDER, "score")


def last_attempts(df: DataFrame, k: int) -> DataFrame:
    """The last ``k`` attempts of each group, numbered from the latest (``recency`` = 1)."""
    return top_rows(df, GROUP_KEY, [F.col(c).desc() for c in ATTEMPT_ORDER], k, "recency")


def _mean_of_few(scores: str) -> str:
    """Mean of a short array: exact where all are narrow, else summed in ascending order."""
    exact = f"aggregate({scores}, cast(0 as decimal(38,10)), (a, x) -> cast(a + try_cast(x as decimal(18,10)) as decimal(38,10)))"
    plain = f"aggregate(array_sort({scores}), 0D, (a, x) -> a + x / size({scores}))"
    return f"if(exists({scores}, x -> {N.is_wide('x')}), {plain}, cast({exact} as double) / size({scores}))"


def recent_average(df: DataFrame, k: int = 2) -> DataFrame:
    """Latest score and mean of the last ``k`` scores (of all, where there are fewer)."""
    sums = N.narrow_sums("score", [], squares=False)
    # A group's rows come in the order of the window, so the sum of wide ones has one order too.
    own = {"latest_score": "max(if(recency = 1, score, null))", "far": f"sum(if({N.is_wide('score')}, score / {k}D, null))"}
    rows = last_attempts(usable_attempts(df), k).groupBy(*GROUP_KEY).agg(*N.columns(own | sums))
    mean = F.expr(f"{N.narrow_total()} / n + if(far is null, 0D, far * ({k}D / n))")
    return rows.select(*GROUP_KEY, "latest_score", N.round_even(mean, 2).alias("recent_avg_score"))


def _sums(df: DataFrame) -> DataFrame:
    """Exact sums and first attempt of each group."""
    first = F.min_by("score", attempt_order()).alias("first_score")
    return df.groupBy(*GROUP_KEY).agg(*N.columns(N.narrow_sums("score", EXAM_TYPES)), first)


def _wide(df: DataFrame) -> DataFrame:
    kinds = ", ".join(f"'{kind}'" for kind in EXAM_TYPES)
    return N.wide_sums(df, GROUP_KEY, "score", f"if(exam_type in ({kinds}), exam_type, 'other')")


def _with_figures(sums: DataFrame, wide: DataFrame) -> DataFrame:
    """Counts, means, deviation and gap from the sums of both ranges."""
    return _figures(sums.join(N.wide_figures(wide, GROUP_KEY, EXAM_TYPES), GROUP_KEY, "left"), sums.columns)


def _figures(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same of rows that hold both sums; ``columns``: names that go on where they are keys or scores."""
    figures = {"average": N.joint_mean()} | N.deviation_steps()
    figures |= {"real": N.joint_mean("_real"), "mock": N.joint_mean("_mock")}
    # A step for each figure: in one, the generated method is too long to be compiled, and every row is interpreted.
    for name, text in figures.items():
        rows = with_values(rows, {name: F.expr(text)})
    kept = [c for c in columns if c in {*GROUP_KEY, "first_score", "first", "last"}]
    return rows.select(
        *kept, F.col("n").alias("attempt_count"), N.round_even(F.col("average"), 2).alias("average_score"),
        rules.settled(F.col("spread")).alias("deviation"), N.round_even(F.col("real") - F.col("mock"), 2).alias("mock_vs_real_gap"),
    )


def mock_real_gap(df: DataFrame) -> DataFrame:
    """Mean of real minus mean of mock scores; null where one kind is missing."""
    attempts = usable_attempts(df)
    return _with_figures(_sums(attempts), _wide(attempts)).select(*GROUP_KEY, "mock_vs_real_gap")


def _judged(rows: DataFrame, thresholds: Thresholds) -> DataFrame:
    count, first, last = F.col("attempt_count"), F.col("first_score"), F.col("latest_score")
    average, deviation = F.col("average_score"), F.col("deviation")
    return (
        rows.withColumn("trend", rules.trend(count, first, last, thresholds))
        .withColumns(
            {
                "improvement_velocity": rules.velocity(count, first, last),
                "consistency_score": rules.consistency(count, deviation),
                "volatility_level": rules.volatility(count, deviation, thresholds),
                "performance_band": rules.band(average, thresholds),
                "risk_flag": rules.risk(average, F.col("trend"), thresholds),
                "data_confidence_level": rules.confidence(count, thresholds),
            }
        )
        .select(ANALYTICS.names)
    )


def subject_analytics(df: DataFrame, window: int = 2, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """One analytics row per student, grade and subject."""
    attempts = usable_attempts(df)
    rows = _with_figures(_sums(attempts), _wide(attempts)).join(grows(recent_average(attempts, window)), GROUP_KEY)
    return _judged(rows, thresholds)


def group_states(df: DataFrame, window: int = 2) -> DataFrame:
    """One state row per group: sums, first attempt, last ``window`` attempts (latest first), wide sums.

    Its size does not depend on the number of attempts.
    """
    if window < 1:
        raise ValueError("k must be at least 1")
    attempts = usable_attempts(df)
    sums = N.columns(N.narrow_sums("score", EXAM_TYPES))
    # Spark's own aggregate of the greatest values holds at most ``window`` attempts of a group in each task.
    last = InternalFunction.collect_top_k(_scored_attempt(), window, False).alias("last")
    totals = attempts.groupBy(*GROUP_KEY).agg(*sums, F.min(_scored_attempt()).alias("first"), last)
    rows = totals.join(_wide(attempts), GROUP_KEY, "left")
    return rows.select(*GROUP_KEY, *SUMS, "first", "last", F.expr(f"{N.merged_wide(f'coalesce(wide, {N.NO_WIDE})')} as wide"))


def merge_states(states: list[DataFrame], window: int = 2) -> DataFrame:
    """States of the union of disjoint sets of attempts. A group has one row in each frame at most."""
    rows = reduce(DataFrame.unionByName, states)
    return rows.groupBy(*GROUP_KEY).agg(
        *N.columns({c: f"sum({c})" for c in SUMS}), F.min("first").alias("first"),
        F.slice(F.sort_array(F.flatten(F.collect_list("last")), asc=False), 1, window).alias("last"),
        F.flatten(F.collect_list("wide")).alias("wide"),
    ).withColumn("wide", F.expr(N.merged_wide("wide")))


def analytics_of_states(states: DataFrame, window: int = 2, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """The analytics rows of the groups, from their states alone."""
    recent = _mean_of_few(f"transform(slice(last, 1, {window}), a -> a.score)")
    # A row holds its own wide sums, so nothing is joined and the rows stay where they lie.
    rows = _figures(N.with_wide_figures(states, EXAM_TYPES), states.columns).withColumns(
        {
            "first_score": F.expr("first.score"), "latest_score": F.expr("last[0].score"),
            "recent_avg_score": N.round_even(F.expr(recent), 2),
        }
    )
    return _judged(rows, thresholds)


def phase_counters(df: DataFrame) -> DataFrame:
    """Distinct students and records of an output table."""
    return df.agg(
        F.countDistinct("student_id").alias("students"),
        F.count(F.lit(1)).alias("records"),
    )

import datetime as dt
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import attempts, scored, table
from scoreflow import schemas as S
from scoreflow.operators import metrics


def one(spark, *args, **kwargs):
    rows = metrics.subject_analytics(scored(spark, *args, **kwargs)).collect()
    assert len(rows) == 1
    return rows[0]


def test_single_attempt(spark):
    r = one(spark, [70])
    assert (r.trend, r.improvement_velocity, r.consistency_score) == ("insufficient_data", 0.0, 1.0)
    assert (r.volatility_level, r.mock_vs_real_gap, r.data_confidence_level) == ("unknown", None, "low")


@pytest.mark.parametrize(
    "scores, trend, velocity, level",
    [
        ([60, 65], "stable", 2.5, "low"),
        ([60, 66], "improving", 3.0, "low"),
        ([65, 60], "stable", -2.5, "low"),
        ([66, 60], "declining", -3.0, "low"),
        ([60, 70], "improving", 5.0, "medium"),
        ([50, 70], "improving", 10.0, "high"),
        ([60, 70, 60, 70], "improving", 2.5, "medium"),
    ],
)
def test_limits(spark, scores, trend, velocity, level):
    r = one(spark, scores)
    assert (r.trend, r.improvement_velocity, r.volatility_level) == (trend, velocity, level)


def test_population_deviation(spark):
    r = one(spark, [42, 42, 39])
    assert (r.average_score, r.recent_avg_score, r.improvement_velocity, r.consistency_score) == (41.0, 40.5, -1.0, 0.414)


@pytest.mark.parametrize("average, band", [(59.99, "low"), (60, "medium"), (79.99, "medium"), (80, "high")])
def test_bands(spark, average, band):
    assert one(spark, [average]).performance_band == band


@pytest.mark.parametrize(
    "scores, risk", [([66, 50], "high"), ([50, 50], "medium"), ([90, 70], "medium"), ([70, 70], "low")]
)
def test_risk(spark, scores, risk):
    assert one(spark, scores).risk_flag == risk


@pytest.mark.parametrize("count, level", [(2, "low"), (3, "medium"), (4, "medium"), (5, "high")])
def test_confidence(spark, count, level):
    assert one(spark, [70] * count).data_confidence_level == level


def test_gap_needs_both_kinds(spark):
    assert one(spark, [60, 65], ["real", "mock"]).mock_vs_real_gap == -5.0
    assert one(spark, [60, 65], ["real", "real"]).mock_vs_real_gap is None


def test_ties_on_a_day_follow_the_attempt(spark):
    rows = [("S1", 5, "Math", "A", "mock", 2, 70, "2024-01-01"), ("S1", 5, "Math", "B", "mock", 1, 60, "2024-01-01")]
    r = metrics.subject_analytics(attempts(spark, rows)).first()
    assert (r.latest_score, r.trend) == (70.0, "improving")
    same = [("S1", 5, "Math", e, "mock", 1, s, "2024-01-01") for e, s in (("MOCK_10", 40), ("MOCK_2", 90))]
    assert metrics.subject_analytics(attempts(spark, same)).first().latest_score == 90.0


def test_text_input_and_dropped_rows(spark):
    rows = [
        ("S1", "N", "5", "Math", "E1", "mock", "1", "50", "100", "2024-01-01"),
        ("S1", "N", "5", "Math", "E2", "mock", "1", "bad", "100", "2024-01-02"),
        ("S1", "N", "5", "Math", "E3", "mock", "1", "60", "100", "2024-13-02"),
        (None, "N", "5", "Math", "E4", "mock", "1", "60", "100", "2024-01-04"),
        ("S1", "N", None, "Math", "E5", "mock", "1", "60", "100", "2024-01-04"),
    ]
    out = metrics.subject_analytics(spark.createDataFrame(rows, S.RAW)).collect()
    assert [(r.student_id, r.grade, r.attempt_count, r.average_score) for r in out] == [("S1", 5, 1, 50.0)]


def brute_force(rows, k=2):
    groups = {}
    for s, g, sub, e, kind, n, score, day in rows:
        groups.setdefault((s, g, sub), []).append((day, n, e, float(score), kind))
    out = []
    for key, items in groups.items():
        items.sort()
        scores = [i[3] for i in items]
        real = [i[3] for i in items if i[4] == "real"]
        mock = [i[3] for i in items if i[4] == "mock"]
        n, std = len(scores), float(np.std(scores))
        diff = scores[-1] - scores[0]
        avg = float(np.round(np.mean(scores), 2))
        trend = "insufficient_data" if n < 2 else "improving" if diff > 5 else "declining" if diff < -5 else "stable"
        out.append(
            (
                *key, n, avg, scores[-1], float(np.round(np.mean(scores[-k:]), 2)), trend,
                0.0 if n < 2 else float(np.round(diff / n, 2)),
                1.0 if n < 2 else float(np.round(1 / (1 + std), 3)),
                "unknown" if n < 2 else "low" if std < 5 else "medium" if std < 10 else "high",
                float(np.round(np.mean(real) - np.mean(mock), 2)) if real and mock else None,
                "low" if avg < 60 else "medium" if avg < 80 else "high",
                "high" if avg < 60 and trend == "declining" else "medium" if avg < 60 or trend == "declining" else "low",
                "high" if n >= 5 else "medium" if n >= 3 else "low",
            )
        )
    return sorted(out, key=str)


def random_rows(seed, hot=0):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        hit = i < hot
        rows.append(
            (
                "HOT" if hit else f"S{rng.randrange(40)}", 7 if hit else rng.randrange(1, 4),
                "Math" if hit else rng.choice(["Math", "Art"]), f"E{i}", rng.choice(["mock", "real"]),
                rng.randrange(1, 4), rng.randrange(0, 401) / 4,
                str(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(30))),
            )
        )
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot, k", [(1, 0, 2), (2, 300, 2), (3, 300, 3)])
def test_against_brute_force_with_a_group_of_a_third(spark, seed, hot, k):
    rows = random_rows(seed, hot)
    got = metrics.subject_analytics(attempts(spark, rows).repartition(9), window=k)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(rows, k)


def decimal_rows(seed):
    rng = random.Random(seed)
    return [(*r[:6], rng.randrange(0, 10001) / 100 if i % 2 else rng.randrange(0, 1001) / 10, r[7]) for i, r in enumerate(random_rows(seed, 300))]


def test_decimal_scores_do_not_depend_on_partitions(spark):
    rows = [r for seed in range(4) for r in decimal_rows(seed)]
    rows = [(*r[:3], f"{r[3]}-{i}", *r[4:]) for i, r in enumerate(rows)]
    want = None
    for parts, order in ((1, 1), (5, 2), (16, 3), (97, 4)):
        random.Random(order).shuffle(rows)
        df = attempts(spark, sorted(rows, key=lambda r: hash((order, r)))).repartition(parts)
        got = table(metrics.subject_analytics(df, window=3).na.fill(-99.0))
        averages = table(metrics.recent_average(df, 5))
        want = want or (got, averages)
        assert (got, averages) == want


def test_decimal_means_are_those_of_exact_numbers(spark):
    rows = decimal_rows(8)
    got = {(r.student_id, r.grade, r.subject): r for r in metrics.subject_analytics(attempts(spark, rows)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault((r[0], r[1], r[2]), []).append(Fraction(str(r[6])))
    for key, scores in groups.items():
        mean = sum(scores) / len(scores)
        assert abs(Fraction(got[key].average_score) - mean) <= Fraction(1, 200) + Fraction(1, 10**9)
        spread = float(sum((x - mean) ** 2 for x in scores) / len(scores)) ** 0.5
        if len(scores) > 1:
            assert abs(got[key].consistency_score - 1 / (1 + spread)) < 0.000501


def test_nan_and_infinite_scores_are_left_out(spark):
    rows = scored(spark, [50, 60, 70])
    odd = rows.withColumn("score", F.when(F.col("exam_id") == "E1", float("nan")).when(F.col("exam_id") == "E2", float("inf")).otherwise(F.col("score")))
    r = metrics.subject_analytics(odd).first()
    assert (r.attempt_count, r.average_score, r.performance_band) == (1, 50.0, "low")


def test_input_order_does_not_matter(spark):
    rows = random_rows(5, 300)
    first = table(metrics.subject_analytics(attempts(spark, rows)).na.fill(-99.0))
    random.Random(9).shuffle(rows)
    assert table(metrics.subject_analytics(attempts(spark, rows).repartition(13)).na.fill(-99.0)) == first


def test_group_limit_runs_before_the_shuffle(spark, tmp_path):
    """A hot group leaves each task as a few rows: limit and partial aggregate come first."""
    path = str(tmp_path / "a")
    attempts(spark, random_rows(1)).write.parquet(path)
    plan = metrics.subject_analytics(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if line.strip()]
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 4
    assert any("partial_sum" in lines[i + 1] for i in shuffles)
    assert any("WindowGroupLimit" in lines[i + 1] and "Partial" in lines[i + 1] for i in shuffles)
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert "PushedFilters: [IsNotNull(student_id), IsNotNull(grade)" in plan
    # Two of the exchanges are those of wide scores; their scan skips row groups without any.
    wide = metrics._wide(spark.read.parquet(path)).select("student_id")._jdf.queryExecution().optimizedPlan().toString()
    assert ">= 1048576.0) OR (score" in wide
    assert "max_score" not in plan.split("ReadSchema")[1]


def test_joined_branches_add_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "a")
    attempts(spark, random_rows(1)).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = metrics.subject_analytics(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # One each for the two branches, two for the wide scores.
    assert plan.count("Exchange hashpartitioning") == 4 and "SortMergeJoin" in plan


def test_recent_average_rejects_no_rows(spark):
    with pytest.raises(ValueError):
        metrics.recent_average(scored(spark, [1]), 0)


def test_phase_counters(spark):
    df = metrics.subject_analytics(attempts(spark, random_rows(1)))
    r = metrics.phase_counters(df).first()
    assert r.records == df.count() and r.students == df.select("student_id").distinct().count()


def plain(scores):
    """Mean and population deviation of exact fractions."""
    exact = [Fraction(x) for x in scores]
    mean = sum(exact) / len(exact)
    return float(mean), float(sum((x - mean) ** 2 for x in exact) / len(exact)) ** 0.5


@pytest.mark.parametrize(
    "scores",
    [[1e21], [1e300, 1e300], [1e14, 50.0], [50.0, 1e14], [1e14, 1e14 + 4, 1e14 + 8], [2.0**20, 2.0**20 - 0.5, 1.25],
     [1e21, 1e21 + 2**18, 3.0], [1.7e308, 1.7e308, 1.0], [4e15 + 1, 4e15 + 3], [1048576.25] * 3],
)
def test_every_finite_score_has_exact_figures(spark, scores):
    r = one(spark, scores)
    mean = float(sum(map(Fraction, scores)) / len(scores))
    assert r.average_score == pytest.approx(mean, rel=1e-14, abs=0.00501) and r.attempt_count == len(scores)
    exact = [Fraction(x) for x in scores]
    spread = sum((x - sum(exact) / len(exact)) ** 2 for x in exact) / len(exact)
    deviation = float(spread) ** 0.5 if spread < 10**300 else float("inf")
    want = 1.0 if len(scores) == 1 else round(1 / (1 + deviation), 3)
    assert r.consistency_score == pytest.approx(want, abs=1e-9)
    assert r.recent_avg_score == pytest.approx(float(sum(exact[-2:]) / len(exact[-2:])), rel=1e-14, abs=0.00501)
    states = metrics.group_states(scored(spark, scores))
    assert metrics.analytics_of_states(states).collect() == [r]


def test_wide_scores_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(8)
    scores = [rng.choice([rng.uniform(0, 100), rng.uniform(1e6, 1e9), 10.0 ** rng.randrange(7, 25), 0.1]) for _ in range(400)]
    df = scored(spark, scores)
    seen = {tuple(metrics.subject_analytics(df.orderBy(F.rand(seed)).repartition(1 + seed)).first()) for seed in range(4)}
    assert len(seen) == 1
    mean, _ = plain(scores)
    assert next(iter(seen))[4] == pytest.approx(mean, rel=1e-13)


def many_attempts(spark, n=900, seed=4):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    rows = [
        (f"S{rng.randrange(5)}", 5, rng.choice(["Art", "Math"]), f"E{i}", rng.choice(["mock", "real"]), 1 + i % 3,
         rng.choice([round(rng.uniform(0, 100), 2), round(rng.uniform(0, 100), 6), 1e21 * rng.random() if i % 50 == 0 else 7.5]),
         str(start + dt.timedelta(days=rng.randrange(40))))
        for i in range(n)
    ]
    return attempts(spark, rows)


@pytest.mark.parametrize("window", [1, 2, 7])
def test_merged_states_equal_a_full_recompute(spark, window):
    df = many_attempts(spark).withColumn("part", F.pmod(F.xxhash64("exam_id"), F.lit(4)))
    parts = [metrics.group_states(df.filter(F.col("part") == i).drop("part"), window) for i in range(4)]
    whole = metrics.group_states(df.drop("part"), window)
    merged = metrics.merge_states([metrics.merge_states(parts[:2], window), parts[3], parts[2]], window)
    assert table(merged) == table(whole)
    got = metrics.analytics_of_states(merged, window)
    assert table(got) == table(metrics.subject_analytics(df.drop("part"), window))


def test_state_size_does_not_grow(spark):
    row = metrics.group_states(many_attempts(spark, 1500), 3).first()
    assert len(row.last) == 3 and len(row.wide) <= 3 * 30


def test_metrics_use_no_decimal_buffers(spark):
    """The sums are bigint buffers; decimals appear only after the last exchange."""
    plan = metrics._sums(many_attempts(spark, 10))._jdf.queryExecution().executedPlan().toString()
    assert "decimal" not in plan


def test_large_windows_are_taken_in_two_levels(spark):
    rows = [("S1", 5, "Art", f"E{i:05}", "mock", 1, i % 101, "2024-01-01") for i in range(6000)]
    rows += [(f"S{2 + i}", 5, "Art", "E", "mock", 1, 3, "2024-01-01") for i in range(300)]
    df = attempts(spark, rows).repartition(8)
    for k in (3, 1000, 1001, 5000, 9000):
        got = metrics.last_attempts(df, k)
        own = sorted((r.recency, r.exam_id) for r in got.filter("student_id = 'S1'").collect())
        assert own == [(i + 1, f"E{5999 - i:05}") for i in range(min(k, 6000))]
        assert got.filter("student_id <> 'S1'").count() == 300
    # The first level deals a group to parts, so no task holds the whole of it.
    parts = metrics.last_attempts(df, 1001)._jdf.queryExecution().optimizedPlan().toString()
    assert parts.count("row_number()") == 2 and "_salt" in parts

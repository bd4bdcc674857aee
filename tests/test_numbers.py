import random

import numpy as np
from pyspark.sql import functions as F

from scoreflow.functions import numbers as N


def values(spark, column, data, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_round_tenth_follows_the_exact_binary_value(spark):
    rng = random.Random(1)
    data = [66.35, 0.25, 0.75, 0.35, 2.5, 0.05, 0.15, 99.95, 0.0, 100.0, 1234.45, 1e6 + 0.25]
    data += [round(rng.uniform(0, 100), 2) for _ in range(3000)]
    data += [sum(round(rng.uniform(0, 100), 2) for _ in range(3)) / 3 for _ in range(1000)]
    assert values(spark, N.round_tenth, data) == [round(x, 1) for x in data]


def test_round_even_scales_like_numpy(spark):
    rng = random.Random(2)
    data = [2.675, 0.125, 0.375, 2.5, -2.675, -0.125] + [rng.uniform(-100, 100) for _ in range(2000)]
    assert values(spark, lambda c: N.round_even(c, 2), data) == [float(np.round(x, 2)) for x in data]


def test_to_number_takes_plain_numbers_only(spark):
    data = ["1", " 2.5 ", "+3", "-.5", "4.", "1e2", "1.5d", "1,000", "abc", "", None, "0x1f", "1_0", "NaN"]
    expected = [1.0, 2.5, 3.0, -0.5, 4.0, 100.0] + [None] * 8
    assert values(spark, N.to_number, data, "string") == expected


def test_to_moment_takes_whole_dates_only(spark):
    data = ["2024-02-01", " 2024-02-01 10:30:00", "2024-02-01T10:30", "2024-02", "2024", "2024-02-30", "01/02/2024", "", None]
    got = [None if v is None else str(v) for v in values(spark, N.to_moment, data, "string")]
    assert got[:3] == ["2024-02-01 00:00:00", "2024-02-01 10:30:00", "2024-02-01 10:30:00"]
    assert got[3:] == [None] * 6


def test_steady_mean_does_not_depend_on_row_order(spark):
    rng = random.Random(3)
    data = [round(rng.uniform(0, 100), 2) for _ in range(500)]
    means = set()
    for seed in range(4):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame([(v,) for v in data], "x double").repartition(7)
        means.add(df.agg(N.steady_mean(F.col("x"))).first()[0])
    assert len(means) == 1


def test_finite(spark):
    assert values(spark, N.finite, [1.0, float("nan"), float("inf"), float("-inf"), None]) == [1.0, None, None, None, None]

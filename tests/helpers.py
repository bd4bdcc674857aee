"""Small builders for tests."""

import datetime as dt

from scoreflow import schemas as S


def attempts(spark, rows):
    """Rows of (student, grade, subject, exam, type, attempt, score, day)."""
    data = [
        (s, f"Name {s}", g, sub, e, kind, n, float(score), 100.0, dt.date.fromisoformat(day))
        for s, g, sub, e, kind, n, score, day in rows
    ]
    return spark.createDataFrame(data, S.VALIDATED)


def scored(spark, scores, kinds=None, subject="Math", student="S1"):
    """One group whose scores are a day apart."""
    kinds = kinds or ["mock"] * len(scores)
    start = dt.date(2024, 1, 1)
    rows = [
        (student, 5, subject, f"E{i}", kind, 1, score, str(start + dt.timedelta(days=i)))
        for i, (score, kind) in enumerate(zip(scores, kinds))
    ]
    return attempts(spark, rows)


def table(df):
    return sorted(tuple(r) for r in df.collect())

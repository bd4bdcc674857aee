"""Rule cascades as column expressions. Texts and ranks are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreflow.functions.numbers import round_even
from scoreflow.schemas import DEFAULTS, Thresholds

# --- metric rules -------------------------------------------------------------------


def trend(count: Column, first: Column, last: Column, t: Thresholds = DEFAULTS) -> Column:
    change = last - first
    return (
        F.when(count < 2, "insufficient_data")
        .when(change > t.trend_delta, "improving")
        .when(change < -t.trend_delta, "declining")
        .otherwise("stable")
    )


def velocity(count: Column, first: Column, last: Column) -> Column:
    """Change per attempt; the divisor is the number of attempts."""
    return F.when(count < 2, F.lit(0.0)).otherwise(round_even((last - first) / count, 2))


def settled(std: Column) -> Column:
    """Deviation without the last noise digits, so the merge order cannot move a limit case."""
    return round_even(std, 9)


def consistency(count: Column, std: Column) -> Column:
    return F.when(count < 2, F.lit(1.0)).otherwise(round_even(1 / (1 + std), 3))


def volatility(count: Column, std: Column, t: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(count < 2, "unknown")
        .when(std < t.low_std, "low")
        .when(std < t.medium_std, "medium")
        .otherwise("high")
    )


def band(average: Column, t: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(average < t.low_score, "low")
        .when(average < t.high_score, "medium")
        .otherwise("high")
    )


def risk(average: Column, trend_: Column, t: Thresholds = DEFAULTS) -> Column:
    low, falling = average < t.low_score, trend_ == "declining"
    return F.when(low & falling, "high").when(low | falling, "medium").otherwise("low")


def confidence(count: Column, t: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(count >= t.high_confidence, "high")
        .when(count >= t.medium_confidence, "medium")
        .otherwise("low")
    )


# --- insight rules ------------------------------------------------------------------


def _finding(issue: str, cause: str, urgency: str) -> Column:
    return F.struct(
        F.lit(issue).alias("primary_issue"),
        F.lit(cause).alias("root_cause_category"),
        F.lit(urgency).alias("urgency_level"),
    )


def finding(average: Column, trend_: Column, t: Thresholds = DEFAULTS) -> Column:
    """Primary issue, root cause and urgency of a subject row as one struct."""
    low, falling = average < t.low_score, F.coalesce(trend_ == "declining", F.lit(False))
    return (
        F.when(
            low & falling,
            _finding(
                "Consistently low and declining performance",
                "Conceptual gaps with poor reinforcement",
                "high",
            ),
        )
        .when(low, _finding("Low overall performance", "Weak foundational understanding", "medium"))
        .when(
            falling,
            _finding("Performance regression", "Inconsistent preparation or focus", "medium"),
        )
        .otherwise(_finding("No major academic concern", "Healthy learning pattern", "low"))
    )


def under_pressure(gap: Column, t: Thresholds = DEFAULTS) -> Column:
    """Real exams clearly below mock exams; a missing gap is not pressure."""
    return F.coalesce(gap < t.pressure_gap, F.lit(False))


def secondary_issue(volatility_: Column, gap: Column, t: Thresholds = DEFAULTS) -> Column:
    return (
        F.when(volatility_ == "high", "Highly inconsistent performance")
        .when(under_pressure(gap, t), "Exam pressure affecting real exam performance")
        .otherwise("None observed")
    )


def focus_area(urgency: Column) -> Column:
    return (
        F.when(urgency == "high", "Immediate concept revision and guided practice")
        .when(urgency == "medium", "Structured revision and consistency building")
        .otherwise("Maintain current learning approach")
    )


# --- display rules ------------------------------------------------------------------


def score_colour(score: Column) -> Column:
    """``score`` is a double, null where the cell held no number."""
    return F.when(score >= 70, "green").when(score >= 50, "amber").when(score < 50, "red").otherwise("amber")


def _rising(text: Column) -> Column:
    return text.contains("up") | text.contains("improv")


def _falling(text: Column) -> Column:
    return text.contains("down") | text.contains("declin")


def trend_colour(trend_: Column) -> Column:
    text = F.lower(trend_)
    return F.when(_rising(text), "green").when(_falling(text), "red").otherwise("amber")


def trend_caption(trend_: Column) -> Column:
    text = F.lower(trend_)
    return (
        F.when(_rising(text), "↑ Improving").when(_falling(text), "↓ Declining").otherwise("— Stable")
    )


def is_rising(trend_: Column) -> Column:
    return F.coalesce(_rising(F.lower(trend_)), F.lit(False))


def is_falling(trend_: Column) -> Column:
    return F.coalesce(_falling(F.lower(trend_)), F.lit(False))


def risk_rank(risk_: Column) -> Column:
    """Critical > High > Medium > Low > anything else, whatever the letter case."""
    text = F.lower(risk_)
    return (
        F.when(text == "critical", 4)
        .when(text == "high", 3)
        .when(text == "medium", 2)
        .when(text == "low", 1)
        .otherwise(0)
    )


def confidence_label(level: Column) -> Column:
    """Capitalized level, ``Unknown`` where it is missing."""
    text = F.when(F.coalesce(level, F.lit("")) == "", "unknown").otherwise(level)
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 2**31 - 1)))


def confidence_percent(label: Column) -> Column:
    return (
        F.when(label == "High", 100).when(label == "Medium", 60).when(label == "Low", 30).otherwise(10)
    )


def progress_percent(score: Column) -> Column:
    return F.least(F.coalesce(score, F.lit(0.0)), F.lit(100.0))

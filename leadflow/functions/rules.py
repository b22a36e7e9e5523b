"""Lead rules as columns: tier, polarity, priority. Cut-offs are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(score: Column, hot: float = 0.7, warm: float = 0.4) -> Column:
    return (
        F.when(score >= hot, "hot").when(score >= warm, "warm").when(score.isNotNull(), "cold")
    )


def polarity(score: Column, cut: float = 0.25) -> Column:
    return (
        F.when(score > cut, "Positive")
        .when(score < -cut, "Negative")
        .when(score.isNotNull(), "Neutral")
    )


def strength(score: Column) -> Column:
    return F.abs(score)


def priority(
    score: Column, sentiment: Column, high: float = 0.7, pleased: float = 0.25
) -> Column:
    """Final label of a lead. A lead without feedback counts as neutral."""
    mood = F.coalesce(sentiment, F.lit(0.0))
    return (
        F.when(score.isNull(), "Unscored")
        .when((score >= high) & (mood >= 0), "High Priority Lead")
        .when(score >= high, "Review Manually Before Sales")
        .when(mood >= pleased, "Consider for Nurturing")
        .otherwise("Low Priority")
    )

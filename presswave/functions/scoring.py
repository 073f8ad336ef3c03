"""Scores and tiers as column expressions. Constants are those of the scores' definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 3600.0


def decay(age_hours: Column, half_life: float = 24.0, floor: float = 0.05) -> Column:
    return F.greatest(F.lit(floor), F.pow(F.lit(0.5), age_hours / half_life))


def relevance(importance: Column, age_hours: Column, scale: float = 36.0) -> Column:
    return F.round(F.least(F.greatest(importance / 10, F.lit(0.1)), F.lit(1.0)) * F.exp(-age_hours / scale), 4)


def priority(base: Column, age_hours: Column, quality: Column, tier: Column, video: Column, city: Column | None = None, thread: Column | None = None) -> Column:
    """``city``: whether the source is a city's; ``thread``: the state of the article's story, null without one."""
    blended = 0.85 * decay(age_hours) + 0.15 * quality
    score = base * blended * F.when(tier == 4, 6.0).otherwise(1.0) * F.when(video, 1.18).otherwise(1.0)
    if city is not None:
        score *= F.when(city, 0.01).otherwise(1.0)
    if thread is not None:
        score *= F.when(thread == "active", 3.0).when(thread == "dormant", 1.05).when(thread.isNotNull(), 1.55).otherwise(1.0)
    return score


def breaking(distinct_sources: Column, age_hours: Column, average: Column, most: Column) -> Column:
    return distinct_sources * F.greatest(F.lit(0.2), F.exp(-age_hours / 36)) * (0.4 + average + 0.25 * most)


def momentum(recent: Column, baseline: Column, days: float = 3, base_days: float = 14) -> Column:
    """Recent rate over the baseline's; ten times the count where there is no baseline."""
    return F.when(baseline == 0, recent * 10.0).otherwise(F.round(recent / baseline * (base_days / days), 2))


def cadence(per_day: Column) -> Column:
    return F.when(per_day >= 30, "daily").when(per_day >= 10, "2day").when(per_day >= 3, "weekly").when(per_day >= 1, "monthly").otherwise("skip")


def sentiment_bucket(score: Column) -> Column:
    return F.when(score <= -0.6, "very_negative").when(score <= -0.2, "negative").when(score < 0.2, "neutral").when(score < 0.6, "positive").otherwise("very_positive")


def popularity(tier: Column) -> Column:
    return F.when(tier == 1, 0.85).when(tier == 2, 1.0).when(tier == 3, 1.35).otherwise(1.0)


def member_weight(members: Column) -> Column:
    """An organisation's share for each member country."""
    return F.least(F.lit(0.5), 3.5 / F.greatest(members, F.lit(7)))


def rule_confidence(mean: Column, spread: Column) -> Column:
    return 1 - spread / (F.abs(mean) + 0.01)

"""Presentation bands and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from indexwright.schemas import PROXY_RUNG, RUNG_MEANING


def movement_band(change_pct: Column) -> Column:
    """Five bands around zero for a percentage change."""
    return (
        F.when(change_pct >= 5, "SHARP_RISE")
        .when(change_pct >= 1, "RISE")
        .when(change_pct > -1, "STABLE")
        .when(change_pct > -5, "FALL")
        .when(change_pct.isNotNull(), "SHARP_FALL")
    )


def freshness(age_hours: Column) -> Column:
    """How old the newest observation is, judged against two thresholds."""
    return (
        F.when(age_hours.isNull(), "NO_DATA")
        .when(age_hours <= 26, "CURRENT")
        .when(age_hours <= 72, "STALE")
        .otherwise("OVERDUE")
    )


def departure_band(departure_at: Column, zone: str = "Asia/Kolkata") -> Column:
    """Local clock band of a UTC departure; an unknown departure counts as MORNING."""
    hour = F.hour(F.from_utc_timestamp(departure_at, zone))
    return (
        F.when(hour.isNull(), "MORNING")
        .when(hour < 8, "EARLY_MORNING")
        .when(hour < 12, "MORNING")
        .when(hour < 16, "MIDDAY")
        .when(hour < 20, "EVENING")
        .otherwise("NIGHT")
    )


def rung_meaning(rung: Column) -> Column:
    label = F.lit("unknown")
    for value, text in RUNG_MEANING.items():
        label = F.when(rung == value, text).otherwise(label)
    return label


def is_proxy(rung: Column) -> Column:
    """Weights at this rung or weaker are not route-level traffic."""
    return rung >= PROXY_RUNG

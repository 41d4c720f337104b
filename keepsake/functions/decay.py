"""Strength over time: decay, tiers, reinforcement and what follows from them."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import r4, unit


def tier_by_importance(importance: Column) -> Column:
    """Daily decay rate: 0.10 from 8, 0.15 from 5, else 0.20."""
    return F.when(importance >= 8, 0.10).when(importance >= 5, 0.15).otherwise(0.20)


def tier_scan(importance: Column) -> Column:
    """The scans' and the retriever's rate: 0.10 from 8, 0.20 up to 3, else 0.15."""
    return F.when(importance >= 8, 0.10).when(importance <= 3, 0.20).otherwise(0.15)


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 86_400_000_000.0


def strength_after(strength: Column, rate: Column, days: Column) -> Column:
    """strength * (1 - rate) ** days in four decimals; unchanged where no time has passed."""
    return F.when(days <= 0, strength).otherwise(unit(r4(strength * F.pow(1 - rate, days))))


def unrounded_strength(strength: Column, rate: Column, days: Column) -> Column:
    return unit(strength * F.pow(1 - rate, days))


def refreshed(strength: Column, boost: float = 1.0) -> Column:
    """After an access."""
    return F.least(F.lit(1.0), r4(0.7 * strength + 0.3 * boost))


def merged_strength(strength: Column) -> Column:
    """After a duplicate was merged in; not rounded."""
    return F.least(F.lit(1.0), 0.7 * strength + 0.3)


def category(strength: Column) -> Column:
    return F.when(strength >= 0.7, "strong").when(strength >= 0.4, "fading").when(strength >= 0.1, "critical").otherwise("forgotten")


def days_until(strength: Column, rate: Column, target: float) -> Column:
    """Days until the strength has fallen to ``target``; 0 if it has, null if it never does."""
    return F.when(strength <= target, 0.0).when((rate <= 0) | (rate >= 1), None).otherwise(F.log(F.lit(target) / strength) / F.log(1 - rate))


def recency(hours: Column, per_hour: float = 0.1) -> Column:
    """0.3 where there was no access yet."""
    return F.when(hours.isNull(), 0.3).otherwise(F.exp(-per_hour * hours))


def curve(strength: Column, rate: Column, days: int) -> Column:
    """Array of (day, strength) from day 0 to ``days``."""
    return F.transform(F.sequence(F.lit(0), F.lit(days)), lambda d: F.struct(d.alias("day"), strength_after(strength, rate, d.cast("double")).alias("strength")))


def reinforcements_until(target: float, start: float) -> int:
    """Accesses that lift ``start`` to ``target``, by the closed form 1 - (1 - s) * 0.7 ** n."""
    return 0 if start >= target else max(1, round(log((1 - target) / (1 - start)) / log(0.7) + 0.4999))


def reinforced_closed_form(strength: Column, accesses: Column) -> Column:
    """Strength after n accesses without rounding between them."""
    return F.lit(1.0) - (1 - strength) * F.pow(F.lit(0.7), accesses)

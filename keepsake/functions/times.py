"""Times as texts, relative to a given time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def relative(ts: Column, as_of: datetime) -> Column:
    """just now, 5m ago, 3h ago, 2d ago, 4w ago, else the day."""
    seconds = (F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)) / 1_000_000.0
    ago = lambda by, unit, least: F.concat(F.greatest(F.floor(seconds / by + 0.5), F.lit(least)).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 45, "just now").when(seconds < 3600, ago(60, "m", 1)).when(seconds < 86_400, ago(3600, "h", 0)).when(seconds < 7 * 86_400, ago(86_400, "d", 0)).when(seconds < 35 * 86_400, ago(7 * 86_400, "w", 0)).otherwise(F.date_format(ts, "MMM d"))


def duration(seconds: Column) -> Column:
    """59s, 2m, 2m 5s."""
    rest = F.floor(F.pmod(seconds, F.lit(60.0)) + 0.5)
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))
    return F.when(seconds < 60, F.concat(rounded(seconds), F.lit("s"))).when(rest > 0, F.concat(minutes, F.lit(" "), rest.cast("string"), F.lit("s"))).otherwise(minutes)

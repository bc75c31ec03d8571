"""Levels and delivery checks as column expressions. Digital silence is minus infinity, as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE = float("-inf")
#: The bands next to a limit in which a check warns, in dB and LU.
DB_EDGE, LU_EDGE = 0.5, 0.2
PASS, WARN, FAIL, UNSPECIFIED = "pass", "warn", "fail", "unspecified"


def dbfs(amplitude: Column) -> Column:
    """20 log10 of an amplitude, minus infinity for 0 and below; null stays null."""
    return F.when(amplitude <= 0, F.lit(SILENCE)).otherwise(20 * F.log10(amplitude))


def rms(samples: Column) -> Column:
    """Root of the mean square of an array of samples; 0 for an empty one."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) == 0, F.lit(0.0)).otherwise(F.sqrt(total / F.greatest(F.size(samples), F.lit(1))))


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def range_status(value: Column, low: Column, high: Column, edge: float = DB_EDGE) -> Column:
    """pass inside [low, high], warn up to `edge` inside of a limit (at it too), fail outside or NaN; a null limit sets no limit."""
    outside = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    close = F.coalesce(value - low <= edge, F.lit(False)) | F.coalesce(high - value <= edge, F.lit(False))
    status = F.when(value.isNull() | F.isnan(value) | outside, FAIL).when(close, WARN).otherwise(PASS)
    return F.when(low.isNull() & high.isNull(), UNSPECIFIED).otherwise(status)


def upper_status(value: Column, high: Column, edge: float = DB_EDGE) -> Column:
    return range_status(value, F.lit(None).cast("double"), high, edge)


def traffic_light(checks: Column) -> Column:
    """red if any check of the array fails, yellow if any warns, else green."""
    return F.when(F.array_contains(checks, FAIL), "red").when(F.array_contains(checks, WARN), "yellow").otherwise("green")


def format_db(value: Column, unit: str = "dBFS") -> Column:
    """With one decimal and a typographic minus; an em dash for null."""
    shown = F.regexp_replace(F.format_string("%.1f", value), "^-", "−")
    return F.when(value.isNull() | F.isnan(value), "—").when(value == F.lit(SILENCE), f"−∞ {unit}").otherwise(F.concat(shown, F.lit(f" {unit}")))

"""Timecodes of marker files as column expressions, from seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _millis(seconds: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(seconds * 1000 + 0.5)).cast("long")


def _part(ms: Column, unit: int, modulus: int | None = None) -> Column:
    n = F.floor(ms / unit).cast("long")
    return n if modulus is None else F.pmod(n, F.lit(modulus))


def minutes_seconds(seconds: Column) -> Column:
    """M:SS.mmm, and H:MM:SS.mmm from an hour on."""
    ms = _millis(seconds)
    tail = F.format_string("%02d.%03d", _part(ms, 1000, 60), F.pmod(ms, F.lit(1000)))
    hours = F.format_string("%d:%02d:", _part(ms, 3_600_000), _part(ms, 60_000, 60))
    return F.concat(F.when(ms >= 3_600_000, hours).otherwise(F.format_string("%d:", _part(ms, 60_000))), tail)


def subtitle_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = _millis(seconds)
    return F.format_string("%02d:%02d:%02d,%03d", _part(ms, 3_600_000), _part(ms, 60_000, 60), _part(ms, 1000, 60), F.pmod(ms, F.lit(1000)))

"""Timestamps as numbers. Columns without a time zone count in the session's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column | str) -> Column:
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def seconds_between(earlier: Column | str, later: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)

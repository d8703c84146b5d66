"""Calendar helpers (C4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doy_range(year, month) -> tuple[Column, Column]:
    """C4: inclusive day-of-year range of a month, leap-aware."""
    y = F.col(year) if isinstance(year, str) else year
    m = F.col(month) if isinstance(month, str) else month
    first = F.make_date(y, m, F.lit(1))
    return F.dayofyear(first), F.dayofyear(F.last_day(first))

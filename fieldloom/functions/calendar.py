"""Months, seasons and node labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The warm season in its own order, and its first month.
WARM_MONTHS = (10, 11, 12, 1, 2, 3)
SEASON_START = 10


def in_season(month: Column, months: tuple[int, ...] = WARM_MONTHS) -> Column:
    return month.isin(*months)


def season_year(year: Column, month: Column) -> Column:
    """A season is named after the year in which it starts."""
    return F.when(month >= SEASON_START, year).otherwise(year - 1)


def month_position(month: Column, months: tuple[int, ...] = WARM_MONTHS) -> Column:
    """0 for the season's first month, 1 for the next; null outside the season."""
    place = F.array_position(F.array(*map(F.lit, months)), month.cast("int"))
    return F.when(place > 0, (place - 1).cast("int"))


def flat_label(i: Column, j: Column, columns: int) -> Column:
    return F.when((i >= 0) & (j >= 0), i * columns + j).cast("int")

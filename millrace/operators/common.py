"""Shared building blocks: as-of dates, trailing windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = Column | dt.date | str | None


def as_of_col(as_of: AsOf = None) -> Column:
    """The reference day of a trailing window; ``None`` means today."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("date")


def last_day(df: DataFrame, date_col: str = "production_date") -> Column:
    """As-of = the last day present in ``df`` (a scalar subquery, no collect)."""
    return df.select(F.max(date_col)).scalar()


def trailing_window(df: DataFrame, days: int, as_of: AsOf = None,
                    date_col: str = "production_date") -> DataFrame:
    """``date >= as_of - days``: days+1 calendar days, no upper bound."""
    return df.filter(F.col(date_col) >= F.date_sub(as_of_col(as_of), int(days)))


def safe_div(num: Column, den: Column) -> Column:
    """Null instead of an ANSI divide-by-zero error."""
    return F.try_divide(num, den)


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def truncate_int(c: Column) -> Column:
    """Python ``int(x)`` on a float: toward zero, as a BIGINT."""
    return c.cast("bigint")


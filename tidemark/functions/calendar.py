"""Calendar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CADENCES = ("month", "quarter", "year")


def months_later(d: Column, n: int) -> Column:
    """The same day `n` months on; a day that month lacks runs over (31 March, -1 month: 3 March)."""
    return F.date_add(F.add_months(F.trunc(d, "MM"), n), F.dayofmonth(d) - 1)


def before(d: Column, unit: str) -> Column:
    """The last day before the month, quarter or year of `d`."""
    return F.date_sub(F.trunc(d, unit), 1)


def period(d: Column, cadence: str) -> Column:
    """2024-05, 2024-Q2 or 2024."""
    year = F.date_format(d, "yyyy")
    return {"month": F.date_format(d, "yyyy-MM"), "quarter": F.concat(year, F.lit("-Q"), F.quarter(d).cast("string")), "year": year}[cadence]


def new_york_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def new_york_label(ts: Column) -> Column:
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "America/New_York"), "MMM d, yyyy, h:mm a"), F.lit(" ET"))

"""Calendars of climate models: from a day's number to its date, and the lengths of months and years, as column functions of the series' own calendar.

A day's number counts from 1970-01-01 in the calendar itself, so a difference of numbers is a difference of days in any calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of calendars, and days before each month of a year without 29 February.
STANDARD = ["standard", "gregorian", "proleptic_gregorian"]
NO_LEAP, ALL_LEAP, THIRTY = ["noleap", "365_day"], ["all_leap", "366_day"], ["360_day"]
BEFORE_MONTH = [0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]


def is_leap(calendar: Column, year: Column) -> Column:
    """Whether a year has a 29 February; a null calendar is the standard one. In a year of twelve 30-day months it does not stand out, and is none here."""
    common = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    return F.when(calendar.isin(ALL_LEAP), True).when(calendar.isin(NO_LEAP + THIRTY), False).otherwise(common)


def days_in_year(calendar: Column, year: Column) -> Column:
    return F.when(calendar.isin(THIRTY), 360).otherwise(F.when(is_leap(calendar, year), 366).otherwise(365))


def days_in_month(calendar: Column, year: Column, month: Column) -> Column:
    own = F.element_at(F.array(*[F.lit(b - a) for a, b in zip(BEFORE_MONTH, [*BEFORE_MONTH[1:], 365])]), month.cast("int"))
    return F.when(calendar.isin(THIRTY), 30).otherwise(own + F.when((month == 2) & is_leap(calendar, year), 1).otherwise(0))


def known(calendar: Column) -> Column:
    """The calendar's name in lower case, ``standard`` for none; an unknown one is an error where it is met."""
    name = F.coalesce(F.lower(F.trim(calendar)), F.lit("standard"))
    return F.when(name.isin(STANDARD + NO_LEAP + ALL_LEAP + THIRTY), name).otherwise(F.raise_error(F.concat(F.lit("unknown calendar "), name)))


def day_number(calendar: Column, year: Column, month: Column, day: Column) -> Column:
    """Number of a date, the inverse of date_parts."""
    y = (year - 1970).cast("long")
    before = F.element_at(F.array(*map(F.lit, BEFORE_MONTH)), month.cast("int"))
    fixed = F.when(calendar.isin(ALL_LEAP), y * 366 + before + F.when(month > 2, 1).otherwise(0) + day - 1).when(calendar.isin(NO_LEAP), y * 365 + before + day - 1).when(calendar.isin(THIRTY), y * 360 + (month - 1) * 30 + day - 1)
    return F.coalesce(fixed, F.unix_date(F.make_date(year, month, day)).cast("long"))


def date_parts(calendar: Column, number: Column) -> Column:
    """Struct of year, month, day and doy of a day's number."""
    n = number.cast("long")
    size = F.when(calendar.isin(THIRTY), 360).when(calendar.isin(NO_LEAP), 365).when(calendar.isin(ALL_LEAP), 366)
    year = F.lit(1970) + F.floor(n / size)
    rest = F.pmod(n, size)
    # Of the months that begin on or before the day the last; all_leap has a day more after February.
    start = lambda k: BEFORE_MONTH[k] + F.when(calendar.isin(ALL_LEAP), int(k > 1)).otherwise(0)
    month, first = F.lit(1), F.lit(0)
    for k in range(1, 12):
        month, first = F.when(rest >= start(k), k + 1).otherwise(month), F.when(rest >= start(k), start(k)).otherwise(first)
    month = F.when(calendar.isin(THIRTY), F.floor(rest / 30) + 1).otherwise(month)
    day = F.when(calendar.isin(THIRTY), rest % 30 + 1).otherwise(rest - first + 1)
    date = F.date_from_unix_date(n.cast("int"))
    pick = lambda own, real, name: F.when(size.isNotNull(), own).otherwise(real).cast("int").alias(name)
    return F.struct(pick(year, F.year(date), "year"), pick(month, F.month(date), "month"), pick(day, F.dayofmonth(date), "day"), pick(rest + 1, F.dayofyear(date), "doy"))


def decode_days(df: DataFrame, offset: Column, since: Column | None = None) -> DataFrame:
    """df (with a column calendar) with day_idx, year, month, day and doy of ``offset`` days after the date ``since`` (yyyy-mm-dd, with a time or without), 1970-01-01 by default. A null offset gives null parts.

    What is after the point counts as part of the day. Columns of these names are replaced."""
    calendar = known(F.col("calendar"))
    start = F.lit(0)
    if since is not None:
        part = lambda k: F.regexp_extract(since, r"(\d+)-(\d+)-(\d+)", k).cast("int")
        hour = lambda k: F.coalesce(F.nullif(F.regexp_extract(since, r"\d[T ](\d+):(\d+)", k), F.lit("")).cast("double"), F.lit(0.0))
        start = day_number(calendar, part(1), part(2), part(3)) + hour(1) / 24 + hour(2) / 1440
    out = df.withColumn("day_idx", F.floor(offset + start).cast("int")).withColumn("_date", date_parts(calendar, F.col("day_idx")))
    return out.withColumns({c: F.when(F.col("day_idx").isNotNull(), F.col(f"_date.{c}")) for c in ("year", "month", "day", "doy")}).drop("_date")

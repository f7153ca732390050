"""Scalar rules shared by the reports, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """Integer part, towards zero. 64 bits wide, so one huge order cannot overflow it."""
    return value.cast("bigint")


def day_of(moment: Column) -> Column:
    """Calendar day of a moment, or of a text that may not be one."""
    return F.to_date(moment)


def day_of_text(text: Column) -> Column:
    return text.try_cast("date")


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds on the clock from ``start`` to ``end``, whatever the session's time zone."""

    def of_day(moment: Column) -> Column:
        return F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)

    days = F.date_diff(F.to_date(end), F.to_date(start)).cast("bigint")
    return days * 86400 + of_day(end) - of_day(start)


def days_between(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``, to the nearest whole day."""
    return F.round(seconds_between(start, end) / F.lit(86400.0)).cast("int")


def ratio(part: Column, total: Column) -> Column:
    """``part / total`` as a double; null for a zero total."""
    return F.try_divide(part.cast("double"), total.cast("double"))


def guarded_ratio(programmed: Column, produced: Column, required: Column) -> Column:
    """Produced over required, 0 when nothing is programmed, null when nothing is required."""
    return F.round(F.when(programmed != 0, ratio(produced, required)).otherwise(F.lit(0.0)), 5)


def _percent(share: Column) -> Column:
    # Float noise is rounded off first, so that 0.285 counts as 28.5 and not as 28.499999999999996.
    return F.round(F.round(share * 100, 8)).cast("bigint").cast("string")


def percent_label(share: Column) -> Column:
    """``0.455`` as ``46%``; null stays null."""
    return F.concat(_percent(share), F.lit("%"))


def percent_text(share: Column) -> Column:
    """``0.45`` as ``45 %``."""
    return F.concat(_percent(share), F.lit(" %"))


def day_month(moment: Column) -> Column:
    return F.date_format(moment, "dd-MMM")


def day_text(moment: Column) -> Column:
    return F.date_format(moment, "dd-MM-yyyy")


def first_chars(text: Column, n: int = 15) -> Column:
    return F.substring(text, 1, n)


def last_chars(text: Column, n: int = 35) -> Column:
    return F.right(text, F.lit(n))


def thousands(value: Column) -> Column:
    """``1234.5`` as ``1,234``; presentation only."""
    return F.format_number(value, 0)


def cap_at_one(share: Column) -> Column:
    """At most 1; null stays null, unlike ``least``."""
    return F.when(share > 1, F.lit(1.0)).otherwise(share)


def floor_at_zero(value: Column) -> Column:
    """At least 0; null stays null, unlike ``greatest``."""
    return F.when(value < 0, F.lit(0.0)).otherwise(value)

"""Calendar arithmetic as column expressions: weekdays, Saturday weeks, solar Hijri (Jalali) months.

Weekdays count from Monday (0) to Sunday (6); the weekend is 5 and 6.  A
business week runs from Saturday to Friday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ampflow.functions.numeric import let


def _int(x: Column) -> Column:
    return x.cast("int")


def _div(a: Column, b: int) -> Column:
    """Whole quotient of a non-negative number."""
    return F.floor(a / F.lit(b)).cast("long")


def is_weekend(day: Column) -> Column:
    return F.weekday(day).isin(5, 6).cast("int")


def saturday_of(day: Column) -> Column:
    """First day of the week that holds ``day``."""
    return F.date_sub(day, _int((F.weekday(day) + 2) % 7))


def friday_of(day: Column) -> Column:
    return F.date_add(saturday_of(day), 6)


def next_week(as_of: Column) -> Column:
    """struct(start, end) of the first whole week after ``as_of``; the day itself counts if it is a Saturday."""
    start = F.when(F.weekday(as_of) == 5, as_of).otherwise(F.date_add(saturday_of(as_of), 7))
    return F.struct(start.alias("start"), F.date_add(start, 6).alias("end"))


def whole_weeks(first: Column, last: Column) -> Column:
    """Saturdays of all weeks that lie within [first, last]."""
    start = next_week(first)["start"]
    stop = F.date_sub(last, 6)
    return F.when(start <= stop, F.sequence(start, stop, F.expr("interval 7 days"))).otherwise(F.array().cast("array<date>"))


#: Day number (from 1970-01-01) of the start of solar year y is 365 y + floor((8 y + 21) / 33) plus this:
#: 8 leap years in 33, laid so that 1403-01-01 is 2024-03-20.
_YEAR_ZERO = -492633


def _year_start(y: Column) -> Column:
    return 365 * y + _div(8 * y + 21, 33) + _YEAR_ZERO


def _year_of(n: Column) -> Column:
    about = _div((n - _YEAR_ZERO) * 33, 365 * 33 + 8)  # or one off
    return let(about, lambda y: F.when(_year_start(y) > n, y - 1).when(_year_start(y + 1) <= n, y + 1).otherwise(y))


def jalali(day: Column) -> Column:
    """struct(jy, jm, jd) of a Gregorian date: six months of 31 days, then months of 30."""

    def parts(year: Column, at: Column) -> Column:
        month = F.when(at < 186, _div(at, 31) + 1).otherwise(_div(at - 186, 30) + 7)
        dom = F.when(at < 186, at % 31 + 1).otherwise((at - 186) % 30 + 1)
        return F.struct(_int(year).alias("jy"), _int(month).alias("jm"), _int(dom).alias("jd"))

    of = lambda n: let(_year_of(n), lambda y: let(n - _year_start(y), lambda at: parts(y, at)))
    return let(F.unix_date(day).cast("long"), of)


def from_jalali(jy: Column, jm: Column, jd: Column) -> Column:
    """The Gregorian date of a Jalali year, month and day."""
    before = F.when(jm <= 6, 31 * (jm - 1)).otherwise(186 + 30 * (jm - 7))
    return F.date_from_unix_date(_int(_year_start(jy.cast("long")) + before + jd - 1))


def jalali_month_start(day: Column) -> Column:
    return let(day, lambda d: F.date_sub(d, _int(jalali(d)["jd"] - 1)))


def jalali_month_end(day: Column) -> Column:
    """A month has 31 days at most, so start + 31 lies in the next month."""
    return F.date_sub(jalali_month_start(F.date_add(jalali_month_start(day), 31)), 1)


def next_jalali_month(as_of: Column) -> Column:
    """struct(start, end) of the first whole month after ``as_of``; the day itself counts if it opens a month."""
    start = let(as_of, lambda d: F.when(jalali(d)["jd"] == 1, d).otherwise(F.date_add(jalali_month_end(d), 1)))
    return let(start, lambda s: F.struct(s.alias("start"), jalali_month_end(s).alias("end")))


def target_day_columns(day: Column) -> dict[str, Column]:
    """Calendar features of a day and of the day after it, and whether they differ."""
    nxt = F.date_add(day, 1)
    of = lambda d: {
        "day_of_week": F.weekday(d),
        "is_weekend": is_weekend(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
    }
    here, there = of(day), of(nxt)
    out = {"day_of_month": F.dayofmonth(day), **here}
    out |= {f"target_{k}": v for k, v in there.items()}
    out["weekend_changes"] = (here["is_weekend"] != there["is_weekend"]).cast("int")
    out["month_changes"] = (here["month"] != there["month"]).cast("int")
    return out

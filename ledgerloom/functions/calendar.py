"""The Solar-Hijri calendar as integer arithmetic on day numbers, all of it column expressions.

Dates are kept as text YYYY/MM/DD, which orders like time, or as DATE for arithmetic. A cycle of 33 years has 12053 days; within
it each 4 years have 1461.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from the calendar's zero to 1970-01-01, in each direction of the conversion.
EPOCH_FROM, EPOCH_TO = 1075195, 1075195 - 355668 - 1
WEEKDAYS = ("دوشنبه", "سه‌شنبه", "چهارشنبه", "پنجشنبه", "جمعه", "شنبه", "یکشنبه")
MONTHS = ("فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند")


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("int")


def jalali_parts(date: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a DATE."""
    day = F.unix_date(date) + F.lit(EPOCH_FROM)
    cycle, d = _div(day, 12053), day % 12053
    four, d = _div(d, 1461), d % 1461
    later = d > 365
    year = F.lit(-1595) + 33 * cycle + 4 * four + F.when(later, _div(d - 1, 365)).otherwise(0)
    d = F.when(later, (d - 1) % 365).otherwise(d)
    first = d < 186
    month = F.when(first, _div(d, 31) + 1).otherwise(_div(d - 186, 30) + 7)
    return year.cast("int"), month.cast("int"), (F.when(first, d % 31).otherwise((d - 186) % 30) + 1).cast("int")


def jalali_text(date: Column) -> Column:
    """YYYY/MM/DD of a DATE; null for null."""
    y, m, d = jalali_parts(date)
    return F.when(date.isNotNull(), F.format_string("%04d/%02d/%02d", y, m, d))


def from_parts(year: Column, month: Column, day: Column) -> Column:
    """The DATE of a Solar-Hijri day; day 30 of month 12 of a common year is the first of the next year."""
    j = year + 1595
    n = F.lit(-355668) + 365 * j + _div(j, 33) * 8 + _div(j % 33 + 3, 4) + day + F.when(month < 7, (month - 1) * 31).otherwise((month - 7) * 30 + 186)
    return F.date_from_unix_date((n - 365 - 719163).cast("int"))


DIGITS = ("۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "01234567890123456789")


def fold_digits(text: Column) -> Column:
    """Persian and Arabic digits as ASCII ones."""
    return F.translate(text, *DIGITS)


def normalize_date(text: Column) -> Column:
    """YYYY/MM/DD, zero-padded, of a text with a plausible date and nothing else; null otherwise."""
    plain = F.regexp_replace(fold_digits(F.trim(text)), "[-.]", "/")
    parts = F.split(F.nullif(F.regexp_extract(plain, r"^\d{4}/\d{1,2}/\d{1,2}$", 0), F.lit("")), "/")

    def shown(x: Column) -> Column:
        y, m, d = (F.get(x, i).cast("int") for i in range(3))
        good = m.between(1, 12) & (d >= 1) & (d <= F.when(m <= 6, 31).otherwise(30))
        return F.when(good, F.format_string("%04d/%02d/%02d", y, m, d))

    # a list of one, so that the parts are reckoned once and not wherever they are named
    return F.get(F.transform(F.array(parts), shown), 0)


def parse(text: Column) -> Column:
    """The DATE of a canonical text."""
    y, m, d = (F.substring(text, a, n).cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
    return from_parts(y, m, d)


def is_leap(year: Column) -> Column:
    """Whether the last month has 30 days."""
    return F.datediff(from_parts(year + 1, F.lit(1), F.lit(1)), from_parts(year, F.lit(1), F.lit(1))) == 366


def month_end(year: Column, month: Column) -> Column:
    return F.when(month <= 6, 31).when(month <= 11, 30).otherwise(F.when(is_leap(year), 30).otherwise(29))


def add_months(year: Column, month: Column, day: Column, months: Column) -> tuple[Column, Column, Column]:
    """Calendar months later, the day cut to 31 or 30."""
    at = year * 12 + month - 1 + months
    y, m = _div(at, 12), at % 12 + 1
    return y, m.cast("int"), F.least(day, F.when(m <= 6, 31).otherwise(30)).cast("int")


def weekday_name(date: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(date) + 1)


def long_text(date: Column) -> Column:
    y, m, d = jalali_parts(date)
    return F.concat_ws(" ", weekday_name(date), d.cast("string"), F.element_at(F.array(*map(F.lit, MONTHS)), m), y.cast("string"))


def exchange_time(text: Column) -> Column:
    """A time of a trade as YYYY-MM-DD HH:MM; years under 1700 are Solar-Hijri; without a clock it is 00:00."""
    plain = F.translate(fold_digits(F.trim(text)), "/T", "- ")
    shape = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s+(\d{1,2}):(\d{2}))?"
    y, m, d, hour, minute = (F.nullif(F.regexp_extract(plain, shape, i), F.lit("")).cast("int") for i in range(1, 6))
    own = F.when(m.between(1, 12) & d.between(1, 31), F.when(y < 1700, from_parts(y, m, d)).otherwise(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")))
    clock = F.format_string("%02d:%02d", F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)))
    return F.when(own.isNotNull(), F.concat_ws(" ", F.date_format(own, "yyyy-MM-dd"), clock))


def add_days(text: Column, days: Column) -> Column:
    """A canonical text some days later."""
    return jalali_text(F.date_add(parse(text), days))


def days_until(text: Column, as_of: Column) -> Column:
    """Days from one canonical text's day to another's."""
    return F.datediff(parse(text), parse(as_of))


def end_of(start: Column, n: Column, unit: Column) -> Column:
    """The end of a duration from a canonical text on: units are day, week, month and year; the day before the same day."""
    y, m, d = (F.substring(start, a, k).cast("int") for a, k in ((1, 4), (6, 2), (9, 2)))
    later = F.format_string("%04d/%02d/%02d", *add_months(y, m, d, n * F.when(unit == "year", 12).otherwise(1)))
    return F.when(start.isNull() | n.isNull(), F.lit(None)).when(unit.isin("month", "year"), later).when(unit.isin("day", "week"), add_days(start, (n * F.when(unit == "week", 7).otherwise(1)).cast("int")))


def period(name: str, today: str) -> tuple[str | None, str | None]:
    """First and last day, as canonical texts, of month, previous, quarter, year or all, on the driver; the end is one that no day passes."""
    y, m = int(today[:4]), int(today[5:7])
    at = lambda k: f"{(y * 12 + m - 1 + k) // 12:04d}/{(y * 12 + m - 1 + k) % 12 + 1:02d}"
    first, last = {"month": (at(0), at(0)), "previous": (at(-1), at(-1)), "quarter": (at(-2), at(0)), "year": (f"{y:04d}/01", f"{y:04d}/12"), "all": (None, None)}[name]
    return (f"{first}/01", f"{last}/31") if first else (None, None)

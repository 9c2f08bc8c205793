"""ISO-8601 periods: parsing, length, time buckets and texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_SECONDS, YEAR_SECONDS, DAY_SECONDS = 2_629_800, 31_557_600, 86_400
_DATE, _CLOCK = {"Y": "years", "M": "months", "W": "weeks", "D": "days"}, {"H": "hours", "M": "minutes", "S": "seconds"}
_NAMES = [("years", "year"), ("months", "month"), ("weeks", "week"), ("days", "day"), ("hours", "hour"), ("minutes", "min"), ("seconds", "sec")]


@dataclass(frozen=True)
class Period:
    """A calendar period. ``PT1H``, ``P1M``, also written without P (``3H``) or without T (``P1H``)."""

    years: int = 0
    months: int = 0
    weeks: int = 0
    days: int = 0
    hours: int = 0
    minutes: int = 0
    seconds: int = 0

    @staticmethod
    def parse(text: str) -> Period:
        m = re.fullmatch(r"P?((?:\d+[YMWD])*)(?:T?((?:\d+[HMS])*))", text.strip().upper())
        if not m or not (m[1] or m[2]):
            raise ValueError(f"not a period: {text!r}")
        got = {_DATE[u]: int(n) for n, u in re.findall(r"(\d+)([YMWD])", m[1])}
        got |= {_CLOCK[u]: int(n) for n, u in re.findall(r"(\d+)([HMS])", m[2])}
        return Period(**got)

    @property
    def total(self) -> int:
        """Average length in seconds; months and years are those of the mean calendar."""
        return self.years * YEAR_SECONDS + self.months * MONTH_SECONDS + (self.weeks * 7 + self.days) * DAY_SECONDS + self.hours * 3600 + self.minutes * 60 + self.seconds

    def text(self, only_first: bool = False) -> str:
        """'1 hour, 30 mins'."""
        parts = [f"{n} {name}{'s' if n != 1 else ''}" for field, name in _NAMES if (n := getattr(self, field))]
        return parts[0] if only_first else ", ".join(parts)

    def interval(self) -> Column:
        """Calendar interval to add to a timestamp."""
        return F.make_interval(*[F.lit(n) for n in (self.years, self.months, self.weeks, self.days, self.hours, self.minutes, self.seconds)])


def seconds(text: str) -> int:
    return Period.parse(text).total


def bucket(ts: Column, period: str, tz: str = "UTC") -> Column:
    """Start of the period that holds ``ts``, on the wall clock of ``tz``; weeks begin on Monday.

    Months and years (and multiples) are counted from year 0, days and shorter from 1970.
    """
    p = Period.parse(period)
    local = F.from_utc_timestamp(ts, tz)
    months = p.years * 12 + p.months
    if months and not (p.weeks or p.days or p.hours or p.minutes or p.seconds):
        n = F.year(local) * 12 + F.month(local) - 1
        n = n - n % months
        start = F.make_date((n / 12).cast("int"), n % 12 + 1, F.lit(1)).cast("timestamp")
    elif p.weeks == 1 and p.total == 7 * DAY_SECONDS:
        start = F.date_trunc("week", local)
    else:
        start = F.timestamp_seconds(F.floor(F.unix_timestamp(local) / p.total) * p.total)
    return F.to_utc_timestamp(start, tz)


def bucket_seconds(start: Column, period: str) -> Column:
    """Length of the bucket that begins at ``start``: real for single months and years, else average."""
    p = Period.parse(period)
    if p.months == 1 and p.total == MONTH_SECONDS:
        return F.dayofmonth(F.last_day(start)).cast("double") * DAY_SECONDS
    return F.lit(float(p.total))


def hourly_timesteps(hours: float, period: str) -> int | float:
    """How many steps of ``period`` make ``hours``; rounded up unless under 1.05."""
    n = 3600 / seconds(period) * hours
    return n if n < 1.05 else int(-(-n // 1))


def iso_z(ts: Column) -> Column:
    """ISO 8601 in UTC with a Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_of_seconds(s: Column) -> Column:
    """Period text of a step in seconds; lengths of calendar units are named by the unit."""
    # Ranges of days that mean weeks, months and years.
    day = s / DAY_SECONDS
    whole = lambda n: F.concat(F.lit("P"), n.cast("int").cast("string"))
    months = [(28, 31, "P1M"), (59, 62, "P2M"), (89, 92, "P3M"), (120, 123, "P4M"), (150, 153, "P5M"), (181, 184, "P6M"), (364, 368, "P1Y")]
    out = F.when(day == 7, F.lit("P1W"))
    for lo, hi, name in months:
        out = out.when((day >= lo) & (day < hi + 1), F.lit(name))
    h, m, sec = (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), (s % 60).cast("int")
    part = lambda n, u: F.when(n > 0, F.concat(n.cast("string"), F.lit(u))).otherwise("")
    clock = F.concat(F.lit("PT"), part(h, "H"), part(m, "M"), part(sec, "S"))
    return out.when(s % DAY_SECONDS == 0, F.concat(whole(day), F.lit("D"))).otherwise(clock)

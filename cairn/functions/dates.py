"""Calendar columns and time parsers. Times are UTC unless an offset is given."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts that a time may be typed in.
LAYOUTS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy"]


def calendar(t: Column) -> dict[str, Column]:
    """Year, month, ISO year and ISO week; null where the time is."""
    return {
        "year": F.year(t),
        "month": F.month(t),
        "iso_year": F.extract(F.lit("YEAROFWEEK"), t).cast("int"),
        "workweek": F.weekofyear(t),
    }


def parse(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(x)) for x in LAYOUTS))


class Span(NamedTuple):
    years: int = 0
    months: int = 0
    days: int = 0
    hours: int = 0


def parse_span(text: str) -> Span:
    """'1y2m3d4h' in any order; a later value of a unit replaces an earlier one."""
    parts = re.findall(r"(-?\d+)([ymdh])", text)
    if "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a duration: {text!r}")
    got = {unit: int(n) for n, unit in parts}
    return Span(*(got.get(u, 0) for u in "ymdh"))


def minus(t: Column, span: Span) -> Column:
    """Calendar subtraction in which days overflow into the next month instead of stopping at its end."""
    months = 12 * span.years + span.months
    first = F.add_months(F.trunc(t, "MM"), -months)
    day = F.date_add(first, (F.dayofmonth(t) - 1 - span.days).cast("int"))
    of_day = F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t))
    micros = F.unix_micros(day.cast("timestamp")) + of_day - span.hours * 3_600_000_000
    return F.timestamp_micros(micros)


def bucket(t: Column, unit: str, offset_minutes: Column | None = None) -> Column:
    """A number that changes with the calendar unit, in the row's own offset."""
    local = t if offset_minutes is None else F.timestamp_micros(F.unix_micros(t) + offset_minutes.cast("long") * 60_000_000)
    y, m = F.year(local).cast("long"), F.month(local)
    of_unit = {
        "minute": F.floor(F.unix_micros(local) / 60_000_000),
        "hour": F.floor(F.unix_micros(local) / 3_600_000_000),
        "day": F.unix_date(F.to_date(local)).cast("long"),
        "week": F.extract(F.lit("YEAROFWEEK"), local).cast("long") * 100 + F.weekofyear(local),
        "month": y * 100 + m,
        "quarter": y * 10 + F.quarter(local),
        "half": y * 10 + F.when(m <= 6, 1).otherwise(2),
        "year": y,
    }
    return of_unit[unit].cast("long")


def truncate(t: Column, unit: str) -> Column:
    return F.date_trunc(unit, t)

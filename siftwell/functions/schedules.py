"""Schedules of five fields (minute, hour, day, month, weekday) as bit sets, and the next time that one is due, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of each field (fixed values); weekday 0 is Monday.
RANGES = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 6)}
#: Months that are looked through: days of a month come back on the same weekday within 40 years at the latest.
HORIZON = 12 * 41


def fields(line: Column) -> dict[str, Column]:
    """The five fields by name; null if there aren't five."""
    parts = F.split(F.trim(line), r"\s+")
    return {n: F.when(F.size(parts) == 5, F.element_at(parts, i + 1)) for i, n in enumerate(RANGES)}


def bits(field: Column, low: int, high: int) -> Column:
    """A field as a long with a bit for each value it allows: lists of a, a-b and *, each with /step where wanted. Null for anything else."""
    items = F.split(field, ",")
    good = F.forall(items, lambda x: x.rlike(r"^(\*|\d{1,2}(-\d{1,2})?)(/[1-9]\d?)?$"))

    def held(item: Column, v: Column) -> Column:
        base = F.split(item, "/")
        step = F.coalesce(F.get(base, F.lit(1)).cast("int"), F.lit(1))
        ends = F.split(F.get(base, F.lit(0)), "-")
        star = F.get(base, F.lit(0)) == "*"
        first = F.when(star, low).otherwise(F.get(ends, F.lit(0)).try_cast("int"))
        last = F.coalesce(F.get(ends, F.lit(1)).cast("int"), F.when(star | (F.size(base) > 1), high).otherwise(first))
        return (v >= first) & (v <= last) & (F.pmod(v - first, step) == 0)

    values = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda v: F.exists(items, lambda i: held(i, v)))
    whole = F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v)))
    return F.when(good & (whole != 0), whole)


def has(mask: Column, v: Column) -> Column:
    """Is the bit of value v set?"""
    return F.call_function("getbit", mask, v.cast("int")) == 1


def parsed(line: Column) -> Column:
    """A struct of five bit sets; null for a line that is no schedule."""
    masks = {n: bits(f, *RANGES[n]) for n, f in fields(line).items()}
    valid = masks["minute"].isNotNull()
    for m in masks.values():
        valid = valid & m.isNotNull()
    return F.when(valid, F.struct(*(m.alias(n) for n, m in masks.items())))


def _first(low: int, high: int, mask: Column, least: Column) -> Column:
    """The least value from ``least`` on that a mask allows."""
    return F.get(F.filter(F.sequence(F.lit(low), F.lit(high)), lambda v: (v >= least) & has(mask, v)), F.lit(0))


def next_due(schedule: Column, now: Column) -> Column:
    """The first full minute at or after ``now`` (a timestamp) at which a parsed schedule is due: all five fields have to hold, day and weekday
    both. Null for a null schedule or time, and for a day that never comes, as 30 February. ``schedule`` is used many times, so give it
    as a column that an earlier select has made with parsed()."""
    at = F.date_trunc("minute", now + F.expr("INTERVAL 59999999 MICROSECONDS"))
    minute, hour, today = F.minute(at), F.hour(at), F.to_date(at)
    m, h = schedule["minute"], schedule["hour"]
    this_hour = F.when(has(h, hour), _first(0, 59, m, minute))
    later = _first(0, 23, h, hour + 1)
    none = F.lit(0)
    in_day = F.coalesce(hour * 60 + this_hour, later * 60 + _first(0, 59, m, none))
    fits = lambda d: has(schedule["day"], F.dayofmonth(d)) & has(schedule["month"], F.month(d)) & has(schedule["weekday"], F.weekday(d))

    def in_month(first: Column) -> Column:
        days = F.sequence(F.greatest(first, F.date_add(today, 1)), F.last_day(first))
        return F.when(has(schedule["month"], F.month(first)) & (F.last_day(first) > today), F.get(F.filter(days, fits), F.lit(0)))

    months = F.transform(F.sequence(F.lit(0), F.lit(HORIZON)), lambda i: F.add_months(F.trunc(today, "MM"), i))
    other = F.aggregate(months, F.lit(None).cast("date"), lambda s, first: F.when(s.isNotNull(), s).otherwise(in_month(first)))
    start = _first(0, 23, h, none) * 60 + _first(0, 59, m, none)
    at_minute = lambda d, n: F.timestamp_add("MINUTE", n, d.cast("timestamp"))
    return F.when(fits(today) & in_day.isNotNull(), at_minute(today, in_day)).otherwise(at_minute(other, start))

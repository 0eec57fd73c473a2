"""ISO weeks: Column expressions for data, and the labels of a few weeks for plans that name them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(day: Column) -> Column:
    """``IYYY-Www`` of a date; null for null."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def monday(day: Column) -> Column:
    return F.trunc(day, "WEEK").cast("date")


def weeks_between(a: Column, b: Column) -> Column:
    """Whole weeks from the week of ``a`` to that of ``b``."""
    return (F.datediff(monday(b), monday(a)) / 7).cast("int")


def labels_before(day: Column, n: int) -> Column:
    """The labels of the ``n`` weeks before that of ``day``, oldest first, as an array."""
    return F.transform(F.sequence(F.lit(n), F.lit(1), F.lit(-1)), lambda k: iso_week(F.date_sub(monday(day), k.cast("int") * 7)))


def month(day: Column) -> Column:
    """``yyyy-MM``: the period of clusters."""
    return F.date_format(day, "yyyy-MM")


def months_back(day: Column, n: int) -> Column:
    """The day ``n`` months of 31 days each before ``day``."""
    return F.date_sub(day, 31 * n)


def stale(last: Column, as_of: Column, days: int = 2) -> Column:
    """Whether more than ``days`` have passed; null if there was nothing yet."""
    return F.datediff(as_of, last) > days


def plan_weeks(current: str, back: int) -> list[str]:
    """Labels that a plan compares with: ``back`` weeks and then ``current``, a label itself."""
    last = datetime.strptime(f"{current}-1", "%G-W%V-%u")
    return [f"{last - timedelta(days=7 * k):%G-W%V}" for k in reversed(range(back + 1))]


def plan_days(current: str, back: int) -> tuple[str, str]:
    """First and last day of the weeks of :func:`plan_weeks`, in ISO form."""
    last = datetime.strptime(f"{current}-1", "%G-W%V-%u")
    return f"{last - timedelta(days=7 * back):%Y-%m-%d}", f"{last + timedelta(days=6):%Y-%m-%d}"

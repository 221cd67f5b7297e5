"""Small Column expressions: division, period arithmetic, ids, frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

WEEKLY = "W"
MONTHLY = "M"


def check_frequency(frequency: str) -> str:
    if frequency not in (WEEKLY, MONTHLY):
        raise ValueError(f"frequency must be 'W' or 'M', not {frequency!r}")
    return frequency


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields NULL on a zero denominator (ANSI mode raises)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def nan_ratio(numerator: Column, denominator: Column) -> Column:
    """Division for the accuracy metrics: NaN when the denominator is zero or missing."""
    return F.coalesce(ratio(numerator, denominator), F.lit(float("nan")))


def clip_at_zero(value: Column) -> Column:
    # greatest(0, NULL) would be 0; a missing forecast stays missing
    return F.when(value < 0, F.lit(0.0)).otherwise(value)


def period_start(date: Column, frequency: str) -> Column:
    """Monday of the week, or first of the month, as a DATE."""
    return F.trunc(date, "week" if check_frequency(frequency) == WEEKLY else "month")


def future_period(last: Column, step: Column, frequency: str) -> Column:
    """Start of the ``step``-th period after ``last``."""
    if check_frequency(frequency) == WEEKLY:
        return F.date_add(last, (step * 7).cast("int"))
    return F.add_months(F.trunc(last, "month"), step.cast("int"))


def steps_after(date: Column, last: Column, season_length: int, frequency: str) -> Column:
    """Step whose look-back date (one season earlier) is ``date``; NULL if there is none.

    Solving for the step turns the look-back join into a row-local expression.
    """
    if check_frequency(frequency) == WEEKLY:
        days = F.datediff(date, last) + F.lit(7 * season_length)
        return F.when(days % 7 == 0, (days / 7).cast("int"))
    months = (F.year(date) - F.year(last)) * 12 + F.month(date) - F.month(last)
    return F.when(F.dayofmonth(date) == 1, (months + season_length).cast("int"))


def joined_id(*keys: str) -> Column:
    """Synthetic series id; NULL if any key is NULL (``concat_ws`` would skip it)."""
    parts: list[Column] = []
    for k in keys:
        parts += [F.lit("__"), F.col(k)]
    return F.concat(*parts[1:])


def day_number(label: Column) -> Column:
    """Numeric part of a ``d_<n>`` label, so that d_10 sorts after d_2."""
    return F.substring(label, 3, 10).cast("int")


def series_window(keys: str | list[str] | tuple[str, ...], order: str) -> WindowSpec:
    """Rows of one series in time order.

    A panel has one row per (series, period), so a partition is bounded by the number of periods
    in the calendar whatever the volume of the facts behind it.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    return W.partitionBy(*keys).orderBy(order)


def with_minimum(value: Column, counted: Column, frame: WindowSpec, minimum: int) -> Column:
    """``value`` over ``frame``, NULL unless at least ``minimum`` non-null inputs lie in it."""
    return F.when(F.count(counted).over(frame) >= minimum, value.over(frame))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)

"""Calendar, SNAP and event features.

Weekly features come from the calendar reduced to one row per week, joined once. That table grows
with the number of weeks only; Catalyst checks its size and broadcasts it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import WEEKLY, period_start
from demandspark.schemas import NAMED_EVENTS, SNAP_STATES


def time_columns(date_col: str = "date") -> dict[str, Column]:
    d = F.col(date_col)
    return {
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "year": F.year(d),
        "day_of_year": F.dayofyear(d),
    }


def add_time_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Month, ISO week, year and day of year."""
    return df.withColumns(time_columns(date_col))


def add_day_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Weekday (Monday 1 to Sunday 7), month, year, day of month and weekend flag."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "dow": F.weekday(d) + 1,
            "month": F.month(d),
            "year": F.year(d),
            "day_of_month": F.dayofmonth(d),
            "is_weekend": F.weekday(d) >= 5,
        }
    )


def pick_state(state_col: str, per_state: dict[str, Column], default: Column) -> Column:
    """The expression of the row's state, ``default`` for states without one."""
    chosen = None
    for state, value in per_state.items():
        here = F.col(state_col) == state
        chosen = F.when(here, value) if chosen is None else chosen.when(here, value)
    return default if chosen is None else chosen.otherwise(default)


def add_snap_day(
    df: DataFrame, calendar: DataFrame, state_col: str = "state_id", day_col: str = "d"
) -> DataFrame:
    """``is_snap_day`` of the row's own state; False for states without SNAP data."""
    flags = [f"snap_{s}" for s in SNAP_STATES]
    joined = df.join(calendar.select(day_col, *flags), day_col, "left")
    flag = pick_state(state_col, {s: F.col(f"snap_{s}") == 1 for s in SNAP_STATES}, F.lit(False))
    return joined.select(*df.columns, flag.alias("is_snap_day"))


def add_event_day(df: DataFrame, calendar: DataFrame, day_col: str = "d") -> DataFrame:
    """Name and type of the day's first event, NULL on ordinary days."""
    events = calendar.select(
        day_col,
        F.col("event_name_1").alias("event_name"),
        F.col("event_type_1").alias("event_type"),
    )
    return df.join(events, day_col, "left").select(*df.columns, "event_name", "event_type")


def _snap_sums() -> list[Column]:
    return [F.sum(f"snap_{s}").alias(f"_snap_{s}") for s in SNAP_STATES]


def event_columns(named_events: Sequence[str] = NAMED_EVENTS) -> list[str]:
    return [f"event_{e}_in_week" for e in named_events] + ["event_other_in_week", "any_event_in_week"]


def _event_flags(named_events: Sequence[str]) -> list[Column]:
    name = F.col("event_name_1")
    tests = [name == e for e in named_events]
    tests += [name.isNotNull() & ~name.isin(list(named_events)), name.isNotNull()]
    return [
        F.max(F.when(t, 1).otherwise(0)).alias(c)
        for t, c in zip(tests, event_columns(named_events), strict=True)
    ]


def weekly_calendar(
    calendar: DataFrame,
    named_events: Sequence[str] = NAMED_EVENTS,
    date_col: str = "date",
) -> DataFrame:
    """One row per Monday week: SNAP days per state, event flags, first price week."""
    return calendar.groupBy(period_start(F.col("date"), WEEKLY).alias(date_col)).agg(
        *_snap_sums(),
        *_event_flags(named_events),
        F.min_by("wm_yr_wk", "date").alias("wm_yr_wk"),
    )


def snap_week_column(state_col: str = "state_id") -> Column:
    counts = {s: F.col(f"_snap_{s}") for s in SNAP_STATES}
    return F.coalesce(pick_state(state_col, counts, F.lit(0)), F.lit(0)).cast("bigint")


def add_snap_weeks(
    track: DataFrame,
    calendar: DataFrame,
    states: DataFrame | None = None,
    date_col: str = "date",
) -> DataFrame:
    """``snap_days_in_week`` for the series' state; 0 where state or week is unknown.

    ``states`` maps track id to ``state_id``. It must use the track's own ids: the raw daily ids
    differ from them and would match nothing. Leave it out when the track carries ``state_id``.
    """
    weeks = calendar.groupBy(period_start(F.col("date"), WEEKLY).alias(date_col)).agg(*_snap_sums())
    rows = track
    if states is not None:
        rows = track.join(states.select("id", "state_id").distinct(), "id", "left")
    joined = rows.join(weeks, date_col, "left")
    return joined.select(*track.columns, snap_week_column().alias("snap_days_in_week"))


def add_event_weeks(
    track: DataFrame,
    calendar: DataFrame,
    named_events: Sequence[str] = NAMED_EVENTS,
    date_col: str = "date",
) -> DataFrame:
    """0/1 flags per named event, for other events and for any event in the week."""
    weeks = calendar.groupBy(period_start(F.col("date"), WEEKLY).alias(date_col)).agg(
        *_event_flags(named_events)
    )
    flags = [
        F.coalesce(F.col(c), F.lit(0)).cast("tinyint").alias(c) for c in event_columns(named_events)
    ]
    return track.join(weeks, date_col, "left").select(*track.columns, *flags)

"""The feature matrix of a track."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import joined_id
from demandspark.operators.calendar import (
    event_columns,
    snap_week_column,
    time_columns,
    weekly_calendar,
)
from demandspark.operators.promo import finish_promo, join_promo_weeks, promo_signal
from demandspark.operators.reshape import store_states
from demandspark.operators.rollup import LEVEL_KEYS, prepare_track
from demandspark.operators.windows import add_level_lags, lag_columns, rolling_columns
from demandspark.schemas import (
    FEATURE_LAGS,
    FEATURE_STATS,
    FEATURE_WINDOWS,
    NAMED_EVENTS,
    SNAP_STATES,
    track,
)

TIME_FEATURES = ("month", "week_of_year", "year", "day_of_year")


def level_columns(track_name: str) -> tuple[str, ...]:
    """Hierarchy levels for pooled features; a state-level track has no store."""
    if track(track_name).id_format == "item_store":
        return ("dept_id", "store_id", "cat_id")
    return ("dept_id", "cat_id", "state_id")


def used_lags(include_current: bool) -> tuple[int, ...]:
    """The lags, with the period itself (lag 0) if it may be used."""
    return (0, *FEATURE_LAGS) if include_current else FEATURE_LAGS


def basic_feature_columns(include_current: bool = False) -> list[str]:
    """The 17 lag, rolling and time features."""
    return (
        [f"sales_lag_{k}" for k in used_lags(include_current)]
        + [f"sales_roll{w}_{s}" for w in FEATURE_WINDOWS for s in FEATURE_STATS]
        + list(TIME_FEATURES)
    )


def feature_columns(
    levels: Sequence[str] = ("dept_id", "store_id", "cat_id"), include_current: bool = False
) -> list[str]:
    """All 31 features in order, with ``include_current`` one more."""
    return (
        basic_feature_columns(include_current)
        + ["snap_days_in_week"]
        + event_columns(NAMED_EVENTS)
        + [f"{level}_avg_sales_lag_1" for level in levels]
        + ["is_on_promo", "price_relative_to_ref"]
    )


def basic_features(
    panel: DataFrame, keys: str | Sequence[str] = "id", include_current: bool = False
) -> DataFrame:
    """Lags, rolling statistics and time features: one exchange and one sort by series.

    ``keys`` may name the columns the id was built from. A track that was just rolled up by them is
    then partitioned for the windows already, which it is not for the id built from them.

    A row describes the periods before its own. With ``include_current`` its own sales count too, as
    lag 0 and at the end of the rolling windows; targets lie ahead of the row either way.
    """
    return panel.withColumns(
        {
            **lag_columns(used_lags(include_current), keys=keys),
            **rolling_columns(FEATURE_WINDOWS, keys=keys, statistics=FEATURE_STATS, shift=0 if include_current else 1),
            **time_columns(),
        }
    )


def features_from_track(
    rows: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    track_name: str = "fresh_weekly",
    states: DataFrame | None = None,
    include_current: bool = False,
) -> DataFrame:
    """Feature matrix of a track that carries its hierarchy columns.

    The calendar is reduced to one row per week and joined once for SNAP days, event flags and the
    price week. No step after the windows shuffles the panel by anything but its series. State-level tracks also need ``states``, the store -> state map.
    """
    t = track(track_name)
    levels = level_columns(track_name)
    signal, keys = promo_signal(prices, t.id_format, states)
    matrix = basic_features(rows, LEVEL_KEYS[t.level], include_current)
    matrix = add_level_lags(matrix, levels=levels)
    matrix = matrix.join(F.broadcast(weekly_calendar(calendar)), "date", "left")  # a row a week
    matrix = finish_promo(join_promo_weeks(matrix, signal, keys))
    # a track above state level has no state of its own, hence no SNAP days
    snap = snap_week_column() if "state_id" in rows.columns else F.lit(0).cast("bigint")
    flags = {c: F.coalesce(F.col(c), F.lit(0)).cast("tinyint") for c in event_columns(NAMED_EVENTS)}
    return (
        matrix.withColumns({"snap_days_in_week": snap, **flags})
        .drop(*[f"_snap_{s}" for s in SNAP_STATES])
        .select("id", "date", "sales", *feature_columns(levels, include_current))
    )


def feature_matrix(
    daily: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    track_name: str = "fresh_weekly",
) -> DataFrame:
    """Track preparation and features in one lazy plan."""
    rows = prepare_track(daily, track_name, with_attributes=True)
    states = store_states(daily) if track(track_name).id_format == "item_state" else None
    return features_from_track(rows, calendar, prices, track_name, states)


def attach_hierarchy(panel: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Put the hierarchy columns on a bare ``(id, date, sales)`` track."""
    return panel.join(hierarchy, "id", "left")


def track_id(level: str):
    """Id expression of a hierarchy level."""
    return joined_id(*LEVEL_KEYS[level])

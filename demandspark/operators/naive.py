"""Naive forecasts: historical mean, seasonal naive, drift.

Each is one aggregation per series (combined map-side) followed by a row-local explode of the
horizon. Ids times future dates is never a join. ``by`` adds group keys such as ``fold_id``, so
all folds run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import (
    check_frequency,
    clip_at_zero,
    future_period,
    ratio,
    steps_after,
)

NAIVE_MODELS = ("HistoricalMean", "SeasonalNaive", "DriftNaive")


def last_date(train: DataFrame, by: Sequence[str] = (), date_col: str = "date") -> Column:
    """The last training date (of the row's ``by`` group) as a scalar subquery.

    Forecast dates follow the last date of the whole training set, not that of each series. The
    groups are folds, so the map has a handful of entries.
    """
    if not by:
        return train.agg(F.max(date_col)).scalar()
    group = F.struct(*by)
    ends = train.groupBy(*by).agg(F.max(date_col).alias("_end"))
    table = ends.agg(F.map_from_entries(F.collect_list(F.struct(group, F.col("_end"))))).scalar()
    return F.element_at(table, group)


def steps(horizon: int) -> Column:
    if horizon < 1:
        raise ValueError(f"horizon must be at least 1, not {horizon}")
    return F.sequence(F.lit(1), F.lit(horizon))


def future_periods(train: DataFrame, horizon: int, frequency: str = "W", by: Sequence[str] = ()) -> DataFrame:
    """The next ``horizon`` period starts after the end of the training set."""
    check_frequency(frequency)
    ends = train.groupBy(*by).agg(F.max("date").alias("_last")).filter("_last IS NOT NULL")
    return ends.select(*by, "_last", F.explode(steps(horizon)).alias("step")).select(
        *by, "step", future_period(F.col("_last"), F.col("step"), frequency).alias("date")
    )


def _mean() -> Column:
    return F.avg("sales").alias("_mean")


def _ends() -> list[Column]:
    return [
        F.min_by("sales", "date").alias("_first"),
        F.max_by("sales", "date").alias("_last_sales"),
        F.count("sales").alias("_n"),
    ]


def _season_hits(step: Column, horizon: int) -> list[Column]:
    # one pair of plain aggregates per step: collect_list would turn the whole aggregation into an
    # object aggregate, which falls back to sorting the panel after a few keys
    aggs = []
    for h in range(1, horizon + 1):
        aggs.append(F.count(F.when(step == h, 1)).alias(f"_hit_{h}"))
        aggs.append(F.max(F.when(step == h, F.col("sales").cast("double"))).alias(f"_value_{h}"))
    return aggs


def _flat_points(value: Column, horizon: int) -> Column:
    return F.transform(
        steps(horizon), lambda h: F.struct(h.alias("step"), value.cast("double").alias("prediction"))
    )


def _mean_points(horizon: int) -> Column:
    return _flat_points(F.col("_mean"), horizon)


def _season_points(horizon: int) -> Column:
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"_hit_{h}") > 0,
                    F.struct(F.lit(h).alias("step"), F.col(f"_value_{h}").alias("prediction")),
                )
                for h in range(1, horizon + 1)
            ]
        )
    )
    # a series without any look-back value falls back to its mean; partly covered ones do not
    return F.when(F.size(found) > 0, found).otherwise(_mean_points(horizon))


def drift_value(first: Column, last: Column, n: Column, step: Column) -> Column:
    slope = F.coalesce(ratio(last - first, n - 1), F.lit(0.0))
    return clip_at_zero(last.cast("double") + slope * step)


def _drift_points(horizon: int) -> Column:
    first, last, n = F.col("_first"), F.col("_last_sales"), F.col("_n")
    return F.transform(
        steps(horizon),
        lambda h: F.struct(
            h.alias("step"), drift_value(first, last, n, h).alias("prediction")
        ),
    )


def points_to_rows(
    series: DataFrame, points: Column, end: Column, frequency: str, keys: Sequence[str]
) -> DataFrame:
    """Explode per-series ``(step, prediction)`` arrays into dated prediction rows."""
    return (
        series.select(*keys, end.alias("_end"), F.explode(points).alias("_p"))
        .select(
            *keys,
            future_period(F.col("_end"), F.col("_p")["step"], frequency).alias("date"),
            F.col("_p")["prediction"].alias("prediction"),
        )
    )


def historical_mean(
    train: DataFrame, horizon: int, frequency: str = "W", by: Sequence[str] = ()
) -> DataFrame:
    """Mean of the series' training history for every future period."""
    check_frequency(frequency)
    series = train.groupBy(*by, "id").agg(_mean())
    return points_to_rows(series, _mean_points(horizon), last_date(train, by), frequency, [*by, "id"])


def seasonal_naive(
    train: DataFrame,
    horizon: int,
    season_length: int,
    frequency: str = "W",
    by: Sequence[str] = (),
) -> DataFrame:
    """The value one season earlier; series without any such value get their mean.

    The step a training row serves follows from its date, so neither a look-back join nor an
    anti-join for the fallback is needed.
    """
    if season_length < 1:
        raise ValueError(f"season_length must be at least 1, not {season_length}")
    end = last_date(train, by)
    step = steps_after(F.col("date"), F.col("_end"), season_length, frequency)
    series = (
        train.withColumn("_end", end)
        .groupBy(*by, "id", "_end")
        .agg(_mean(), *_season_hits(step, horizon))
    )
    return points_to_rows(series, _season_points(horizon), F.col("_end"), frequency, [*by, "id"])


def drift(
    train: DataFrame, horizon: int, frequency: str = "W", by: Sequence[str] = ()
) -> DataFrame:
    """Line through the first and last training value, extended and clipped at zero."""
    check_frequency(frequency)
    series = train.groupBy(*by, "id").agg(*_ends())
    return points_to_rows(series, _drift_points(horizon), last_date(train, by), frequency, [*by, "id"])


def all_naive(
    train: DataFrame,
    horizon: int,
    season_length: int,
    frequency: str = "W",
    by: Sequence[str] = (),
) -> DataFrame:
    """The three naive forecasts with a ``model_name`` column, out of one aggregation."""
    if season_length < 1:
        raise ValueError(f"season_length must be at least 1, not {season_length}")
    step = steps_after(F.col("date"), F.col("_end"), season_length, frequency)
    series = (
        train.withColumn("_end", last_date(train, by))
        .groupBy(*by, "id", "_end")
        .agg(_mean(), *_ends(), *_season_hits(step, horizon))
    )
    points = (_mean_points(horizon), _season_points(horizon), _drift_points(horizon))
    models = F.array(
        *[
            F.struct(F.lit(name).alias("model_name"), p.alias("points"))
            for name, p in zip(NAIVE_MODELS, points, strict=True)
        ]
    )
    rows = series.select(*by, "id", "_end", F.explode(models).alias("_m")).select(
        *by, "id", "_end", F.col("_m")["model_name"].alias("model_name"), F.col("_m")["points"].alias("_points")
    )
    return points_to_rows(
        rows, F.col("_points"), F.col("_end"), frequency, [*by, "model_name", "id"]
    )

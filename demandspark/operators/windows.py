"""Lags, rolling statistics, leads, lagged level means, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import series_window

_ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    # median() is refused with a frame; percentile() interpolates the same way
    "median": lambda c: F.percentile(c, F.lit(0.5)),
}


def lag_columns(
    lags: Sequence[int],
    target: str = "sales",
    keys: str | Sequence[str] = "id",
    order: str = "date",
) -> dict[str, Column]:
    w = series_window(keys, order)
    return {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}


def rolling_columns(
    windows: Sequence[int],
    target: str = "sales",
    keys: str | Sequence[str] = "id",
    order: str = "date",
    statistics: Sequence[str] = ("mean", "std"),
    shift: int = 1,
) -> dict[str, Column]:
    unknown = sorted(set(statistics) - set(_ROLLING))
    if unknown:
        raise ValueError(f"rolling statistics not supported: {unknown}")
    w = series_window(keys, order)
    out: dict[str, Column] = {}
    for size in windows:
        frame = w.rowsBetween(-(shift + size - 1), -shift)
        for stat in statistics:
            out[f"{target}_roll{size}_{stat}"] = _ROLLING[stat](F.col(target)).over(frame)
    return out


def add_lags(df: DataFrame, lags: Sequence[int], **columns) -> DataFrame:
    """Value ``k`` periods back, per series; NULL before the series starts."""
    return df.withColumns(lag_columns(lags, **columns))


def add_rolling(df: DataFrame, windows: Sequence[int], **columns) -> DataFrame:
    """Rolling statistics that end ``shift`` periods back.

    The shift is part of the frame, so a statistic and its shift are one window expression, and all
    of them share the exchange and sort of the lags.
    """
    return df.withColumns(rolling_columns(windows, **columns))


def lead_targets(
    df: DataFrame,
    horizon: int,
    target: str = "sales",
    keys: str | Sequence[str] = "id",
    order: str = "date",
) -> DataFrame:
    """The value ``h`` periods ahead as ``target_h<h>``, for h = 1..horizon."""
    w = series_window(keys, order)
    return df.withColumns(
        {f"target_h{h}": F.lead(target, h).over(w) for h in range(1, horizon + 1)}
    )


def lagged_level_means(
    track: DataFrame,
    levels: Sequence[str],
    lag: int = 1,
    date_col: str = "date",
    sales_col: str = "sales",
) -> DataFrame:
    """Per tuple of level values and date: the lagged mean sales of each level.

    The panel is first summed to the tuples (map-side combine does most of it); everything after
    runs on those few rows. The lag runs over the means of a level, never over the panel partitioned
    by level, where one department could hold a third of all rows. Rows without a level value have
    no level mean.
    """
    base = track.groupBy(*levels, date_col).agg(
        F.sum(sales_col).alias("_s"), F.count(sales_col).alias("_n")
    )
    each = F.array(
        *[F.struct(F.lit(x).alias("name"), F.col(x).cast("string").alias("value")) for x in levels]
    )
    long = base.withColumn("_level", F.explode(each)).select(
        *levels, date_col, "_s", "_n", F.col("_level.name").alias("_name"), F.col("_level.value").alias("_value")
    )
    mean = F.try_divide(F.sum("_s").cast("double"), F.sum("_n").cast("double"))
    lagged = F.lag("_mean", lag).over(series_window(["_name", "_value"], date_col))
    means = (
        long.groupBy("_name", "_value", date_col)
        .agg(mean.alias("_mean"))
        .select(
            F.col("_name").alias("_n1"),
            F.col("_value").alias("_v1"),
            F.col(date_col).alias("_d1"),
            lagged.alias("_lagged"),
        )
    )
    # the date is compared null-safe: plain equality would push IS NOT NULL below one of the two
    # uses of `base`, and Spark could no longer reuse its exchange
    on = (
        (F.col("_name") == F.col("_n1"))
        & (F.col("_value") == F.col("_v1"))
        & F.col(date_col).eqNullSafe(F.col("_d1"))
    )
    by_level = [
        F.max(F.when(F.col("_name") == x, F.col("_lagged"))).alias(f"{x}_avg_sales_lag_{lag}")
        for x in levels
    ]
    tuples = long.join(means, on, "left").groupBy(*levels, date_col).agg(*by_level)
    return tuples.withColumnsRenamed({**{x: f"_{x}" for x in levels}, date_col: "_date"})


def add_level_lags(
    track: DataFrame,
    hierarchy: DataFrame | None = None,
    lag: int = 1,
    levels: Sequence[str] = ("dept_id", "store_id", "cat_id"),
    date_col: str = "date",
    sales_col: str = "sales",
) -> DataFrame:
    """Add ``<level>_avg_sales_lag_<lag>`` for each level.

    ``hierarchy`` maps the track id to the level columns; leave it out when the track carries them.
    The panel joins one table that holds the means of all levels. It has a row per tuple of levels and
    period, whatever the number of series, and is broadcast: left to AQE, the panel would be
    shuffled whole before that table's size is known.
    """
    source = track if hierarchy is None else hierarchy
    absent = sorted(set(levels) - set(source.columns))
    if absent:
        raise ValueError(f"level columns are missing: {absent}")
    rows = track
    if hierarchy is not None:
        rows = track.join(hierarchy.select("id", *levels), "id", "left")
    means = lagged_level_means(rows, levels, lag, date_col, sales_col)
    on = F.col(date_col).eqNullSafe(F.col("_date"))
    for level in levels:
        on = on & F.col(level).eqNullSafe(F.col(f"_{level}"))
    added = [f"{level}_avg_sales_lag_{lag}" for level in levels]
    return rows.join(F.broadcast(means), on, "left").select(*track.columns, *added)


def latest_per_series(
    df: DataFrame,
    keys: str | Sequence[str] = "id",
    date_col: str = "date",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The last row of each series; ``columns`` narrows it, by default all columns stay.

    ``max_by`` combines map-side: no sort, and one row per series and task is shuffled.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if columns is not None:
        wanted = [*keys, date_col, *columns]
        absent = sorted(set(wanted) - set(df.columns))
        if absent:
            raise ValueError(f"columns are missing: {absent}")
        df = df.select(*dict.fromkeys(wanted))
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), date_col).alias("_last"))
        .select(*[c if c in keys else F.col("_last")[c].alias(c) for c in df.columns])
    )

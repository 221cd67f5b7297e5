"""Forecast accuracy metrics as aggregate expressions.

All four are ratios or roots of plain sums and averages, so Spark combines them map-side: only one
partial row per (group, task) is shuffled, whatever the number of forecasts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandspark.functions.columns import nan_ratio


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def wmape(actual: Column | str, predicted: Column | str) -> Column:
    """Sum of absolute errors over sum of absolute actuals; NaN when nothing was sold."""
    y, p = _double(actual), _double(predicted)
    return nan_ratio(F.sum(F.abs(y - p)), F.sum(F.abs(y)))


def bias(actual: Column | str, predicted: Column | str) -> Column:
    """Mean signed error over mean absolute actual; NaN when nothing was sold."""
    y, p = _double(actual), _double(predicted)
    return nan_ratio(F.avg(p - y), F.avg(F.abs(y)))


def rmse(actual: Column | str, predicted: Column | str) -> Column:
    y, p = _double(actual), _double(predicted)
    return F.coalesce(F.sqrt(F.avg((y - p) * (y - p))), F.lit(float("nan")))


def mae(actual: Column | str, predicted: Column | str) -> Column:
    y, p = _double(actual), _double(predicted)
    return F.coalesce(F.avg(F.abs(y - p)), F.lit(float("nan")))


def metric_columns(actual: Column | str = "sales", predicted: Column | str = "prediction") -> list[Column]:
    """The whole suite plus the number of compared points, for one ``agg``."""
    return [
        wmape(actual, predicted).alias("wmape"),
        bias(actual, predicted).alias("bias"),
        rmse(actual, predicted).alias("rmse"),
        mae(actual, predicted).alias("mae"),
        F.count(F.lit(1)).alias("n_obs"),
    ]

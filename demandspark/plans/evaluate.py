"""Walk-forward evaluation: predictions against actuals, per model, fold and segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.accuracy import metric_columns
from demandspark.functions.columns import ratio, series_window
from demandspark.operators import naive
from demandspark.operators.boosting import BoostedForecaster
from demandspark.operators.ets import ets_folds
from demandspark.operators.folds import assign_folds
from demandspark.operators.segments import lifecycle, rotation_tiers, series_classes
from demandspark.schemas import SMOOTHING_FORMS

FOLD_COLUMNS = ("fold_id", "train_end", "test_start", "test_end")


def score(test: DataFrame, predictions: DataFrame, group: Sequence[str]) -> DataFrame:
    """Metrics per group over the points that have both an actual and a prediction.

    Missing predictions drop out; ``n_obs`` shows how many points were compared.
    """
    joined = test.select("fold_id", "id", "date", "sales").join(
        predictions, ["fold_id", "id", "date"]
    )
    return joined.groupBy(*group).agg(*metric_columns())


def describe_folds(metrics: DataFrame, folds: DataFrame) -> DataFrame:
    """Put the fold boundaries next to the metrics; both sides are a few rows."""
    rest = [c for c in metrics.columns if c not in ("model_name", "fold_id")]
    return metrics.join(folds, "fold_id").select("model_name", *FOLD_COLUMNS, *rest)


def evaluate(
    panel: DataFrame,
    folds: DataFrame,
    forecast: Callable[[DataFrame], DataFrame],
    model_name: str | None = None,
) -> DataFrame:
    """Evaluate a stateless forecast on all folds in one job.

    ``forecast`` maps training rows with ``fold_id`` to predictions with ``fold_id``, for all series
    of the training set; the join with the test rows keeps those that are tested. ``model_name`` may
    be left out when the predictions carry it. Folds without rows simply do not appear.
    """
    rows = assign_folds(panel.select("id", "date", "sales"), folds)
    predictions = forecast(rows.filter("role = 'train'"))
    if model_name is not None:
        predictions = predictions.withColumn("model_name", F.lit(model_name))
    test = rows.filter("role = 'test'")
    return describe_folds(score(test, predictions, ["model_name", "fold_id"]), folds)


def naive_forecasts(season_length: int, frequency: str, horizon: int) -> dict[str, Callable]:
    """The naive models by name, each for :func:`evaluate`."""
    by = ["fold_id"]
    return {
        "HistoricalMean": lambda t: naive.historical_mean(t, horizon, frequency, by),
        "SeasonalNaive": lambda t: naive.seasonal_naive(t, horizon, season_length, frequency, by),
        "DriftNaive": lambda t: naive.drift(t, horizon, frequency, by),
    }


def evaluate_naive(
    panel: DataFrame, folds: DataFrame, horizon: int, season_length: int, frequency: str = "W"
) -> DataFrame:
    """All naive models on all folds: one aggregation, one join."""
    return evaluate(
        panel, folds, lambda t: naive.all_naive(t, horizon, season_length, frequency, ["fold_id"])
    )


def evaluate_ets(
    panel: DataFrame,
    folds: DataFrame,
    horizon: int,
    season_length: int,
    frequency: str = "W",
    min_history: int | None = None,
    model_name: str = "ExponentialSmoothing",
    forms: Sequence[str] = SMOOTHING_FORMS,
) -> DataFrame:
    rows = panel.select("id", "date", "sales")
    predictions = ets_folds(rows, folds, horizon, season_length, frequency, min_history, forms).withColumn(
        "model_name", F.lit(model_name)
    )
    test = assign_folds(rows, folds).filter("role = 'test'")
    return describe_folds(score(test, predictions, ["model_name", "fold_id"]), folds)


def evaluate_boosted(matrix: DataFrame, folds: DataFrame, forecaster: BoostedForecaster) -> DataFrame:
    """All folds are fitted in the same passes over the rows; folds without training or test rows drop out."""
    fitted = forecaster.fit_folds(matrix, folds)
    if not fitted:
        raise ValueError("no fold has both training and test rows")
    test = assign_folds(matrix.select("id", "date", "sales"), folds).filter("role = 'test'")
    predictions = stack([f.predict().withColumn("fold_id", F.lit(k)) for k, f in fitted.items()])
    named = predictions.withColumn("model_name", F.lit(forecaster.name))
    return describe_folds(score(test, named, ["model_name", "fold_id"]), folds)


def stack(parts: Iterable[DataFrame]) -> DataFrame:
    """Results of several models in one table."""
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metrics_by_segment(
    panel: DataFrame, test: DataFrame, predictions: DataFrame
) -> DataFrame:
    """Metrics per model, fold and intermittence class of the series."""
    labels = series_classes(panel).select("id", "intermittence_label")
    return score(
        test, predictions.join(labels, "id"), ["model_name", "fold_id", "intermittence_label"]
    )


def naive_scales(train: DataFrame, season_length: int, by: Sequence[str] = ("fold_id",), id_col: str = "id") -> DataFrame:
    """``by``, id and ``scale``: the mean absolute change from one season to the next in the training rows; NULL
    for a series that has no two values a season apart. Panels have no gaps, so a season is so many rows."""
    change = F.abs(F.col("sales") - F.lag("sales", season_length).over(series_window([*by, id_col], "date"))).cast("double")
    return train.withColumn("_change", change).groupBy(*by, id_col).agg(F.avg("_change").alias("scale"))


def mase(
    test: DataFrame, predictions: DataFrame, scales: DataFrame, group: Sequence[str] = ("model_name", "fold_id")
) -> DataFrame:
    """Mean of absolute errors over the scale of their series, per group, over the points of series with a scale
    above zero; ``n_obs`` counts these, ``n_unscaled`` the others. NaN if there are none."""
    joined = test.select("fold_id", "id", "date", "sales").join(predictions, ["fold_id", "id", "date"]).join(scales, ["fold_id", "id"], "left")
    scaled = F.coalesce(F.col("scale") > 0, F.lit(False))
    error = F.abs(F.col("sales") - F.col("prediction"))
    return joined.groupBy(*group).agg(
        F.coalesce(F.avg(F.when(scaled, ratio(error, F.col("scale")))), F.lit(float("nan"))).alias("mase"),
        F.count_if(scaled).alias("n_obs"), F.count_if(~scaled).alias("n_unscaled"),
    )


def metrics_by_rotation(train: DataFrame, test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Metrics per model, fold and rotation tier; tiers come from each fold's training volume."""
    tiers = rotation_tiers(train, ["fold_id"]).select("fold_id", "id", "rotation_tier")
    return score(test, predictions.join(tiers, ["fold_id", "id"]), ["model_name", "fold_id", "rotation_tier"])


def metrics_by_stage(train: DataFrame, test: DataFrame, predictions: DataFrame) -> DataFrame:
    """Metrics per model, fold and lifecycle stage at the end of the fold's training rows."""
    stages = lifecycle(train).select("fold_id", "id", "stage")
    return score(test, predictions.join(stages, ["fold_id", "id"]), ["model_name", "fold_id", "stage"])


def summarise(metrics: DataFrame) -> DataFrame:
    """Mean metrics over the folds per model, sample deviation of WMAPE, total points; one row a model, in any order."""
    return (
        metrics.groupBy("model_name")
        .agg(
            F.avg("wmape").alias("wmape_mean"),
            F.stddev_samp("wmape").alias("wmape_std"),
            F.avg("bias").alias("bias_mean"),
            F.avg("rmse").alias("rmse_mean"),
            F.avg("mae").alias("mae_mean"),
            F.sum("n_obs").alias("n_obs_total"),
        )
        .orderBy("wmape_mean", "model_name")
    )

"""End-to-end jobs: benchmark a track, train and publish, score a request table.

Each job stores the track and the feature matrix as tables and reads them back, so that later steps
do not repeat the way from the raw files and a lost executor costs no more than its tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.operators import ets, folds as fold_ops, naive, reshape, rollup, stockout
from demandspark.operators.boosting import BoostedForecaster, BoostingSettings
from demandspark.plans import evaluate, features, scoring
from demandspark.schemas import FOLD_COUNT, Track, track
from demandspark.sources import files
from demandspark.sources.storage import input_mark, materialize

BOOSTED = "boosted-tweedie"
SMOOTHING = "exponential-smoothing"
MODELS = (BOOSTED, SMOOTHING)


@dataclass(frozen=True)
class Inputs:
    track: Track
    panel: DataFrame
    matrix: DataFrame
    feature_cols: list[str]


def prepare(
    spark: SparkSession,
    data_dir: str,
    work_dir: str,
    track_name: str = "fresh_weekly",
    stores: Sequence[str] | None = None,
    sample: int | None = None,
) -> Inputs:
    """Track and feature matrix of the raw files, stored under ``work_dir`` and read back."""
    t = track(track_name)
    tables = files.read_all(spark, data_dir, melt=True)
    daily = tables["sales"]
    if stores:
        daily = reshape.keep_values(daily, "store_id", stores)
    rows = rollup.prepare_track(daily, track_name, with_attributes=True, require_rows=True)
    if sample:
        rows = reshape.sample_series(rows, sample)
    # one place for each choice of rows: another choice never reads what this one stored
    chosen = f"{work_dir}/track={track_name}/{selection(data_dir, stores, sample, input_mark(spark, data_dir))}"
    rows = materialize(rows, f"{chosen}/panel")
    states = reshape.store_states(daily) if t.id_format == "item_state" else None
    matrix = features.features_from_track(
        rows, tables["calendar"], tables["prices"], track_name, states
    )
    matrix = materialize(matrix, f"{chosen}/features")
    panel = rows.select("id", "date", "sales")
    return Inputs(t, panel, matrix, features.feature_columns(features.level_columns(track_name)))


def selection(data_dir: str, stores: Sequence[str] | None, sample: int | None, mark: str) -> str:
    """A folder name for the inputs (``mark`` changes with their files) and the chosen series."""
    text = repr((data_dir, sorted(stores) if stores else None, sample or None, mark))
    return f"rows={hashlib.sha256(text.encode()).hexdigest()[:16]}"


def fold_table(panel: DataFrame, t: Track, n_folds: int = FOLD_COUNT) -> DataFrame:
    return fold_ops.walk_forward(panel, t.horizon_days, n_folds)


def benchmark(
    inputs: Inputs,
    out_dir: str,
    n_folds: int = FOLD_COUNT,
    include_smoothing: bool = False,
    settings: BoostingSettings | None = None,
) -> dict[str, DataFrame]:
    """Evaluate all models on walk-forward folds and write the result tables as CSV.

    Returns the stockout audit, the metrics per fold, the summary and the feature importance of the
    corrected Tweedie model on the last fold.
    """
    t, settings = inputs.track, settings or BoostingSettings()
    spark = inputs.panel.sparkSession
    folds = fold_table(inputs.panel, t, n_folds)
    variants = [("l1", "none"), ("tweedie", "none"), ("tweedie", "rolling_mean")]
    forecasters = [
        BoostedForecaster(inputs.feature_cols, t.horizon, o, t.frequency, c, settings) for o, c in variants
    ]
    parts = [
        evaluate.evaluate_naive(inputs.panel, folds, t.horizon, t.season_length, t.frequency),
        *[evaluate.evaluate_boosted(inputs.matrix, folds, f) for f in forecasters],
    ]
    if include_smoothing:
        parts.append(
            evaluate.evaluate_ets(inputs.panel, folds, t.horizon, t.season_length, t.frequency, forms=t.forms)
        )
    files.write_result(evaluate.stack(parts), f"{out_dir}/per_fold")
    per_fold = files.read_result(spark, f"{out_dir}/per_fold", files.schemas.METRICS)
    files.write_result(evaluate.summarise(per_fold), f"{out_dir}/summary")
    last = folds.agg(F.max("train_end").alias("d")).first()["d"]
    fitted = forecasters[-1].fit(inputs.matrix.filter(F.col("date") <= last))
    files.write_result(fitted.feature_importance(), f"{out_dir}/importance")
    return {
        "audit": stockout.stockout_stats(inputs.panel),
        "per_fold": per_fold,
        "summary": files.read_result(spark, f"{out_dir}/summary", files.schemas.SUMMARY),
        "importance": files.read_result(spark, f"{out_dir}/importance", files.schemas.IMPORTANCE),
    }


def top_features(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def train_and_publish(
    inputs: Inputs,
    root: str,
    models: Sequence[str] = MODELS,
    settings: BoostingSettings | None = None,
) -> list[str]:
    """Train on the whole history and publish each requested model."""
    unknown = sorted(set(models) - set(MODELS))
    if unknown:
        raise ValueError(f"unknown models {unknown}; choose from {list(MODELS)}")
    t = inputs.track
    paths = []
    for name in models:
        if name == BOOSTED:
            forecaster = BoostedForecaster(
                inputs.feature_cols, t.horizon, "tweedie", t.frequency, "rolling_mean", settings or BoostingSettings()
            )
            fitted = forecaster.fit(inputs.matrix)
            paths.append(scoring.publish_boosted(root, name, t.name, fitted, inputs.matrix))
        else:
            predictions = ets.ets(inputs.panel, t.horizon, t.season_length, t.frequency, forms=t.forms)
            paths.append(
                scoring.publish(
                    root, name, t.name, inputs.panel, predictions, t.horizon, t.frequency,
                    extra={"season_length": str(t.season_length)},
                )
            )
    return paths


def publish_drift(inputs: Inputs, root: str) -> str:
    t = inputs.track
    predictions = naive.drift(inputs.panel, t.horizon, t.frequency)
    return scoring.publish(root, "drift", t.name, inputs.panel, predictions, t.horizon, t.frequency)


def score(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """Answer ``(id, horizon, model_name)`` requests; refused ones carry their reason and no points."""
    return scoring.answer(requests, scoring.published_models(spark, root), scoring.published_predictions(spark, root))

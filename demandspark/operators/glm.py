"""Tweedie regression with a log link: one generalized linear model per horizon step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import future_period
from demandspark.operators.windows import latest_per_series, lead_targets


@dataclass(frozen=True)
class GlmSettings:
    power: float = 1.5
    # a little shrinkage keeps features that repeat each other apart
    regularization: float = 1e-3
    iterations: int = 25
    tolerance: float = 1e-8


def _vectors(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    """Features on the scale of the link: log(1 + x); a missing one is 0."""
    names = [f"_g_{c}" for c in feature_cols]
    rows = df.withColumns({n: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for n, c in zip(names, feature_cols, strict=True)})
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows).drop(*names)


def fit_glm(rows: DataFrame, feature_cols: Sequence[str], label: str, s: GlmSettings = GlmSettings()) -> GeneralizedLinearRegressionModel:
    """Iteratively reweighted least squares: a pass over the rows per iteration, sums of the size of the features."""
    usable = rows.where(F.col(label).isNotNull()).withColumn("label", F.greatest(F.col(label).cast("double"), F.lit(0.0)))
    model = GeneralizedLinearRegression(
        family="tweedie", variancePower=s.power, linkPower=0.0, regParam=s.regularization, maxIter=s.iterations, tol=s.tolerance, solver="irls"
    )
    return model.fit(_vectors(usable, feature_cols).select("features", "label"))


def glm_forecast(matrix: DataFrame, feature_cols: Sequence[str], horizon: int, frequency: str = "W", s: GlmSettings = GlmSettings()) -> DataFrame:
    """``id, date, prediction`` for the next ``horizon`` periods, from each series' latest row."""
    rows = lead_targets(matrix, horizon).persist()
    try:
        models = {h: fit_glm(rows, feature_cols, f"target_h{h}", s) for h in range(1, horizon + 1)}
        end = matrix.agg(F.max("date").alias("d")).first()["d"]
    finally:
        rows.unpersist()
    latest = _vectors(latest_per_series(matrix, "id", "date", feature_cols), feature_cols).select("id", "features")
    out = None
    for h, model in models.items():
        part = model.transform(latest).select("id", future_period(F.lit(end), F.lit(h), frequency).alias("date"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out

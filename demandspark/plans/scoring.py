"""Publish trained models and score batches of requests.

Requests are a table, so their number is not limited and nothing loops over ids. A published model is a
folder of versions. A version is written once and never changed: metadata, latest feature rows,
predictions for its trained steps, for boosted trees the models, and a manifest with the rows and a
checksum of every table. A small file names the current version. It is replaced in one step after all
else is there, so a reader sees the old version or the new one, whole, whenever it looks and wherever a
publishing job died.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.operators.boosting import BoostedForecast, load_models
from demandspark.operators.reshape import keep_ids
from demandspark.operators.windows import latest_per_series
from demandspark.schemas import REQUEST_HORIZON_MAX, REQUEST_HORIZON_MIN
from demandspark.sources.feature_store import load_features
from demandspark.sources.storage import exists, read_text, require, subfolders, write_text

FORMAT_VERSION = "1.1"
#: File that names the current version of a model; tables of a version that its manifest counts.
CURRENT = "current"
TABLES = ("metadata", "features", "predictions")

METADATA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("track_name", T.StringType()),
        T.StructField("train_end", T.DateType()),
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("horizon", T.IntegerType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("trained_at", T.TimestampType()),
        T.StructField("format_version", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass(frozen=True)
class Published:
    """The current version of a published model."""

    metadata: dict
    features: DataFrame
    predictions: DataFrame
    models: dict

    @property
    def horizon(self) -> int:
        return self.metadata["horizon"]

    def predict(self, horizon: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        horizon = self.horizon if horizon is None else horizon
        if not 1 <= horizon <= self.horizon:
            raise ValueError(f"published for steps 1 to {self.horizon}, not {horizon}")
        rows = self.predictions.filter(F.col("step") <= horizon)
        return (rows if ids is None else keep_ids(rows, ids)).select("id", "date", "prediction")


def _numbered(predictions: DataFrame, end: Column | None = None) -> DataFrame:
    """Predictions with their step, numbered by date within the small set of forecast dates."""
    dates = predictions.agg(F.array_sort(F.collect_set("date"))).scalar()
    return predictions.withColumn("step", F.array_position(dates, F.col("date")).cast("int"))


def publish(
    root: str,
    model_name: str,
    track_name: str,
    train: DataFrame,
    predictions: DataFrame,
    horizon: int,
    frequency: str,
    feature_cols: Sequence[str] = (),
    fitted: BoostedForecast | None = None,
    extra: dict[str, str] | None = None,
) -> str:
    """Write a new version of a model and make it the current one; gives the version's folder."""
    spark = train.sparkSession
    model = f"{root.rstrip('/')}/{model_name}"
    version = f"v-{uuid.uuid4().hex}"
    path = f"{model}/{version}"
    columns = list(feature_cols) or ["sales"]
    latest_per_series(train, "id", "date", columns).write.mode("overwrite").parquet(f"{path}/features")
    _numbered(predictions.select("id", "date", "prediction")).write.mode("overwrite").parquet(
        f"{path}/predictions"
    )
    if fitted is not None:
        fitted.save_models(f"{path}/models")
    row = (
        train.agg(F.max("date").alias("train_end"))
        .select(
            F.lit(model_name).alias("model_name"),
            F.lit(track_name).alias("track_name"),
            "train_end",
            F.array(*[F.lit(c) for c in feature_cols]).cast("array<string>").alias("feature_cols"),
            F.lit(horizon).alias("horizon"),
            F.lit(frequency).alias("frequency"),
            F.current_timestamp().alias("trained_at"),
            F.lit(FORMAT_VERSION).alias("format_version"),
            _text_map(extra or {}).alias("extra"),
        )
        .select(*METADATA.names)
    )
    row.repartition(1).write.parquet(f"{path}/metadata")
    counted = [_checked(spark, path, t) for t in TABLES]
    stack = counted[0].unionByName(counted[1]).unionByName(counted[2])
    stack.repartition(1).write.parquet(f"{path}/manifest")
    write_text(spark, f"{model}/{CURRENT}", version)
    return path


def _checked(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row: table, number of rows, and a sum over the hashes of its rows."""
    rows = spark.read.parquet(f"{path}/{name}")
    checksum = F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return rows.agg(F.count(F.lit(1)).alias("rows"), checksum.alias("checksum")).select(F.lit(name).alias("name"), "rows", "checksum")


def verify(spark: SparkSession, root: str, model_name: str) -> DataFrame:
    """``name, rows, checksum, intact`` of the tables of the current version, read again."""
    path = current_version(spark, f"{root.rstrip('/')}/{model_name}")
    found = [_checked(spark, path, t) for t in TABLES]
    now = found[0].unionByName(found[1]).unionByName(found[2])
    told = spark.read.parquet(f"{path}/manifest").withColumnsRenamed({"rows": "told_rows", "checksum": "told_checksum"})
    same = (F.col("rows") == F.col("told_rows")) & (F.col("checksum") == F.col("told_checksum"))
    return now.join(told, "name").select("name", "rows", "checksum", same.alias("intact"))


def current_version(spark: SparkSession, model: str) -> str:
    """Folder of the current version; raises where nothing was published as a whole."""
    if not exists(spark, f"{model}/{CURRENT}"):
        raise ValueError(f"{model} holds no published model")
    return f"{model}/{read_text(spark, f'{model}/{CURRENT}').strip()}"


def _text_map(values: dict[str, str]) -> Column:
    pairs = [F.lit(str(x)) for kv in values.items() for x in kv]
    return (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")


def publish_boosted(
    root: str, model_name: str, track_name: str, fitted: BoostedForecast, matrix: DataFrame
) -> str:
    """Publish boosted trees trained on the whole feature matrix."""
    return publish(
        root,
        model_name,
        track_name,
        matrix,
        fitted.predict(),
        fitted.horizon,
        fitted.frequency,
        fitted.feature_cols,
        fitted,
        {"method": fitted.name},
    )


def load(spark: SparkSession, root: str, model_name: str, with_models: bool = True) -> Published:
    """Read a model folder; refuses folders that hold something else or another format."""
    path = current_version(spark, require(spark, f"{root.rstrip('/')}/{model_name}"))
    if not exists(spark, f"{path}/metadata"):
        raise ValueError(f"{path} holds no published model")
    found = spark.read.parquet(f"{path}/metadata")
    if set(found.columns) != set(METADATA.names):
        raise ValueError(f"{path} holds no published model")
    rows = found.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} must describe exactly one model")
    metadata = rows[0].asDict()
    if metadata["format_version"] != FORMAT_VERSION:
        raise ValueError(
            f"{path} has format {metadata['format_version']}, this version reads {FORMAT_VERSION}"
        )
    stored = f"{path}/models"
    models = load_models(spark, stored) if with_models and exists(spark, stored) else {}
    return Published(
        metadata,
        load_features(spark, f"{path}/features"),
        spark.read.parquet(f"{path}/predictions"),
        models,
    )


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Current versions under ``root`` that hold what a model needs; only names are listed here."""
    models = [f"{root.rstrip('/')}/{name}" for name in subfolders(spark, root)]
    paths = [current_version(spark, m) for m in models if exists(spark, f"{m}/{CURRENT}")]
    return [p for p in paths if exists(spark, f"{p}/metadata") and exists(spark, f"{p}/predictions")]


def _of_folder() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -4)


def published_models(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of all usable models under ``root`` as one table, read in one pass.

    Folders of another format, with other content, or describing more than one model, are no models.
    """
    folders = _folders(spark, root)
    if not folders:
        return spark.createDataFrame([], METADATA)
    rows = spark.read.schema(METADATA).parquet(*[f"{p}/metadata" for p in folders]).withColumn("_folder", _of_folder())
    usable = rows.where((F.col("format_version") == FORMAT_VERSION) & F.col("model_name").isNotNull() & F.col("horizon").isNotNull())
    single = rows.groupBy("_folder").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_folder")
    return usable.join(single, "_folder", "left_semi").select(*METADATA.names)


def published_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Predictions of every model under ``root`` with their ``model_name`` and ``step``, as one table."""
    schema = "id string, date date, prediction double, step int"
    folders = _folders(spark, root)
    if not folders:
        return spark.createDataFrame([], f"model_name string, {schema}")
    rows = spark.read.schema(schema).parquet(*[f"{p}/predictions" for p in folders])
    return rows.select(_of_folder().alias("model_name"), "id", "date", "prediction", "step")


def model_info(spark: SparkSession, root: str) -> DataFrame:
    """One row per usable model."""
    return published_models(spark, root).select(
        "model_name", "track_name", "train_end", F.size("feature_cols").alias("feature_count"), "horizon", "frequency", "trained_at"
    )


def answer(requests: DataFrame, models: DataFrame, predictions: DataFrame) -> DataFrame:
    """Answer ``(id, horizon, model_name)`` requests to any published model: one join with the models, one
    with their predictions. Refused requests carry their reason and no points."""
    known = models.select("model_name", F.col("horizon").alias("_trained"), "train_end")
    h = F.col("horizon")
    reason = F.when(F.col("_trained").isNull(), "unknown model")
    reason = reason.when(F.col("id").isNull() | (F.col("id") == ""), "no series id")
    reason = reason.when(h.isNull() | ~h.between(REQUEST_HORIZON_MIN, REQUEST_HORIZON_MAX), "horizon out of bounds")
    reason = reason.when(h > F.col("_trained"), "horizon beyond the trained steps")
    checked = requests.join(known, "model_name", "left").withColumn("reason", reason)
    point = F.struct("date", "prediction")
    series = predictions.groupBy("model_name", "id").agg(F.array_sort(F.collect_list(point)).alias("_points"))
    empty = F.array().cast("array<struct<date:date,prediction:double>>")
    good = F.col("reason").isNull()
    status = F.when(~good, "rejected").when(F.col("_points").isNull(), "unknown series").otherwise("ok")
    points = F.when(good & F.col("_points").isNotNull(), F.slice("_points", F.lit(1), F.greatest(h, F.lit(1)))).otherwise(empty)
    return checked.join(series, ["model_name", "id"], "left").select(
        *requests.columns, "reason", status.alias("status"), points.alias("points"), F.when(good, F.col("train_end")).alias("train_end")
    )


def check_requests(
    requests: DataFrame, trained_horizon: int, known_models: Sequence[str] | None = None
) -> DataFrame:
    """Add ``status`` (accepted or rejected) and ``reason`` to ``(id, horizon, model_name)`` rows."""
    h = F.col("horizon")
    reason = F.when(F.col("id").isNull() | (F.col("id") == ""), "no series id")
    reason = reason.when(
        h.isNull() | ~h.between(REQUEST_HORIZON_MIN, REQUEST_HORIZON_MAX), "horizon out of bounds"
    )
    reason = reason.when(h > trained_horizon, "horizon beyond the trained steps")
    if known_models is not None:
        reason = reason.when(~F.col("model_name").isin(list(known_models)), "unknown model")
    return requests.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    )


def points_per_series(predictions: DataFrame) -> DataFrame:
    """``points``: the predictions of a series as one sorted array (at most the horizon long)."""
    point = F.struct("date", "prediction")
    return predictions.groupBy("id").agg(F.array_sort(F.collect_list(point)).alias("points"))


def score_batch(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Answer ``(id, horizon, ...)`` requests; unknown ids get an empty list.

    Predictions are folded into one row per series first, so repeated requests for a hot id join
    one row each.
    """
    empty = F.array().cast("array<struct<date:date,prediction:double>>")
    answered = requests.join(points_per_series(predictions), "id", "left")
    return answered.withColumns(
        {
            "status": F.when(F.col("points").isNull(), "unknown series").otherwise("ok"),
            "points": F.coalesce(F.slice("points", F.lit(1), F.col("horizon")), empty),
        }
    )


def history_and_forecasts(history: DataFrame, forecasts: DataFrame) -> DataFrame:
    """History and the forecasts of several models as ``(id, date, series, value)``."""
    past = history.select(
        "id", "date", F.lit("Historical sales").alias("series"), F.col("sales").cast("double").alias("value")
    )
    ahead = forecasts.select(
        "id",
        "date",
        F.concat(F.lit("Forecast ("), F.col("model_name"), F.lit(")")).alias("series"),
        F.col("prediction").alias("value"),
    )
    return past.unionByName(ahead)


def forecast_chart(history: DataFrame, forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per series and date, one column per line of the chart."""
    rows = history_and_forecasts(history, forecasts)
    lines = ["Historical sales", *[f"Forecast ({m})" for m in models]]
    return rows.groupBy("id", "date").pivot("series", lines).agg(F.min("value"))


def train_end(panel: DataFrame) -> date:
    return panel.agg(F.max("date").alias("d")).first()["d"]

"""Latest feature row per series, as a Parquet table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from demandspark.operators.reshape import keep_ids
from demandspark.operators.windows import latest_per_series
from demandspark.sources.storage import require


def save_features(
    df: DataFrame,
    path: str,
    id_col: str = "id",
    date_col: str = "date",
    columns: Sequence[str] | None = None,
) -> str:
    """Write the latest row of each series; all columns stay unless ``columns`` narrows them."""
    latest_per_series(df, id_col, date_col, columns).write.mode("overwrite").parquet(path)
    return path


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(require(spark, path))


def features_for(store: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Stored rows of the requested ids; unknown ids are dropped."""
    return keep_ids(store, ids, id_col)

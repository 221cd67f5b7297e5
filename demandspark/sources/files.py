"""CSV sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from demandspark import schemas
from demandspark.operators.reshape import melt_days
from demandspark.sources.storage import exists, require


def source_path(spark: SparkSession, key: str, data_dir: str) -> str:
    """Path of a source table by its logical name."""
    if key not in schemas.SOURCE_FILES:
        raise KeyError(f"no source called {key!r}; choose from {sorted(schemas.SOURCE_FILES)}")
    return require(spark, f"{data_dir.rstrip('/')}/{schemas.SOURCE_FILES[key]}")


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file or folder; reads the header only, no type inference."""
    return spark.read.option("header", True).option("maxColumns", 100_000).csv(path).columns


def read_calendar(spark: SparkSession, data_dir: str) -> DataFrame:
    return _csv(spark, source_path(spark, "calendar", data_dir), schemas.CALENDAR)


def read_prices(spark: SparkSession, data_dir: str) -> DataFrame:
    return _csv(spark, source_path(spark, "prices", data_dir), schemas.PRICES)


def read_sales_wide(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row per series, one integer column per day of the header."""
    path = source_path(spark, "sales", data_dir)
    columns = header_columns(spark, path)
    fields = {f.name: f for f in schemas.wide_sales([c for c in columns if c.startswith("d_")])}
    schema = T.StructType([fields[c] for c in columns])
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("maxColumns", 100_000)
        .csv(path)
    )


def read_all(spark: SparkSession, data_dir: str, melt: bool = False) -> dict[str, DataFrame]:
    """Calendar, sales and prices; ``melt`` gives sales as dated rows per day."""
    calendar = read_calendar(spark, data_dir)
    sales = read_sales_wide(spark, data_dir)
    if melt:
        sales = melt_days(sales, calendar)
    return {"calendar": calendar, "sales": sales, "prices": read_prices(spark, data_dir)}


def write_result(df: DataFrame, path: str) -> str:
    """Write a result table (metrics, summary, importance) as one CSV part with a header.

    Meant for tables of a few rows per model and fold; panels go to Parquet.
    """
    df.repartition(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_result(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A result table written by :func:`write_result`, or None if there is none."""
    return _csv(spark, path, schema) if exists(spark, path) else None

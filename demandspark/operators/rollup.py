"""Roll daily sales up in the hierarchy and in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.functions.columns import joined_id, period_start
from demandspark.schemas import track

LEVEL_KEYS = {
    "sku_store": ("item_id", "store_id"),
    "sku_state": ("item_id", "state_id"),
    "sku_national": ("item_id",),
    "dept_state": ("dept_id", "state_id"),
}

# Hierarchy columns that each level's keys determine, so they can ride in its group key
LEVEL_ATTRIBUTES = {
    "sku_store": ("dept_id", "cat_id", "state_id"),
    "sku_state": ("dept_id", "cat_id"),
    "sku_national": ("dept_id", "cat_id"),
    "dept_state": ("cat_id",),
}


def _total(column: str) -> Column:
    # a group without any value sums to 0, not NULL
    return F.coalesce(F.sum(column), F.lit(0))


def rollup_time(
    df: DataFrame,
    frequency: str,
    group_cols: Sequence[str] = ("id",),
    date_col: str = "date",
    sales_col: str = "sales",
) -> DataFrame:
    """Sum per Monday week or calendar month; partial first and last periods are kept."""
    return df.groupBy(*group_cols, period_start(F.col(date_col), frequency).alias(date_col)).agg(
        _total(sales_col).alias(sales_col)
    )


def level_keys(level: str) -> tuple[str, ...]:
    if level not in LEVEL_KEYS:
        raise ValueError(f"level must be one of {sorted(LEVEL_KEYS)}, not {level!r}")
    return LEVEL_KEYS[level]


def rollup_level(
    df: DataFrame, level: str, sales_col: str = "sales", date_col: str = "date"
) -> DataFrame:
    """Sum per hierarchy level and date, with the level's synthetic id."""
    keys = level_keys(level)
    return (
        df.groupBy(*keys, date_col)
        .agg(_total(sales_col).alias(sales_col))
        .withColumn("id", joined_id(*keys))
    )


def prepare_track(
    daily: DataFrame,
    track_name: str,
    dept_col: str = "dept_id",
    date_col: str = "date",
    sales_col: str = "sales",
    with_attributes: bool = False,
    require_rows: bool = False,
) -> DataFrame:
    """The track's ``(id, date, sales)`` panel.

    Sums of sums compose, so hierarchy and time are rolled up in one ``groupBy``: one shuffle,
    after partial aggregation has collapsed each hot product to one row per period and task.

    ``with_attributes`` keeps the hierarchy columns (they are determined by the keys), which spares
    the feature plan a second pass over the facts and a join. ``require_rows`` runs a small action
    to fail early when the department filter leaves nothing.
    """
    t = track(track_name)
    chosen = daily.filter(F.col(dept_col).isin(list(t.departments)))
    if require_rows and chosen.isEmpty():
        raise ValueError(f"{dept_col} holds none of {list(t.departments)}")
    keys = level_keys(t.level)
    attributes = LEVEL_ATTRIBUTES[t.level] if with_attributes else ()
    grouped = chosen.groupBy(
        *keys, *attributes, period_start(F.col(date_col), t.frequency).alias(date_col)
    ).agg(_total(sales_col).alias(sales_col))
    kept = [*keys, *attributes] if with_attributes else []
    return grouped.select(joined_id(*keys).alias("id"), date_col, sales_col, *kept)


def fill_periods(track: DataFrame, keys: Sequence[str], frequency: str, first: Column, last: Column, value: str = "sales") -> DataFrame:
    """One row per series (``keys``) and period from that of ``first`` to that of ``last``; new rows hold 0.

    From each row to the next one of its series, so the gaps are filled row by row."""
    date = F.col("date")
    w = W.partitionBy(*keys).orderBy("date")
    rows = track.withColumns({"_next": F.lead(date).over(w), "_prev": F.lag(date).over(w)})
    step = F.expr("interval 7 days" if frequency == "W" else "interval 1 month")
    start = F.when(F.col("_prev").isNull(), period_start(first, frequency)).otherwise(date)
    end = F.when(F.col("_next").isNull(), period_start(last, frequency)).otherwise(F.date_sub("_next", 1))
    filled = rows.select(
        *[c for c in track.columns if c not in ("date", value)], F.col("date").alias("_at"), F.col(value).alias("_value"),
        F.explode(F.sequence(start, end, step)).alias("date"),
    )
    filled = filled.withColumn(value, F.when(F.col("date") == F.col("_at"), F.col("_value")).otherwise(F.lit(0)).cast(dict(track.dtypes)[value]))
    return filled.select(*track.columns)


def prepare_sparse_track(
    facts: DataFrame, track_name: str, first: Column, last: Column, with_attributes: bool = False, partitions: int | None = None
) -> DataFrame:
    """The panel of :func:`prepare_track` from days with sales only.

    Days without sales add nothing to a sum, so they are never made: facts are summed to periods first, and
    the gaps that are left are filled at the grain of the track. With ``partitions`` the sums go by series to
    that many partitions, where later windows and joins by series find the filled rows: only sums are
    shuffled, and AQE does not pack them by their size before the gaps are filled."""
    t = track(track_name)
    series = level_keys(t.level)
    kept = prepare_track(facts, track_name, with_attributes=True)
    keys = [*series, *LEVEL_ATTRIBUTES[t.level]]
    if partitions is None:
        filled = fill_periods(kept, keys, t.frequency, first, last)
    else:
        sums = kept.drop("id").repartition(partitions, *series)
        filled = fill_periods(sums, keys, t.frequency, first, last).withColumn("id", joined_id(*series)).select(*kept.columns)
    return filled if with_attributes else filled.select("id", "date", "sales")

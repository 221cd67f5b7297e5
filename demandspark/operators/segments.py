"""Intermittence classes, lifts and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.functions.columns import ratio, series_window
from demandspark.operators.naive import last_date
from demandspark.operators.ranking import exact_rank
from demandspark.schemas import INTERMITTENCE_BOUNDS, INTERMITTENCE_TOP

# Shares of the series, by falling volume, in the three rotation tiers
ROTATION = (("fast", 0.2), ("medium", 0.8), ("slow", 1.0))

# Lifecycle: weeks until a series is mature, and the fall of its fitted level over as many weeks, in shares
# of its mean, beyond which it declines
NEW_WEEKS = 26
DECLINE_SHARE = 0.25


def intermittence(zero_share: Column, checked: bool = False) -> Column:
    """Class of a zero share; ``checked`` raises for shares outside [0, 1]."""
    label = None
    for bound, name in INTERMITTENCE_BOUNDS:
        test = zero_share < bound
        label = F.when(test, name) if label is None else label.when(test, name)
    label = label.otherwise(INTERMITTENCE_TOP)
    if checked:
        outside = ~zero_share.between(0.0, 1.0)
        label = F.when(outside, F.raise_error(F.lit("zero share must lie in [0, 1]"))).otherwise(label)
    return label


def zero_shares(df: DataFrame, id_col: str = "id", sales_col: str = "sales") -> DataFrame:
    """Zero share, mean and total per series."""
    return df.groupBy(id_col).agg(
        F.avg((F.col(sales_col) == 0).cast("int")).alias("zero_share"),
        F.avg(sales_col).alias("avg_sales"),
        F.sum(sales_col).alias("total_sales"),
    )


def series_classes(df: DataFrame, id_col: str = "id", sales_col: str = "sales") -> DataFrame:
    """One row per series: zero share and intermittence class."""
    return zero_shares(df, id_col, sales_col).select(
        id_col, "zero_share", intermittence(F.col("zero_share")).alias("intermittence_label")
    )


def add_intermittence(df: DataFrame, id_col: str = "id", sales_col: str = "sales") -> DataFrame:
    """Zero share and class joined back to every row of the series."""
    classes = series_classes(df, id_col, sales_col)
    return df.join(classes, id_col, "left").select(*df.columns, "zero_share", "intermittence_label")


def lift(df: DataFrame, group_col: str, condition_col: str, value_col: str = "sales") -> DataFrame:
    """Mean where the condition is false and true, and the lift in percent, per group.

    A conditional aggregate: the two columns are known, so no pivot has to look for them. Rows are
    combined map-side; one row per group and task is shuffled even if one group holds most rows.
    """
    cond, value = F.col(condition_col), F.col(value_col)
    return (
        df.groupBy(group_col)
        .agg(
            F.avg(F.when(~cond, value)).alias("false_avg"),
            F.avg(F.when(cond, value)).alias("true_avg"),
        )
        .withColumn("lift_pct", (ratio(F.col("true_avg"), F.col("false_avg")) - 1) * 100)
    )


def pivot_values(
    df: DataFrame, index: str, column: str, value: str, values: Sequence[str], how: str = "first"
) -> DataFrame:
    """``value`` spread over one column per entry of ``values``.

    The entries are given, so no job has to collect them. ``first`` takes the smallest value, which
    is the value itself when (index, column) is unique and does not depend on row order.
    """
    agg = {"first": F.min, "mean": F.avg}[how]
    return df.groupBy(index).pivot(column, list(values)).agg(agg(value))


def rotation_tiers(df: DataFrame, by: Sequence[str] = (), id_col: str = "id", sales_col: str = "sales") -> DataFrame:
    """``by``, id, ``volume``, ``rotation_rank`` and ``rotation_tier``: the top fifth, the middle and the bottom
    fifth of the series by volume (ties by id), exactly, within ``by`` (folds, say)."""
    volumes = df.groupBy(*by, id_col).agg(F.coalesce(F.sum(sales_col), F.lit(0)).alias("volume"))
    ranked = exact_rank(volumes, [F.desc("volume"), F.asc(id_col)], by, "rotation_rank")
    tier = F.lit(ROTATION[-1][0])
    for name, share in reversed(ROTATION[:-1]):
        tier = F.when((F.col("rotation_rank") - 1) < F.col("rotation_rank_of") * share, name).otherwise(tier)
    return ranked.select(*by, id_col, "volume", "rotation_rank", tier.alias("rotation_tier"))


def product_age(df: DataFrame, id_col: str | Sequence[str] = "id", date_col: str = "date", sales_col: str = "sales") -> DataFrame:
    """Add ``product_age_weeks``: whole weeks since the first sale up to the row's date, NULL before it.

    The window ends at the row, so the age never knows of later sales."""
    so_far = series_window(id_col, date_col).rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col(sales_col) > 0, F.col(date_col))).over(so_far)
    return df.withColumn("product_age_weeks", F.floor(F.datediff(F.col(date_col), first) / 7).cast("int"))


def lifecycle(
    train: DataFrame, by: Sequence[str] = ("fold_id",), weeks: int = NEW_WEEKS, decline: float = DECLINE_SHARE, id_col: str = "id"
) -> DataFrame:
    """``by``, id, ``age_weeks``, ``slope`` (units a week, least squares over the last ``weeks`` weeks) and ``stage``
    at the end of the training rows of each ``by`` group: ``unsold``, ``new`` (first sale less than ``weeks``
    weeks ago), ``declining`` (the fitted fall over ``weeks`` weeks exceeds ``decline`` of the mean) or ``mature``.

    One aggregation: the end of a group is a scalar subquery, all sums are exact.
    """
    rows = train.withColumn("_end", last_date(train, by))
    week = F.floor(F.datediff("_end", "date") / 7)
    x = F.when(week < weeks, (F.lit(weeks - 1) - week)).cast("long")
    y = F.when(week < weeks, F.col("sales"))
    series = rows.groupBy(*by, id_col, "_end").agg(
        F.min(F.when(F.col("sales") > 0, F.col("date"))).alias("_first"),
        F.count(y).alias("_n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"),
    )
    n, sx, sy = F.col("_n"), F.col("_x"), F.col("_y")
    slope = ratio(n * F.col("_xy") - sx * sy, n * F.col("_xx") - sx * sx)
    age = F.floor(F.datediff("_end", "_first") / 7).cast("int")
    falls = -slope * weeks > decline * ratio(sy, n)
    stage = F.when(age.isNull(), "unsold").when(age < weeks, "new").when(F.coalesce(falls, F.lit(False)), "declining").otherwise("mature")
    return series.select(*by, id_col, age.alias("age_weeks"), slope.alias("slope"), stage.alias("stage"))

"""Walk-forward folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.schemas import FOLD_COUNT, FOLD_GAP_DAYS


def walk_forward(
    panel: DataFrame,
    horizon_days: int,
    n_folds: int = FOLD_COUNT,
    gap_days: int = FOLD_GAP_DAYS,
    date_col: str = "date",
    frequency: str = "D",
) -> DataFrame:
    """Fold table ``(fold_id, train_end, test_start, test_end)``; fold 0 tests the oldest window.

    The windows tile the end of the panel. With ``frequency='M'`` ``horizon_days`` counts calendar
    months instead of days, so that every window holds the same number of month starts. The job
    fails when the panel is too short.
    """
    if n_folds < 1 or horizon_days < 1 or gap_days < 0:
        raise ValueError("n_folds and horizon_days must be positive, gap_days not negative")
    lo, hi, i = F.col("_lo"), F.col("_hi"), F.col("_i")
    bounds = panel.agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    if frequency == "M":
        have = F.months_between(F.trunc(hi, "month"), F.trunc(lo, "month")).cast("int") + 1
        need = n_folds * horizon_days + 1
        end = F.last_day(F.add_months(F.trunc(hi, "month"), -(i * horizon_days)))
        start = F.add_months(F.trunc(hi, "month"), -((i + 1) * horizon_days) + 1)
    else:
        have = F.datediff(hi, lo) + 1
        need = n_folds * horizon_days + gap_days + 1
        end = F.date_sub(hi, i * horizon_days)
        start = F.date_sub(hi, (i + 1) * horizon_days - 1)
    message = F.concat(
        F.lit("panel spans "), have.cast("string"), F.lit(f" periods, folds need {need}")
    )
    # inside the generator, so the optimizer cannot drop the check
    counter = F.when(have < need, F.raise_error(message).cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.lit(n_folds - 1))
    )
    return bounds.select("_lo", "_hi", F.explode(counter).alias("_i")).select(
        (F.lit(n_folds - 1) - i).cast("int").alias("fold_id"),
        F.date_sub(start, gap_days + 1).alias("train_end"),
        start.alias("test_start"),
        end.alias("test_end"),
    )


def folds_array(folds: DataFrame) -> Column:
    """All folds as one array-of-structs scalar subquery (a handful of elements)."""
    fold = F.struct("fold_id", "train_end", "test_start", "test_end")
    return folds.agg(F.array_sort(F.collect_list(fold))).scalar()


def assign_folds(panel: DataFrame, folds: DataFrame, date_col: str = "date") -> DataFrame:
    """Each row once per fold that uses it, with ``fold_id`` and ``role`` train or test.

    Rows in the gap, or after a fold's test window, are in neither. The few folds come in as a
    scalar subquery and are exploded row by row: no join, no shuffle.
    """
    day, fold = F.col(date_col), F.col("_fold")
    in_train = day <= fold["train_end"]
    in_test = day.between(fold["test_start"], fold["test_end"])
    return (
        panel.withColumn("_fold", F.explode(folds_array(folds)))
        .filter(in_train | in_test)
        .select(
            *panel.columns,
            fold["fold_id"].alias("fold_id"),
            F.when(in_train, "train").otherwise("test").alias("role"),
        )
    )

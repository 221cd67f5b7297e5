"""Exploratory queries over the dense daily panel (``daily``) or the days with sales (``sold``).

All are partial aggregates of the panel followed by work on the few result rows. The calendar joins
on a day label; where a query only needs totals per day, the panel is reduced to days first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandspark.functions.columns import ratio
from demandspark.operators.promo import promo_from_prices
from demandspark.operators.reshape import join_day
from demandspark.operators.segments import lift, zero_shares
from demandspark.operators.stockout import flag_daily, stockout_by_series


def daily_total(sold: DataFrame, calendar: DataFrame) -> DataFrame:
    """Total of every calendar day, 0 without sales; ``sold`` need not hold the empty days."""
    totals = sold.groupBy("date").agg(F.sum("sales").alias("total_sales"))
    return calendar.select("date").join(totals, "date", "left").select(
        "date", F.coalesce("total_sales", F.lit(0)).alias("total_sales")
    )


def weekday_means(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    return (
        join_day(daily, calendar, ["weekday", "wday"])
        .groupBy("weekday", "wday")
        .agg(F.avg("sales").alias("avg_sales"))
    )


def weekday_amplitude(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Largest over smallest weekday mean, with the peak and trough weekday."""
    key = F.struct("avg_sales", "wday")
    return weekday_means(daily, calendar).agg(
        ratio(F.max("avg_sales"), F.min("avg_sales")).alias("amplitude"),
        F.max_by("weekday", key).alias("peak"),
        F.min_by("weekday", key).alias("trough"),
    )


def month_means(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.month("date").alias("month")).agg(F.avg("sales").alias("avg_sales"))


def month_means_by_category(daily: DataFrame) -> DataFrame:
    return daily.groupBy("cat_id", F.month("date").alias("month")).agg(
        F.avg("sales").alias("avg_sales")
    )


def month_amplitude_by_category(daily: DataFrame) -> DataFrame:
    return (
        month_means_by_category(daily)
        .groupBy("cat_id")
        .agg(F.max("avg_sales").alias("max"), F.min("avg_sales").alias("min"))
        .withColumn("amplitude_ratio", ratio(F.col("max"), F.col("min")))
    )


def totals_on(sold: DataFrame, calendar: DataFrame, month: int, day: int) -> DataFrame:
    """Totals of one calendar day of every year; the filter runs before the aggregation."""
    chosen = (F.month("date") == month) & (F.dayofmonth("date") == day)
    return daily_total(sold.filter(chosen), calendar.filter(chosen))


def event_day_share(calendar: DataFrame) -> DataFrame:
    return calendar.agg(
        F.count("event_name_1").alias("event_days"),
        F.count(F.lit(1)).alias("days"),
        (ratio(F.count("event_name_1"), F.count(F.lit(1))) * 100).alias("pct"),
    )


def event_type_counts(calendar: DataFrame) -> DataFrame:
    return (
        calendar.filter(F.col("event_type_1").isNotNull())
        .groupBy("event_type_1")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def event_lift(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    rows = join_day(daily, calendar, ["event_type_1"]).withColumn(
        "is_event", F.col("event_type_1").isNotNull()
    )
    return lift(rows, "cat_id", "is_event")


def snap_lift(daily: DataFrame, calendar: DataFrame, state: str = "CA") -> DataFrame:
    """SNAP days against other days in the stores of one state."""
    rows = join_day(daily.filter(F.col("state_id") == state), calendar, [f"snap_{state}"])
    return lift(rows.withColumn("is_snap", F.col(f"snap_{state}") == 1), "cat_id", "is_snap")


def event_type_lift(daily: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean per category and event type against the category's days without event."""
    means = (
        join_day(daily, calendar, ["event_type_1"])
        .groupBy("cat_id", "event_type_1")
        .agg(F.avg("sales").alias("avg_sales"))
    )
    plain = F.max(F.when(F.col("event_type_1").isNull(), F.col("avg_sales")))
    return (
        means.withColumn("baseline", plain.over(W.partitionBy("cat_id")))
        .filter(F.col("event_type_1").isNotNull())
        .withColumn(
            "lift_pct", ratio(F.col("avg_sales") - F.col("baseline"), F.col("baseline")) * 100
        )
        .orderBy("cat_id", F.desc("lift_pct"), "event_type_1")
    )


def event_days(sold: DataFrame, calendar: DataFrame, n: int = 15, highest: bool = False) -> DataFrame:
    """The ``n`` event days with the lowest or highest total; ties by date."""
    days = calendar.filter(F.col("event_name_1").isNotNull()).select(
        "d", "date", "event_name_1", "event_type_1"
    )
    order = F.desc("total_sales") if highest else F.asc("total_sales")
    return days.join(daily_total(sold, calendar), "date", "left").orderBy(order, "date").limit(n)


def zero_share_counts(daily: DataFrame) -> DataFrame:
    share = F.col("zero_share")
    return zero_shares(daily).agg(
        F.count_if(share > 0.5).alias("over_half"),
        F.count_if(share > 0.8).alias("over_80"),
        F.count_if(share < 0.1).alias("under_10"),
        F.count(F.lit(1)).alias("n_series"),
    )


def zero_share_histogram(daily: DataFrame, bins: int = 50) -> DataFrame:
    """Series per equal-width bin of the zero share; a share of 1 falls into the last bin."""
    position = F.least(F.floor(F.col("zero_share") * bins), F.lit(bins - 1)).cast("int")
    return zero_shares(daily).groupBy(position.alias("bin")).agg(F.count(F.lit(1)).alias("n_series"))


SERIES_KEYS = ("item_id", "store_id")


def suspicious_share(daily: DataFrame) -> DataFrame:
    return (
        flag_daily(daily, id_col=SERIES_KEYS)
        .agg(
            F.count_if(F.col("sales") == 0).alias("n_zeros"),
            F.count_if("suspicious_zero").alias("n_suspicious"),
        )
        .withColumn("pct", ratio(F.col("n_suspicious"), F.col("n_zeros")) * 100)
    )


def stockout_top(daily: DataFrame, n: int = 10) -> DataFrame:
    """Series with the most suspicious zeros among those that sell at all."""
    return (
        stockout_by_series(flag_daily(daily, id_col=SERIES_KEYS))
        .filter(F.col("avg_sales") > 0)
        .orderBy(F.desc("n_suspicious"), "id")
        .limit(n)
    )


def promo_frequency(prices: DataFrame) -> DataFrame:
    return promo_from_prices(prices).agg(
        (F.avg(F.col("on_promo").cast("int")) * 100).alias("pct_on_promo"),
        F.count("on_promo").alias("n_known"),
    )


def first_sales(sold: DataFrame) -> DataFrame:
    return (
        sold.filter(F.col("sales") > 0)
        .groupBy("id")
        .agg(F.min("date").alias("first_sale_date"))
    )


def cold_start_share(sold: DataFrame) -> DataFrame:
    """Series, those first sold after the first day of the panel, and their percentage."""
    start = sold.agg(F.min("date")).scalar()
    late = F.count_if(F.col("first_sale_date") > F.col("_start"))
    return (
        first_sales(sold)
        .withColumn("_start", start)
        .agg(F.count(F.lit(1)).alias("n_series"), late.alias("n_cold_start"))
        .withColumn("pct", ratio(F.col("n_cold_start"), F.col("n_series")) * 100)
    )


def cold_start_histogram(sold: DataFrame) -> DataFrame:
    """Cold-start series per month of their first sale."""
    start = sold.agg(F.min("date")).scalar()
    return (
        first_sales(sold)
        .filter(F.col("first_sale_date") > start)
        .groupBy(F.trunc("first_sale_date", "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_series"))
    )


def series_stats(panel: DataFrame) -> DataFrame:
    """Periods, mean, maximum and zero share per series."""
    return panel.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.avg("sales").alias("mean_sales"),
        F.max("sales").alias("max_sales"),
        F.avg((F.col("sales") == 0).cast("int")).alias("zero_share"),
    )

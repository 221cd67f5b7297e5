"""Registered queries: every operator over the whole star-schema tables.

Operators on the daily panel (one row per series and day) report, per series and month, the number of
their rows and one hash over every cell of them, NULLs included.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.functions import accuracy
from demandspark.operators import (
    calendar as cal,
    ets,
    folds as fold_ops,
    glm,
    naive,
    promo,
    reconcile,
    reshape,
    rollup,
    segments,
    sketches,
    stockout,
    windows,
)
from demandspark.operators.boosting import BoostedForecaster
from demandspark.plans import evaluate, explore, features, scoring
from demandspark.schemas import NAMED_EVENTS, TRACKS
from demandspark.sources import files, star_schema as star
from demandspark.sources.feature_store import features_for
from demandspark.sources.storage import new_folder

Query = Callable[[SparkSession, str], DataFrame]

FRESH = TRACKS["fresh_weekly"]
COVERAGE_MINIMUM = 350

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


# Shared inputs ------------------------------------------------------------


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def fresh(spark: SparkSession, sf: str, grain: str = "brand", attributes: bool = False) -> DataFrame:
    """The weekly track. Persisted, since evaluation reads it for bounds, training and test."""
    return star.track_panel(spark, sf, FRESH.name, grain, attributes).persist()


def fresh_folds(panel: DataFrame) -> DataFrame:
    return fold_ops.walk_forward(panel, FRESH.horizon_days)


def fresh_predictions(panel: DataFrame, folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test rows and the three naive predictions of all folds."""
    rows = fold_ops.assign_folds(panel, folds)
    predictions = naive.all_naive(
        rows.filter("role = 'train'"), FRESH.horizon, FRESH.season_length, "W", ["fold_id"]
    )
    return rows.filter("role = 'test'"), predictions


def all_ids(spark: SparkSession, sf: str, grain: str = "brand") -> DataFrame:
    """Track-format ids of every series, also of departments outside the track."""
    pairs = star.sold(spark, sf, grain).select("item_id", "store_id", "dept_id", "state_id").distinct()
    return pairs.withColumn("id", features.track_id("sku_store"))


def row_text(columns: Sequence[Column | str]) -> Column:
    """All columns of a row as one text; a NULL is marked, so it differs from any value."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cells])


def digest(daily: DataFrame, columns: Sequence[Column | str], part: Column | None = None) -> DataFrame:
    """Rows and MD5 over every cell of every row, per series and month (or ``part``).

    The operator's rows are as many as the panel's; any altered cell changes the digest.
    """
    part = F.trunc("date", "month") if part is None else part
    return daily.groupBy("id", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.md5(F.array_join(F.array_sort(F.collect_list(row_text(columns))), "\n")).alias("rows_md5"),
    )


IDS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
DAILY = (*IDS, "d", "date", "sales")


def _flag(column: str) -> Column:
    return F.col(column).cast("bigint")


# Sources ------------------------------------------------------------------


def _csv_folder(df: DataFrame, key: str) -> str:
    root = new_folder(df.sparkSession, "csv")
    df.write.option("header", True).csv(f"{root}/{files.schemas.SOURCE_FILES[key]}")
    return root


@query
def src_calendar(spark, sf):
    root = _csv_folder(star.calendar(spark, sf), "calendar")
    return files.read_calendar(spark, root)


@query
def src_prices(spark, sf):
    root = _csv_folder(star.prices(spark, sf), "prices")
    return files.read_prices(spark, root)


@query
def src_sales_wide(spark, sf):
    """The wide file, written and read as CSV: one digest of all day columns per series."""
    root = _csv_folder(star.sales_wide(spark, sf), "sales")
    wide = files.read_sales_wide(spark, root)
    days = reshape.day_columns(wide)
    series = wide.select(*IDS, F.expr(f"array({', '.join(days)})").alias("s"))
    cells = F.transform("s", lambda v: F.coalesce(v.cast("string"), F.lit("\\N")))
    return series.select(
        *IDS, F.size("s").cast("bigint").alias("n_days"), F.md5(F.array_join(cells, ",")).alias("days_md5")
    )


@query
def feature_store_latest(spark, sf):
    return windows.latest_per_series(_matrix(spark, sf))


# Reshape ------------------------------------------------------------------


@query
def melt_sales(spark, sf):
    long = reshape.melt_days(star.sales_wide(spark, sf))
    no = F.substring("d", 3, 10).cast("bigint")
    return digest(long, [*IDS, "d", "sales"], F.floor(no / 32).cast("bigint"))


@query
def melt_sales_dated(spark, sf):
    return digest(reshape.melt_days(star.sales_wide(spark, sf), star.calendar(spark, sf)), DAILY)


def _launched(spark, sf) -> DataFrame:
    return reshape.melt_days(star.sales_wide(spark, sf), star.calendar(spark, sf), from_first_sale=True)


@query
def drop_pre_launch(spark, sf):
    return digest(_launched(spark, sf), DAILY)


@query
def subset_stores(spark, sf):
    return digest(reshape.keep_values(star.daily_sales(spark, sf), "store_id", ["NATION_1", "NATION_2"]), DAILY)


@query
def sample_series(spark, sf):
    return reshape.sample_series(fresh(spark, sf), 20)


@query
def id_hierarchy_item_store(spark, sf):
    return reshape.hierarchy_map(star.sold(spark, sf), "item_store")


@query
def id_hierarchy_item_state(spark, sf):
    return reshape.hierarchy_map(star.sold(spark, sf), "item_state")


@query
def features_for_ids(spark, sf):
    store = windows.latest_per_series(features.basic_features(fresh(spark, sf)))
    wanted = all_ids(spark, sf).filter("state_id = 'CA'")
    rows = features_for(store, wanted)
    return rounded(rows, *[c for c in features.basic_feature_columns() if "_roll" in c])


@query
def history_last_2y(spark, sf):
    return reshape.recent_history(fresh(spark, sf), 730)


# Joins and sets -----------------------------------------------------------


@query
def join_calendar_left(spark, sf):
    rows = reshape.join_day(star.daily_sales(spark, sf), star.calendar(spark, sf), ["wday", "wm_yr_wk"])
    return digest(rows, [*DAILY, "wday", "wm_yr_wk"])


@query
def eval_inner_join(spark, sf):
    panel = fresh(spark, sf)
    test, predictions = fresh_predictions(panel, fresh_folds(panel))
    joined = test.join(predictions, ["fold_id", "id", "date"])
    return rounded(joined.select("model_name", "fold_id", "id", "date", "sales", "prediction"), "prediction")


@query
def ids_missing_anti(spark, sf):
    return reshape.missing_ids(all_ids(spark, sf), fresh(spark, sf))


@query
def ids_routed_intersect(spark, sf):
    launched = rollup.prepare_track(_launched(spark, sf), FRESH.name)
    routed = ets.routed_ids(launched, FRESH.season_length, COVERAGE_MINIMUM)
    return reshape.common_ids(all_ids(spark, sf).filter("state_id <> 'CA'"), routed)


# Rollups ------------------------------------------------------------------


@query
def agg_weekly(spark, sf):
    return rollup.rollup_time(star.daily_sales(spark, sf), "W", ["item_id", "store_id"])


@query
def agg_monthly(spark, sf):
    return rollup.rollup_time(star.daily_sales(spark, sf), "M", ["item_id", "store_id"])


@query
def agg_sku_store(spark, sf):
    level = rollup.rollup_level(star.daily_sales(spark, sf), "sku_store")
    return digest(level, ["id", "item_id", "store_id", "date", "sales"])


@query
def agg_sku_state(spark, sf):
    level = rollup.rollup_level(star.daily_sales(spark, sf), "sku_state")
    return digest(level, ["id", "item_id", "state_id", "date", "sales"])


@query
def agg_sku_national(spark, sf):
    return rollup.rollup_level(star.daily_sales(spark, sf), "sku_national")


@query
def agg_dept_state(spark, sf):
    return rollup.rollup_level(star.daily_sales(spark, sf), "dept_state")


@query
def track_fresh_weekly(spark, sf):
    return star.track_panel(spark, sf, "fresh_weekly")


@query
def track_fresh_weekly_fine(spark, sf):
    return star.track_panel(spark, sf, "fresh_weekly", "brand_type")


@query
def track_fresh_weekly_part(spark, sf):
    return star.track_panel(spark, sf, "fresh_weekly", "part")


@query
def track_dry_monthly(spark, sf):
    return star.track_panel(spark, sf, "dry_monthly")


@query
def track_non_food_monthly(spark, sf):
    return star.track_panel(spark, sf, "non_food_monthly")


# Stockouts, segments, lifts -----------------------------------------------


@query
def stockout_by_series(spark, sf):
    flagged = stockout.flag_daily(star.daily_sales(spark, sf), id_col=explore.SERIES_KEYS)
    return rounded(stockout.stockout_by_series(flagged), "avg_sales", "suspicious_share")


@query
def stockout_by_category(spark, sf):
    flagged = stockout.flag_daily(star.daily_sales(spark, sf), id_col=explore.SERIES_KEYS)
    return rounded(
        stockout.stockout_by_category(flagged),
        "pct_suspicious_among_zeros",
        "pct_suspicious_among_all",
    )


@query
def intermittence_labels(spark, sf):
    rows = segments.add_intermittence(fresh(spark, sf))
    return rounded(rows, "zero_share")


def _lifts(df: DataFrame) -> DataFrame:
    return rounded(df, "false_avg", "true_avg", "lift_pct")


@query
def lift_event(spark, sf):
    rows = cal.add_event_day(star.daily_sales(spark, sf), star.calendar(spark, sf))
    return _lifts(
        segments.lift(rows.withColumn("is_event", F.col("event_name").isNotNull()), "store_id", "is_event")
    )


@query
def lift_promo(spark, sf):
    rows = promo.join_promo_daily(
        star.daily_sales(spark, sf),
        promo.promo_from_prices(star.prices(spark, sf)),
        star.calendar(spark, sf),
    )
    return _lifts(segments.lift(rows, "store_id", "on_promo"))


@query
def lift_snap(spark, sf):
    rows = cal.add_snap_day(star.daily_sales(spark, sf), star.calendar(spark, sf))
    return _lifts(segments.lift(rows, "state_id", "is_snap_day"))


# Metrics ------------------------------------------------------------------

METRIC_NAMES = ("wmape", "bias", "rmse", "mae")


def _metric(spark, sf, fn: Callable, name: str) -> DataFrame:
    panel = fresh(spark, sf)
    test, predictions = fresh_predictions(panel, fresh_folds(panel))
    joined = test.join(predictions, ["fold_id", "id", "date"])
    return joined.groupBy("model_name").agg(r6(fn("sales", "prediction")).alias(name))


@query
def metric_wmape(spark, sf):
    return _metric(spark, sf, accuracy.wmape, "wmape")


@query
def metric_bias(spark, sf):
    return _metric(spark, sf, accuracy.bias, "bias")


@query
def metric_rmse(spark, sf):
    return _metric(spark, sf, accuracy.rmse, "rmse")


@query
def metric_mae(spark, sf):
    return _metric(spark, sf, accuracy.mae, "mae")


@query
def metrics_by_fold(spark, sf):
    """Minimum slice: track, folds, drift on all folds, metrics."""
    panel = fresh(spark, sf)
    forecast = evaluate.naive_forecasts(FRESH.season_length, "W", FRESH.horizon)["DriftNaive"]
    return rounded(evaluate.evaluate(panel, fresh_folds(panel), forecast, "DriftNaive"), *METRIC_NAMES)


@query
def metrics_by_segment(spark, sf):
    panel = fresh(spark, sf)
    test, predictions = fresh_predictions(panel, fresh_folds(panel))
    return rounded(evaluate.metrics_by_segment(panel, test, predictions), *METRIC_NAMES)


def _evaluated(spark, sf, grain: str = "brand") -> DataFrame:
    panel = fresh(spark, sf, grain)
    return evaluate.evaluate_naive(panel, fresh_folds(panel), FRESH.horizon, FRESH.season_length)


@query
def eval_naive(spark, sf):
    panel = fresh(spark, sf)
    forecast = evaluate.naive_forecasts(FRESH.season_length, "W", FRESH.horizon)["HistoricalMean"]
    return rounded(
        evaluate.evaluate(panel, fresh_folds(panel), forecast, "HistoricalMean"), *METRIC_NAMES
    )


@query
def eval_all_naive(spark, sf):
    return rounded(_evaluated(spark, sf), *METRIC_NAMES)


@query
def eval_all_naive_fine(spark, sf):
    return rounded(_evaluated(spark, sf, "brand_type"), *METRIC_NAMES)


@query
def eval_all_naive_part(spark, sf):
    return rounded(_evaluated(spark, sf, "part"), *METRIC_NAMES)


@query
def summary_by_model(spark, sf):
    return rounded(
        evaluate.summarise(_evaluated(spark, sf)),
        "wmape_mean", "wmape_std", "bias_mean", "rmse_mean", "mae_mean",
    )


@query
def pivot_wmape_by_fold(spark, sf):
    wide = segments.pivot_values(
        _evaluated(spark, sf), "fold_id", "model_name", "wmape", naive.NAIVE_MODELS, "mean"
    )
    return rounded(wide, *naive.NAIVE_MODELS)


@query
def pivot_forecast_vs_history(spark, sf):
    panel = fresh(spark, sf)
    predictions = naive.all_naive(panel, FRESH.horizon, FRESH.season_length, "W")
    chart = scoring.forecast_chart(reshape.recent_history(panel, 730), predictions, naive.NAIVE_MODELS)
    return rounded(chart, *[c for c in chart.columns if c not in ("id", "date")])


@query
def series_stats(spark, sf):
    return rounded(explore.series_stats(fresh(spark, sf)), "mean_sales", "zero_share")


@query
def hierarchy_cardinality(spark, sf):
    columns = ["state_id", "store_id", "cat_id", "dept_id", "item_id", "id", "d"]
    days = star.calendar(spark, sf).agg(F.count_distinct("d").alias("n_d"))
    return reshape.cardinalities(star.sold_daily(spark, sf), columns[:-1]).withColumn("n_d", days.scalar())


@query
def event_type_counts(spark, sf):
    return explore.event_type_counts(star.calendar(spark, sf))


@query
def ets_coverage(spark, sf):
    launched = rollup.prepare_track(_launched(spark, sf), FRESH.name)
    return rounded(ets.coverage(launched, FRESH.season_length, COVERAGE_MINIMUM), "ets_share")


@query
def ets_coverage_default(spark, sf):
    """With the minimum that the models use, two seasons."""
    launched = rollup.prepare_track(_launched(spark, sf), FRESH.name)
    return rounded(ets.coverage(launched, FRESH.season_length), "ets_share")


# Exploration --------------------------------------------------------------


@query
def eda_daily_total(spark, sf):
    return explore.daily_total(star.sold_daily(spark, sf), star.calendar(spark, sf))


@query
def eda_dow_avg(spark, sf):
    return rounded(explore.weekday_means(star.daily_sales(spark, sf), star.calendar(spark, sf)), "avg_sales")


@query
def eda_dow_amplitude(spark, sf):
    return rounded(
        explore.weekday_amplitude(star.daily_sales(spark, sf), star.calendar(spark, sf)), "amplitude"
    )


@query
def eda_month_avg(spark, sf):
    return rounded(explore.month_means(star.daily_sales(spark, sf)), "avg_sales")


@query
def eda_month_cat(spark, sf):
    return rounded(explore.month_means_by_category(star.daily_sales(spark, sf)), "avg_sales")


@query
def eda_month_amplitude(spark, sf):
    return rounded(
        explore.month_amplitude_by_category(star.daily_sales(spark, sf)), "max", "min", "amplitude_ratio"
    )


@query
def eda_christmas_totals(spark, sf):
    return explore.totals_on(star.sold_daily(spark, sf), star.calendar(spark, sf), 12, 25)


@query
def eda_event_day_share(spark, sf):
    return rounded(explore.event_day_share(star.calendar(spark, sf)), "pct")


@query
def eda_event_lift(spark, sf):
    return _lifts(explore.event_lift(star.daily_sales(spark, sf), star.calendar(spark, sf)))


@query
def eda_snap_lift(spark, sf):
    return _lifts(explore.snap_lift(star.daily_sales(spark, sf), star.calendar(spark, sf)))


@query
def eda_event_type_lift(spark, sf):
    return rounded(
        explore.event_type_lift(star.daily_sales(spark, sf), star.calendar(spark, sf)),
        "avg_sales", "baseline", "lift_pct",
    )


@query
def eda_event_days_bottom(spark, sf):
    return explore.event_days(star.sold_daily(spark, sf), star.calendar(spark, sf), 15)


@query
def eda_event_days_top(spark, sf):
    return explore.event_days(star.sold_daily(spark, sf), star.calendar(spark, sf), 15, highest=True)


@query
def eda_zero_share_counts(spark, sf):
    return explore.zero_share_counts(star.daily_sales(spark, sf))


@query
def eda_zero_share_hist(spark, sf):
    return explore.zero_share_histogram(star.daily_sales(spark, sf))


@query
def eda_suspicious_share(spark, sf):
    return rounded(explore.suspicious_share(star.daily_sales(spark, sf)), "pct")


@query
def eda_stockout_top10(spark, sf):
    return rounded(explore.stockout_top(star.daily_sales(spark, sf)), "avg_sales", "suspicious_share")


@query
def eda_promo_frequency(spark, sf):
    return rounded(explore.promo_frequency(star.prices(spark, sf)), "pct_on_promo")


@query
def eda_promo_lift(spark, sf):
    rows = promo.join_promo_daily(
        star.daily_sales(spark, sf),
        promo.promo_from_prices(star.prices(spark, sf)),
        star.calendar(spark, sf),
    )
    return _lifts(segments.lift(rows, "cat_id", "on_promo"))


@query
def cold_start_share(spark, sf):
    return rounded(explore.cold_start_share(star.sold_daily(spark, sf)), "pct")


@query
def eda_cold_start_hist(spark, sf):
    return explore.cold_start_histogram(star.sold_daily(spark, sf))


# Windows and features -----------------------------------------------------


@query
def feat_lags(spark, sf):
    return windows.add_lags(fresh(spark, sf), features.FEATURE_LAGS)


@query
def feat_rolling_mean_std(spark, sf):
    rows = windows.add_rolling(fresh(spark, sf), features.FEATURE_WINDOWS)
    return rounded(rows, *rows.columns[3:])


@query
def feat_rolling_min_max_median(spark, sf):
    rows = windows.add_rolling(fresh(spark, sf), [4, 13], statistics=("min", "max", "median"))
    return rounded(rows, *[c for c in rows.columns if c.endswith("median")])


@query
def feat_targets(spark, sf):
    return windows.lead_targets(fresh(spark, sf), FRESH.horizon)


@query
def stockout_daily_flags(spark, sf):
    flagged = stockout.flag_daily(star.daily_sales(spark, sf), id_col=explore.SERIES_KEYS)
    # the mean times its count of days is a whole number of fifteenths or so; round before summing
    mean = F.round(F.col("rolling_mean") * 360360, 0).cast("bigint")
    return digest(flagged, [*DAILY, "suspicious_zero", mean])


@query
def stockout_weekly_flags(spark, sf):
    return stockout.flag_periods(fresh(spark, sf))


@query
def stockout_corrected_mean(spark, sf):
    return rounded(stockout.correct_stockouts(fresh(spark, sf), "rolling_mean"), "sales")


@query
def stockout_corrected_median(spark, sf):
    return rounded(stockout.correct_stockouts(fresh(spark, sf), "median"), "sales")


@query
def stockout_stats(spark, sf):
    return rounded(stockout.stockout_stats(fresh(spark, sf)), "share_suspicious", "mean_imputed_value")


@query
def promo_flags(spark, sf):
    rows = promo.promo_from_prices(star.prices(spark, sf))
    # prices and their medians are equal to the bit; rounding them would only add ties
    return rounded(rows, "price_relative_to_ref")


@query
def feat_hier_lags(spark, sf):
    panel = fresh(spark, sf)
    hierarchy = reshape.hierarchy_map(star.sold(spark, sf))
    rows = windows.add_level_lags(panel, hierarchy)
    return rounded(rows, *rows.columns[3:]).select("id", "date", "sales", *rows.columns[3:])


@query
def feat_time_basic(spark, sf):
    return cal.add_time_features(fresh(spark, sf))


@query
def feat_calendar_daily(spark, sf):
    rows = cal.add_day_features(star.daily_sales(spark, sf))
    numbers = [F.col(c).cast("bigint") for c in ("dow", "month", "year", "day_of_month", "is_weekend")]
    return digest(rows, [*DAILY, *numbers])


@query
def feat_snap_day(spark, sf):
    rows = cal.add_snap_day(star.daily_sales(spark, sf), star.calendar(spark, sf))
    return digest(rows, [*DAILY, _flag("is_snap_day")])


@query
def feat_event_day(spark, sf):
    rows = cal.add_event_day(star.daily_sales(spark, sf), star.calendar(spark, sf))
    return digest(rows, [*DAILY, "event_name", "event_type"])


@query
def feat_snap_week(spark, sf):
    states = reshape.hierarchy_map(star.sold(spark, sf))
    return cal.add_snap_weeks(fresh(spark, sf), star.calendar(spark, sf), states)


@query
def feat_event_week(spark, sf):
    rows = cal.add_event_weeks(fresh(spark, sf), star.calendar(spark, sf))
    return rows.withColumns({c: F.col(c).cast("int") for c in cal.event_columns(NAMED_EVENTS)})


@query
def feat_promo_daily(spark, sf):
    rows = promo.join_promo_daily(
        star.daily_sales(spark, sf),
        promo.promo_from_prices(star.prices(spark, sf)),
        star.calendar(spark, sf),
    )
    scaled = F.round(F.col("price_relative_to_ref") * 1000000, 0).cast("bigint")
    return digest(rows, [*DAILY, "wm_yr_wk", _flag("on_promo"), scaled])


def _promo_weeks(spark, sf, panel: DataFrame, id_format: str) -> DataFrame:
    facts = star.sold(spark, sf)
    rows = promo.add_promo_weeks(
        panel,
        star.prices(spark, sf),
        star.calendar(spark, sf),
        reshape.hierarchy_map(facts, id_format),
        id_format,
        reshape.store_states(facts),
    )
    return rows.select(
        "id", "date", "sales", F.col("is_on_promo").cast("int").alias("is_on_promo"), r6("price_relative_to_ref").alias("price_relative_to_ref")
    )


@query
def feat_promo_week_store(spark, sf):
    return _promo_weeks(spark, sf, fresh(spark, sf), "item_store")


@query
def feat_promo_week_state(spark, sf):
    level = rollup.rollup_level(star.daily_sales(spark, sf), "sku_state")
    return _promo_weeks(spark, sf, rollup.rollup_time(level, "W"), "item_state")


def _plain_matrix(spark, sf, grain: str = "brand") -> DataFrame:
    # Both the windows and the level means read the track. It is persisted where its series are bounded; by
    # part it would fill the disk, and both read the shuffled sums again and fill the gaps themselves.
    if grain == "part":
        track = star.track_panel(spark, sf, FRESH.name, grain, True, star.series_partitions(spark, sf))
    else:
        track = fresh(spark, sf, grain, attributes=True)
    return features.features_from_track(
        track,
        star.calendar(spark, sf),
        star.prices(spark, sf, grain),
    )


def _matrix(spark, sf, grain: str = "brand") -> DataFrame:
    matrix = _plain_matrix(spark, sf, grain)
    flags = [*cal.event_columns(NAMED_EVENTS), "is_on_promo"]
    matrix = matrix.withColumns({c: F.col(c).cast("int") for c in flags})
    means = [c for c in matrix.columns if "_roll" in c or "_avg_" in c] + ["price_relative_to_ref"]
    return rounded(matrix, *means)


@query
def feature_matrix(spark, sf):
    return _matrix(spark, sf)


@query
def feature_matrix_fine(spark, sf):
    return _matrix(spark, sf, "brand_type")


@query
def feature_matrix_part(spark, sf):
    return _matrix(spark, sf, "part")


@query
def feature_matrix_dry_monthly(spark, sf):
    """State-level track: promotions and hierarchy means come from the state levels."""
    dry = TRACKS["dry_monthly"]
    rows = rollup.prepare_track(star.daily_sales(spark, sf), dry.name, with_attributes=True)
    states = reshape.store_states(star.sold(spark, sf))
    matrix = features.features_from_track(rows, star.calendar(spark, sf), star.prices(spark, sf), dry.name, states)
    flags = [*cal.event_columns(NAMED_EVENTS), "is_on_promo"]
    matrix = matrix.withColumns({c: F.col(c).cast("int") for c in flags})
    means = [c for c in matrix.columns if "_roll" in c or "_avg_" in c] + ["price_relative_to_ref"]
    return rounded(matrix, *means)


@query
def feature_matrix_basic(spark, sf):
    rows = features.basic_features(fresh(spark, sf))
    return rounded(rows, *[c for c in rows.columns if "_roll" in c])


@query
def feature_matrix_basic_current(spark, sf):
    rows = features.basic_features(fresh(spark, sf), include_current=True)
    return rounded(rows, *[c for c in rows.columns if "_roll" in c])


# Folds and forecasts ------------------------------------------------------


@query
def folds(spark, sf):
    return fresh_folds(fresh(spark, sf))


def _dry(spark, sf) -> DataFrame:
    return star.track_panel(spark, sf, "dry_monthly")


def _monthly_folds(panel: DataFrame) -> DataFrame:
    return fold_ops.walk_forward(panel, TRACKS["dry_monthly"].horizon, frequency="M")


@query
def folds_monthly(spark, sf):
    return _monthly_folds(_dry(spark, sf))


@query
def eval_naive_monthly(spark, sf):
    panel, dry = _dry(spark, sf), TRACKS["dry_monthly"]
    found = evaluate.evaluate_naive(panel, _monthly_folds(panel), dry.horizon, dry.season_length, dry.frequency)
    return rounded(found, *METRIC_NAMES)


@query
def fold_assignment(spark, sf):
    panel = fresh(spark, sf)
    return fold_ops.assign_folds(panel, fresh_folds(panel))


@query
def future_periods(spark, sf):
    weekly = naive.future_periods(fresh(spark, sf), FRESH.horizon, "W").withColumn("frequency", F.lit("W"))
    monthly = star.track_panel(spark, sf, "dry_monthly")
    return weekly.unionByName(
        naive.future_periods(monthly, 3, "M").withColumn("frequency", F.lit("M"))
    )


def _both_tracks(spark, sf, forecast: Callable) -> DataFrame:
    """A forecast on the weekly and on the monthly dry-goods track."""
    dry = TRACKS["dry_monthly"]
    monthly = star.track_panel(spark, sf, dry.name).persist()
    out = forecast(fresh(spark, sf), FRESH).unionByName(forecast(monthly, dry))
    return rounded(out.select("id", "date", "prediction"), "prediction")


@query
def fc_hist_mean(spark, sf):
    return _both_tracks(spark, sf, lambda p, t: naive.historical_mean(p, t.horizon, t.frequency))


@query
def fc_seasonal_naive(spark, sf):
    return _both_tracks(
        spark, sf, lambda p, t: naive.seasonal_naive(p, t.horizon, t.season_length, t.frequency)
    )


@query
def fc_drift(spark, sf):
    return _both_tracks(spark, sf, lambda p, t: naive.drift(p, t.horizon, t.frequency))


@query
def fc_ets(spark, sf):
    """Form chosen per series on the weekly and the monthly track (additive and seasonal forms)."""
    dry = TRACKS["dry_monthly"]
    monthly = star.track_panel(spark, sf, dry.name).persist()
    parts = [
        ets.ets(p, t.horizon, t.season_length, t.frequency, forms=t.forms)
        for p, t in ((fresh(spark, sf), FRESH), (monthly, dry))
    ]
    return rounded(evaluate.stack(parts), "prediction")


@query
def eval_ets(spark, sf):
    panel = fresh(spark, sf)
    return rounded(
        evaluate.evaluate_ets(panel, fresh_folds(panel), FRESH.horizon, FRESH.season_length),
        *METRIC_NAMES,
    )


@query
def fc_ses(spark, sf):
    """Level-only smoothing over the whole grid."""
    rows = ets.ets(fresh(spark, sf), FRESH.horizon, FRESH.season_length, forms=("ANN",))
    return rounded(rows, "prediction")


@query
def fc_ets_refined(spark, sf):
    """Level and trend smoothing with three finer grids around the best row."""
    rows = ets.ets(fresh(spark, sf), FRESH.horizon, FRESH.season_length, forms=("ANN", "AAN"), refinements=3)
    return rounded(rows, "prediction")


def _boosted(spark, sf, objective: str, correction: str = "none"):
    matrix = _plain_matrix(spark, sf).persist()
    forecaster = BoostedForecaster(
        features.feature_columns(),
        FRESH.horizon,
        objective,
        target_correction=correction,
    )
    return forecaster, matrix


def _fitted(spark, sf, objective: str, correction: str = "none"):
    forecaster, matrix = _boosted(spark, sf, objective, correction)
    return forecaster.fit(matrix)


@query
def gbt_train_rows(spark, sf):
    """What the corrected models learn from: one row per series, date and step with a target."""
    forecaster, matrix = _boosted(spark, sf, "tweedie", "rolling_mean")
    wide = forecaster.training_rows(matrix)
    steps = [F.struct(F.lit(h).alias("step"), F.col(f"target_h{h}").alias("label")) for h in range(1, FRESH.horizon + 1)]
    long = wide.select("id", "date", F.explode(F.array(*steps)).alias("s"))
    return rounded(long.select("id", "date", "s.step", "s.label").where("label IS NOT NULL"), "label")


@query
def gbt_prediction_rows(spark, sf):
    """Which predictions the models make, and that they can be used."""
    rows = _fitted(spark, sf, "l2").predict()
    most = fresh(spark, sf).groupBy("id").agg(F.max("sales").alias("most"))
    near = F.col("prediction").between(0, 3 * F.col("most")) & ~F.isnan("prediction")
    return rows.join(most, "id").select("id", "date", near.alias("usable"))


@query
def fc_gbt_l1(spark, sf):
    return _fitted(spark, sf, "l1").predict()


@query
def fc_gbt_l2(spark, sf):
    return _fitted(spark, sf, "l2").predict()


@query
def fc_tweedie(spark, sf):
    return _fitted(spark, sf, "tweedie").predict()


@query
def fc_tweedie_corrected(spark, sf):
    return _fitted(spark, sf, "tweedie", "rolling_mean").predict()


@query
def gbt_importance(spark, sf):
    return _fitted(spark, sf, "l2").feature_importance()


@query
def eval_boosted(spark, sf):
    """Walk-forward evaluation of the corrected Tweedie model; all folds and steps are grown together."""
    forecaster, matrix = _boosted(spark, sf, "tweedie", "rolling_mean")
    found = evaluate.evaluate_boosted(matrix, fresh_folds(matrix), forecaster)
    return rounded(found, *METRIC_NAMES)


@query
def fc_glm_tweedie(spark, sf):
    return rounded(glm.glm_forecast(_plain_matrix(spark, sf), features.feature_columns(), FRESH.horizon), "prediction")


# Segments, ages, scaled errors ----------------------------------------------


def _train(panel: DataFrame, folds: DataFrame) -> DataFrame:
    return fold_ops.assign_folds(panel, folds).filter("role = 'train'")


@query
def segment_rotation(spark, sf):
    return segments.rotation_tiers(fresh(spark, sf, "brand_type"))


@query
def metrics_by_rotation(spark, sf):
    panel = fresh(spark, sf)
    folds = fresh_folds(panel)
    test, predictions = fresh_predictions(panel, folds)
    return rounded(evaluate.metrics_by_rotation(_train(panel, folds), test, predictions), *METRIC_NAMES)


@query
def segment_lifecycle(spark, sf):
    panel = fresh(spark, sf, "brand_type")
    return rounded(segments.lifecycle(_train(panel, fresh_folds(panel))), "slope")


@query
def metrics_by_stage(spark, sf):
    panel = fresh(spark, sf)
    folds = fresh_folds(panel)
    test, predictions = fresh_predictions(panel, folds)
    return rounded(evaluate.metrics_by_stage(_train(panel, folds), test, predictions), *METRIC_NAMES)


@query
def feat_product_age(spark, sf):
    return segments.product_age(fresh(spark, sf))


@query
def feat_promo_duration(spark, sf):
    rows = promo.add_promo_runs(promo.promo_from_prices(star.prices(spark, sf)), star.calendar(spark, sf))
    return rows.select("item_id", "store_id", "wm_yr_wk", "promo_run", "promo_weeks", "weeks_since_promo")


@query
def metric_mase(spark, sf):
    panel = fresh(spark, sf)
    folds = fresh_folds(panel)
    test, predictions = fresh_predictions(panel, folds)
    scales = evaluate.naive_scales(_train(panel, folds), FRESH.season_length)
    return rounded(evaluate.mase(test, predictions, scales), "mase")


@query
def cardinality_sketch(spark, sf):
    """Distinct items and stores per state over two years, merged from monthly sketches, against exact counts."""
    columns, by = ["item_id", "store_id"], ["state_id"]
    facts = star.sold_daily(spark, sf, "brand_type")
    merged = sketches.merged_counts(sketches.distinct_sketches(facts, columns, by), columns, by, "1996-01-01", "1997-12-01")
    chosen = facts.where("date BETWEEN DATE'1996-01-01' AND DATE'1997-12-31'")
    exact = chosen.groupBy(*by).agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))
    far = lambda c: F.abs(F.col(c) - F.col(f"n_{c}")) <= 4 * sketches.STANDARD_ERROR * F.col(f"n_{c}")
    return merged.join(exact, by).select(*by, *(f"n_{c}" for c in columns), *(far(c).alias(f"{c}_within_error") for c in columns))


# Reconciliation -------------------------------------------------------------

LEVELS = [(), ("state_id",), ("store_id",), ("item_id",), ("item_id", "store_id")]


def _places(panel: DataFrame) -> DataFrame:
    return panel.select("id", "item_id", "store_id", "state_id").distinct()


@query
def reconcile_bottom_up(spark, sf):
    panel = fresh(spark, sf, attributes=True)
    predictions = naive.drift(panel, FRESH.horizon)
    exact = F.round("prediction", 6).cast("decimal(18,6)").alias("prediction")
    rows = predictions.select("id", "date", exact).join(_places(panel), "id")
    return reconcile.bottom_up(rows, LEVELS).withColumn("prediction", F.col("prediction").cast("double"))


@query
def reconcile_top_down(spark, sf):
    panel = fresh(spark, sf, attributes=True)
    total = panel.groupBy("date").agg(F.sum("sales").alias("sales")).withColumn("id", F.lit("total"))
    volumes = panel.groupBy("id", "item_id", "store_id", "state_id").agg(F.sum("sales").alias("volume"))
    return reconcile.top_down(naive.drift(total, FRESH.horizon), volumes, LEVELS)


def _node_panel(panel: DataFrame) -> DataFrame:
    """The series of every level; ids are level and node."""
    sums = reconcile.level_sums(panel, LEVELS, "sales")
    return sums.select(F.concat("level", F.lit("|"), "node").alias("id"), "date", "sales")


@query
def reconcile_mint(spark, sf):
    """Drift forecasts of every level made coherent with their fold errors' shrunk covariance."""
    panel = fresh(spark, sf, attributes=True)
    nodes = _node_panel(panel).persist()
    rows = fold_ops.assign_folds(nodes, fresh_folds(nodes))
    predicted = naive.drift(rows.filter("role = 'train'"), FRESH.horizon, "W", ["fold_id"])
    missed = rows.filter("role = 'test'").join(predicted, ["fold_id", "id", "date"])
    error = F.struct("fold_id", "date", (F.col("sales") - F.col("prediction")).alias("e"))
    errors = missed.groupBy(F.col("id").alias("node")).agg(F.transform(F.array_sort(F.collect_list(error)), lambda x: x["e"]).alias("errors"))
    base = naive.drift(nodes, FRESH.horizon).withColumnRenamed("id", "node").persist()
    dates = [r["date"] for r in base.select("date").distinct().orderBy("date").collect()]
    edges = reconcile.hierarchy_edges(_places(panel), LEVELS[-1], LEVELS)
    return reconcile.min_trace(base, errors, edges, dates)


# Scoring ------------------------------------------------------------------


def _published(spark, sf) -> str:
    """A folder with two models of the track, drift and historical mean."""
    panel = fresh(spark, sf)
    root = new_folder(spark, "models")
    for name, predictions in (
        ("drift", naive.drift(panel, FRESH.horizon)), ("mean", naive.historical_mean(panel, FRESH.horizon))
    ):
        scoring.publish(root, name, FRESH.name, panel, predictions, FRESH.horizon, "W")
    return root


@query
def model_info(spark, sf):
    return scoring.model_info(spark, _published(spark, sf)).drop("trained_at")


@query
def score_models(spark, sf):
    """Requests to two published models and to one that does not exist."""
    root = _published(spark, sf)
    names = F.explode(F.array(F.lit("drift"), F.lit("mean"), F.lit("absent")))
    requests = _requests(spark, sf).drop("model_name").withColumn("model_name", names)
    answered = scoring.answer(requests, scoring.published_models(spark, root), scoring.published_predictions(spark, root))
    return answered.select(
        "id", "horizon", "model_name", "status", "reason", "train_end", F.size("points").alias("n_points"), _points_text().alias("points")
    )


def _requests(spark, sf, grain: str = "brand") -> DataFrame:
    """One request per known series of any department; the horizon runs from 0 to 14."""
    number = F.regexp_extract("item_id", "[0-9]+", 0).cast("int")
    nation = F.regexp_extract("store_id", "[0-9]+", 0).cast("int")
    return all_ids(spark, sf, grain).select(
        "id", ((number * 7 + nation) % 15).alias("horizon"), F.lit("drift").alias("model_name")
    )


def _points_text() -> Column:
    cells = F.transform("points", lambda p: F.concat(
        p["date"].cast("string"), F.lit("="), F.round(p["prediction"], 6).cast("decimal(18,6)").cast("string")))
    return F.array_join(cells, ";")


def _scored(spark, sf, grain: str = "brand"):
    requests = scoring.check_requests(_requests(spark, sf, grain), FRESH.horizon)
    accepted = requests.filter("status = 'accepted'").drop("status", "reason")
    answered = scoring.score_batch(accepted, naive.drift(fresh(spark, sf, grain), FRESH.horizon))
    return answered.select(
        "id", "horizon", "model_name", "status", F.size("points").alias("n_points"), _points_text().alias("points")
    )


@query
def score_batch(spark, sf):
    return _scored(spark, sf)


@query
def score_batch_part(spark, sf):
    return _scored(spark, sf, "part")


@query
def score_rejects(spark, sf):
    checked = scoring.check_requests(_requests(spark, sf), FRESH.horizon, ["drift"])
    return checked.filter("status = 'rejected'")

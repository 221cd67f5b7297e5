"""Table schemas, track definitions and fixed values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values -------------------------------------------------------------

ID_COLUMNS = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")

SNAP_STATES = ("CA", "TX", "WI")

NAMED_EVENTS = (
    "Christmas",
    "Thanksgiving",
    "PesachEnd",
    "PurimEnd",
    "LaborDay",
    "SuperBowl",
)

# zero share below the bound -> label; the last label has no bound
INTERMITTENCE_BOUNDS = (
    (0.10, "high_volume"),
    (0.50, "medium"),
    (0.80, "intermittent"),
)
INTERMITTENCE_TOP = "extreme_intermittent"

FEATURE_LAGS = (1, 2, 4, 8, 13, 26, 52)
FEATURE_WINDOWS = (4, 13, 26)
FEATURE_STATS = ("mean", "std")

FOLD_COUNT = 4
FOLD_GAP_DAYS = 0
SEED = 42

# Error, trend and season (none) of the non-seasonal smoothing forms
SMOOTHING_FORMS = ("ANN", "MNN", "AAN", "MAN", "AAdN", "MAdN")

REQUEST_HORIZON_MIN = 1
REQUEST_HORIZON_MAX = 12

SOURCE_FILES = {
    "calendar": "calendar.csv",
    "sales": "sales_train_evaluation.csv",
    "prices": "sell_prices.csv",
}

# Schemas ------------------------------------------------------------------

CALENDAR = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("weekday", T.StringType()),
        T.StructField("wday", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("d", T.StringType()),
        T.StructField("event_name_1", T.StringType()),
        T.StructField("event_type_1", T.StringType()),
        T.StructField("event_name_2", T.StringType()),
        T.StructField("event_type_2", T.StringType()),
        T.StructField("snap_CA", T.IntegerType()),
        T.StructField("snap_TX", T.IntegerType()),
        T.StructField("snap_WI", T.IntegerType()),
    ]
)

PRICES = T.StructType(
    [
        T.StructField("store_id", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("wm_yr_wk", T.IntegerType()),
        T.StructField("sell_price", T.DoubleType()),
    ]
)

PANEL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("sales", T.DoubleType()),
    ]
)

METRICS = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("fold_id", T.IntegerType()),
        T.StructField("train_end", T.DateType()),
        T.StructField("test_start", T.DateType()),
        T.StructField("test_end", T.DateType()),
        T.StructField("wmape", T.DoubleType()),
        T.StructField("bias", T.DoubleType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("n_obs", T.LongType()),
    ]
)

SUMMARY = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("wmape_mean", T.DoubleType()),
        T.StructField("wmape_std", T.DoubleType()),
        T.StructField("bias_mean", T.DoubleType()),
        T.StructField("rmse_mean", T.DoubleType()),
        T.StructField("mae_mean", T.DoubleType()),
        T.StructField("n_obs_total", T.LongType()),
    ]
)

IMPORTANCE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("importance", T.DoubleType()),
    ]
)


def wide_sales(day_columns: list[str]) -> T.StructType:
    """Schema of the wide daily sales file for the day columns of its header."""
    return T.StructType(
        [T.StructField(c, T.StringType()) for c in ID_COLUMNS]
        + [T.StructField(c, T.IntegerType()) for c in day_columns]
    )


# Tracks ------------------------------------------------------


@dataclass(frozen=True)
class Track:
    """One planning track: which products, at which grain, how far ahead."""

    name: str
    frequency: str
    level: str
    departments: tuple[str, ...]
    horizon: int
    season_length: int
    # forms of exponential smoothing; a season of 52 weeks would need 52 initial states of a series
    forms: tuple[str, ...] = SMOOTHING_FORMS

    @property
    def id_format(self) -> str:
        return "item_store" if self.level == "sku_store" else "item_state"

    @property
    def horizon_days(self) -> int:
        return self.horizon * (7 if self.frequency == "W" else 30)


TRACKS = {
    t.name: t
    for t in (
        Track("fresh_weekly", "W", "sku_store", ("FOODS_3",), 4, 52),
        Track(
            "dry_monthly",
            "M",
            "sku_state",
            ("FOODS_1", "FOODS_2", "HOUSEHOLD_1", "HOUSEHOLD_2"),
            3,
            12,
            (*SMOOTHING_FORMS, "ANA", "AAA", "AAdA"),
        ),
        Track("non_food_monthly", "M", "sku_state", ("HOBBIES_1", "HOBBIES_2"), 3, 12, (*SMOOTHING_FORMS, "ANA", "AAA", "AAdA")),
    )
}


def track(name: str) -> Track:
    if name not in TRACKS:
        raise KeyError(f"no track called {name!r}; choose from {sorted(TRACKS)}")
    return TRACKS[name]

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from demandspark.operators import windows
from demandspark.operators.promo import join_promo_weeks
from demandspark.operators.rollup import prepare_sparse_track
from demandspark.plans.features import features_from_track
from helpers import MONDAY, by_key, calendar, column, panel, weeks


def test_lags_respect_series(spark):
    df = windows.add_lags(panel(spark, {"X": [1, 2, 3], "Y": [7, 8, 9]}), [1, 2])
    assert column(df.filter("id = 'X'"), "sales_lag_1") == [None, 1, 2]
    assert column(df.filter("id = 'Y'"), "sales_lag_2") == [None, None, 7]


def test_rolling_is_shifted(spark):
    df = windows.add_rolling(panel(spark, {"X": range(1, 11)}), [3], statistics=("mean",))
    got = column(df, "sales_roll3_mean")
    assert got[0] is None and got[3] == 2.0


def test_rolling_std_needs_two(spark):
    df = windows.add_rolling(panel(spark, {"X": [1, 3, 5]}), [4])
    got = column(df, "sales_roll4_std")
    assert got[:2] == [None, None] and got[2] == pytest.approx(2**0.5)


def test_unknown_statistic(spark):
    with pytest.raises(ValueError):
        windows.add_rolling(panel(spark, {"X": [1]}), [3], statistics=("kurtosis",))


def test_rolling_against_plain_loop(spark):
    rng = random.Random(7)
    values = [None if rng.random() < 0.2 else rng.randint(0, 9) for _ in range(60)]
    stats = ("mean", "std", "min", "max", "median")
    df = windows.add_rolling(panel(spark, {"X": values}), [4, 13], statistics=stats)
    rows = df.orderBy("date").collect()
    fns = {
        "mean": (1, statistics.fmean),
        "std": (2, statistics.stdev),
        "min": (1, min),
        "max": (1, max),
        "median": (1, statistics.median),
    }
    for w in (4, 13):
        for i, row in enumerate(rows):
            seen = [v for v in values[max(0, i - w) : i] if v is not None]
            for s, (need, fn) in fns.items():
                got = row[f"sales_roll{w}_{s}"]
                if len(seen) < need:
                    assert got is None
                else:
                    assert got == pytest.approx(fn(seen))


def test_lags_and_rolling_share_one_exchange(spark):
    from demandspark.plans.features import basic_features

    df = basic_features(panel(spark, {"X": [1, 2]}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_leads(spark):
    df = windows.lead_targets(panel(spark, {"X": [1, 2, 3]}), 2)
    assert column(df, "target_h1") == [2, 3, None]
    assert column(df, "target_h2") == [3, None, None]


@pytest.fixture
def hierarchy(spark):
    rows = [(f"{i}__{s}", i, s, "FOODS_3", "FOODS", "CA") for i in "AB" for s in ("S1", "S2")]
    return spark.createDataFrame(
        rows, "id string, item_id string, store_id string, dept_id string, cat_id string, state_id string"
    )


def test_level_lags(spark, hierarchy):
    ids = {f"{i}__{s}": [10, 10, 10] for i in "AB" for s in ("S1", "S2")}
    df = windows.add_level_lags(panel(spark, ids), hierarchy)
    assert set(df.columns) == {
        "id", "date", "sales",
        "dept_id_avg_sales_lag_1", "store_id_avg_sales_lag_1", "cat_id_avg_sales_lag_1",
    }
    got = column(df.filter("id = 'A__S1'"), "store_id_avg_sales_lag_1")
    assert got == [None, 10.0, 10.0]


def test_level_lags_average_siblings(spark, hierarchy):
    df = windows.add_level_lags(
        panel(spark, {"A__S1": [1, 5], "A__S2": [3, 5], "B__S1": [5, 5], "B__S2": [7, None]}), hierarchy
    )
    last = by_key(df.filter("date = '2020-01-13'"), "id")
    assert last[("A__S1",)]["dept_id_avg_sales_lag_1"] == 4.0
    assert last[("A__S1",)]["store_id_avg_sales_lag_1"] == 3.0
    assert last[("B__S2",)]["store_id_avg_sales_lag_1"] == 5.0


def test_missing_level(spark, hierarchy):
    with pytest.raises(ValueError):
        windows.add_level_lags(panel(spark, {"A__S1": [1]}), hierarchy.drop("dept_id"))


def test_latest_row(spark):
    df = panel(spark, {"A": [1, 2, None], "B": [4]})
    got = by_key(windows.latest_per_series(df), "id")
    assert got[("A",)]["sales"] is None and got[("B",)]["sales"] == 4
    assert windows.latest_per_series(df, columns=["sales"]).columns == ["id", "date", "sales"]
    with pytest.raises(ValueError):
        windows.latest_per_series(df, columns=["nothing"])


def filled_rows_shuffled(plan):
    """Exchanges of filled rows themselves, not of sums over them."""
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    lines = [re.sub(r"^\*\(\d+\) ", "", line) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if line.startswith("Exchange"):
            below = next((x for x in lines[i + 1 :] if re.match(r".*Aggregate|Generate explode\(sequence|.*Scan", x)), "")
            found += [line] * below.startswith("Generate explode(sequence")
    return found


def test_filled_rows_of_a_matrix_are_not_shuffled(spark):
    weeks_ = weeks(20)
    sold = [(f"I{i}", "FOODS_3", "FOODS", f"S{i % 2}", "CA", w, 1 + (i + k) % 5) for i in range(4) for k, w in enumerate(weeks_) if (i + k) % 3]
    facts = spark.createDataFrame(sold, "item_id string, dept_id string, cat_id string, store_id string, state_id string, date date, sales bigint")
    prices = spark.createDataFrame(
        [(f"S{i % 2}", f"I{i}", 11101 + k, 5.0 - (k % 4)) for i in range(4) for k in range(20)], "store_id string, item_id string, wm_yr_wk int, sell_price double"
    )
    days = calendar(spark, MONDAY, 140)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, plain = (
            prepare_sparse_track(facts, "fresh_weekly", F.lit(weeks_[0]), F.lit(weeks_[-1]), True, n) for n in (8, None)
        )
        got, want = (features_from_track(r, days, prices) for r in (rows, plain))
        assert not filled_rows_shuffled(got._jdf.queryExecution().executedPlan().toString())
        assert got.count() == 80 and by_key(got, "id", "date") == by_key(want, "id", "date")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_promo_weeks_keep_every_row_and_match(spark):
    rows = spark.createDataFrame([("A", "S", 1), ("A", "S", 2), ("A", "S", None), ("A", None, 1), ("B", "S", 1)], "item_id string, store_id string, wm_yr_wk int")
    signal = spark.createDataFrame(
        [("A", "S", 1, True, 0.5), ("A", "S", 1, False, 1.0), ("A", "S", None, True, 0.1), ("A", None, 1, True, 0.2), ("B", "S", 2, True, 0.3)],
        "item_id string, store_id string, wm_yr_wk int, on_promo boolean, price_relative_to_ref double",
    )
    keys = ["item_id", "store_id", "wm_yr_wk"]
    want = rows.join(signal, keys, "left").select(*rows.columns, "on_promo", "price_relative_to_ref")
    got = join_promo_weeks(rows, signal, keys)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))

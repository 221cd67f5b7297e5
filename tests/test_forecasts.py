from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from demandspark.functions.accuracy import metric_columns
from demandspark.operators import folds as fold_ops
from demandspark.operators import naive
from demandspark.plans import evaluate
from helpers import MONDAY, by_key, column, panel


def values(df, sid):
    return [r["prediction"] for r in df.filter(F.col("id") == sid).orderBy("date").collect()]


def test_historical_mean(spark):
    got = naive.historical_mean(panel(spark, {"X": [10] * 20}), 4)
    assert values(got, "X") == [10.0] * 4
    first = got.orderBy("date").first()["date"]
    assert first == MONDAY + timedelta(days=140)


def test_dates_follow_the_global_end(spark):
    got = naive.historical_mean(panel(spark, {"X": [1, 2], "Y": [1, 2, 3, 4]}), 1)
    assert {r["date"] for r in got.collect()} == {MONDAY + timedelta(days=28)}


def test_seasonal_looks_back(spark):
    got = naive.seasonal_naive(panel(spark, {"X": range(60)}), 4, 52)
    assert values(got, "X") == [8, 9, 10, 11]


def test_seasonal_fallback_only_without_any_hit(spark):
    p = panel(spark, {"X": [10] * 20})
    assert values(naive.seasonal_naive(p, 4, 52), "X") == [10.0] * 4
    # L lacks the look-backs of the first two steps, S lacks all four
    q = panel(spark, {"L": range(60), "S": range(5)}).filter("id <> 'L' OR sales >= 10")
    got = naive.seasonal_naive(q, 4, 52)
    assert values(got, "L") == [10, 11] and len(values(got, "S")) == 4
    with pytest.raises(ValueError):
        naive.seasonal_naive(p, 4, 0)


def test_seasonal_monthly(spark):
    months = [(f"{2019 + m // 12}-{m % 12 + 1:02d}-01", float(m)) for m in range(14)]
    p = spark.createDataFrame([("X", *m) for m in months], "id string, d string, sales double").selectExpr(
        "id", "cast(d as date) AS date", "sales"
    )
    got = naive.seasonal_naive(p, 3, 12, "M")
    assert values(got, "X") == [2, 3, 4]
    assert column(got, "date") == [date(2020, m, 1) for m in (3, 4, 5)]


def test_drift(spark):
    got = naive.drift(panel(spark, {"U": range(10), "D": [9, 7, 5, 3, 1], "O": [4]}), 3)
    assert values(got, "U") == [10, 11, 12]
    assert values(got, "D") == [0, 0, 0]
    assert values(got, "O") == [4, 4, 4]


def test_drift_does_not_depend_on_row_order(spark):
    p = panel(spark, {"U": range(10)}).orderBy(F.rand(3))
    assert values(naive.drift(p, 2), "U") == [10, 11]


def test_all_naive_matches_the_single_models(spark):
    p = panel(spark, {"A": range(60), "B": [3, 0, 4], "C": [5] * 40})
    got = naive.all_naive(p, 4, 52)
    for name, one in (
        ("HistoricalMean", naive.historical_mean(p, 4)),
        ("SeasonalNaive", naive.seasonal_naive(p, 4, 52)),
        ("DriftNaive", naive.drift(p, 4)),
    ):
        assert by_key(got.filter(F.col("model_name") == name).drop("model_name"), "id", "date") == by_key(one, "id", "date")


def test_future_periods(spark):
    p = panel(spark, {"X": [1, 2]}, start=date(2020, 12, 1), step=31)
    assert column(naive.future_periods(p, 2, "M"), "date") == [date(2021, 2, 1), date(2021, 3, 1)]
    with pytest.raises(ValueError):
        naive.future_periods(p, 2, "Q")
    with pytest.raises(ValueError):
        naive.drift(p, 0)


def test_empty_training_set(spark):
    empty = panel(spark, {"X": [1]}).filter("false")
    assert naive.drift(empty, 3).count() == 0
    assert naive.seasonal_naive(empty, 3, 52).count() == 0


def metrics(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "sales double, prediction double")
    return df.agg(*metric_columns()).first()


def test_metrics(spark):
    m = metrics(spark, [(10, 12), (20, 18), (30, 30)])
    assert m["wmape"] == pytest.approx(4 / 60) and m["bias"] == pytest.approx(0) and m["n_obs"] == 3
    assert m["mae"] == pytest.approx(4 / 3) and m["rmse"] == pytest.approx((8 / 3) ** 0.5)
    assert metrics(spark, [(0, 1), (10, 9), (20, 22)])["wmape"] == pytest.approx(4 / 30)


def test_metrics_without_sales_are_nan(spark):
    m = metrics(spark, [(0, 1), (0, 2)])
    assert m["wmape"] != m["wmape"] and m["bias"] != m["bias"] and m["mae"] == 1.5


def test_folds(spark):
    p = panel(spark, {"X": [1] * 30}, date(2020, 1, 1), 1)
    rows = fold_ops.walk_forward(p, 5, n_folds=3, gap_days=2).orderBy("fold_id").collect()
    assert [r["fold_id"] for r in rows] == [0, 1, 2]
    assert rows[-1]["test_end"] == date(2020, 1, 30)
    for r in rows:
        assert (r["test_end"] - r["test_start"]).days == 4
        assert (r["test_start"] - r["train_end"]).days == 3
    assert rows[1]["test_start"] == rows[0]["test_end"] + timedelta(days=1)


def test_fold_assignment_leaves_the_gap_out(spark):
    p = panel(spark, {"X": [1] * 30}, date(2020, 1, 1), 1)
    folds = fold_ops.walk_forward(p, 5, n_folds=1, gap_days=5)
    got = fold_ops.assign_folds(p, folds)
    assert got.filter("role = 'train'").count() == 20 and got.filter("role = 'test'").count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_folds_fail_on_short_panels(spark):
    p = panel(spark, {"X": [1] * 3}, date(2020, 1, 1), 1)
    with pytest.raises(Exception, match="folds need"):
        fold_ops.walk_forward(p, 5, n_folds=3).collect()
    with pytest.raises(ValueError):
        fold_ops.walk_forward(p, 0)


def test_monthly_folds_hold_whole_months(spark):
    rows = [("X", date(2019 + m // 12, m % 12 + 1, 1), 1.0) for m in range(24)]
    p = spark.createDataFrame(rows, "id string, date date, sales double")
    folds = fold_ops.walk_forward(p, 3, n_folds=2, frequency="M")
    got = fold_ops.assign_folds(p, folds).filter("role = 'test'").groupBy("fold_id").count()
    assert {r["fold_id"]: r["count"] for r in got.collect()} == {0: 3, 1: 3}


def test_evaluation_of_a_constant_series(spark):
    p = panel(spark, {"X": [10] * 30})
    folds = fold_ops.walk_forward(p, 14)
    forecast = evaluate.naive_forecasts(52, "W", 2)["HistoricalMean"]
    rows = evaluate.evaluate(p, folds, forecast, "HistoricalMean").collect()
    assert len(rows) == 4 and all(r["wmape"] < 1e-9 for r in rows)
    assert set(rows[0].asDict()) == {
        "model_name", "fold_id", "train_end", "test_start", "test_end", "wmape", "bias", "rmse", "mae", "n_obs",
    }


def test_several_models_and_their_summary(spark):
    p = panel(spark, {"X": [10 + i % 3 for i in range(60)]})
    folds = fold_ops.walk_forward(p, 14, n_folds=3)
    got = evaluate.evaluate_naive(p, folds, 2, 52)
    assert got.count() == 9
    summary = evaluate.summarise(got).collect()
    means = [r["wmape_mean"] for r in summary]
    assert len(summary) == 3 and means == sorted(means)
    assert {r["n_obs_total"] for r in summary} == {6}
    one = evaluate.summarise(got.filter("fold_id = 0")).first()
    assert one["wmape_std"] is None


def test_segment_metrics(spark):
    p = panel(spark, {"A": [10] * 30, "B": [0] * 28 + [1, 0]})
    folds = fold_ops.walk_forward(p, 14, n_folds=1)
    rows = fold_ops.assign_folds(p, folds)
    predictions = naive.all_naive(rows.filter("role = 'train'"), 2, 52, "W", ["fold_id"])
    got = evaluate.metrics_by_segment(p, rows.filter("role = 'test'"), predictions)
    assert {r["intermittence_label"] for r in got.collect()} == {"high_volume", "extreme_intermittent"}

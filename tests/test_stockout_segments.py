import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from demandspark.operators import segments, stockout
from helpers import by_key, column, panel


def test_daily_flags(spark):
    a = [5] * 30
    a[14] = 0
    df = stockout.flag_daily(panel(spark, {"A": a, "B": [0] * 20 + [3] * 10}, date(2020, 1, 1), 1))
    flagged = {(r["id"], r["date"].day) for r in df.filter("suspicious_zero").collect()}
    assert ("A", 15) in flagged
    assert not any(i == "B" and d <= 12 for i, d in flagged)
    assert df.filter("suspicious_zero AND sales > 0").count() == 0
    with pytest.raises(ValueError):
        stockout.flag_daily(df, window_size=14)


def test_daily_mean_needs_ten(spark):
    df = stockout.flag_daily(panel(spark, {"A": [4] * 12}, date(2020, 1, 1), 1))
    got = column(df, "rolling_mean")
    assert got[:2] == [None, None] and got[2] == 4.0 and got[-1] is None


def test_series_summary(spark):
    flagged = stockout.flag_daily(panel(spark, {"X": [1, 2, 3, 4, 5]}, date(2020, 1, 1), 1))
    row = stockout.stockout_by_series(flagged).first()
    assert row["suspicious_share"] == 0.0 and row["n_zeros"] == 0 and row["avg_sales"] == 3.0


def test_one_zero_is_flagged_and_imputed(spark):
    values = [10] * 20
    values[15] = 0
    p = panel(spark, {"X": values})
    assert [i for i, f in enumerate(column(stockout.flag_periods(p), "is_suspicious_zero")) if f] == [15]
    for strategy in ("rolling_mean", "median"):
        assert column(stockout.correct_stockouts(p, strategy), "sales") == [10.0] * 20
    stats = stockout.stockout_stats(p).first()
    assert stats["n_suspicious"] == 1 and stats["share_suspicious"] == 0.05 and stats["mean_imputed_value"] == 10.0


def test_no_flag_before_min_history(spark):
    values = [10] * 20
    values[2] = 0
    assert stockout.flag_periods(panel(spark, {"X": values})).filter("is_suspicious_zero").count() == 0


def test_end_of_life_is_flagged_briefly(spark):
    p = panel(spark, {"X": [10] * 5 + [0] * 15})
    assert stockout.flag_periods(p).filter("is_suspicious_zero").count() <= 4


def test_clean_and_none(spark):
    p = panel(spark, {"X": [10] * 20})
    assert column(stockout.correct_stockouts(p), "sales") == [10.0] * 20
    for strategy in ("none", "rolling_mean"):
        stats = stockout.stockout_stats(p, strategy).first()
        assert stats["n_total_rows"] == 20 and stats["n_suspicious"] == 0
        assert math.isnan(stats["mean_imputed_value"])
    with pytest.raises(ValueError):
        stockout.correct_stockouts(p, "guess")


def test_flags_by_fold_do_not_leak(spark):
    p = panel(spark, {"X": [10] * 10 + [0] + [100] * 5})
    two = p.filter("date < '2020-03-23'").withColumn("fold_id", F.lit(0)).unionByName(p.withColumn("fold_id", F.lit(1)))
    got = stockout.flag_periods(two, series=["fold_id", "id"]).filter("is_suspicious_zero")
    assert {r["fold_id"] for r in got.collect()} == {0}


def test_classes(spark):
    shares = [(0.0, "high_volume"), (0.0999, "high_volume"), (0.1, "medium"), (0.5, "intermittent"), (0.8, "extreme_intermittent"), (1.0, "extreme_intermittent")]
    df = spark.createDataFrame([(s,) for s, _ in shares], "s double")
    got = by_key(df.withColumn("c", segments.intermittence(F.col("s"), checked=True)), "s")
    assert all(got[(s,)]["c"] == c for s, c in shares)
    with pytest.raises(Exception, match="zero share"):
        spark.createDataFrame([(1.2,)], "s double").select(segments.intermittence(F.col("s"), True)).collect()


def test_labels_join_back(spark):
    df = segments.add_intermittence(panel(spark, {"A": [1] * 10, "B": [0] * 9 + [1]}))
    got = {r["id"]: r["intermittence_label"] for r in df.collect()}
    assert got == {"A": "high_volume", "B": "extreme_intermittent"} and df.count() == 20


def test_lift(spark):
    rows = [("A", False, 10)] * 2 + [("A", True, 12)] * 2 + [("B", False, 10)] * 2 + [("B", True, 5)] * 2
    df = spark.createDataFrame(rows, "cat string, on_promo boolean, sales bigint")
    got = by_key(segments.lift(df, "cat", "on_promo"), "cat")
    assert got[("A",)]["lift_pct"] == pytest.approx(20) and got[("B",)]["lift_pct"] == pytest.approx(-50)


def test_lift_without_baseline_is_null(spark):
    df = spark.createDataFrame([("A", True, 1), ("B", False, 0), ("B", True, 1)], "cat string, on_promo boolean, sales bigint")
    assert all(r["lift_pct"] is None for r in segments.lift(df, "cat", "on_promo").collect())


def test_pivot(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 3.0)], "f int, m string, v double")
    got = by_key(segments.pivot_values(df, "f", "m", "v", ["a", "b"]), "f")
    assert got[(1,)] == {"f": 1, "a": 3.0, "b": None}

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from demandspark.operators import reshape, rollup
from helpers import by_key, calendar

IDS = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string"


@pytest.fixture
def wide(spark):
    rows = [
        ("S1", "SKU_1", "FOODS_3", "FOODS", "CA_1", "CA", 0, 3, 2),
        ("S2", "SKU_2", "FOODS_3", "FOODS", "CA_1", "CA", 5, 0, 1),
        ("S3", "SKU_3", "FOODS_3", "FOODS", "CA_1", "CA", 0, 0, 0),
    ]
    return spark.createDataFrame(rows, IDS + ", d_1 int, d_2 int, d_3 int")


@pytest.fixture
def daily(spark):
    start = date(2020, 1, 1)
    rows = [
        (f"{i}_{s}_evaluation", i, "FOODS_3", "FOODS", s, "CA", start + timedelta(days=k), 1)
        for i in "AB"
        for s in ("S1", "S2")
        for k in range(30)
    ]
    return spark.createDataFrame(rows, IDS + ", date date, sales bigint")


def test_melt_has_a_row_per_series_and_day(spark, wide):
    long = reshape.melt_days(wide)
    assert long.count() == 9
    got = by_key(long, "id", "d")
    assert [got[("S1", f"d_{i}")]["sales"] for i in (1, 2, 3)] == [0, 3, 2]


def test_melt_joins_the_date(spark, wide):
    cal = calendar(spark, date(2020, 1, 1), 3)
    got = by_key(reshape.melt_days(wide, cal), "id", "d")
    assert got[("S2", "d_3")]["date"] == date(2020, 1, 3)


def test_first_sale_drops_leading_zeros_and_unsold_series(wide):
    got = by_key(reshape.melt_days(wide, from_first_sale=True), "id", "d")
    assert set(got) == {("S1", "d_2"), ("S1", "d_3"), ("S2", "d_1"), ("S2", "d_2"), ("S2", "d_3")}


def test_first_sale_compares_day_numbers(spark):
    values = [0, 1] + [0] * 9 + [4]
    cols = ", ".join(f"d_{i} int" for i in range(1, 13))
    wide = spark.createDataFrame([("X", "i", "d", "c", "s", "t", *values)], IDS + ", " + cols)
    kept = [r["d"] for r in reshape.melt_days(wide, from_first_sale=True).collect()]
    assert sorted(kept, key=lambda d: int(d[2:])) == [f"d_{i}" for i in range(2, 13)]


def test_melt_keeps_nulls(spark):
    wide = spark.createDataFrame([("X", "i", "d", "c", "s", "t", None, 2)], IDS + ", d_1 int, d_2 int")
    assert reshape.melt_days(wide).filter("sales IS NULL").count() == 1


def test_melt_needs_no_shuffle(wide):
    plan = reshape.melt_days(wide, from_first_sale=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_monthly_rollup(daily):
    got = rollup.rollup_time(daily, "M", ["item_id", "store_id"])
    assert {r["sales"] for r in got.filter("date = '2020-01-01'").collect()} == {30}


def test_weekly_rollup_starts_on_monday_and_keeps_partial_weeks(daily):
    got = rollup.rollup_time(daily, "W", ["item_id", "store_id"])
    assert {r["d"] for r in got.select(F.weekday("date").alias("d")).collect()} == {0}
    one = got.filter("item_id = 'A' AND store_id = 'S1'").orderBy("date").collect()
    assert [r["sales"] for r in one] == [5, 7, 7, 7, 4]


def test_unknown_frequency_and_level(daily):
    with pytest.raises(ValueError):
        rollup.rollup_time(daily, "Q", ["item_id"])
    with pytest.raises(ValueError):
        rollup.rollup_level(daily, "planet")


def test_levels(daily):
    state = rollup.rollup_level(daily, "sku_state")
    assert state.count() == 60
    assert {r["id"] for r in state.collect()} == {"A__CA", "B__CA"}
    assert {r["sales"] for r in state.collect()} == {2}
    assert {r["id"] for r in rollup.rollup_level(daily, "sku_national").collect()} == {"A", "B"}
    assert {r["id"] for r in rollup.rollup_level(daily, "dept_state").collect()} == {"FOODS_3__CA"}


def test_track(daily):
    track = rollup.prepare_track(daily, "fresh_weekly")
    assert track.columns == ["id", "date", "sales"]
    assert {r["id"] for r in track.collect()} == {"A__S1", "A__S2", "B__S1", "B__S2"}
    assert track.agg(F.sum("sales")).first()[0] == 120


def test_track_equals_two_step_rollup(daily):
    two = rollup.rollup_time(rollup.rollup_level(daily, "sku_store"), "W")
    assert by_key(two.select("id", "date", "sales"), "id", "date") == by_key(
        rollup.prepare_track(daily, "fresh_weekly"), "id", "date"
    )


def test_track_errors(daily):
    with pytest.raises(KeyError):
        rollup.prepare_track(daily, "nothing")
    with pytest.raises(ValueError):
        rollup.prepare_track(daily, "non_food_monthly", require_rows=True)


def test_sum_of_nulls_is_zero(spark):
    df = spark.createDataFrame([("X", date(2020, 1, 1), None)], "id string, date date, sales bigint")
    assert rollup.rollup_time(df, "W").first()["sales"] == 0


def test_null_key_gives_null_id(spark):
    df = spark.createDataFrame([("A", None, date(2020, 1, 1), 1)], "item_id string, store_id string, date date, sales bigint")
    assert rollup.rollup_level(df, "sku_store").first()["id"] is None


def test_hierarchy_map(daily):
    store = reshape.hierarchy_map(daily, "item_store")
    assert store.count() == 4
    assert by_key(store, "id")[("A__S1",)]["dept_id"] == "FOODS_3"
    state = reshape.hierarchy_map(daily, "item_state")
    assert "store_id" not in state.columns and state.count() == 2
    with pytest.raises(ValueError):
        reshape.hierarchy_map(daily, "planet")


def test_id_sets(spark, daily):
    wanted = spark.createDataFrame([("A_S1_evaluation",), ("none",), ("none",)], "id string")
    assert reshape.keep_ids(daily, wanted).count() == 30
    assert [r["id"] for r in reshape.missing_ids(wanted, daily).collect()] == ["none"]
    assert [r["id"] for r in reshape.common_ids(wanted, daily).collect()] == ["A_S1_evaluation"]


def test_sample_is_seeded_and_whole(daily):
    a = reshape.sample_series(daily, 2)
    assert a.count() == 60
    shuffled = reshape.sample_series(daily.orderBy(F.rand(1)).repartition(3), 2)
    assert {r["id"] for r in a.collect()} == {r["id"] for r in shuffled.collect()}


def test_recent_history(daily):
    assert reshape.recent_history(daily, 9).select("date").distinct().count() == 10


def test_cardinalities(daily):
    assert reshape.cardinalities(daily, ["item_id", "store_id"]).first().asDict() == {
        "n_item_id": 2,
        "n_store_id": 2,
    }
    assert reshape.cardinalities(daily, ["item_id"], approximate=True).first()["n_item_id"] == 2

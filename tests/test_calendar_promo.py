from datetime import date

import pytest

from demandspark.operators import calendar as cal
from demandspark.operators import promo
from helpers import MONDAY, by_key, calendar, column, panel


def test_time_and_day_features(spark):
    df = spark.createDataFrame([(date(2016, 1, 1),), (date(2016, 1, 4),)], "date date")
    t = by_key(cal.add_time_features(df), "date")
    assert t[(date(2016, 1, 1),)]["week_of_year"] == 53
    assert t[(date(2016, 1, 4),)]["day_of_year"] == 4
    d = by_key(cal.add_day_features(df), "date")
    assert d[(date(2016, 1, 4),)]["dow"] == 1 and not d[(date(2016, 1, 4),)]["is_weekend"]
    assert d[(date(2016, 1, 1),)]["dow"] == 5


@pytest.mark.parametrize("day,weekend", [(3, False), (4, True), (5, True), (6, False)])
def test_weekend(spark, day, weekend):
    df = spark.createDataFrame([(date(2020, 1, day),)], "date date")
    assert cal.add_day_features(df).first()["is_weekend"] is weekend


def test_snap_day_by_state(spark):
    days = spark.createDataFrame([("d_1", 1, 0, 1)], "d string, snap_CA int, snap_TX int, snap_WI int")
    rows = spark.createDataFrame([(s, "d_1") for s in ("CA", "TX", "WI", "NY")], "state_id string, d string")
    got = by_key(cal.add_snap_day(rows, days), "state_id")
    assert [got[(s,)]["is_snap_day"] for s in ("CA", "TX", "WI", "NY")] == [True, False, True, False]
    assert "snap_CA" not in cal.add_snap_day(rows, days).columns


def test_event_day(spark):
    days = calendar(spark, MONDAY, 2, events={1: ("SuperBowl", "Sporting")})
    rows = spark.createDataFrame([("d_1",), ("d_2",)], "d string")
    got = by_key(cal.add_event_day(rows, days), "d")
    assert got[("d_1",)]["event_name"] == "SuperBowl" and got[("d_2",)]["event_type"] is None


def test_snap_weeks(spark):
    days = calendar(spark, MONDAY, 21, snap_ca=(1, 2, 3, 4, 5))
    states = spark.createDataFrame([("A__S1", "CA"), ("B__S1", "TX")], "id string, state_id string")
    df = cal.add_snap_weeks(panel(spark, {"A__S1": [1] * 3, "B__S1": [1] * 3, "C__S9": [1]}), days, states)
    assert column(df.filter("id = 'A__S1'"), "snap_days_in_week") == [5, 0, 0]
    assert column(df.filter("id = 'B__S1'"), "snap_days_in_week") == [0, 0, 0]
    assert column(df.filter("id = 'C__S9'"), "snap_days_in_week") == [0]
    assert "state_id" not in df.columns


def test_event_weeks(spark):
    p = panel(spark, {"X": [1] * 3})
    days = calendar(spark, MONDAY, 21, events={5: ("Christmas", "National"), 9: ("Parade", "Cultural")})
    rows = cal.add_event_weeks(p, days).orderBy("date").collect()
    assert [r["event_Christmas_in_week"] for r in rows] == [1, 0, 0]
    assert [r["event_other_in_week"] for r in rows] == [0, 1, 0]
    assert [r["any_event_in_week"] for r in rows] == [1, 1, 0]
    custom = cal.add_event_weeks(p, days, named_events=("Parade",)).orderBy("date").collect()
    assert [r["event_Parade_in_week"] for r in custom] == [0, 1, 0]
    assert [r["event_other_in_week"] for r in custom] == [1, 0, 0]


@pytest.fixture
def prices(spark):
    rows = [("X", "S", 11101 + i, 9.0 if i == 4 else 10.0) for i in range(10)]
    return spark.createDataFrame(rows, "item_id string, store_id string, wm_yr_wk int, sell_price double")


def test_promo_flags(prices):
    rows = promo.promo_from_prices(prices).orderBy("wm_yr_wk").collect()
    assert [r["ref_price"] for r in rows[:3]] == [None] * 3
    assert [r["wm_yr_wk"] for r in rows if r["on_promo"]] == [11105]
    assert rows[4]["price_relative_to_ref"] == pytest.approx(0.9)


def test_small_drop_is_no_promo(spark):
    rows = [("X", "S", i, 9.7 if i == 5 else 10.0) for i in range(10)]
    df = spark.createDataFrame(rows, "item_id string, store_id string, wm_yr_wk int, sell_price double")
    assert promo.promo_from_prices(df).filter("on_promo").count() == 0


def test_daily_join_defaults(spark, prices):
    days = spark.createDataFrame([("d_1", 11105), ("d_2", 11101)], "d string, wm_yr_wk int")
    sales = spark.createDataFrame(
        [("X", "S", "d_1"), ("X", "S", "d_2"), ("U", "S", "d_1")], "item_id string, store_id string, d string"
    )
    got = by_key(promo.join_promo_daily(sales, promo.promo_from_prices(prices), days), "item_id", "d")
    assert got[("X", "d_1")]["on_promo"]
    assert not got[("X", "d_2")]["on_promo"] and got[("X", "d_2")]["price_relative_to_ref"] == 1.0
    assert not got[("U", "d_1")]["on_promo"] and got[("U", "d_1")]["price_relative_to_ref"] == 1.0


@pytest.fixture
def weekly_prices(spark):
    rows = [
        (item, store, w, 9.0 if w == 11103 and (item, store) != ("A", "S3") else 10.0)
        for item in ("A",)
        for store in ("S1", "S2", "S3")
        for w in range(11098, 11106)
    ]
    return spark.createDataFrame(rows, "item_id string, store_id string, wm_yr_wk int, sell_price double")


def test_store_level_promo(spark, weekly_prices):
    days = calendar(spark, MONDAY, 21, weeks_of=lambda i: 11102 + (i - 1) // 7)
    hierarchy = spark.createDataFrame(
        [("A__S1", "A", "S1", "CA"), ("UNKNOWN__S1", "UNKNOWN", "S1", "CA")],
        "id string, item_id string, store_id string, state_id string",
    )
    p = panel(spark, {"A__S1": [10, 12, 11], "UNKNOWN__S1": [5]})
    df = promo.add_promo_weeks(p, weekly_prices, days, hierarchy)
    assert df.columns == ["id", "date", "sales", "is_on_promo", "price_relative_to_ref"]
    assert column(df.filter("id = 'A__S1'"), "is_on_promo") == [0, 1, 0]
    unknown = df.filter("id = 'UNKNOWN__S1'").first()
    assert unknown["is_on_promo"] == 0 and unknown["price_relative_to_ref"] == 1.0
    with pytest.raises(ValueError):
        promo.add_promo_weeks(p, weekly_prices, days, hierarchy, "planet")


def test_state_level_promo(spark, weekly_prices):
    days = calendar(spark, MONDAY, 21, weeks_of=lambda i: 11102 + (i - 1) // 7)
    hierarchy = spark.createDataFrame([("A__CA", "A", "CA"), ("A__TX", "A", "TX")], "id string, item_id string, state_id string")
    stores = spark.createDataFrame([("S1", "CA"), ("S2", "TX"), ("S3", "TX")], "store_id string, state_id string")
    df = promo.add_promo_weeks(
        panel(spark, {"A__CA": [1] * 3, "A__TX": [1] * 3}), weekly_prices, days, hierarchy, "item_state", stores
    )
    assert column(df.filter("id = 'A__CA'"), "is_on_promo") == [0, 1, 0]
    # half of the stores is not more than half
    assert column(df.filter("id = 'A__TX'"), "is_on_promo") == [0, 0, 0]
    assert column(df.filter("id = 'A__TX'"), "price_relative_to_ref")[1] == pytest.approx(0.95)


def test_week_takes_its_first_price_week(spark):
    days = calendar(spark, MONDAY, 7, weeks_of=lambda i: 11102 if i <= 5 else 11103)
    assert cal.weekly_calendar(days).first()["wm_yr_wk"] == 11102
    assert cal.weekly_calendar(days).first()["date"] == MONDAY


def test_promo_weeks_are_looked_up_by_generated_code(spark):
    """Repeated price weeks repeat a row, null weeks match nothing, and no lambda is interpreted for each row."""
    rows = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "x"), ("a", None, "x"), ("b", 1, "x"), ("c", 1, "x"), (None, 1, "x")], "item_id string, wm_yr_wk int, store_id string"
    )
    signal = spark.createDataFrame(
        [("a", "x", 1, True, 0.5), ("a", "x", 1, None, 0.7), ("a", "x", 2, True, 0.6), ("a", "x", None, True, 0.1), ("b", "x", None, True, 0.2), (None, "x", 1, True, 0.3)],
        "item_id string, store_id string, wm_yr_wk int, on_promo boolean, price_relative_to_ref double",
    )
    found = promo.join_promo_weeks(rows, signal, ["item_id", "store_id", "wm_yr_wk"])
    assert found.columns == [*rows.columns, "on_promo", "price_relative_to_ref"]
    want = [("a", 1, True, 0.5), ("a", 1, None, 0.7), ("a", 3, None, None), ("a", None, None, None), ("b", 1, None, None), ("c", 1, None, None), (None, 1, None, None)]
    got = [(r.item_id, r.wm_yr_wk, r.on_promo, r.price_relative_to_ref) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan

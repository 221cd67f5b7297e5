"""The whole way from CSV files to results, on a small generated data set."""

from datetime import date, timedelta

import pytest

from demandspark import __main__ as cli
from demandspark.operators.boosting import BoostingSettings
from demandspark.plans import features, jobs

DAYS = 7 * 40
START = date(2020, 1, 4)
QUICK = BoostingSettings(rounds=2, max_depth=2, min_rows=2)


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    lines = [
        "date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI"
    ]
    for i in range(DAYS):
        d = START + timedelta(days=i)
        event = "SuperBowl,Sporting" if i == 29 else ","
        lines.append(
            f"{d},{11101 + i // 7},{d:%A},{(d.weekday() + 2) % 7 + 1},{d.month},{d.year},d_{i + 1},{event},,,{int(d.day <= 10)},0,0"
        )
    (root / "calendar.csv").write_text("\n".join(lines) + "\n")
    header = "id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(f"d_{i + 1}" for i in range(DAYS))
    rows, prices = [header], ["store_id,item_id,wm_yr_wk,sell_price"]
    for n, (item, dept) in enumerate((("F_1", "FOODS_3"), ("F_2", "FOODS_3"), ("H_1", "HOBBIES_1"))):
        for store, state in (("CA_1", "CA"), ("CA_2", "CA"), ("TX_1", "TX")):
            sales = [(i * (n + 3)) % 7 if i >= 10 * n else 0 for i in range(DAYS)]
            rows.append(f"{item}_{store}_evaluation,{item},{dept},{dept[:-2]},{store},{state}," + ",".join(map(str, sales)))
            prices += [f"{store},{item},{11101 + w},{4.0 if w == 9 else 5.0}" for w in range(40)]
    (root / "sales_train_evaluation.csv").write_text("\n".join(rows) + "\n")
    (root / "sell_prices.csv").write_text("\n".join(prices) + "\n")
    return str(root)


@pytest.fixture(scope="module")
def inputs(spark, data_dir, tmp_path_factory):
    return jobs.prepare(spark, data_dir, str(tmp_path_factory.mktemp("work")))


def test_feature_matrix_has_31_features(inputs):
    assert len(inputs.feature_cols) == 31
    assert inputs.matrix.columns == ["id", "date", "sales", *inputs.feature_cols]
    assert inputs.matrix.count() == inputs.panel.count() == inputs.panel.distinct().count()
    week = inputs.matrix.filter("event_SuperBowl_in_week = 1").select("date").distinct().collect()
    assert [r["date"] for r in week] == [date(2020, 1, 27)]
    # SNAP days reach the track although its ids differ from the daily ids
    assert inputs.matrix.filter("id LIKE '%CA_1' AND snap_days_in_week > 0").count() > 0
    assert inputs.matrix.filter("id LIKE '%TX_1' AND snap_days_in_week > 0").count() == 0
    assert inputs.matrix.filter("is_on_promo = 1").select("date").distinct().count() == 1


def test_state_track_has_features_too(spark, data_dir, tmp_path):
    got = jobs.prepare(spark, data_dir, str(tmp_path), "non_food_monthly")
    assert "state_id_avg_sales_lag_1" in got.feature_cols and len(got.feature_cols) == 31
    assert {r["id"] for r in got.panel.select("id").distinct().collect()} == {"H_1__CA", "H_1__TX"}


def test_stores_sample_and_empty_track(spark, data_dir, tmp_path):
    one = jobs.prepare(spark, data_dir, str(tmp_path / "a"), stores=["CA_1"], sample=1)
    assert one.panel.select("id").distinct().count() == 1
    with pytest.raises(ValueError):
        jobs.prepare(spark, data_dir, str(tmp_path / "b"), "dry_monthly")


def test_benchmark(inputs, tmp_path):
    got = jobs.benchmark(inputs, str(tmp_path), n_folds=2, include_smoothing=True, settings=QUICK)
    names = {r["model_name"] for r in got["per_fold"].collect()}
    assert names == {
        "HistoricalMean", "SeasonalNaive", "DriftNaive", "ExponentialSmoothing",
        "BoostedTrees", "BoostedTrees-tweedie", "BoostedTrees-tweedie-corr-rolling_mean",
    }
    assert got["per_fold"].count() == 14
    means = [r["wmape_mean"] for r in got["summary"].collect()]
    assert len(means) == 7 and means == sorted(means)
    assert got["importance"].count() == 31 and jobs.top_features(got["importance"], 5).count() == 5
    assert got["audit"].first()["n_total_rows"] == inputs.panel.count()


def test_train_publish_and_score(spark, inputs, tmp_path):
    root = str(tmp_path / "models")
    assert len(jobs.train_and_publish(inputs, root, settings=QUICK)) == 2
    jobs.publish_drift(inputs, root)
    with pytest.raises(ValueError):
        jobs.train_and_publish(inputs, root, ["crystal-ball"])
    requests = spark.createDataFrame(
        [
            ("F_1__CA_1", 4, jobs.BOOSTED),
            ("F_1__CA_1", 2, jobs.SMOOTHING),
            ("nobody", 4, "drift"),
            ("F_2__TX_1", 9, "drift"),
            ("F_2__TX_1", 1, "absent"),
        ],
        "id string, horizon int, model_name string",
    )
    requests.write.parquet(str(tmp_path / "requests"))
    cli.main(["score", "--models-dir", root, "--requests", str(tmp_path / "requests"), "--out-dir", str(tmp_path / "answers")])
    got = {(r["id"], r["model_name"]): r for r in spark.read.parquet(str(tmp_path / "answers")).collect()}
    assert len(got) == 5
    assert len(got[("F_1__CA_1", jobs.BOOSTED)]["points"]) == 4
    assert len(got[("F_1__CA_1", jobs.SMOOTHING)]["points"]) == 2
    assert got[("nobody", "drift")]["status"] == "unknown series" and got[("nobody", "drift")]["points"] == []
    assert got[("F_2__TX_1", "drift")]["reason"] == "horizon beyond the trained steps"
    assert got[("F_2__TX_1", "absent")]["reason"] == "unknown model"


def test_command_line_arguments():
    args = cli.arguments().parse_args(
        ["benchmark", "--data-dir", "a", "--work-dir", "b", "--out-dir", "c", "--stores", "CA_1", "--folds", "2"]
    )
    assert args.stores == ["CA_1"] and args.folds == 2 and not args.smoothing
    assert len(features.basic_feature_columns()) == 17

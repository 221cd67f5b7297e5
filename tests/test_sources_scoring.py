from datetime import date

import pytest
from pyspark.sql import functions as F

from demandspark import schemas
from demandspark.operators import naive, windows
from demandspark.operators.boosting import BoostedForecaster, BoostingSettings
from demandspark.sources.storage import input_mark, materialize, write_text
from demandspark.plans import evaluate, scoring
from demandspark.sources import feature_store, files, storage
from helpers import MONDAY, by_key, panel


@pytest.fixture
def data_dir(spark, tmp_path):
    (tmp_path / "calendar.csv").write_text(
        "date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX,snap_WI\n"
        "2011-01-29,11101,Saturday,1,1,2011,d_1,,,,,0,0,0\n"
        "2011-01-30,11101,Sunday,2,1,2011,d_2,SuperBowl,Sporting,,,0,1,0\n"
    )
    (tmp_path / "sales_train_evaluation.csv").write_text(
        "id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\nI_S_evaluation,I,FOODS_3,FOODS,S,CA,3,0\n"
    )
    (tmp_path / "sell_prices.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\nS,I,11101,2.5\n")
    return str(tmp_path)


def test_csv_sources(spark, data_dir):
    tables = files.read_all(spark, data_dir)
    assert tables["calendar"].schema == schemas.CALENDAR
    assert tables["calendar"].filter("d = 'd_2'").first()["event_name_1"] == "SuperBowl"
    assert tables["calendar"].filter("d = 'd_1'").first()["event_name_1"] is None
    assert dict(tables["sales"].dtypes)["d_2"] == "int"
    assert tables["prices"].first()["sell_price"] == 2.5
    melted = files.read_all(spark, data_dir, melt=True)["sales"]
    assert by_key(melted, "d")[("d_1",)]["date"] == date(2011, 1, 29)


def test_missing_sources(spark, data_dir, tmp_path):
    with pytest.raises(KeyError):
        files.source_path(spark, "weather", data_dir)
    with pytest.raises(FileNotFoundError):
        files.read_calendar(spark, str(tmp_path / "absent"))


def test_result_files(spark, tmp_path):
    path = str(tmp_path / "importance")
    assert files.read_result(spark, path, schemas.IMPORTANCE) is None
    df = spark.createDataFrame([("a", 0.5), ("b", 0.25)], schemas.IMPORTANCE)
    files.write_result(df, path)
    assert files.read_result(spark, path, schemas.IMPORTANCE).collect() == df.collect()


def test_materialize_writes_once(spark, tmp_path):
    path = str(tmp_path / "track")
    first = storage.materialize(panel(spark, {"X": [1, 2]}), path)
    again = storage.materialize(panel(spark, {"X": [9]}), path)
    assert first.count() == again.count() == 2


def test_shared_folder_prefers_the_session_setting(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": "hdfs://shared/scratch"}.get(key, default)

    class Session:
        conf = Conf()

    assert storage.shared_folder(Session()) == "hdfs://shared/scratch"
    assert "checkpoints" in storage.shared_folder(spark)


def test_feature_store(spark, tmp_path):
    path = str(tmp_path / "features")
    df = panel(spark, {"A": [1, 2], "B": [3], "C": [4]}).withColumn("feature_1", F.col("sales") * 2)
    feature_store.save_features(df, path, columns=["feature_1"])
    store = feature_store.load_features(spark, path)
    assert store.columns == ["id", "date", "feature_1"] and store.count() == 3
    assert by_key(store, "id")[("A",)]["feature_1"] == 4
    wanted = spark.createDataFrame([("A",), ("Z",)], "id string")
    assert feature_store.features_for(store, wanted).count() == 1
    with pytest.raises(FileNotFoundError):
        feature_store.load_features(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        feature_store.save_features(df, path, columns=["nothing"])


@pytest.fixture
def published(spark, tmp_path):
    root = str(tmp_path / "models")
    p = panel(spark, {"A": [42] * 10, "B": [42] * 10, "C": [42] * 10})
    scoring.publish(root, "drift", "fresh_weekly", p, naive.drift(p, 4), 4, "W", extra={"k": "v"})
    return root


def test_publish_and_load(spark, published):
    model = scoring.load(spark, published, "drift")
    assert model.metadata["extra"] == {"k": "v"} and model.horizon == 4
    assert model.features.count() == 3
    wanted = spark.createDataFrame([("A",)], "id string")
    assert [r["prediction"] for r in model.predict(2, wanted).collect()] == [42.0, 42.0]
    with pytest.raises(ValueError):
        model.predict(5)
    info = scoring.model_info(spark, published).first()
    assert info["model_name"] == "drift" and info["feature_count"] == 0


def test_load_refuses_other_things(spark, published, tmp_path):
    with pytest.raises(FileNotFoundError):
        scoring.load(spark, published, "absent")
    with pytest.raises(ValueError):
        (tmp_path / "bare").mkdir()
        scoring.load(spark, str(tmp_path), "bare")
    drift = scoring.current_version(spark, f"{published}/drift")
    meta = spark.read.parquet(f"{drift}/metadata")
    for name, rows in (("wrong", panel(spark, {"A": [1]})), ("old", meta.withColumn("format_version", F.lit("0.1")))):
        rows.write.parquet(f"{published}/{name}/v1/metadata")
        spark.read.parquet(f"{drift}/predictions").write.parquet(f"{published}/{name}/v1/predictions")
        write_text(spark, f"{published}/{name}/current", "v1")
        with pytest.raises(ValueError, match="format" if name == "old" else "no published"):
            scoring.load(spark, published, name)
    meta.write.parquet(f"{published}/unnamed/v1/metadata")  # a job that died before it named its version
    assert [r["model_name"] for r in scoring.published_models(spark, published).collect()] == ["drift"]
    assert scoring.published_models(spark, str(tmp_path / "absent")).collect() == []
    assert scoring.published_predictions(spark, str(tmp_path / "absent")).collect() == []


def test_batch_scoring(spark, published):
    model = scoring.load(spark, published, "drift")
    requests = spark.createDataFrame(
        [("A", 2), ("A", 4), ("Z", 4)], "id string, horizon int"
    )
    got = by_key(scoring.score_batch(requests, model.predict()), "id", "horizon")
    assert len(got[("A", 2)]["points"]) == 2 and len(got[("A", 4)]["points"]) == 4
    assert got[("A", 4)]["points"][0]["prediction"] == 42.0
    dates = [p["date"] for p in got[("A", 4)]["points"]]
    assert dates == sorted(dates)
    assert got[("Z", 4)]["points"] == [] and got[("Z", 4)]["status"] == "unknown series"


def test_request_bounds(spark):
    requests = spark.createDataFrame(
        [("A", 0, "drift"), ("A", 13, "drift"), ("A", 5, "drift"), ("A", 4, "drift"), ("A", 1, "x"), ("", 1, "drift")],
        "id string, horizon int, model_name string",
    )
    got = scoring.check_requests(requests, 4, ["drift"]).collect()
    assert [r["status"] for r in got] == ["rejected"] * 3 + ["accepted"] + ["rejected"] * 2
    assert [r["reason"] for r in got][:3] == [
        "horizon out of bounds", "horizon out of bounds", "horizon beyond the trained steps",
    ]


def test_chart(spark):
    p = panel(spark, {"A": [1, 2]})
    chart = scoring.forecast_chart(p, naive.all_naive(p, 1, 52), ["DriftNaive"])
    rows = chart.orderBy("date").collect()
    assert [r["Historical sales"] for r in rows] == [1, 2, None]
    assert rows[2]["Forecast (DriftNaive)"] == 3


def test_boosted_models_survive_publishing(spark, tmp_path):
    m = windows.add_lags(panel(spark, {"X": range(40), "Y": range(5, 45)}), [1, 2])
    settings = BoostingSettings(rounds=3, step_size=0.5, max_depth=2, min_rows=1)
    for objective in ("l2", "tweedie"):
        fitted = BoostedForecaster(["sales_lag_1", "sales_lag_2"], 2, objective, settings=settings).fit(m)
        scoring.publish_boosted(str(tmp_path), objective, "fresh_weekly", fitted, m)
        back = scoring.load(spark, str(tmp_path), objective)
        assert sorted(back.models) == [1, 2]
        before = by_key(fitted.predict(), "id", "date")
        assert by_key(back.predict(), "id", "date") == before
        fitted.models = back.models
        assert by_key(fitted.predict(), "id", "date") == before


def test_boosted_evaluation(spark):
    m = windows.add_lags(panel(spark, {"X": range(40), "Y": range(5, 45)}), [1, 2])
    from demandspark.operators.folds import walk_forward

    folds = walk_forward(m, 14, n_folds=2)
    settings = BoostingSettings(rounds=2, max_depth=2, min_rows=1)
    f = BoostedForecaster(["sales_lag_1", "sales_lag_2"], 2, "l2", settings=settings)
    rows = evaluate.evaluate_boosted(m, folds, f).collect()
    assert {r["fold_id"] for r in rows} == {0, 1} and {r["n_obs"] for r in rows} == {4}
    assert {r["model_name"] for r in rows} == {"BoostedTrees-l2"}
    assert rows[0]["test_end"] <= MONDAY.replace(year=2021)


def test_a_reader_sees_whole_versions_only(spark, published, monkeypatch):
    assert all(r["intact"] for r in scoring.verify(spark, published, "drift").collect())
    before = scoring.load(spark, published, "drift")
    first = [tuple(r) for r in before.predict().orderBy("id", "date").collect()]
    new = panel(spark, {"A": [1, 2], "B": [3, 4]})
    predictions = new.withColumn("prediction", F.col("sales") * 100).select("id", "date", "prediction")

    def dies(*_):
        raise RuntimeError("killed")

    # killed after everything was written, but before the version was named
    monkeypatch.setattr(scoring, "write_text", dies)
    with pytest.raises(RuntimeError):
        scoring.publish(published, "drift", "t", new, predictions, 2, "W")
    monkeypatch.undo()
    assert [tuple(r) for r in scoring.load(spark, published, "drift").predict().orderBy("id", "date").collect()] == first
    scoring.publish(published, "drift", "t", new, predictions, 2, "W")
    # who loaded before goes on reading the old version, who loads now reads the new one
    assert [tuple(r) for r in before.predict().orderBy("id", "date").collect()] == first
    assert {r["prediction"] for r in scoring.load(spark, published, "drift").predict().collect()} == {100.0, 200.0, 300.0, 400.0}
    assert {r["model_name"] for r in scoring.published_predictions(spark, published).collect()} >= {"drift"}
    assert all(r["intact"] for r in scoring.verify(spark, published, "drift").collect())


def test_materialize_replaces_what_a_dead_job_left(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(3).write.parquet(path)
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert materialize(spark.range(10), path).count() == 10
    assert materialize(spark.range(99), path).count() == 10
    mark = input_mark(spark, path)
    spark.range(5).write.mode("overwrite").parquet(path)
    assert input_mark(spark, path) != mark

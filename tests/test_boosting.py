import dataclasses
import pickle
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from demandspark.operators import folds, windows
from demandspark.operators.boosting import BoostedForecaster, BoostingSettings, binned, grow, load_models
from demandspark.plans import evaluate
from helpers import MONDAY, panel

FEATURES = ["sales_lag_1", "sales_lag_4", "month"]
QUICK = BoostingSettings(rounds=6, step_size=0.5, max_depth=3, min_rows=1, checkpoint_rounds=3)


def matrix(spark, series):
    from demandspark.operators.calendar import add_time_features

    return add_time_features(windows.add_lags(panel(spark, series), [1, 4]))


def test_argument_checks(spark):
    with pytest.raises(ValueError):
        BoostedForecaster([], 2, "l1")
    with pytest.raises(ValueError):
        BoostedForecaster(FEATURES, 2, "l3")
    with pytest.raises(ValueError):
        BoostedForecaster(FEATURES, 2, "l1", target_correction="guess")
    with pytest.raises(ValueError):
        BoostedForecaster(["nothing"], 2, "l1").fit(matrix(spark, {"X": range(9)}))


def test_names():
    assert BoostedForecaster(FEATURES, 1, "l1").name == "BoostedTrees"
    assert BoostedForecaster(FEATURES, 1, "tweedie").name == "BoostedTrees-tweedie"
    both = BoostedForecaster(FEATURES, 1, "tweedie", target_correction="rolling_mean")
    assert both.name == "BoostedTrees-tweedie-corr-rolling_mean"


@pytest.mark.parametrize("objective", ["l2", "tweedie"])
def test_ramp(spark, objective):
    fitted = BoostedForecaster(FEATURES, 2, objective, settings=QUICK).fit(matrix(spark, {"X": range(60)}))
    assert sorted(fitted.models) == [1, 2]
    rows = fitted.predict().orderBy("date").collect()
    assert len(rows) == 2 and all(30 < r["prediction"] < 70 for r in rows)
    assert (rows[0]["date"] - MONDAY).days == 60 * 7
    assert len(fitted.predict(1).collect()) == 1
    with pytest.raises(ValueError):
        fitted.predict(3)
    importance = fitted.feature_importance().collect()
    assert [r["feature"] for r in importance][0] in FEATURES and len(importance) == 3
    assert importance[0]["importance"] >= importance[-1]["importance"]


def test_ids_and_correction(spark):
    values = [i % 10 + 5 for i in range(60)]
    for i in (30, 35, 40):
        values[i] = 0
    m = matrix(spark, {"X": values, "Y": range(60)})
    f = BoostedForecaster(FEATURES, 1, "l1", target_correction="rolling_mean", settings=QUICK).fit(m)
    stats = f.stats.first()
    assert stats["n_total_rows"] == 120 and stats["n_suspicious"] > 0
    wanted = spark.createDataFrame([("X",), ("none",)], "id string")
    rows = f.predict(ids=wanted).collect()
    assert [r["id"] for r in rows] == ["X"] and rows[0]["prediction"] >= 0


def test_step_without_targets_is_nan(spark):
    fitted = BoostedForecaster(FEATURES, 2, "l2", settings=QUICK).fit(matrix(spark, {"X": [1, 2]}))
    assert sorted(fitted.models) == [1]
    second = fitted.predict(2).orderBy("date").collect()[1]
    assert second["prediction"] != second["prediction"]


@pytest.mark.parametrize("objective", ["l2", "tweedie"])
def test_forecasts_do_not_depend_on_partitions(spark, objective):
    rng = random.Random(4)
    series = {f"S{k}": [rng.randrange(1, 9) + (i + k) % 4 for i in range(50)] for k in range(12)}
    settings = dataclasses.replace(QUICK, row_fraction=0.7, feature_fraction=0.7)
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = BoostedForecaster(FEATURES, 2, objective, settings=settings).fit(matrix(spark, series).repartition(n)).predict()
            found.append({(r["id"], r["date"]): r["prediction"] for r in rows.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], rel=1e-9) for k in found[0])


def test_models_can_be_stored(spark, tmp_path):
    fitted = BoostedForecaster(FEATURES, 2, "tweedie", settings=QUICK).fit(matrix(spark, {"X": range(60)}))
    fitted.save_models(str(tmp_path))
    want = [r["prediction"] for r in fitted.predict().orderBy("date").collect()]
    fitted.models = load_models(spark, str(tmp_path))
    assert [r["prediction"] for r in fitted.predict().orderBy("date").collect()] == want


def slow_trees(rows, objective, s, base):
    """The same boosting by sorting, row by row: ``rows`` are (features, target)."""
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    margin = np.full(len(y), base)

    def grow(use, g, h, depth):
        best, whole = None, g[use].sum() ** 2 / h[use].sum()
        for j in range(x.shape[1]) if depth < s.max_depth else ():
            for v in np.unique(x[use, j])[:-1]:
                low, high = use & (x[:, j] <= v), use & (x[:, j] > v)
                if min(low.sum(), high.sum()) < s.min_rows:
                    continue
                gain = g[low].sum() ** 2 / h[low].sum() + g[high].sum() ** 2 / h[high].sum() - whole
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, low, high)
        if best is None:
            margin[use] -= s.step_size * g[use].sum() / h[use].sum()
            return
        grow(best[1], g, h, depth + 1)
        grow(best[2], g, h, depth + 1)

    for _ in range(s.rounds):
        if objective == "l2":
            g, h = margin - y, np.ones(len(y))
        else:
            low, high = np.exp(-0.5 * margin), np.exp(0.5 * margin)
            g, h = high - y * low, 0.5 * high + 0.5 * y * low
        grow(np.ones(len(y), bool), g, h, 0)
    return np.exp(margin) if objective == "tweedie" else margin


@pytest.mark.parametrize("objective", ["l2", "tweedie"])
def test_trees_against_a_plain_loop(spark, objective):
    rng = np.random.default_rng(6)
    n, settings = 300, dataclasses.replace(QUICK, max_depth=4, min_rows=7, row_fraction=1.0, feature_fraction=1.0, checkpoint_rounds=2)
    a, b = rng.integers(0, 12, n), rng.integers(0, 6, n)
    y = a * 2 + (b > 3) * 10 + rng.integers(0, 5, n)
    rows = [(f"S{i % 7}", MONDAY + timedelta(days=i), float(a[i]), float(b[i]), float(y[i]), None if i % 3 else float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, date date, a double, b double, t1 double, t2 double").repartition(5)
    found = grow(df, ["a", "b"], ["t1", "t2"], objective, settings)
    for name, kept in (("t1", rows), ("t2", [r for r in rows if r[5] is not None])):
        base = float(np.mean([r[4] for r in kept]))
        want = slow_trees([(r[2:4], r[4]) for r in kept], objective, settings, np.log(base) if objective == "tweedie" else base)
        model = found[name]
        got = model.predict(binned(np.array([r[2:4] for r in kept]), model.edges))
        assert np.allclose(got, want, rtol=1e-5, atol=1e-5)
        assert model.gains.min() > 0


def test_absolute_loss_follows_medians(spark):
    rows = [(f"S{k}", MONDAY + timedelta(days=i), float(k), 1000.0 if i % 5 == 0 else 10.0 * k) for k in range(1, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, date date, a double, t double")
    settings = dataclasses.replace(QUICK, rounds=30, step_size=0.3)
    model = grow(df, ["a"], ["t"], "l1", settings)["t"]
    got = model.predict(binned(np.array([[1.0], [2.0], [3.0], [4.0]]), model.edges))
    assert np.allclose(got, [10, 20, 30, 40], atol=1.0)


def test_folds_share_their_passes_and_do_not_look_ahead(spark):
    rng = random.Random(4)
    series = {f"S{k}": [rng.randrange(1, 9) + (i + k) % 4 for i in range(60)] for k in range(6)}
    m = matrix(spark, series).persist()
    table = folds.walk_forward(m, 14, n_folds=2)
    forecaster = BoostedForecaster(FEATURES, 2, "l2", target_correction="rolling_mean", settings=QUICK)
    together = forecaster.fit_folds(m, table)
    ends = {r["fold_id"]: r["train_end"] for r in table.collect()}
    assert together.keys() == ends.keys()
    for k, end in ends.items():
        got = {(r["id"], r["date"]): r["prediction"] for r in together[k].predict().collect()}
        assert len(got) == 12 and min(d for _, d in got) == end + timedelta(days=7)
    # rows after a fold's end change nothing
    first = min(ends)
    changed = m.withColumn("sales", F.when(F.col("date") > ends[first], F.lit(1e6)).otherwise(F.col("sales")))
    again = forecaster.fit_folds(changed, table)[first].predict().orderBy("id", "date").collect()
    assert again == together[first].predict().orderBy("id", "date").collect()
    found = evaluate.evaluate_boosted(m, table, forecaster).collect()
    assert sorted(r["fold_id"] for r in found) == sorted(ends) and all(r["n_obs"] == 12 for r in found)
    m.unpersist()


@pytest.mark.parametrize("objective", ["l1", "tweedie"])
def test_sums_stay_with_the_tasks(spark, monkeypatch, objective):
    """What a pass brings to the driver does not grow with the features or the bins."""
    rng = random.Random(4)
    names = [f"x{i}" for i in range(12)]
    rows = [(str(i), MONDAY, *(rng.random() for _ in names), rng.random() * 9) for i in range(300)]
    df = spark.createDataFrame(rows, f"id string, date date, {', '.join(f'{c} double' for c in names)}, t double")
    seen, collect = [], RDD.collect

    def counted(self):
        found = collect(self)
        seen.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", counted)
    assert grow(df, names, ["t"], objective, dataclasses.replace(QUICK, rounds=2))
    # 4 nodes at most: 7 numbers each, or 8 medians; their sums are 10 features x 64 bins x 4 nodes
    assert seen and max(seen) < 2000


@pytest.mark.parametrize("objective", ["l1", "l2", "tweedie"])
def test_more_features_send_no_more_to_the_driver(spark, monkeypatch, objective):
    seen, collect = [], RDD.collect

    def counted(self):
        found = collect(self)
        seen.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", counted)
    sent = []
    for width in (4, 16):
        rng = random.Random(4)
        names = [f"x{i}" for i in range(width)]
        rows = [(str(i), MONDAY, *(rng.random() for _ in names), rng.random() * 9) for i in range(300)]
        df = spark.createDataFrame(rows, f"id string, date date, {', '.join(f'{c} double' for c in names)}, t double")
        seen.clear()
        assert grow(df, names, ["t"], objective, dataclasses.replace(QUICK, rounds=2))
        sent.append(sum(seen))
    assert 0 < sent[1] < 1.5 * sent[0]

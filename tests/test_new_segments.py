import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandspark.operators import glm, promo, ranking, reconcile, rollup, segments, sketches
from demandspark.plans import evaluate
from helpers import MONDAY, by_key, calendar, panel


def test_exact_ranks_with_ties_and_groups(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(3)}", i, rng.randrange(20)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = by_key(ranking.exact_rank(df, [F.desc("v"), F.asc("i")], ["g"]), "g", "i")
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[g, r[1]]["rank"] for r in own] == list(range(1, len(own) + 1))
        assert {got[g, r[1]]["rank_of"] for r in own} == {len(own)}
    assert ranking.exact_rank(df.limit(0), [F.asc("i")]).count() == 0


def test_rotation_tiers(spark):
    df = panel(spark, {f"S{k:02d}": [k, k] for k in range(10)})
    got = {r["id"]: r["rotation_tier"] for r in segments.rotation_tiers(df).collect()}
    assert [i for i, t in sorted(got.items()) if t == "fast"] == ["S08", "S09"]
    assert [i for i, t in sorted(got.items()) if t == "slow"] == ["S00", "S01"]


def test_lifecycle_and_age_do_not_look_ahead(spark):
    series = {
        "old": [10] * 80, "fading": [40] * 54 + [40 - k for k in range(26)], "fresh": [0] * 60 + [5] * 20, "never": [0] * 80,
    }
    df = panel(spark, series).withColumn("sales", F.col("sales").cast("long")).withColumn("fold_id", F.lit(0))
    got = by_key(segments.lifecycle(df), "id")
    assert {i[0]: r["stage"] for i, r in got.items()} == {"old": "mature", "fading": "declining", "fresh": "new", "never": "unsold"}
    assert got[("fresh",)]["age_weeks"] == 19 and got[("fading",)]["slope"] == pytest.approx(-1.0)
    aged = by_key(segments.product_age(df), "id", "date")
    assert aged["fresh", MONDAY + timedelta(weeks=59)]["product_age_weeks"] is None
    assert aged["fresh", MONDAY + timedelta(weeks=61)]["product_age_weeks"] == 1
    cut = MONDAY + timedelta(weeks=50)
    early = by_key(segments.product_age(df.where(F.col("date") <= cut)), "id", "date")
    assert all(aged[k]["product_age_weeks"] == r["product_age_weeks"] for k, r in early.items())


def test_promo_runs_end_at_missing_weeks_and_pass_year_ends(spark):
    # price weeks 1..12; the numbers jump between 6 and 7 as over a year's end
    names = {k: 11100 + k if k <= 6 else 11200 + k for k in range(1, 13)}
    cal = calendar(spark, date(2020, 1, 4), 84, weeks_of=lambda i: names[(i - 1) // 7 + 1])
    flags = {1: False, 2: True, 3: True, 5: True, 6: True, 7: True, 8: None, 9: True, 11: False}
    rows = [("A", "s", names[k], v) for k, v in flags.items()]
    df = spark.createDataFrame(rows, "item_id string, store_id string, wm_yr_wk int, on_promo boolean")
    got = {r["wm_yr_wk"]: (r["promo_run"], r["promo_weeks"], r["weeks_since_promo"]) for r in promo.add_promo_runs(df, cal).collect()}
    want = {1: (None, 0, None), 2: (1, 1, None), 3: (1, 2, 1), 5: (2, 1, 2), 6: (2, 2, 1), 7: (2, 3, 1), 8: (None, 0, 1), 9: (3, 1, 2), 11: (None, 0, 2)}
    assert got == {names[k]: v for k, v in want.items()}


def test_mase_with_zero_and_missing_scales(spark):
    train = panel(spark, {"A": [1, 2, 3, 5], "flat": [4, 4, 4, 4], "short": [7]}).withColumn("fold_id", F.lit(0))
    scales = evaluate.naive_scales(train, 2)
    assert {r["id"]: r["scale"] for r in scales.collect()} == {"A": 2.5, "flat": 0.0, "short": None}
    later = MONDAY + timedelta(weeks=4)
    test = spark.createDataFrame([(0, i, later, 10.0) for i in ("A", "flat", "short")], "fold_id int, id string, date date, sales double")
    predictions = test.select("fold_id", "id", "date", F.lit("m").alias("model_name"), F.lit(5.0).alias("prediction"))
    row = evaluate.mase(test, predictions, scales).first()
    assert (row["mase"], row["n_obs"], row["n_unscaled"]) == (2.0, 1, 2)


def test_filled_periods(spark):
    facts = spark.createDataFrame(
        [("A", "s", date(2020, 1, 8), 3), ("A", "s", date(2020, 1, 10), 4), ("A", "s", date(2020, 2, 4), 5), ("B", "s", date(2020, 1, 30), 1)],
        "item_id string, store_id string, date date, sales long",
    )
    for frequency, n in (("W", 6), ("M", 2)):
        sums = facts.groupBy("item_id", "store_id", F.trunc("date", "week" if frequency == "W" else "month").alias("date")).agg(F.sum("sales").alias("sales"))
        first, last = F.lit(date(2020, 1, 7)), F.lit(date(2020, 2, 12))
        rows = rollup.fill_periods(sums, ["item_id", "store_id"], frequency, first, last).orderBy("item_id", "date").collect()
        assert len(rows) == 2 * n and sum(r["sales"] for r in rows) == 13
        assert [r["sales"] for r in rows if r["item_id"] == "A"] == ([7, 0, 0, 0, 5, 0] if frequency == "W" else [7, 5])


LEVELS = [(), ("state",), ("item",), ("item", "state")]


def hierarchy(spark, seed=4, items=4, states=3):
    rng = np.random.default_rng(seed)
    keys = [(f"i{a}", f"s{b}") for a in range(items) for b in range(states) if (a, b) != (1, 1)]
    return rng, keys


def test_bottom_up_and_top_down(spark):
    rng, keys = hierarchy(spark)
    days = [MONDAY, MONDAY + timedelta(weeks=1)]
    rows = [(f"{i}__{s}", i, s, d, float(rng.integers(0, 9))) for i, s in keys for d in days]
    df = spark.createDataFrame(rows, "id string, item string, state string, date date, prediction double")
    got = by_key(reconcile.bottom_up(df, LEVELS), "level", "node", "date")
    for d in days:
        assert got["total", "total", d]["prediction"] == sum(r[4] for r in rows if r[3] == d)
        assert got["state", "s2", d]["prediction"] == sum(r[4] for r in rows if r[3] == d and r[2] == "s2")
    assert len(got) == 2 * (1 + 3 + 4 + len(keys))
    volumes = [(f"{i}__{s}", i, s, int(rng.integers(0, 50))) for i, s in keys]
    total = spark.createDataFrame([(days[0], 100.4), (days[1], 7.0)], "date date, prediction double")
    down = by_key(reconcile.top_down(total, spark.createDataFrame(volumes, "id string, item string, state string, volume long"), LEVELS), "level", "node", "date")
    for d, units in ((days[0], 100), (days[1], 7)):
        whole = {v[0]: units * v[3] // sum(x[3] for x in volumes) for v in volumes}
        rest = sorted(volumes, key=lambda v: (-(units * v[3] % sum(x[3] for x in volumes)), v[0]))
        for v in rest[: units - sum(whole.values())]:
            whole[v[0]] += 1
        assert {v[0]: down["item__state", v[0], d]["prediction"] for v in volumes} == whole
        assert down["total", "total", d]["prediction"] == units
    nothing = reconcile.top_down(total, spark.createDataFrame([(*v[:3], 0) for v in volumes], "id string, item string, state string, volume long"), LEVELS)
    assert {r["prediction"] for r in nothing.collect()} == {0}


def dense_min_trace(y, errors, summing, weight):
    """The same from matrices: rows of ``summing`` are all nodes, its columns the bottom ones."""
    n = errors.shape[1]
    w = (1 - weight) * errors @ errors.T / n + weight * np.diag((errors**2).mean(axis=1))
    inverse = np.linalg.inv(w)
    bottom = np.linalg.solve(summing.T @ inverse @ summing, summing.T @ inverse @ y)
    return summing @ bottom


@pytest.mark.parametrize("weight", [None])
def test_min_trace_against_matrices(spark, weight):
    rng, keys = hierarchy(spark, items=3, states=2)
    nodes = ["total|total", *[f"state|s{k}" for k in range(2)], *[f"item|i{k}" for k in range(3)], *[f"item__state|{i}__{s}" for i, s in keys]]
    bottoms = nodes[6:]
    summing = np.zeros((len(nodes), len(bottoms)))
    for c, (i, s) in enumerate(keys):
        for node in ("total|total", f"state|{s}", f"item|{i}", bottoms[c]):
            summing[nodes.index(node), c] = 1
    errors = (rng.normal(size=(len(nodes), 8)) + 1.5 * rng.normal(size=8)) * rng.uniform(1, 5, (len(nodes), 1))
    y = np.abs(rng.normal(50, 20, (len(nodes), 2)))
    days = [MONDAY, MONDAY + timedelta(weeks=1)]
    base = spark.createDataFrame([(v, d, float(y[k, c])) for k, v in enumerate(nodes) for c, d in enumerate(days)], "node string, date date, prediction double")
    table = spark.createDataFrame([(v, errors[k].tolist()) for k, v in enumerate(nodes)], "node string, errors array<double>")
    series = spark.createDataFrame(keys, "item string, state string")
    edges = reconcile.hierarchy_edges(series, LEVELS[-1], LEVELS)
    got = by_key(reconcile.min_trace(base, table, edges, days, weight), "node", "date")
    found = np.array([[got[v, d]["prediction"] for d in days] for v in nodes])
    assert np.abs(found - summing @ found[6:]).max() < 1e-6  # coherent
    used = reconcile.shrinkage(table, 8).weight if weight is None else weight
    if weight is None:
        z = errors / np.sqrt((errors**2).mean(axis=1, keepdims=True))
        products = z[:, None, :] * z[None, :, :]
        r = products.mean(axis=2)
        spread = 8 / 7**3 * ((products - r[:, :, None]) ** 2).sum(axis=2)
        off = ~np.eye(len(nodes), dtype=bool)
        assert used == pytest.approx(spread[off].sum() / ((r * 8 / 7) ** 2)[off].sum(), rel=1e-6) and 0 < used < 1
    assert np.abs(found - dense_min_trace(y, errors, summing, used)).max() < 1e-5 * np.abs(found).max()


def test_sketches_merge_to_exact_counts_within_their_error(spark):
    df = spark.range(40_000).selectExpr("id % 5000 AS item", "id % 3 AS state", "date_add(DATE'2020-01-01', CAST(id % 200 AS int)) AS date")
    stored = sketches.distinct_sketches(df, ["item"], ["state"])
    for last, low in (("2020-03-01", "date < DATE'2020-04-01'"), (None, "true")):
        merged = {r["state"]: r["item"] for r in sketches.merged_counts(stored, ["item"], ["state"], None, last).collect()}
        exact = {r["state"]: r["n"] for r in df.where(low).groupBy("state").agg(F.count_distinct("item").alias("n")).collect()}
        assert merged.keys() == exact.keys()
        assert all(abs(merged[k] - n) <= 4 * sketches.STANDARD_ERROR * n for k, n in exact.items())


def test_glm_against_plain_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 3, (400, 2))
    y = rng.poisson(np.exp(0.3 + 0.5 * x[:, 0] - 0.2 * x[:, 1])).astype(float)
    df = spark.createDataFrame([(float(np.expm1(a)), float(np.expm1(b)), float(t)) for (a, b), t in zip(x, y, strict=True)], "a double, b double, t double")
    model = glm.fit_glm(df, ["a", "b"], "t", glm.GlmSettings(regularization=0.0, iterations=50))
    design, beta = np.column_stack([np.ones(len(x)), x]), np.array([np.log(y.mean()), 0, 0])
    for _ in range(60):
        mu = np.exp(design @ beta)
        w = mu ** (2 - 1.5)
        beta = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * (design @ beta + (y - mu) / mu)))
    assert np.allclose([model.intercept, *model.coefficients], beta, atol=1e-4)

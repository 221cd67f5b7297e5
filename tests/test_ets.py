import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from demandspark.operators import ets
from demandspark.operators import folds as fold_ops
from demandspark.operators import naive
from helpers import by_key, panel


def plain_loop(y, form, m, alpha, beta, gamma, phi, horizon):
    """One series, one parameter row, one observation at a time."""
    error, trend, season = form[0], form[1:-1], form[-1]
    k = min(10, len(y))
    s = [0.0] * m
    v = list(y)
    if season != "N":
        first = y[: 2 * m]
        mean = sum(first) / (2 * m)
        rel = [(a / mean if season == "M" else a - mean) for a in first]
        s = [(rel[j] + rel[j + m]) / 2 for j in range(m)]
        centre = sum(s) / m
        s = [(a / centre if season == "M" else a - centre) for a in s]
        v = [(a / s[i % m] if season == "M" else a - s[i % m]) for i, a in enumerate(y)]
    mean = sum(v[:k]) / k
    level, slope = mean, 0.0
    if trend != "N":
        xs = range(1, k + 1)
        mx = sum(xs) / k
        slope = sum((x - mx) * (a - mean) for x, a in zip(xs, v)) / sum((x - mx) ** 2 for x in xs)
        level = mean - slope * mx
    crit_sum = logs = 0.0
    for t, obs in enumerate(y):
        base = level + phi * slope
        st = s[t % m]
        fit = base * st if season == "M" else base + (st if season != "N" else 0)
        e = obs - fit
        crit_sum += (e / fit) ** 2 if error == "M" else e * e
        logs += math.log(fit) if error == "M" else 0
        if season == "M":
            r = e / fit
            level, slope, s[t % m] = base * (1 + alpha * r), phi * slope + beta * base * r, st * (1 + gamma * r)
        else:
            level, slope = base + alpha * e, phi * slope + beta * e
            if season != "N":
                s[t % m] = st + gamma * e
    n = len(y)
    p = 1 + (trend != "N") + (trend == "Ad") + (season != "N") + 1 + (trend != "N") + (m - 1 if season != "N" else 0) + 1
    aicc = n * math.log(max(crit_sum, 1e-12)) + 2 * logs + 2 * p + 2 * p * (p + 1) / (n - p - 1)
    out, damp = [], 0.0
    for h in range(1, horizon + 1):
        damp += phi**h
        f = level + (damp * slope if trend != "N" else 0)
        if season != "N":
            sh = s[(n + h - 1) % m]
            f = f * sh if season == "M" else f + sh
        out.append(f)
    return aicc, out


def chosen(spark, series, season, horizon, forms, alphas=ets.ALPHAS, refinements=0):
    df = spark.createDataFrame([(k, [float(v) for v in y]) for k, y in enumerate(series)], "k int, y array<double>")
    fit = df.select("k", "y", ets.best_fit(F.col("y"), season, forms, alphas, refinements).alias("fit"))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: ets.forecast_at(F.col("fit"), F.size("y"), h))
    return fit.select("k", "fit", ahead.alias("points")).orderBy("k").collect()


@pytest.mark.parametrize("form", ["ANN", "MAN", "AAdN", "ANA", "MNA", "AAA", "MAdA"])
def test_fold_against_plain_loop(spark, form):
    rng = random.Random(form)
    series = [
        [20 + 0.3 * i + 4 * math.sin(i * math.pi / 2) + rng.random() for i in range(n)] for n in (60, 37, 41)
    ]
    for y, got in zip(series, chosen(spark, series, 4, 5, [form], (0.1, 0.5))):
        rows = ets.grids([form], (0.1, 0.5))[form[1:-1], form[-1]]
        best = min((plain_loop(y, form, 4, a, b, g, p, 5) for a, b, g, p in rows), key=lambda r: r[0])
        assert got["fit"]["aicc"] == pytest.approx(best[0], rel=1e-9) and got["fit"]["form"] == form
        assert got["points"] == pytest.approx(best[1], rel=1e-9)


def halfway(v, grid, low, high, turn):
    below = max([x for x in grid if x < v], default=(v + low) / 2)
    above = min([x for x in grid if x > v], default=(v + high) / 2)
    return [v - (v - below) / 2**turn, v, v + (above - v) / 2**turn]


@pytest.mark.parametrize("form", ["ANN", "AAN", "MAdN", "AAA"])
def test_refinement_against_plain_loop(spark, form):
    rng = random.Random(form)
    series = [[20 + 0.2 * i + 3 * math.sin(i * math.pi / 2) + 5 * rng.random() for i in range(n)] for n in (50, 33)]
    alphas, trend, season = (0.1, 0.5), form[1:-1], form[-1]
    coarse, fine = (chosen(spark, series, 4, 3, [form], alphas, r) for r in (0, 2))
    for y, before, after in zip(series, coarse, fine, strict=True):
        tried = lambda row: plain_loop(y, form, 4, *row, 3)[0]  # noqa: B023, E731
        best = min(ets.grids([form], alphas)[trend, season], key=tried)
        for turn in (1, 2):
            a, b, g, p = best
            rows = [best, *itertools.product(
                halfway(a, alphas, 0, 1, turn),
                halfway(b, ets.BETAS, 0, 1, turn) if trend != "N" else [b],
                halfway(g, ets.GAMMAS, 0, 1, turn) if season != "N" else [g],
                halfway(p, ets.PHIS, 0.8, 0.98, turn) if trend == "Ad" else [p],
            )]
            rows = [r for r in rows if (trend == "N" or r[1] < r[0]) and (season == "N" or r[2] < 1 - r[0])]
            best = min(rows, key=tried)
        assert after["fit"]["aicc"] == pytest.approx(tried(best), rel=1e-9)
        assert after["fit"]["aicc"] <= before["fit"]["aicc"]
        assert [after["fit"][c] for c in ets.NAMES] == pytest.approx(best)


def test_refinement_never_worse_and_without_a_form(spark):
    rng = random.Random(5)
    series = [[max(0, rng.gauss(5 + k, 3)) for _ in range(30)] for k in range(6)] + [[1, 2], [0] * 12]
    coarse, fine = (chosen(spark, series, 4, 2, ["ANN", "MNN", "AAdN"], refinements=r) for r in (0, 3))
    for a, b in zip(coarse, fine, strict=True):
        assert (a["fit"] is None) == (b["fit"] is None)
        assert a["fit"] is None or b["fit"]["aicc"] <= a["fit"]["aicc"]
    assert any(a["fit"] and b["fit"]["aicc"] < a["fit"]["aicc"] for a, b in zip(coarse, fine, strict=True))


def test_refinements_do_not_deepen_the_expression(spark):
    y = [20 + 0.2 * i + 3 * math.sin(i * math.pi / 2) + (i * i) % 7 for i in range(40)]
    few, many = (chosen(spark, [y], 4, 2, ["ANN", "AAA"], (0.1, 0.5), r)[0]["fit"] for r in (1, 8))
    assert many["aicc"] <= few["aicc"]


def test_forms_that_cannot_serve(spark):
    with pytest.raises(ValueError):
        ets.grids(["MNM"])
    with pytest.raises(ValueError):
        ets.ets(panel(spark, {"X": range(30)}), 2, 1, forms=["ANA"])
    zero, short = chosen(spark, [[0, 1, 2] * 5, [1, 2]], 4, 2, ["MNN"])
    assert zero["fit"] is None and short["fit"] is None


def test_no_python_in_the_plan(spark):
    plan = ets.ets(panel(spark, {"X": range(30)}), 2, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_routing_by_history(spark):
    p = panel(spark, {"LONG": [5] * 120, "SHORT": range(10)})
    got = ets.ets(p, 2, 52)
    routes = {r["id"]: r["route"] for r in got.collect()}
    assert routes["SHORT"] == "drift" and routes["LONG"] != "drift"
    short = by_key(got.filter("id = 'SHORT'").drop("route"), "id", "date")
    assert short == by_key(naive.drift(p, 2).filter("id = 'SHORT'"), "id", "date")
    assert {r["prediction"] for r in got.filter("id = 'LONG'").collect()} == {5.0}
    everything = ets.ets(p, 2, 52, min_history=5)
    assert "drift" not in {r["route"] for r in everything.collect()}


def test_trend_with_yearly_spikes(spark):
    y = [50 + 0.5 * i + (40 if i % 52 == 0 else 0) for i in range(156)]
    rows = ets.ets(panel(spark, {"X": y}), 4, 52).collect()
    assert len(rows) == 4 and all(math.isfinite(r["prediction"]) and r["prediction"] >= 0 for r in rows)
    assert all(100 < r["prediction"] < 160 for r in rows)


def test_monthly_season_is_followed(spark):
    y = [100 + 30 * math.sin(2 * math.pi * i / 12) for i in range(72)]
    p = panel(spark, {"X": y}, step=30)
    got = [r["prediction"] for r in ets.ets(p, 3, 12, forms=ets.FORMS).orderBy("date").collect()]
    assert got == pytest.approx([100 + 30 * math.sin(2 * math.pi * i / 12) for i in (72, 73, 74)], abs=1.0)


def test_forecasts_are_not_negative(spark):
    rows = ets.ets(panel(spark, {"X": [200 - 2 * i for i in range(100)]}), 30, 4).collect()
    assert min(r["prediction"] for r in rows) >= 0


def test_coverage(spark):
    p = panel(spark, {"A": [1] * 20, "B": [1] * 8, "C": [1] * 9 + [None] * 9})
    row = ets.coverage(p, 5).first()
    assert (row["n_total"], row["n_ets"], row["n_fallback"]) == (3, 1, 2)
    assert row["ets_share"] == pytest.approx(1 / 3)
    empty = ets.coverage(p.filter("false"), 5).first()
    assert empty["n_total"] == 0 and math.isnan(empty["ets_share"])
    assert ets.ets(p.filter("false"), 2, 5).count() == 0


def test_all_folds_equal_fold_by_fold(spark):
    p = panel(spark, {"A": [3 + i % 4 for i in range(60)], "B": [0, 1] * 20 + [2] * 20, "C": [7] * 9})
    folds = fold_ops.walk_forward(p, 14, n_folds=2)
    got = by_key(ets.ets_folds(p, folds, 2, 4), "fold_id", "id", "date")
    expected = {}
    for f in folds.collect():
        train = p.filter(F.col("date") <= f["train_end"])
        for r in ets.ets(train, 2, 4).collect():
            expected[(f["fold_id"], r["id"], r["date"])] = (r["route"], r["prediction"])
    assert {k: (v["route"], v["prediction"]) for k, v in got.items()} == expected

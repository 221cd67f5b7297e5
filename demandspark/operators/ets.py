"""Exponential smoothing with the form chosen per series, and drift for short series.

Spark shuffles the panel once into one sorted array per series (bounded by the number of periods).
Every row of a parameter grid is then folded over the array by ``aggregate``: one recursion serves all
forms, since a missing trend or season is one that stays 0. The form and parameters with the least
AICc win. With ``refinements``, finer grids follow around the best row, each half as wide as the one
before, so the first grid no longer decides the fit. No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import check_frequency, clip_at_zero, future_period, let, ratio
from demandspark.operators.folds import assign_folds, folds_array
from demandspark.operators.naive import drift_value, last_date, steps
from demandspark.schemas import SMOOTHING_FORMS
from demandspark.sources.storage import shuffle_partitions

INITIAL_PERIODS = 10

# Parameter grids
ALPHAS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.01, 0.1, 0.3)
GAMMAS = (0.05, 0.1, 0.3)
PHIS = (0.85, 0.95)
NAMES = ("alpha", "beta", "gamma", "phi")

# error (A or M), trend (N, A or damped Ad) and season (N or A) of each form
FORMS = (*SMOOTHING_FORMS, "ANA", "MNA", "AAA", "MAA", "AAdA", "MAdA")


def grids(forms: Sequence[str], alphas: Sequence[float] = ALPHAS) -> dict[tuple[str, str], list[tuple]]:
    """Rows (alpha, beta, gamma, phi) inside the usual bounds for every trend and season of the forms."""
    unknown = sorted(set(forms) - set(FORMS))
    if unknown or not forms:
        raise ValueError(f"forms must be among {FORMS}, not {unknown}")
    return {
        (trend, season): [
            (a, b, g, p)
            for a, b, g, p in product(
                alphas, BETAS if trend != "N" else (0.0,), GAMMAS if season != "N" else (0.0,), PHIS if trend == "Ad" else (1.0,)
            )
            if (trend == "N" or b < a) and (season == "N" or g < 1 - a)
        ]
        for trend, season in dict.fromkeys((f[1:-1], f[-1]) for f in forms)
    }


def free_parameters(trend: str, season: str, season_length: int) -> int:
    """Smoothing parameters, initial states and the error variance."""
    trends = (trend != "N") * 2 + (trend == "Ad")
    return 3 + trends + (season != "N") * season_length


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _start(values: Column, trend: bool) -> Column:
    """Level and slope before the first observation, from the first periods."""
    first = F.slice(values, 1, INITIAL_PERIODS)
    k = F.size(first).cast("double")
    mean = _total(first) / k
    if not trend:
        return F.struct(mean.alias("level"), F.lit(0.0).alias("slope"))
    middle = (k + 1) / 2
    offsets = F.transform(first, lambda v, i: i + 1 - middle)
    rise = _total(F.zip_with(offsets, first, lambda x, v: x * v))
    spread = _total(F.transform(offsets, lambda x: x * x))
    return let(
        F.struct(mean.alias("mean"), (rise / F.greatest(spread, F.lit(1e-12))).alias("slope")),
        lambda s: F.struct((s["mean"] - s["slope"] * middle).alias("level"), s["slope"].alias("slope")),
    )


def _seasonal_start(values: Column, m: int) -> Column:
    """Seasonal offsets of the phases 0 to m - 1 from the first two cycles; they sum to 0."""
    first = F.slice(values, 1, 2 * m)
    level = _total(first) / float(2 * m)
    phases = F.transform(
        F.sequence(F.lit(1), F.lit(m)),
        lambda j: (F.get(first, j - 1) - level + F.get(first, j + m - 1) - level) / 2,
    )
    return let(phases, lambda s: F.transform(s, lambda v: v - _total(s) / float(m)))


def _fold(values: Column, p: Column, start: Column, season: Column, m: int) -> Column:
    """The smoothing recursion over all observations, with the sums that the criteria need."""
    zero = F.lit(0.0)
    state = F.struct(
        start["level"].alias("level"), start["slope"].alias("slope"), season.alias("season"),
        zero.alias("sse"), zero.alias("relative"), zero.alias("logs"), F.lit(False).alias("bad"),
    )
    points = F.transform(values, lambda y, i: F.struct(y.alias("y"), (i % m).alias("phase")))

    def step(a: Column, point: Column) -> Column:
        seen = F.struct(
            (a["level"] + p["phi"] * a["slope"]).alias("base"), F.get(a["season"], point["phase"]).alias("s"), point["y"].alias("y")
        )

        def judged(b: Column) -> Column:
            fit = b["base"] + b["s"]
            return let(F.struct(fit.alias("fit"), (b["y"] - fit).alias("err")), lambda e: moved(b, e))

        def moved(b: Column, e: Column) -> Column:
            part = F.when(e["fit"] > 0, e["err"] / e["fit"]).otherwise(zero)
            turned = a["season"] if m == 1 else F.transform(
                a["season"], lambda v, k: F.when(k == point["phase"], b["s"] + p["gamma"] * e["err"]).otherwise(v)
            )
            return F.struct(
                (b["base"] + p["alpha"] * e["err"]).alias("level"),
                (p["phi"] * a["slope"] + p["beta"] * e["err"]).alias("slope"),
                turned.alias("season"),
                (a["sse"] + e["err"] * e["err"]).alias("sse"),
                (a["relative"] + part * part).alias("relative"),
                (a["logs"] + F.when(e["fit"] > 0, F.log(e["fit"])).otherwise(zero)).alias("logs"),
                (a["bad"] | (e["fit"] <= 0)).alias("bad"),
            )

        return let(seen, judged)

    return F.aggregate(points, state, step)


def _grid(rows: list[tuple]) -> Column:
    """The rows of a grid as an array of structs."""
    return F.array(*[
        F.struct(F.lit(i).alias("number"), *(F.lit(v).alias(c) for c, v in zip(NAMES, r, strict=True))) for i, r in enumerate(rows)
    ])


def _around(fit: Column, trend: str, kind: str, alphas: Sequence[float], turn: Column) -> Column:
    """Rows around the fitted one, ``turn["share"]`` of the way to the neighbours in the first grid."""
    share = turn["share"]

    def near(name: str, grid: Sequence[float], low: float, high: float) -> Column:
        v, known = fit[name], F.array(*map(F.lit, grid))
        below = F.coalesce(F.array_max(F.filter(known, lambda x: x < v)), (v + F.lit(low)) / 2)
        above = F.coalesce(F.array_min(F.filter(known, lambda x: x > v)), (v + F.lit(high)) / 2)
        return F.array(v - (v - below) * share, v, v + (above - v) * share)

    a = near("alpha", alphas, 0.0, 1.0)
    b = near("beta", BETAS, 0.0, 1.0) if trend != "N" else F.array(fit["beta"])
    g = near("gamma", GAMMAS, 0.0, 1.0) if kind != "N" else F.array(fit["gamma"])
    p = near("phi", PHIS, 0.8, 0.98) if trend == "Ad" else F.array(fit["phi"])
    rows = F.flatten(F.flatten(F.flatten(F.transform(a, lambda w: F.transform(b, lambda x: F.transform(g, lambda y: F.transform(
        p, lambda z: F.struct(*(v.alias(c) for v, c in zip((w, x, y, z), NAMES, strict=True))))))))))
    if trend != "N":
        rows = F.filter(rows, lambda q: q["beta"] < q["alpha"])
    if kind != "N":
        rows = F.filter(rows, lambda q: q["gamma"] < 1 - q["alpha"])
    return F.transform(rows, lambda q, i: F.struct((i + turn["first"]).alias("number"), *(q[c].alias(c) for c in NAMES)))


def _candidates(values: Column, trend: str, kind: str, params: Column, forms: dict[str, int], season_length: int) -> Column:
    """Every usable form of one trend and season with every row of ``params``, as an array of structs."""
    n = F.size(values).cast("double")
    m = season_length if kind != "N" else 1
    k = free_parameters(trend, kind, season_length)
    penalty = 2.0 * k + 2.0 * k * (k + 1) / (n - k - 1)

    def judged(a: Column, p: Column) -> Column:
        out = []
        for form, order in forms.items():
            usable = n > k + 1
            if form[0] == "A":
                score = n * F.log(F.greatest(a["sse"], F.lit(1e-12))) + penalty
            else:
                score = n * F.log(F.greatest(a["relative"], F.lit(1e-12))) + 2 * a["logs"] + penalty
                usable = usable & ~a["bad"] & (F.array_min(values) > 0)
            out.append(F.when(usable, F.struct(
                score.alias("aicc"), F.lit(order).alias("order"), p["number"].alias("number"), F.lit(form).alias("form"),
                *(p[c].alias(c) for c in NAMES), a["level"].alias("level"), a["slope"].alias("slope"),
                a["season"].alias("season"))))
        return F.array(*out)

    def fitted(season: Column) -> Column:
        plain = F.transform(values, lambda y, i: y - F.get(season, i % m)) if kind != "N" else values
        return let(_start(plain, trend != "N"), lambda start: F.flatten(F.transform(
            params, lambda p: let(_fold(values, p, start, season, m), lambda a: judged(a, p)))))

    season = _seasonal_start(values, m) if kind != "N" else F.array(F.lit(0.0))
    return F.when(F.size(values) >= (2 * m if kind != "N" else 1), let(season, fitted))


def best_fit(
    values: Column, season_length: int, forms: Sequence[str], alphas: Sequence[float] = ALPHAS, refinements: int = 0
) -> Column:
    """The form with the least AICc: ``aicc, order, number, form``, its parameters, ``level, slope, season``;
    NULL if none can be used. Ties go to the earlier form, then to the earlier row of the grid. Every
    refinement tries rows around the best one of its trend and season and keeps it if none is better."""
    groups = grids(forms, alphas)
    named = {g: {f: i for i, f in enumerate(forms) if (f[1:-1], f[-1]) == g} for g in groups}
    found = [_candidates(values, *g, _grid(rows), named[g], season_length) for g, rows in groups.items()]
    every = F.flatten(F.filter(F.array(*found), lambda c: c.isNotNull()))
    best = F.array_min(F.filter(every, lambda c: c.isNotNull()))

    def tries(fit: Column, turn: Column) -> Column:
        tried = F.coalesce(*(
            F.when(fit["form"].isin(list(named[g])), _candidates(values, *g, _around(fit, *g, alphas, turn), named[g], season_length))
            for g in groups
        ))
        return F.array_min(F.concat(F.array(fit), F.filter(tried, lambda c: c.isNotNull())))

    if not refinements:
        return best
    # one lambda for all turns: nested a turn in the other, they outgrow the analyzer's iterations
    turns = F.array(*(F.struct(F.lit(1000 * t).alias("first"), F.lit(0.5**t).alias("share")) for t in range(1, refinements + 1)))
    return F.aggregate(turns, best, tries)


def forecast_at(fit: Column, n: Column, h: Column) -> Column:
    """The point forecast ``h`` steps after the ``n``-th observation."""
    damping = F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda a, i: a + F.pow(fit["phi"], i))
    phase = F.pmod(n + h - 1, F.size(fit["season"]))
    return fit["level"] + damping * fit["slope"] + F.get(fit["season"], phase)


def series_arrays(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per series with its sorted ``(date, y)`` history.

    The panel is repartitioned by id before the grouping, which then needs no further exchange; the
    explicit number keeps AQE from packing the costly fits of few bytes into few tasks.
    """
    n = shuffle_partitions(panel.sparkSession)
    y = F.col("sales").cast("double").alias("y")
    point = F.when(F.col("sales").isNotNull(), F.struct("date", y))
    return (
        panel.select(*by, "id", "date", "sales")
        .repartition(n, *by, "id")
        .groupBy(*by, "id")
        .agg(F.array_sort(F.collect_list(point)).alias("_points"))
    )


def _forecast(
    series: DataFrame,
    end: Column,
    keys: Sequence[str],
    horizon: int,
    season_length: int,
    frequency: str,
    min_history: int | None,
    forms: Sequence[str],
    alphas: Sequence[float],
    refinements: int,
) -> DataFrame:
    check_frequency(frequency)
    if season_length < 2 and any(f[-1] != "N" for f in forms):
        raise ValueError(f"seasonal forms need a season of at least 2 periods, not {season_length}")
    need = 2 * season_length if min_history is None else min_history

    def points(y: Column, fit: Column) -> Column:
        first, last, n = F.element_at(y, 1), F.element_at(y, -1), F.size(y)
        # no usable form (for instance too few periods for any AICc) also routes to drift
        return F.transform(steps(horizon), lambda h: F.struct(
            h.alias("step"),
            F.when(fit.isNotNull(), clip_at_zero(forecast_at(fit, n, h)))
            .otherwise(drift_value(first, last, n, h)).alias("prediction"),
            F.coalesce(fit["form"], F.lit("drift")).alias("route"),
        ))

    def routed(y: Column) -> Column:
        return let(F.when(F.size(y) >= need, best_fit(y, season_length, forms, alphas, refinements)), lambda fit: points(y, fit))

    # one expression: the optimizer would repeat a fit that stands in a column of its own
    return (
        series.filter(F.size("_y") > 0)
        .select(*keys, end.alias("_end"), F.explode(let(F.col("_y"), routed)).alias("_p"))
        .select(
            *keys, "_p.route", future_period(F.col("_end"), F.col("_p.step"), frequency).alias("date"), "_p.prediction"
        )
    )


def ets(
    train: DataFrame,
    horizon: int,
    season_length: int,
    frequency: str = "W",
    min_history: int | None = None,
    by: Sequence[str] = (),
    forms: Sequence[str] = SMOOTHING_FORMS,
    alphas: Sequence[float] = ALPHAS,
    refinements: int = 0,
) -> DataFrame:
    """Predictions with the ``route`` taken: the chosen form, or drift for short series.

    Series with fewer than ``min_history`` observations (two seasons by default) take drift.
    Restrict ``train`` to the wanted ids beforehand: only those are then fitted.
    """
    series = series_arrays(train, by).withColumn("_y", F.transform("_points", lambda q: q["y"]))
    return _forecast(
        series, last_date(train, by), [*by, "id"], horizon, season_length, frequency, min_history, forms, alphas, refinements
    )


def ets_folds(
    panel: DataFrame,
    folds: DataFrame,
    horizon: int,
    season_length: int,
    frequency: str = "W",
    min_history: int | None = None,
    forms: Sequence[str] = SMOOTHING_FORMS,
    alphas: Sequence[float] = ALPHAS,
    refinements: int = 0,
) -> DataFrame:
    """:func:`ets` for all folds; each history is shuffled once and cut per fold in place."""
    fold = F.col("_fold")
    train_end = fold["train_end"]
    kept = F.filter("_points", lambda q: q["date"] <= F.col("train_end"))
    ends = assign_folds(panel.select("date").distinct(), folds).filter("role = 'train'")
    series = (
        series_arrays(panel)
        .withColumn("_fold", F.explode(folds_array(folds)))
        .select("id", "_points", fold["fold_id"].alias("fold_id"), train_end.alias("train_end"))
        .withColumn("_y", F.transform(kept, lambda q: q["y"]))
    )
    return _forecast(
        series,
        last_date(ends, ["fold_id"]),
        ["fold_id", "id"],
        horizon,
        season_length,
        frequency,
        min_history,
        forms,
        alphas,
        refinements,
    )


def coverage(
    train: DataFrame, season_length: int, min_history: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Series long enough for smoothing, series routed to drift, and the smoothing share."""
    need = 2 * season_length if min_history is None else min_history
    lengths = train.groupBy(*by, "id").agg(F.count("sales").alias("_n"))
    long_enough = F.count_if(F.col("_n") >= need)
    total = F.count(F.lit(1))
    return lengths.groupBy(*by).agg(
        total.alias("n_total"),
        long_enough.alias("n_ets"),
        F.count_if(F.col("_n") < need).alias("n_fallback"),
        F.coalesce(ratio(long_enough, total), F.lit(float("nan"))).alias("ets_share"),
    )


def routed_ids(train: DataFrame, season_length: int, min_history: int | None = None) -> DataFrame:
    """Ids long enough for smoothing."""
    need = 2 * season_length if min_history is None else min_history
    return train.groupBy("id").agg(F.count("sales").alias("_n")).filter(F.col("_n") >= need).select("id")

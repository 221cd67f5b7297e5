"""Coherent forecasts over a hierarchy: bottom-up, top-down and minimum trace.

A hierarchy is a list of levels, each a tuple of columns of the bottom series; ``()`` is the total. Nodes are
named by their level and their values. Forecasts come as ``level, node, date, prediction``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.operators.ranking import exact_rank
from demandspark.sources.storage import cut_lineage

Level = tuple[str, ...]


def level_name(level: Level) -> str:
    return "__".join(level) or "total"


def node_name(level: Level) -> Column:
    """The values of a level's columns; the total has one node."""
    if not level:
        return F.lit("total")
    parts: list[Column] = []
    for c in level:
        parts += [F.lit("__"), F.col(c)]
    return F.concat(*parts[1:])


def _named(rows: DataFrame, levels: Sequence[Level], columns: Sequence[str]) -> tuple[Column, Column]:
    """Level and node of rows of a grouping set, by the mask of the columns that it leaves out."""
    name = node = F.lit(None).cast("string")
    for level in levels:
        mask = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level)
        name = F.when(F.col("_mask") == mask, level_name(level)).otherwise(name)
        node = F.when(F.col("_mask") == mask, node_name(level)).otherwise(node)
    return name, node


def level_sums(rows: DataFrame, levels: Sequence[Level], value: str, extra: Sequence[str] = ("date",)) -> DataFrame:
    """``extra, level, node, value``: sums of all levels in one aggregation over grouping sets."""
    if len(set(levels)) != len(levels):
        raise ValueError("levels must differ")
    columns = sorted({c for level in levels for c in level})
    sets = [[F.col(c) for c in (*extra, *level)] for level in levels]
    all_columns = [F.col(c) for c in (*extra, *columns)]
    found = rows.groupingSets(sets, *all_columns).agg(F.sum(value).alias(value), F.grouping_id().alias("_id"))
    found = found.withColumn("_mask", F.col("_id") % (1 << len(columns)))
    name, node = _named(found, levels, columns)
    return found.select(*extra, name.alias("level"), node.alias("node"), value)


def bottom_up(predictions: DataFrame, levels: Sequence[Level], value: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Bottom forecasts (with the columns of the hierarchy) summed to every level."""
    return level_sums(predictions, levels, value, [*by, "date"])


def top_down(total: DataFrame, volumes: DataFrame, levels: Sequence[Level], id_col: str = "id") -> DataFrame:
    """Whole units of a forecast of the total (``date, prediction``) allocated to the series of ``volumes`` (``id``, columns of
    the hierarchy, ``volume`` in whole units) and summed to every level: ``date, level, node, prediction``.

    A series gets the whole part of its share; the units that are left go to the largest remainders (ties by
    id). Shares, remainders and ranks are exact whole numbers, and ranks are taken over all tasks. If
    nothing was ever sold, nothing is allocated.
    """
    sums = volumes.agg(F.sum("volume").cast("decimal(38,0)")).scalar()
    dates = total.select("date", F.round("prediction").cast("long").alias("_units"))
    points = dates.agg(F.array_sort(F.collect_list(F.struct("date", "_units")))).scalar()  # a horizon of dates
    rows = volumes.withColumn("_p", F.explode(points)).select(
        *volumes.columns, F.col("_p.date").alias("date"), F.col("_p._units").alias("_units"), sums.alias("_sum")
    )
    product = F.col("_units").cast("decimal(19,0)") * F.col("volume").cast("decimal(18,0)")
    whole = F.when(F.col("_sum") > 0, F.expr("CAST(_product DIV _sum AS bigint)")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_product", product).withColumn("_whole", whole)
    rows = rows.withColumn("_rest", F.col("_product") - F.col("_whole") * F.col("_sum"))
    spare = rows.groupBy("date").agg((F.first("_units") - F.sum("_whole")).alias("_spare"), F.first("_sum").alias("_all"))
    ranked = exact_rank(rows, [F.desc("_rest"), F.asc(id_col)], ["date"], "_rank")
    given = ranked.join(F.broadcast(spare.select(F.col("date").alias("_day"), "_spare", "_all")), F.col("date") == F.col("_day"))
    extra = ((F.col("_rank") <= F.col("_spare")) & (F.col("_all") > 0)).cast("long")
    bottom = given.withColumn("prediction", F.col("_whole") + extra)
    return level_sums(bottom, levels, "prediction", ["date"])


@dataclass(frozen=True)
class Shrunk:
    """Error covariance ``(1 - weight) * E E' / n + weight * diagonal``; ``weight`` by Schaefer and Strimmer."""

    weight: float
    n: int


def shrinkage(errors: DataFrame, n: int) -> Shrunk:
    """From the n x n products of error vectors alone: sums over all pairs of series follow from it."""
    unit = F.transform("errors", lambda e: e / F.col("_sd"))
    sd = F.sqrt(F.aggregate("errors", F.lit(0.0), lambda a, e: a + e * e) / n)
    rows = errors.withColumn("_sd", sd).where("_sd > 0").select(unit.alias("z"))
    products = [F.sum(F.col("z")[i] * F.col("z")[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    fourth = F.sum(F.aggregate("z", F.lit(0.0), lambda a, e: a + e * e * e * e)).alias("fourth")
    found = rows.agg(*products, fourth, F.count(F.lit(1)).alias("m")).first()
    m = found["m"]
    if m < 2 or n < 2:
        return Shrunk(1.0, n)
    gram = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = found[f"g{i}_{j}"]
    squares = float((gram**2).sum()) / n**2  # of all correlations
    spread = float((np.diag(gram) ** 2).sum()) - n * squares
    own = found["fourth"] - n * m  # what the diagonal adds to the spread
    off = squares - m
    weight = 1.0 if off <= 0 else (spread - own) * n / (n - 1) ** 3 / (off * (n / (n - 1)) ** 2)
    return Shrunk(float(min(1.0, max(0.0, weight))), n)


def min_trace(
    base: DataFrame, errors: DataFrame, edges: DataFrame, dates: Sequence, weight: float | None = None, tolerance: float = 1e-7, most_rounds: int = 1000
) -> DataFrame:
    """Minimum-trace reconciliation: ``node, date, prediction`` of all nodes, coherent.

    ``base`` has ``node, date, prediction``, ``errors`` has ``node, errors`` (an array of past base errors, as long for
    every node), ``edges`` has ``bottom, ancestor`` for every bottom node and each node above it.

    With the error covariance W and the constraints C (a node less its bottom nodes), the solution is
    ``y - W C' (C W C')^-1 C y``. W is a diagonal and a product of the few error vectors, so nothing
    larger than the edges is built: ``C D C'`` is summed once to pairs of ancestors that share a bottom node, and
    ``(C W C') u = C y`` is solved by conjugate gradients, all dates at once. A round is a join over these
    pairs and an aggregation; only a few numbers a date come to the driver. Sums over the bottom
    nodes make the result coherent.
    """
    h = len(dates)
    n = errors.select(F.size("errors")).first()[0]
    found = shrinkage(errors, n) if weight is None else Shrunk(weight, n)
    variance = F.aggregate("errors", F.lit(0.0), lambda a, e: a + e * e) / n
    mean = errors.agg(F.avg(variance)).first()[0] or 1.0
    low = max(mean, 1e-12) * 1e-6  # a series without errors still has some variance
    lists = base.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("date", "prediction"))).alias("_m"))
    y = F.array(*(F.coalesce(F.col("_m")[F.lit(d)], F.lit(0.0)) for d in dates))
    scaled = F.transform("errors", lambda e: e * float(np.sqrt((1 - found.weight) / n)))
    # the variance that is left beside the product of error vectors
    own = F.lit(found.weight) * F.greatest(variance, F.lit(low)) + F.lit((1 - found.weight) * low)
    nodes = cut_lineage(
        lists.join(errors, "node").select("node", y.alias("y"), own.alias("d"), scaled.alias("e"))
    )
    plus = lambda c, k: F.array(*(F.sum(F.col(c)[i]) for i in range(k)))
    leaves = edges.join(nodes.withColumnRenamed("node", "bottom"), "bottom")
    under = leaves.groupBy("ancestor").agg(plus("y", h).alias("y_b"), plus("e", n).alias("e_b"))
    less = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    pairs = edges.select("bottom", F.col("ancestor").alias("b"))
    grid = leaves.select("bottom", F.col("ancestor").alias("a"), "d").join(pairs, "bottom").groupBy("a", "b").agg(F.sum("d").alias("m"))
    grid = cut_lineage(grid)
    above = nodes.join(under, F.col("node") == F.col("ancestor"))
    diagonal = grid.where("a = b").select(F.col("a").alias("ancestor"), F.col("m").alias("m_aa"))
    zero = F.array(*[F.lit(0.0)] * h)
    state = above.join(diagonal, "ancestor").select(
        "node", "d", less("e", "e_b").alias("f"), less("y", "y_b").alias("r"), zero.alias("u"), "m_aa"
    )
    f2 = F.aggregate("f", F.lit(0.0), lambda a, e: a + e * e)
    state = state.withColumn("w", F.lit(1.0) / (F.col("d") + F.col("m_aa") + f2)).drop("m_aa")
    state = cut_lineage(state.withColumn("p", F.transform("r", lambda v: v * F.col("w"))))
    dot = lambda a, b: [F.sum(F.col(a)[i] * F.col(b)[i] * (F.col("w") if b != "q" or a != "p" else 1)) for i in range(h)]
    numbers = lambda rows, columns: np.array([v or 0.0 for v in rows.agg(*columns).first()])
    rz = numbers(state, dot("r", "r"))
    goal = tolerance**2 * np.maximum(rz, 1e-300)
    literal = lambda values: F.array(*(F.lit(float(v)) for v in values))
    # numbers of a round stay inside array literals: the generated code is then that of the round before
    inner = lambda c, v: F.aggregate(F.zip_with(F.col(c), literal(v), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    for _ in range(most_rounds):
        if (rz <= goal).all():
            break
        z = numbers(state, [F.sum(F.col("f")[t] * F.col("p")[i]) for t in range(n) for i in range(h)]).reshape(n, h)
        spread = grid.join(state.select(F.col("node").alias("b"), "p"), "b").groupBy("a").agg(
            F.array(*(F.sum(F.col("m") * F.col("p")[i]) for i in range(h))).alias("g")
        )
        low_rank = F.array(*(inner("f", z[:, i]) for i in range(h)))
        q = F.zip_with(F.zip_with("g", F.transform("p", lambda v: v * F.col("d")), lambda a, b: a + b), low_rank, lambda a, b: a + b)
        state = cut_lineage(state.join(spread, F.col("node") == F.col("a")).select("node", "d", "f", "w", "r", "u", "p", q.alias("q")))
        got = numbers(state, [*dot("p", "q"), *dot("r", "q"), *dot("q", "q")]).reshape(3, h)
        alpha = np.where(rz > goal, rz / np.where(got[0] > 0, got[0], 1.0), 0.0)
        after = np.maximum(rz - 2 * alpha * got[1] + alpha**2 * got[2], 0.0)
        beta = np.where(alpha > 0, after / np.maximum(rz, 1e-300), 0.0)
        along = lambda a, b, s: F.zip_with(F.col(a), F.zip_with(F.col(b), literal(s), lambda v, k: v * k), lambda v, k: v + k)
        state = state.select("node", "d", "f", "w", along("r", "q", -alpha).alias("r"), along("u", "p", alpha).alias("u"), "p")
        steep = F.transform("r", lambda v: v * F.col("w"))
        state = state.withColumn("p", F.zip_with(steep, F.zip_with("p", literal(beta), lambda v, k: v * k), lambda a, b: a + b))
        state = cut_lineage(state)  # else each of the sums below would hold the whole expression
        rz = np.where(alpha > 0, after, rz)
    else:
        raise RuntimeError(f"no solution within {most_rounds} rounds")
    # y - W C' u at the bottom: C'u is minus the sum of u over the ancestors
    total = numbers(state, [F.sum(F.col("f")[t] * F.col("u")[i]) for t in range(n) for i in range(h)]).reshape(n, h)
    pulled = edges.join(state.select(F.col("node").alias("ancestor"), "u"), "ancestor").groupBy("bottom").agg(plus("u", h).alias("c"))
    joint = F.array(*(inner("e", total[:, i]) for i in range(h)))
    moved = F.zip_with(F.zip_with("y", F.transform("c", lambda v: v * F.col("d")), lambda a, b: a + b), joint, lambda a, b: a - b)
    bottoms = cut_lineage(nodes.join(pulled, F.col("node") == F.col("bottom")).select("bottom", moved.alias("y")))
    sums = edges.join(bottoms, "bottom").groupBy(F.col("ancestor").alias("node")).agg(plus("y", h).alias("y"))
    both = bottoms.select(F.col("bottom").alias("node"), "y").unionByName(sums)
    return both.select("node", F.posexplode("y").alias("i", "prediction")).select(
        "node", F.element_at(F.array(*map(F.lit, dates)), F.col("i") + 1).alias("date"), "prediction"
    )


def hierarchy_edges(series: DataFrame, bottom: Level, levels: Sequence[Level]) -> DataFrame:
    """``bottom, ancestor`` of every series and each level above the bottom; nodes as ``level|node``."""
    full = lambda level: F.concat(F.lit(f"{level_name(level)}|"), node_name(level))
    above = F.array(*(full(level) for level in levels if level != bottom))
    return series.select(full(bottom).alias("bottom"), F.explode(above).alias("ancestor")).distinct()

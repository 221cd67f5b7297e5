"""Unpivot, series selection and hierarchy maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.functions.columns import joined_id
from demandspark.schemas import ID_COLUMNS, SEED


def day_columns(wide: DataFrame) -> list[str]:
    return [c for c in wide.columns if c.startswith("d_")]


def melt_days(
    wide: DataFrame,
    calendar: DataFrame | None = None,
    from_first_sale: bool = False,
) -> DataFrame:
    """One row per series and day out of the wide ``d_*`` columns.

    The day columns go through one array and ``explode``: a row-local generator whose generated
    code does not grow with the ~2,000 day columns as an Expand would.

    ``from_first_sale`` drops the days before the first positive sale, and series that never sold.
    The first sale is found inside the wide row, so it costs no shuffle. Days are compared by
    their number: comparing the labels as text would put d_10 before d_2.
    """
    days = sorted(day_columns(wide), key=lambda c: int(c[2:]))
    ids = [c for c in ID_COLUMNS if c in wide.columns]
    # SQL text, since thousands of Column objects are slow to build from Python
    rows = wide.select(*ids, F.expr(f"array({', '.join(days)})").alias("_sales"))
    points = F.transform("_sales", lambda s, i: F.struct(i.alias("pos"), s.alias("sales")))
    if from_first_sale:
        # array_position is 1-based and 0 when nothing was ever sold; it is found once per row
        first = F.array(F.array_position(F.transform("_sales", lambda s: s > 0), True).cast("int"))
        sold = F.transform(first, lambda p: F.when(p > 0, F.slice(points, F.greatest(p, F.lit(1)), F.size("_sales"))))
        points = F.element_at(sold, 1)
    labels = F.split(F.lit(",".join(days)), ",")
    long = rows.select(*ids, F.explode(points).alias("_p")).select(
        *ids, F.element_at(labels, F.col("_p.pos") + 1).alias("d"), F.col("_p.sales").alias("sales")
    )
    if calendar is not None:
        long = join_day(long, calendar, ["date"])
    return long


def join_day(daily: DataFrame, calendar: DataFrame, columns: Sequence[str], on: str = "d") -> DataFrame:
    """Left join of the day dimension.

    No broadcast hint: the calendar holds one row per day, so Catalyst sees a few hundred KB and
    broadcasts it after its own size check.
    """
    return daily.join(calendar.select(on, *columns), on, "left").select(*daily.columns, *columns)


def hierarchy_map(daily: DataFrame, id_format: str = "item_store") -> DataFrame:
    """Distinct track id -> hierarchy columns, for ``item_store`` or ``item_state`` ids."""
    if id_format == "item_store":
        key, rest = "store_id", ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
    elif id_format == "item_state":
        key, rest = "state_id", ["item_id", "dept_id", "cat_id", "state_id"]
    else:
        raise ValueError(f"id_format must be 'item_store' or 'item_state', not {id_format!r}")
    return daily.select(joined_id("item_id", key).alias("id"), *rest).distinct()


def store_states(daily: DataFrame) -> DataFrame:
    """Distinct store -> state."""
    return daily.select("store_id", "state_id").distinct()


def keep_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose ``column`` is in a short list (stores, departments); pushed to the scan."""
    return df.filter(F.col(column).isin(list(values)))


def keep_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of the requested series. Requests are a table, so their number is not limited."""
    return df.join(ids.select(id_col).distinct(), id_col, "left_semi")


def missing_ids(requested: DataFrame, known: DataFrame, id_col: str = "id") -> DataFrame:
    """Requested ids that ``known`` does not hold."""
    # both sides are reduced to distinct ids map-side before the shuffle
    return requested.select(id_col).distinct().join(known.select(id_col).distinct(), id_col, "left_anti")


def common_ids(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    return left.select(id_col).intersect(right.select(id_col))


def sample_series(df: DataFrame, n: int, seed: int = SEED, id_col: str = "id") -> DataFrame:
    """All rows of ``n`` series drawn by a seeded hash of the id, independent of row order."""
    drawn = (
        df.select(id_col)
        .distinct()
        .orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))), id_col)
        .limit(n)
    )
    return df.join(drawn, id_col, "left_semi")


def recent_history(panel: DataFrame, days: int = 730, date_col: str = "date") -> DataFrame:
    """Rows of the last ``days`` days before the end of the panel."""
    end = panel.agg(F.max(date_col)).scalar()
    return panel.filter(F.col(date_col) >= F.date_sub(end, days))


def cardinalities(daily: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per hierarchy column.

    Exact counts first reduce the facts to the distinct key tuples (partial aggregation collapses
    them in the map tasks), so the per-column counts run over the series, not over the facts.
    """
    if approximate:
        return daily.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    keys = daily.select(*columns).distinct()
    return keys.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])

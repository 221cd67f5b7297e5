"""Calendar, daily sales and weekly prices derived from the star-schema tables.

item = part brand (or brand and type, or the part itself), store = nation of the supplier, state by
region, sales = shipped quantity. The panel is dense: days without a shipment hold an explicit 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from demandspark.operators.rollup import prepare_sparse_track
from demandspark.schemas import CALENDAR, ID_COLUMNS
from demandspark.sources.storage import shuffle_partitions

# Fixed values -------------------------------------------------------------

DEPARTMENTS = (
    "FOODS_1",
    "FOODS_2",
    "FOODS_3",
    "HOUSEHOLD_1",
    "HOUSEHOLD_2",
    "HOBBIES_1",
    "HOBBIES_2",
)
REGION_STATES = {"AMERICA": "CA", "ASIA": "TX", "EUROPE": "WI"}
SNAP_DAYS = {
    "CA": (1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
    "TX": (1, 3, 5, 6, 7, 9, 11, 12, 13, 15),
    "WI": (2, 3, 5, 6, 8, 9, 11, 12, 14, 15),
}
PRICE_WEEK_ZERO = "1994-12-31"

GRAINS = ("brand", "brand_type", "part")

#: Lines behind one partition of a panel by part; a line can stand for a whole series of filled periods.
LINES_PER_PARTITION = 20_000


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table. Its schema is read from a footer once per session, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _item(grain: str) -> Column:
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    if grain == "brand":
        return brand
    if grain == "brand_type":
        return F.concat(brand, F.lit("_"), F.col("p_type"))
    if grain == "part":
        return F.concat(brand, F.lit("_"), F.col("p_partkey").cast("string"))
    raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")


def sold(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """Shipped lines with their product and place.

    Left-deep, so that every join has a stored table on the right whose size Catalyst knows:
    nation and region are always broadcast, supplier and part only while they are small. Beyond
    that they join by shuffle, where AQE splits a hot part or supplier.
    """
    brand_no = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    dept = F.element_at(F.array(*[F.lit(d) for d in DEPARTMENTS]), brand_no % 7 + 1)
    state = F.col("r_name")
    for region, name in REGION_STATES.items():
        state = F.when(F.col("r_name") == region, name).otherwise(state)
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        _item(grain).alias("item_id"),
        dept.alias("dept_id"),
        F.split_part(dept, F.lit("_"), F.lit(1)).alias("cat_id"),
    )
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            F.to_date("l_shipdate").alias("date"),
        )
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            "item_id",
            "dept_id",
            "cat_id",
            F.col("n_name").alias("store_id"),
            state.alias("state_id"),
            "date",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
        )
    )


def _bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").agg(F.min(day).alias("d0"), F.max(day).alias("d1"))


def _price_week(date: Column) -> Column:
    weeks = F.floor(F.datediff(date, F.lit(PRICE_WEEK_ZERO).cast("date")) / 7)
    return (F.lit(10000) + weeks).cast("int")


def _events() -> tuple[Column, Column]:
    date = F.col("date")
    month, day, dow = F.month(date), F.dayofmonth(date), F.weekday(date)
    # name, type, condition; weekday 0 is Monday
    rules = (
        ("Christmas", "National", (month == 12) & (day == 25)),
        ("Thanksgiving", "National", (month == 11) & (dow == 3) & day.between(22, 28)),
        ("LaborDay", "National", (month == 9) & (dow == 0) & (day <= 7)),
        ("SuperBowl", "Sporting", (month == 2) & (dow == 6) & (day <= 7)),
        ("PurimEnd", "Religious", (month == 3) & (day == 14)),
        ("PesachEnd", "Religious", (month == 4) & (day == 15)),
        ("IndependenceDay", "National", (month == 7) & (day == 4)),
        ("Halloween", "Cultural", (month == 10) & (day == 31)),
    )
    name = kind = F.lit(None).cast("string")
    for n, k, test in rules:
        name, kind = F.when(test, n).otherwise(name), F.when(test, k).otherwise(kind)
    return name, kind


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day between the first and the last shipment."""
    date = F.col("date")
    name, kind = _events()
    second = (F.month(date) == 4) & (F.dayofmonth(date) == 15) & (F.weekday(date) == 6)
    days = _bounds(spark, sf_dir).select("d0", F.explode(F.sequence("d0", "d1")).alias("date"))
    columns = {
        "wm_yr_wk": _price_week(date),
        "weekday": F.date_format(date, "EEEE"),
        "wday": (F.weekday(date) + 2) % 7 + 1,
        "month": F.month(date),
        "year": F.year(date),
        "d": F.concat(F.lit("d_"), (F.datediff(date, F.col("d0")) + 1).cast("string")),
        "event_name_1": name,
        "event_type_1": kind,
        "event_name_2": F.when(second, "Easter"),
        "event_type_2": F.when(second, "Cultural"),
        **{
            f"snap_{s}": F.dayofmonth(date).isin(list(days_)).cast("int")
            for s, days_ in SNAP_DAYS.items()
        },
    }
    return days.withColumns(columns).select(*CALENDAR.names)


PLACES = tuple(c for c in ID_COLUMNS if c != "id")


def sold_daily(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """Days with shipments only: the id columns, ``date`` and ``sales``.

    A hot product collapses map-side to one row per day. Enough for totals, first sales and the
    hierarchy, which days without shipments do not change.
    """
    return (
        sold(spark, sf_dir, grain)
        .groupBy(*PLACES, "date")
        .agg(F.sum("l_quantity").cast("bigint").alias("sales"))
        .select(F.concat("item_id", F.lit("_"), "store_id", F.lit("_evaluation")).alias("id"), *PLACES, "date", "sales")
    )


def daily_sales(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """Dense daily panel: the id columns, ``d``, ``date`` and ``sales``.

    Shipments are summed per series and day first. The gaps are then filled from each row to the
    next one of its series: a window over at most one row per day and a row-local explode, instead
    of a join with all series x all days.
    """
    places = list(PLACES)
    bounds = _bounds(spark, sf_dir)
    # item and store determine the other columns, so the narrow partitioning serves the window and
    # every later grouping by item and store. The window names all of them: a filter on any of them
    # then passes below it, down to the scans.
    facts = sold_daily(spark, sf_dir, grain).drop("id").repartition("item_id", "store_id")
    w = W.partitionBy(*places).orderBy("date")
    last_day = bounds.select("d1").scalar()
    first_day = bounds.select("d0").scalar()
    gaps = facts.withColumns({"_next": F.lead("date").over(w), "_prev": F.lag("date").over(w)})
    start = F.when(F.col("_prev").isNull(), first_day).otherwise(F.col("date"))
    end = F.when(F.col("_next").isNull(), last_day).otherwise(F.date_sub("_next", 1))
    dense = gaps.select(
        *places,
        F.col("date").alias("_sold_on"),
        F.col("sales").alias("_sold"),
        F.explode(F.sequence(start, end)).alias("date"),
    )
    return dense.select(
        F.concat("item_id", F.lit("_"), "store_id", F.lit("_evaluation")).alias("id"),
        *places,
        F.concat(F.lit("d_"), (F.datediff(F.col("date"), first_day) + 1).cast("string")).alias("d"),
        "date",
        F.when(F.col("date") == F.col("_sold_on"), F.col("_sold")).otherwise(F.lit(0)).cast("bigint").alias("sales"),
    )


def track_panel(
    spark: SparkSession, sf_dir: str, track_name: str, grain: str = "brand", with_attributes: bool = False, partitions: int | None = None
) -> DataFrame:
    """A planning track straight from the days with shipments."""
    bounds = _bounds(spark, sf_dir)
    first, last = bounds.select("d0").scalar(), bounds.select("d1").scalar()
    return prepare_sparse_track(sold_daily(spark, sf_dir, grain), track_name, first, last, with_attributes, partitions)


def series_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for a panel whose series grow with the lines: a line makes at most one row before gaps are
    filled, and one series at most. The lines are counted from the footers."""
    return max(shuffle_partitions(spark), math.ceil(table(spark, sf_dir, "lineitem").count() / LINES_PER_PARTITION))


def prices(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """Lowest net unit price per (store, item, price week); does not depend on row order."""
    unit = F.try_divide(
        F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount")), F.col("l_quantity")
    )
    return (
        sold(spark, sf_dir, grain)
        .groupBy("store_id", "item_id", _price_week(F.col("date")).alias("wm_yr_wk"))
        .agg(F.min(unit).alias("sell_price"))
    )


def sales_wide(spark: SparkSession, sf_dir: str, grain: str = "brand") -> DataFrame:
    """The daily panel as one row per series and one integer column per day.

    The rows of a series are sorted into one array (one element per calendar day) and the array is
    spread over the columns, which scales better than a pivot over ~2,500 values.
    """
    n_days = _bounds(spark, sf_dir).select((F.datediff("d1", "d0") + 1).alias("n")).first()["n"]
    ids = list(ID_COLUMNS)
    series = (
        daily_sales(spark, sf_dir, grain)
        .groupBy(*ids)
        .agg(F.array_sort(F.collect_list(F.struct("date", F.col("sales").cast("int").alias("sales")))).alias("_s"))
        .select(*ids, F.transform("_s", lambda s: s["sales"]).alias("_s"))
    )
    # one SQL text per column: thousands of Column objects would be slow to build from Python
    return series.selectExpr(*ids, *[f"_s[{i}] AS d_{i + 1}" for i in range(n_days)])

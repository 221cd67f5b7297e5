"""Exact ranks over any number of rows, without a window that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.sources.storage import cut_lineage, shuffle_partitions

# monotonically_increasing_id: the partition in the upper bits, the row within it in the lower 33
ROW_BITS = 33


def exact_rank(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the row's place from 1 in ``order`` (ties in any order; add a key to settle them) and
    ``<name>_of``, the number of rows, both within ``group``.

    Rows are sorted by range over all tasks. A row's place is its place in its partition plus the rows
    of the group in earlier partitions, which are counted in a table of one row per partition and group.
    """
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    # stored once: range bounds are sampled, and another run could cut elsewhere
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).alias("_part")
    parts = placed.groupBy(*group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select(
        *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_part").alias("_of"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias(f"{name}_of"),
    )
    same = F.shiftright("_at", ROW_BITS) == F.col("_of")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    place = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name)
    return placed.join(parts, same).select(*df.columns, place, f"{name}_of")

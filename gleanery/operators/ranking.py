"""Row numbers within groups without one task per group.

A window function sends each group to one task, which fails when a group holds a third of all rows. Here the rows are range-partitioned
by group and order, so a large group lies across many partitions; the number of a row is its place in its partition plus the sizes of
the group's parts in earlier partitions, and only those sizes (partitions x groups within them) are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import cut


def distributed_row_number(df: DataFrame, groups: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Add `out`, the row number (bigint, from 1) of each row within its group in the given order.

    order must break all ties for a repeatable result. A null group is a group of its own. Empty input, empty result. Rows and columns
    are kept; working columns carry a reserved prefix. The sorted rows are written once to the shared checkpoint folder, so that both
    uses see the same partitions even if an executor is lost.
    """
    keys = [F.col(g) for g in groups]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    kept = cut(placed, "ranked")
    part = F.shiftright(F.col("__at"), 33)
    parts = kept.withColumn("__part", part).groupBy(*groups, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)]
    joined = kept.join(parts, [*same, part == F.col("__p")])
    return joined.withColumn(out, F.col("__at") + F.col("__shift")).drop("__at", "__p", "__shift", *[f"__g{i}" for i in range(len(groups))])

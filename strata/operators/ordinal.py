"""Row ordinals: whole numbers from 0 in the order of a key, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import written


def running_sum(df: DataFrame, order: list, name: str, value: str | None = None, label: str = "ranges") -> DataFrame:
    """df with `name`, the sum of `value` (none: the number of rows) over the rows before each in the given order.

    Rows are range-partitioned by the order and written once: a range exchange samples its borders anew each time it runs, so the sums
    per range and the rows must come from the same copy. A window then runs within each range. The order should be unique for a
    fixed result; a range holds what its share of the rows is, so no task holds more.
    """
    each = F.col(value) if value else F.lit(1)
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    first, total = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.sum(each.cast("long")).alias("s")).collect(), key=lambda r: r["_part"]):  # a row per range
        first.append((r["_part"], total))
        total += r["s"] or 0
    base = df.sparkSession.createDataFrame(first or [(0, 0)], "_part int, _base long")
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(each.cast("long")).over(within), F.lit(0))
    out = ranged.withColumn("_before", before).join(F.broadcast(base), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_before")).drop("_part", "_before", "_base")


def with_ordinal(df: DataFrame, order: list[str], name: str = "_rid", rows_per_part: int = 1 << 20) -> DataFrame:
    """df with `name`. Ranges of the key are numbered apart, and each range starts where the ones before it end.

    order must be unique for a fixed result. A table of one range's size is numbered in one task.
    """
    if df.limit(rows_per_part + 1).count() <= rows_per_part:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return running_sum(df, order, name)


def renumbered(df: DataFrame, name: str = "_rid") -> DataFrame:
    """The ordinals closed up after rows were removed or put in, order kept."""
    return with_ordinal(df.withColumnRenamed(name, "_old"), ["_old"], name).drop("_old")

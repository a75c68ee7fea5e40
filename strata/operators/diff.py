"""Diff and intersect by key or by position.

All forms are one equi-join on the key, so Spark shuffles each side once (or not at all if both are bucketed by it) and
adaptive execution splits skewed keys. Values are compared null-safely: a null value differs from a missing key by
`in_lhs` and `in_rhs`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.ordinal import with_ordinal


def _differs(values: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"l.{v}").eqNullSafe(F.col(f"r.{v}")) for v in values], F.lit(False))


def _on(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])


def dual_diff(lhs: DataFrame, rhs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose values differ or that one side lacks: keys, lhs_<v>, rhs_<v>, in_lhs, in_rhs."""
    left, right = (d.select(*keys, *values, F.lit(True).alias("_in")).alias(a) for d, a in ((lhs, "l"), (rhs, "r")))
    both = left.join(right, _on(keys), "full_outer")
    changed = both.where(F.col("l._in").isNull() | F.col("r._in").isNull() | _differs(values))
    return changed.select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys],
        *[F.col(f"l.{v}").alias(f"lhs_{v}") for v in values],
        *[F.col(f"r.{v}").alias(f"rhs_{v}") for v in values],
        F.col("l._in").isNotNull().alias("in_lhs"),
        F.col("r._in").isNotNull().alias("in_rhs"),
    )


def map_diff(lhs: DataFrame, rhs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of lhs whose key and values are not in rhs."""
    left, right = lhs.select(*keys, *values).alias("l"), rhs.select(*keys, *values).alias("r")
    return left.join(right, _on(keys) & ~_differs(values), "left_anti")


def map_intersect(lhs: DataFrame, rhs: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of lhs with an equal key and equal values in rhs."""
    left, right = lhs.select(*keys, *values).alias("l"), rhs.select(*keys, *values).alias("r")
    return left.join(right, _on(keys) & ~_differs(values), "left_semi")


def set_diff(lhs: DataFrame, rhs: DataFrame, keys: list[str]) -> DataFrame:
    return lhs.select(*keys).distinct().join(rhs.select(*keys), keys, "left_anti")


def set_intersect(lhs: DataFrame, rhs: DataFrame, keys: list[str]) -> DataFrame:
    return lhs.select(*keys).distinct().join(rhs.select(*keys), keys, "left_semi")


def list_diff(lhs: DataFrame, rhs: DataFrame, value: str, idx: str = "_rid") -> DataFrame:
    """Positions of lhs whose element rhs hasn't at that position."""
    return map_diff(lhs, rhs, [idx], [value])


def list_intersect(lhs: DataFrame, rhs: DataFrame, value: str, idx: str = "_rid") -> DataFrame:
    return map_intersect(lhs, rhs, [idx], [value])


def pruned_dual_diff(lhs: DataFrame, rhs: DataFrame, keys: list[str], values: list[str], lhs_hashes: DataFrame, rhs_hashes: DataFrame, bucket: Column) -> DataFrame:
    """dual_diff, over buckets whose stored hashes differ only. hashes: (bucket, hash); bucket: of a row, as the hashes have it.

    Where tables are partitioned by bucket, buckets of equal content are never read.
    """
    both = lhs_hashes.select("bucket", F.col("hash").alias("a")).join(rhs_hashes.select("bucket", F.col("hash").alias("b")), "bucket", "full_outer")
    changed = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")
    keep = lambda d: d.withColumn("bucket", bucket).join(F.broadcast(changed), "bucket", "left_semi").drop("bucket")  # noqa: E731  # at most as many rows as buckets
    return dual_diff(keep(lhs), keep(rhs), keys, values)


def ranges(positions: DataFrame, idx: str = "_rid") -> DataFrame:
    """Positions as maximal runs: first, n."""
    numbered = with_ordinal(positions.select(F.col(idx).alias("i")).distinct(), ["i"], "_n")
    return numbered.groupBy((F.col("i") - F.col("_n")).alias("g")).agg(F.min("i").alias("first"), F.count("*").alias("n")).select("first", "n")

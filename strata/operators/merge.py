"""Three-way merge of keyed rows.

mode 'key': a conflict is a key that both sides changed to different values. mode 'region': both sides' edits are joined
to runs of neighbouring base keys, and runs of both sides that overlap without being the same edits are a conflict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.ordinal import running_sum


def _side(df: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    value = F.struct(*[F.col(v) for v in values]) if values else F.struct(F.lit(1))
    return df.select(*keys, value.alias(name), F.lit(True).alias(f"in_{name}"))


def _three(base: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """All keys with the three values and what each side did."""
    rows = _side(base, keys, values, "v0").join(_side(a, keys, values, "v1"), keys, "full_outer").join(_side(b, keys, values, "v2"), keys, "full_outer")
    there = lambda n: F.col(f"in_{n}").isNotNull()
    changed = lambda n: (there(n) != there("v0")) | (there(n) & ~F.col(n).eqNullSafe(F.col("v0")))
    same = (there("v1") == there("v2")) & F.col("v1").eqNullSafe(F.col("v2"))
    return rows.withColumn("c1", changed("v1")).withColumn("c2", changed("v2")).withColumn("same", same)


def conflicts(base: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that both sides changed to different values: keys, base_/a_/b_ values."""
    rows = _three(base, a, b, keys, values).where(F.col("c1") & F.col("c2") & ~F.col("same"))
    out: list[Column] = [F.col(k) for k in keys]
    for s, n in (("v0", "base"), ("v1", "a"), ("v2", "b")):
        out += [F.col(f"{s}.{v}").alias(f"{n}_{v}") for v in values]
    return rows.select(*out)


def merge3(base: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], values: list[str], prefer: str | None = None) -> DataFrame:
    """The merged rows. Keys in conflict are left out unless `prefer` is 'a' or 'b'; conflicts() lists them."""
    rows = _three(base, a, b, keys, values)
    clash = F.col("c1") & F.col("c2") & ~F.col("same")
    if prefer is None:
        rows = rows.where(~clash)
    use_b = F.col("c2") & (~F.col("c1") if prefer != "b" else F.lit(True))
    there = F.when(use_b, F.col("in_v2")).otherwise(F.col("in_v1"))
    value = F.when(use_b, F.col("v2")).otherwise(F.col("v1"))
    kept = rows.where(there).withColumn("_v", value)
    return kept.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def set_merge3(base: DataFrame, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sets have no values, so no key conflicts: what either side put in or took out holds."""
    return merge3(base.distinct(), a.distinct(), b.distinct(), keys, [])


def region_conflicts(base: DataFrame, a: DataFrame, b: DataFrame, key: str, values: list[str], group: list[str] | None = None) -> DataFrame:
    """Runs of neighbouring changed keys in which both sides have edits that aren't the same: group, first_key, last_key.

    Keys of `base` and of both sides are put in one order per `group` (an object); a key new to the base stands next to the base
    key before it. The order is kept in ranges, so that no task holds an object.
    """
    group = group or []
    rows = _three(base, a, b, [*group, key], values).withColumn("changed", F.col("c1") | F.col("c2"))
    slim = rows.select(*group, key, "changed", "c1", "c2", "same", F.when(F.col("changed"), 0).otherwise(1).alias("_still"))
    rows = running_sum(slim, [*group, key], "run", "_still")  # rows between which none is unchanged have one number
    runs = rows.where("changed").groupBy(*group, "run").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max(F.col("c1").cast("int")).alias("x"), F.max(F.col("c2").cast("int")).alias("y"), F.min((F.col("c1") & F.col("c2") & F.col("same")).cast("int")).alias("same")
    )
    return runs.where("x = 1 AND y = 1 AND same = 0").select(*group, "first_key", "last_key")

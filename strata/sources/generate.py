"""Generated tables. Values come from hashes of the row number and a seed, so every run gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(n: int, seed: int):
    parts = [F.sha2(F.concat_ws(":", F.lit(seed), F.lit(i), F.col("id").cast("string")), 256) for i in range(-(-n // 64))]
    return F.substring(F.concat(*parts), 1, n)


def update_table(spark: SparkSession, n: int, n_refs: int, seed: int = 1) -> DataFrame:
    """_rid, ID, Name, UpdateBy (equal in consecutive rows), AggregateBy (1 to 20), UpdateOn, all text."""
    per = max(1, n // max(1, n_refs))
    size = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(32)) + 1
    group = F.least(F.floor(F.col("id") / per), F.lit(n_refs - 1))
    return spark.range(n).select(
        F.col("id").alias("_rid"),
        F.lpad(F.col("id").cast("string"), 12, "0").alias("ID"),
        F.substr(_text(32, seed + 1), F.lit(1), size.cast("int")).alias("Name"),
        F.lpad(F.conv(group.cast("string"), 10, 36), 12, "0").alias("UpdateBy"),
        (F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(20)) + 1).cast("string").alias("AggregateBy"),
        _text(128, seed + 3).alias("UpdateOn"),
    )


def sample_keys(keys: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n of keys (pos, key), in their own order: a sampling operator."""
    picked = keys.orderBy(F.xxhash64("key", F.lit(seed)), "pos").limit(n)
    return picked.orderBy("pos")


def analytics_table(spark: SparkSession, n: int, n_cols: int) -> DataFrame:
    """_rid, Key = K_i, Col-j = j_i."""
    i = F.col("id").cast("string")
    return spark.range(n).select(F.col("id").alias("_rid"), F.concat(F.lit("K_"), i).alias("Key"), *[F.concat(F.lit(f"{j}_"), i).alias(f"Col-{j}") for j in range(n_cols)])

"""Counts over columns, branches and storage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.diff import dual_diff


def count_where(df: DataFrame, col: str, value: float = 1) -> DataFrame:
    """matches (cells whose number equals value) and total."""
    hit = F.col(col).try_cast("double") == value
    return df.agg(F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("long").alias("matches"), F.count("*").alias("total"))


def diff_count(lhs: DataFrame, rhs: DataFrame, col: str, idx: str = "_rid") -> DataFrame:
    """The number of positions at which a column differs."""
    return dual_diff(lhs, rhs, [idx], [col]).agg(F.count("*").alias("n_diff"))


def zip_average(a: DataFrame, b: DataFrame, idx: str = "_rid") -> DataFrame:
    """idx, average: (a + b) / 2 of whole numbers in step, cut to a whole number. a, b: (idx, v)."""
    both = a.select(idx, F.col("v").alias("a")).join(b.select(idx, F.col("v").alias("b")), idx)
    return both.select(idx, ((F.col("a") + F.col("b")) / 2).cast("long").alias("average"))


def storage_info(segments: DataFrame, kind: str = "kind", size: str = "bytes") -> DataFrame:
    """kind, n_chunks, n_bytes per kind, and with kind 'ALL' in total."""
    out = segments.rollup(kind).agg(F.count("*").alias("n_chunks"), F.sum(size).alias("n_bytes"), F.grouping(kind).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(kind)).alias("kind"), "n_chunks", "n_bytes")


def dedup_increment(before: DataFrame, after: DataFrame, digest: str = "hash", size: str = "bytes") -> DataFrame:
    """What `after` adds to storage that holds `before`: segments whose hash isn't there yet, each once."""
    fresh = after.groupBy(digest).agg(F.max(size).alias("b")).join(before.select(digest), digest, "left_anti")
    return fresh.agg(F.count("*").alias("new_chunks"), F.coalesce(F.sum("b"), F.lit(0)).alias("new_bytes"))


def histogram(spark, n: int, iterations: int, p: float, kind: str = "poisson", seed: int = 1) -> DataFrame:
    """bucket, distr: how often each of n buckets is drawn in `iterations` draws, by inverse distribution.

    The distribution has one row per bucket up to n; draws beyond are dropped. Draws are hashed from the seed: runs agree.
    """
    mean, trials = n * p, n - 1
    rows, total = [], 0.0
    for k in range(n):
        if kind == "poisson":
            log_q = -mean + k * math.log(mean) - math.lgamma(k + 1)
        else:
            log_q = math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p)
        low, total = total, total + math.exp(log_q)
        rows.append((k, low, total))
    table = spark.createDataFrame(rows, "bucket int, low double, high double")
    draws = spark.range(iterations).select(((F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)).alias("x"))
    hits = draws.join(F.broadcast(table), (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).groupBy("bucket").agg(F.count("*").alias("c"))  # n rows, a parameter
    return table.select("bucket").join(hits, "bucket", "left").select("bucket", F.coalesce("c", F.lit(0)).alias("distr"))

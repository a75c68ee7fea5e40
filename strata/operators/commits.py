"""Versions and branches as plain tables.

commits: key, version, parent1, parent2 (null for none), any more columns. heads: key, branch, version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.runtime import remove_written, written


def list_keys(commits: DataFrame) -> DataFrame:
    return commits.select("key").distinct()


def list_branches(heads: DataFrame, key: object) -> DataFrame:
    return heads.where(F.col("key") == F.lit(key)).select("branch").orderBy("branch")


def branch_heads(log: DataFrame, order: list[str]) -> DataFrame:
    """heads from a log of puts (key, branch, version, order...): the last put of each branch, by map-side aggregation."""
    last = F.max(F.struct(*order, "version")).alias("_last")
    return log.groupBy("key", "branch").agg(last).select("key", "branch", "_last.version")


def get_branch(commits: DataFrame, heads: DataFrame, key: object, branch: object) -> DataFrame:
    """The commit at the head of a branch. Both filters reach the scans."""
    head = heads.where((F.col("key") == F.lit(key)) & (F.col("branch") == F.lit(branch))).select("version")
    return commits.where(F.col("key") == F.lit(key)).join(head, "version", "left_semi")


def get_version(commits: DataFrame, key: object, version: object) -> DataFrame:
    return commits.where((F.col("key") == F.lit(key)) & (F.col("version") == F.lit(version)))


def latest_versions(commits: DataFrame) -> DataFrame:
    """Versions that are nobody's parent: the leaves of the commit graph."""
    parents = commits.select("key", F.explode(F.array_compact(F.array("parent1", "parent2"))).alias("version"))
    return commits.join(parents.distinct(), ["key", "version"], "left_anti")


def is_branch_head(heads: DataFrame, versions: DataFrame) -> DataFrame:
    """versions (key, branch, version) with is_head."""
    marked = heads.select("key", "branch", "version", F.lit(True).alias("_h"))
    return versions.join(marked, ["key", "branch", "version"], "left").withColumn("is_head", F.col("_h").isNotNull()).drop("_h")


def exists_keys(commits: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (key) with `found`; a key lives on when all its branches are gone."""
    return keys.join(commits.select("key").distinct().withColumn("_k", F.lit(True)), "key", "left").select("key", F.col("_k").isNotNull().alias("found"))


def fork(heads: DataFrame, old: str, new: str) -> DataFrame:
    """heads with `new` at the head of `old` for every key that has `old` and not `new`; no data is copied."""
    have = heads.where(F.col("branch") == new).select("key")
    made = heads.where(F.col("branch") == old).join(have, "key", "left_anti").withColumn("branch", F.lit(new))
    return heads.unionByName(made)


def rename(heads: DataFrame, old: str, new: str) -> DataFrame:
    have = heads.where(F.col("branch") == new).select("key").distinct().withColumn("_n", F.lit(True))
    moved = F.when((F.col("branch") == old) & F.col("_n").isNull(), F.lit(new)).otherwise(F.col("branch"))
    return heads.join(have, "key", "left").withColumn("branch", moved).drop("_n")


def delete_branch(heads: DataFrame, branch: str) -> DataFrame:
    return heads.where(F.col("branch") != branch)


def merge_commits(heads: DataFrame, target: str, ref: str) -> DataFrame:
    """key, parent1 (head of target), parent2 (head of ref) of the merge commits of every key that has both branches."""
    t = heads.where(F.col("branch") == target).select("key", F.col("version").alias("parent1"))
    return t.join(heads.where(F.col("branch") == ref).select("key", F.col("version").alias("parent2")), "key")


def ancestry(commits: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """key, version, distance of all ancestors of start (key, version), start included at 0, none further than `depth`.

    Paths double in each round: with the ancestors nearer than 2^k known, and for every commit those just 2^k steps up, one
    join gives the ancestors nearer than 2^(k+1). So rounds grow with the logarithm of the history's depth. Each round is written
    to the shared folder, so a long history doesn't make a long plan. A graph with a cycle is an error.
    """
    own = start.select("key").distinct()
    parents = F.explode(F.array_compact(F.array("parent1", "parent2"))).alias("up")
    jump = written(commits.select("key", "version", parents).distinct().join(own, "key", "left_semi"), "ancestry")
    found = written(start.select("key", "version").distinct().withColumn("distance", F.lit(0)), "ancestry")
    most, step = None, 1
    while (depth is None or step <= depth) and not jump.isEmpty():
        most = commits.count() if most is None else most
        if step > most:
            raise StrataError(Code.INVALID_PARAMETER, "the commit graph has a cycle")
        further = found.join(jump, ["key", "version"]).select("key", F.col("up").alias("version"), (F.col("distance") + step).alias("distance"))
        nearer, longer = found, jump
        found = written(found.unionByName(further).groupBy("key", "version").agg(F.min("distance").alias("distance")), "ancestry")
        again = jump.select("key", F.col("version").alias("up"), F.col("up").alias("top"))
        jump = written(jump.join(again, ["key", "up"]).select("key", "version", F.col("top").alias("up")).distinct(), "ancestry")
        remove_written(nearer)
        remove_written(longer)
        step *= 2
    return found if depth is None else found.where(F.col("distance") <= depth)

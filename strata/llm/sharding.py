"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitioning, overfull ranges subdivided.

Records are ordered by (xxhash64 of the group column, doc_id, hash of file and row number), so records of one group lie together. A first pass draws a
size-weighted sample of keys (its expected size is a parameter, not a share of the data) and takes splitters at its
quantiles; a group that outweighs a range is split by doc_id and row, a smaller one stays whole. The exact size of each range is
then measured, and ranges above twice the aim are subdivided by splitters from a new sample of those ranges alone, until
none is left that can be divided. Consecutive ranges are dealt to shards by their exact running size.

Only the splitters, one row per range and never rows of data, reach the driver. Positions within a shard come from
a window per range plus the range's offset, so no task holds a shard.

Defined results: sizes count UTF-8 bytes of the text plus 1, a null text counts 0 bytes. A null doc_id sorts first in its
group. Repeated rows are records of their own and are spread like others: their place in the input's files parts them. Fewer
records than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import row_key, scratch, ship, stable, written

LEAST = -(2**63)
_PREFIX = "_shard_"


def _unit(*cols: Column | str, seed: int) -> Column:
    """A number in [0, 1) from a hash: the same draw in every run."""
    return (F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


Key = tuple[int, int, int]


def _quantile_splitters(keys: list[tuple[int, int, int, float]], aim: float) -> list[Key]:
    """Ends of ranges of about `aim` sampled size, at group borders unless one group outweighs the aim."""
    out, run, at = [], 0.0, 0
    while at < len(keys):
        end = at
        while end < len(keys) and keys[end][0] == keys[at][0]:
            end += 1
        size = sum(k[3] for k in keys[at:end])
        if size > aim:
            if run:
                out.append((keys[at][0], LEAST, LEAST))
            part = 0.0
            for h, i, t, w in keys[at:end]:
                part += w
                if part >= aim:
                    out.append((h, i, t))
                    part = 0.0
            run = part
        else:
            if run and run + size / 2 > aim:
                out.append((keys[at][0], LEAST, LEAST))
                run = 0.0
            run += size
        at = end
    return sorted(set(out))


def _range_of(splitters: list[Key]):
    """A function of (h, i, t): the number of splitters at or below it."""
    own = np.array(splitters, np.int64).reshape(-1, 3)

    @F.pandas_udf("long")
    def rng(h: pd.Series, i: pd.Series, t: pd.Series) -> pd.Series:
        h, i, t = h.to_numpy(), i.to_numpy(), t.to_numpy()
        lo, hi = np.searchsorted(own[:, 0], h, side="left"), np.searchsorted(own[:, 0], h, side="right")
        out = hi.astype(np.int64)
        inside = np.flatnonzero(hi > lo)  # only groups that a splitter names
        for g in np.unique(lo[inside]):
            rows = inside[lo[inside] == g]
            cuts = own[g : hi[rows[0]], 1:]
            names = np.zeros(len(cuts) + len(rows), [("i", np.int64), ("t", np.int64), ("k", np.int8)])
            names["i"], names["t"], names["k"] = np.concatenate([cuts[:, 0], i[rows]]), np.concatenate([cuts[:, 1], t[rows]]), np.repeat([0, 1], [len(cuts), len(rows)])
            order = np.argsort(names, order=("i", "t", "k"), kind="stable")
            below = np.empty(len(names), np.int64)
            below[order] = np.cumsum(names["k"][order] == 0)
            out[rows] = g + below[len(cuts) :]
        return pd.Series(out)

    return rng


def _keyed(docs: DataFrame, group_col: str) -> list[Column]:
    """h, i, t and size of the rows of stable(docs)."""
    row = row_key()
    return [
        F.xxhash64(F.col(group_col)).alias(f"{_PREFIX}h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias(f"{_PREFIX}i"),
        F.xxhash64(row["f"], row["n"]).alias(f"{_PREFIX}t"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias(f"{_PREFIX}size"),
    ]


class Plan:
    """Splitters, and for each range its shard and the number of records of that shard before it. docs: the rows it is made for."""

    def __init__(self, docs: DataFrame, splitters: list[Key], places: list[tuple[int, int, int]], group_col: str):
        self.docs, self.splitters, self.places, self.group_col = docs, splitters, places, group_col

    def place(self, columns: list[Column] | None = None) -> DataFrame:
        """The rows (or columns made of them) with `shard` and `slot`, columns of that name replaced. Rows move once, to a task per range."""
        h, i, t, size, r = (F.col(f"{_PREFIX}{c}") for c in ("h", "i", "t", "size", "r"))
        kept = columns or [F.col(f"`{c}`") for c in self.docs.columns if c not in ("shard", "slot")]
        keyed = self.docs.select(*kept, *_keyed(self.docs, self.group_col))
        names = [c for c in keyed.columns if not c.startswith(_PREFIX)]
        rows = keyed.withColumn(f"{_PREFIX}r", _range_of(self.splitters)(h, i, t))
        within = F.row_number().over(Window.partitionBy(r).orderBy(h, i, t)) - 1
        places = self.docs.sparkSession.createDataFrame(self.places, f"{_PREFIX}r long, {_PREFIX}shard int, {_PREFIX}first long")
        placed = rows.withColumn(f"{_PREFIX}n", within).join(F.broadcast(places), f"{_PREFIX}r", "left")  # a row per range
        shard = F.coalesce(F.col(f"{_PREFIX}shard"), F.raise_error(F.lit("a range without a place: the input has changed since the plan was made")).cast("int"))
        return placed.select(*[F.col(f"`{c}`") for c in names], shard.alias("shard"), (F.col(f"{_PREFIX}first") + F.col(f"{_PREFIX}n")).alias("slot"))


def shard_plan(docs: DataFrame, n_shards: int = 8, group_col: str = "text", ranges_per_shard: int = 64, samples_per_range: int = 32, range_bytes: int = 1 << 30, seed: int = 7) -> Plan:
    """Ranges number n_shards * ranges_per_shard, more if a range would pass range_bytes.

    What the driver holds is samples_per_range keys and one row for each range: 100 TB make 100,000 ranges and 3 million keys, in arrays.
    """
    ship(docs.sparkSession)
    docs = stable(docs)
    rows = docs.select(*[c.alias(n) for c, n in zip(_keyed(docs, group_col), ("h", "i", "t", "size"), strict=True)])
    rows = written(rows, "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not total:
        return Plan(docs, [], [(0, 0, 0)], group_col)
    n_ranges = max(n_shards * ranges_per_shard, math.ceil(total / range_bytes))
    aim = max(1.0, total / n_ranges)
    rate = n_ranges * samples_per_range / total

    def sample(frame: DataFrame, rate: float, seed: int, rows_apart: bool) -> list[tuple[int, int, int, float]]:
        """Keys drawn by size: by (h, i) alike wherever rows lie, rows that repeat a key as one; or row by row."""
        weight = F.greatest(F.col("size").cast("double"), F.lit(1 / rate))
        by = ["h", "i", "t"] if rows_apart else ["h", "i"]
        drawn = frame.where(_unit(*by, seed=seed) < F.col("size") * F.lit(rate)).groupBy(*by).agg(F.sum(weight).alias("w")).toPandas().sort_values(by)
        t = drawn["t"].tolist() if rows_apart else itertools.repeat(LEAST, len(drawn))
        return list(zip(drawn["h"].tolist(), drawn["i"].tolist(), t, drawn["w"].tolist(), strict=True))

    splitters, rows_apart = _quantile_splitters(sample(rows, rate, seed, False), aim), False
    for again in itertools.count():  # ends: splitters grow each round and are keys of records
        ranged = rows.withColumn("r", _range_of(splitters)("h", "i", "t"))
        per = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("h") != F.max("h")) | (F.min("i") != F.max("i")) | (F.min("t") != F.max("t")), F.max("size")).collect()
        over = [r[0] for r in per if r[3] and r[1] > 2 * aim and r[1] > 1.5 * r[4]]
        if not over:
            break
        wanted = docs.sparkSession.createDataFrame([(g,) for g in over], "r long")
        inside = ranged.join(F.broadcast(wanted), "r", "left_semi")  # fewer rows than ranges
        more = _quantile_splitters(sample(inside, 4 * rate, seed + 1 + again, rows_apart), aim)
        if set(more) <= set(splitters):
            if rows_apart:
                break
            rows_apart = True  # what is left are keys that many rows repeat
            continue
        splitters = sorted(set(more) | set(splitters))
    places, before, taken = [], 0, [0] * n_shards
    for g, size, count, *_ in sorted(per, key=lambda r: r[0]):
        shard = min(n_shards - 1, int((before + size / 2) * n_shards / total))
        places.append((g, shard, taken[shard]))
        taken[shard] += count
        before += size
    return Plan(docs, splitters, places, group_col)


@scratch
def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """docs with `shard` and `slot`, for writing with partitionBy("shard")."""
    return shard_plan(docs, n_shards).place()


@scratch
def shard_digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The shard of every document under the law `bytes`."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")
    placed = shard_plan(docs, n_shards).place([F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).cast("long").alias("text_crc32"), size])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

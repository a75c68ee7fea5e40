"""Edits of lists, maps, sets and blobs: as column expressions for small values, as joins for large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.operators.ordinal import with_ordinal

# --- values in a column -------------------------------------------------------------------------------------------


def list_get(a: Column, i: int) -> Column:
    """The element at a 0-based position, null if there is none."""
    return F.try_element_at(a, F.lit(i + 1)) if i >= 0 else F.lit(None)


def list_splice(a: Column, start: int, dels: int, ins: Column) -> Column:
    """dels elements from start on replaced by ins; what goes beyond the end is clipped."""
    n = F.size(a)
    at = F.least(F.lit(start), n)
    rest = F.least(at + dels, n)
    return F.concat(F.slice(a, F.lit(1), at), ins, F.slice(a, rest + 1, n - rest))


def list_insert(a: Column, start: int, ins: Column) -> Column:
    return list_splice(a, start, 0, ins)


def list_delete(a: Column, start: int, dels: int) -> Column:
    return list_splice(a, start, dels, F.slice(a, 1, 0))


def list_append(a: Column, ins: Column) -> Column:
    return F.concat(a, ins)


def map_set(m: Column, k: Column, v: Column) -> Column:
    """k set to v; other keys kept. Needs no map conf: the key is taken out first."""
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def map_multi_set(m: Column, other: Column) -> Column:
    """All of `other` set in m."""
    return F.map_concat(F.map_filter(m, lambda x, _: ~F.map_contains_key(other, x)), other)


def map_remove(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def set_insert(a: Column, x: Column) -> Column:
    return F.sort_array(F.array_union(a, F.array(x)))


def set_remove(a: Column, x: Column) -> Column:
    return F.sort_array(F.array_distinct(F.array_remove(a, x)))


def blob_read(b: Column, pos: int, length: int) -> Column:
    """Bytes from pos on, at most length; none beyond the end."""
    return F.substring(b, pos + 1, length)


def blob_splice(b: Column, pos: int, dels: int, ins: Column) -> Column:
    """dels bytes from pos on replaced by ins; what goes beyond the end is clipped."""
    tail = F.substr(b, F.lit(pos + dels + 1), F.greatest(F.octet_length(b) - (pos + dels), F.lit(0)))
    return F.concat(F.substr(b, F.lit(1), F.lit(pos)), ins, tail)


# --- values in rows -----------------------------------------------------------------------------------------------


def rows_map_set(df: DataFrame, edits: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Upsert of edits by key; of edits that repeat a key the last by `order` holds, without it the greatest row."""
    rest = [c for c in df.columns if c != key]
    last = F.max(F.struct(*([order] if order else []), *rest)).alias("_l")
    edits = edits.groupBy(key).agg(last).select(key, *[F.col(f"_l.`{c}`").alias(c) for c in rest])
    return df.join(edits.select(key), key, "left_anti").unionByName(edits.select(*df.columns))


def rows_map_remove(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def rows_list_splice(df: DataFrame, start: int, dels: int, ins: DataFrame, idx: str = "_rid") -> DataFrame:
    """The long form of list_splice: positions after the cut are moved, nothing is sorted. ins has positions from 0.

    Beyond the end ins follows the last element. One small job finds both lengths.
    """
    n, k = df.count(), ins.count()
    start = min(start, n)
    end = min(start + dels, n)
    head = df.where(F.col(idx) < start)
    tail = df.where(F.col(idx) >= end).withColumn(idx, F.col(idx) + (k - (end - start)))
    return head.unionByName(ins.withColumn(idx, F.col(idx) + start)).unionByName(tail)


def rows_multi_splice(df: DataFrame, splices: DataFrame, ins: DataFrame, idx: str = "_rid") -> DataFrame:
    """Many splices in one step. splices: (seq, start, dels), places of the list as it is; ins: (seq, pos, the list's columns).

    Splices at one place put their elements there in the order of seq. Splices that cut the same elements, or into what another cuts,
    are an error. Beyond the end elements follow the last. What is cut is an anti-join, the rest one renumbering by ranges.
    """
    w = Window.orderBy("start", "seq")  # over splices, not rows
    overlap = splices.withColumn("_end", F.max(F.col("start") + F.col("dels")).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("_end") > F.col("start"))
    bad = overlap.limit(1).collect()
    if bad:
        raise StrataError(Code.INVALID_PARAMETER, f"splices overlap at {bad[0]['start']}")
    cut = splices.where("dels > 0").select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("dels") - 1)).alias(idx))
    values = [c for c in df.columns if c != idx]
    none = F.lit(0).cast("long")
    kept = df.join(cut, idx, "left_anti").select(F.col(idx).alias("_at"), F.lit(1).alias("_kind"), none.alias("_seq"), none.alias("_pos"), *values)
    put = ins.join(splices.select("seq", "start"), "seq").select(F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").cast("long").alias("_seq"), F.col("pos").cast("long").alias("_pos"), *values)
    return with_ordinal(kept.unionByName(put), ["_at", "_kind", "_seq", "_pos"], idx).select(*df.columns)


def rows_list_append(df: DataFrame, more: DataFrame, idx: str = "_rid") -> DataFrame:
    return rows_list_splice(df, 2**62, 0, more, idx)


def distinct_violations(given: DataFrame, existing: DataFrame, value: str) -> DataFrame:
    """Values that the input repeats or that are there already: value, times, exists."""
    counts = given.groupBy(value).agg(F.count("*").alias("times"))
    there = existing.select(value).distinct().withColumn("_there", F.lit(True))
    return counts.join(there, value, "left").where((F.col("times") > 1) | F.col("_there").isNotNull()).select(value, "times", F.col("_there").isNotNull().alias("exists"))

"""Datasets: named entries (entry, version, content hash, payload) and selections of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.functions.hashing import content_hash
from strata.functions.text import entry_name, regularize_csv, split_fields


def entries_from_lines(lines: DataFrame, positions: list[int], line: str = "line", no: str = "line_no") -> DataFrame:
    """entry, payload, line_no from CSV lines; the name is the fields at `positions` joined by ^. Lines that repeat a name: the last holds."""
    parts = split_fields(regularize_csv(F.col(line)))
    name = entry_name(*[F.coalesce(F.try_element_at(parts, F.lit(p + 1)), F.lit("")) for p in positions])
    last = F.max(F.struct(F.col(no), F.col(line))).alias("_l")
    return lines.where(F.trim(F.col(line)) != "").select(name.alias("entry"), line, no).groupBy("entry").agg(last).select("entry", F.col(f"_l.{line}").alias("payload"), F.col(f"_l.{no}").alias("line_no"))


def with_hash(entries: DataFrame, payload: str = "payload") -> DataFrame:
    return entries.withColumn("hash", content_hash(F.col(payload)))


def put_entries(ds: DataFrame, entries: DataFrame, order: str | None = None) -> DataFrame:
    """Upsert by entry name. Of entries that repeat a name one holds: the last by `order`, without it the greatest row."""
    rest = [c for c in ds.columns if c != "entry"]
    last = F.max(F.struct(*([order] if order else []), *rest)).alias("_l")
    one = entries.groupBy("entry").agg(last).select("entry", *[F.col(f"_l.`{c}`").alias(c) for c in rest])
    return ds.join(one.select("entry"), "entry", "left_anti").unionByName(one.select(*ds.columns))


def delete_entries(ds: DataFrame, names: DataFrame) -> DataFrame:
    """Entries removed; names that aren't there are left alone."""
    return ds.join(names.select("entry").distinct(), "entry", "left_anti")


def get_entry(ds: DataFrame, name: str) -> DataFrame:
    return ds.where(F.col("entry") == name)


def exists_entries(ds: DataFrame, names: DataFrame) -> DataFrame:
    there = ds.select("entry").distinct().withColumn("_e", F.lit(True))
    return names.join(there, "entry", "left").select("entry", F.col("_e").isNotNull().alias("found"))


def select_entries(ds: DataFrame, names: DataFrame, check: bool = True) -> DataFrame:
    """Entries in the order of names (pos, entry), repeats repeated. With `check`, a name that isn't there is an error."""
    if check:
        missing = names.join(ds.select("entry"), "entry", "left_anti").limit(1).collect()
        if missing:
            raise StrataError(Code.ENTRY_NOT_EXISTS, missing[0]["entry"])
    return names.join(ds, "entry").orderBy("pos")


def entry_branches(ds: DataFrame, name: str) -> DataFrame:
    """Branches of a dataset (branch, entry) that hold the entry."""
    return ds.where(F.col("entry") == name).select("branch").distinct()


def diff_dataset(lhs: DataFrame, rhs: DataFrame, by: str = "hash") -> DataFrame:
    """Entries that one side lacks or whose `by` (content hash, or version) differs: entry, lhs, rhs."""
    left, right = lhs.select("entry", F.col(by).alias("lhs")), rhs.select("entry", F.col(by).alias("rhs"))
    return left.join(right, "entry", "full_outer").where(~F.col("lhs").eqNullSafe(F.col("rhs"))).select("entry", "lhs", "rhs")


def export_stats(ds: DataFrame, payload: str = "payload") -> DataFrame:
    """n_entries and n_bytes, a newline after each entry."""
    return ds.agg(F.count("*").alias("n_entries"), F.coalesce(F.sum(F.octet_length(payload).cast("long") + 1), F.lit(0)).alias("n_bytes"))


def dereference(snapshot: DataFrame, objects: DataFrame, version: str = "version") -> DataFrame:
    """A snapshot's versions turned into the objects they name."""
    return snapshot.join(objects, version)


def join_by_entries(names: DataFrame, *datasets: DataFrame) -> list[DataFrame]:
    """Of each dataset, the entries with those names. names may be large; Spark broadcasts it only below its threshold."""
    keys = names.select("entry").distinct()
    return [ds.join(keys, "entry", "left_semi") for ds in datasets]


def meta_value(meta: DataFrame, obj: str, branch: str, name: str) -> Column | None:
    row = meta.where((F.col("object") == obj) & (F.col("branch") == branch) & (F.col("k") == name)).select("v").first()
    return row["v"] if row else None

"""Row and column edits of a table with ordinals `_rid`. Each returns a new DataFrame; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.operators.ordinal import renumbered

RID = "_rid"


def _checked(df: DataFrame, cols, exact: bool = False) -> None:
    have = set(df.columns) - {RID}
    if set(cols) - have or (exact and have - set(cols)):
        raise StrataError(Code.INVALID_SCHEMA, ", ".join(sorted(set(cols) ^ have)))


def _column(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise StrataError(Code.COLUMN_NOT_EXISTS, name)


def _values(df: DataFrame, values: Mapping[str, object]) -> dict[str, Column]:
    return {k: (v if isinstance(v, Column) else F.lit(v)).cast(df.schema[k].dataType) for k, v in values.items()}


def get_column(df: DataFrame, col: str) -> DataFrame:
    _column(df, col)
    return df.select(RID, col)


def select_rows(df: DataFrame, col: str, value: object) -> DataFrame:
    """Rows whose column equals value, with their ordinals; the filter reaches the scan."""
    _column(df, col)
    return df.where(F.col(col) == F.lit(value))


def exists_row(df: DataFrame, col: str, value: object) -> bool:
    return not select_rows(df, col, value).limit(1).isEmpty()


def put_column(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Column added or replaced by values (_rid, col). Rows that only one side has stay, with nulls: columns may differ in length."""
    return df.drop(col).join(values.select(RID, col), RID, "full_outer")


def drop_column(df: DataFrame, col: str) -> DataFrame:
    _column(df, col)
    return df.drop(col)


def insert_row(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """One row at the end; it must give all columns and no others."""
    _checked(df, values, exact=True)
    new = df.agg((F.coalesce(F.max(RID), F.lit(-1)) + 1).cast(df.schema[RID].dataType).alias(RID)).select(RID, *[v.alias(k) for k, v in _values(df, values).items()])
    return df.unionByName(new)


def insert_rows_distinct(df: DataFrame, rows: DataFrame, col: str) -> DataFrame:
    """Rows whose `col` isn't in the table yet, put at its end in their own order. rows: the table's columns, `_rid` from 0."""
    fresh = renumbered(rows.join(df.select(col).distinct(), col, "left_anti"))
    top = df.agg((F.coalesce(F.max(RID), F.lit(-1)) + 1).alias("_top"))
    return df.unionByName(fresh.join(F.broadcast(top)).withColumn(RID, F.col(RID) + F.col("_top")).drop("_top"))  # one row


def insert_row_distinct(df: DataFrame, values: Mapping[str, object], col: str) -> DataFrame:
    if exists_row(df, col, values[col]):
        raise StrataError(Code.ROW_EXISTS, str(values[col]))
    return insert_row(df, values)


def update_where(df: DataFrame, cond: Column, values: Mapping[str, object]) -> DataFrame:
    _checked(df, values)
    return df.withColumns({k: F.when(cond, v).otherwise(F.col(k)) for k, v in _values(df, values).items()})


def update_row(df: DataFrame, rid: int, values: Mapping[str, object]) -> DataFrame:
    if rid < 0 or df.where(F.col(RID) == rid).isEmpty():
        raise StrataError(Code.INDEX_OUT_OF_RANGE, str(rid))
    return update_where(df, F.col(RID) == rid, values)


def update_rows(df: DataFrame, col: str, value: object, values: Mapping[str, object]) -> tuple[DataFrame, int]:
    """All rows whose column equals value; with the number of rows changed."""
    if not col or value == "":
        raise StrataError(Code.INVALID_PARAMETER)
    n = select_rows(df, col, value).count()
    if not n:
        raise StrataError(Code.ROW_NOT_EXISTS, str(value))
    return update_where(df, F.col(col) == F.lit(value), values), n


def first_run(df: DataFrame, cond: Column) -> DataFrame:
    """first, last: the first run of consecutive ordinals that meet cond. One pass and no sort of the table.

    The run starts at the least such ordinal and ends before the least later one that doesn't meet it.
    """
    start = df.where(cond).agg(F.min(RID).alias("first"))
    miss = df.where(~F.coalesce(cond, F.lit(False))).join(F.broadcast(start), F.col(RID) > F.col("first")).agg(F.min(RID).alias("stop"))
    top = df.agg(F.max(RID).alias("top"))
    one = start.join(F.broadcast(miss)).join(F.broadcast(top))  # single rows
    return one.select("first", F.coalesce(F.col("stop") - 1, F.col("top")).alias("last"))


def update_first_run(df: DataFrame, col: str, value: object, values: Mapping[str, object]) -> DataFrame:
    """Only the first consecutive run of matches is changed."""
    run = first_run(df, F.col(col) == F.lit(value))
    rows = df.join(F.broadcast(run))
    hit = F.coalesce(F.col(RID).between(F.col("first"), F.col("last")), F.lit(False))
    return update_where(rows.withColumn("_hit", hit).drop("first", "last"), F.col("_hit"), values).drop("_hit")


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """Rows that meet cond removed; later rows move up."""
    return renumbered(df.where(~F.coalesce(cond, F.lit(False))))


def delete_row(df: DataFrame, rid: int) -> DataFrame:
    """One row removed: later ordinals go down by one, and nothing is sorted. An index that no row has is an error."""
    if rid < 0 or df.where(F.col(RID) == rid).isEmpty():
        raise StrataError(Code.INDEX_OUT_OF_RANGE, str(rid))
    return df.where(F.col(RID) != rid).withColumn(RID, F.when(F.col(RID) > rid, F.col(RID) - 1).otherwise(F.col(RID)))


def delete_rows(df: DataFrame, col: str, value: object) -> DataFrame:
    return delete_where(df, F.col(col) == F.lit(value))


def stitch(*columns: DataFrame) -> DataFrame:
    """Rows from columns (_rid, value) kept apart, by ordinal; shorter columns give nulls."""
    out = columns[0]
    for c in columns[1:]:
        out = out.join(c, RID, "full_outer")
    return out


def zip_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two columns in step, as far as the shorter goes."""
    return a.join(b, RID)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows by ordinal, each with the number of rows left out: a display limit."""
    rest = df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return df.orderBy(RID).limit(n).join(F.broadcast(rest))


def consecutive_runs(df: DataFrame, cond: Column, group: list[str]) -> DataFrame:
    """group, first, n of every run of consecutive ordinals that meet cond, per object."""
    island = F.col(RID) - F.row_number().over(Window.partitionBy(*group).orderBy(RID))
    return df.where(cond).select(*group, RID, island.alias("_g")).groupBy(*group, "_g").agg(F.min(RID).alias("first"), F.count("*").alias("n")).drop("_g")

"""Tables and datasets from CSV lines and back. Cells are text; blank lines are skipped; short rows are filled with ''."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.functions.text import regularize_csv, replace_space, split_fields
from strata.operators import dataset
from strata.operators.ordinal import with_ordinal


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, pos of the non-blank lines of a file or folder, trimmed; pos orders them as they stand, by file and place.

    Spark reads a text file's blocks in order; partition and position within it give that order without a sort.
    """
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m")).alias("pos")
    return spark.read.text(path).select(F.trim(F.col("value")).alias("line"), place).where("line <> ''")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, line_no of the non-blank lines of a file or folder, in file order, trimmed."""
    return with_ordinal(ordered_lines(spark, path), ["pos"], "line_no").select("line", "line_no")


def infer_header(header: str) -> tuple[list[str], str]:
    """Column names and the delimiter: the character after the first name. One column alone has ',' as its delimiter."""
    names = [x for x in re.split(r"[ \t,|]", header.strip()) if x]
    rest = header.strip()[len(names[0]) :] if names else ""
    return names, rest[0] if rest else ","


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """_rid and a text column per header name."""
    lines = numbered_lines(spark, path)
    head = lines.where("line_no = 0").select("line").first()
    if head is None:
        raise StrataError(Code.EMPTY_TABLE, path)
    names, delimiter = infer_header(head["line"])
    parts = split_fields(F.col("line"), delimiter)
    body = lines.where("line_no > 0").withColumn("_p", parts)
    return body.select((F.col("line_no") - 1).alias("_rid"), *[F.coalesce(F.try_element_at("_p", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)])


def dump_lines(df: DataFrame, delimiter: str = "|") -> DataFrame:
    """_rid, line with columns in byte order of name. Rows end where the shortest column does: at the first null cell."""
    cols = sorted((c for c in df.columns if c != "_rid"), key=str.encode)
    short = F.lit(False)
    for c in cols:
        short = short | F.col(f"`{c}`").isNull()
    stop = df.where(short).agg(F.min("_rid").alias("_stop"))
    rows = df.join(F.broadcast(stop)).where("_stop IS NULL OR _rid < _stop")  # one row
    return rows.select("_rid", F.concat_ws(delimiter, *[F.col(f"`{c}`").cast("string") for c in cols]).alias("line"))


def dump_table(df: DataFrame, path: str, delimiter: str = "|") -> None:
    """A folder of text files in row order, the header in the first; parts are ranges of rows, so nothing meets in one task."""
    cols = sorted((c for c in df.columns if c != "_rid"), key=str.encode)
    if df.isEmpty():
        raise StrataError(Code.EMPTY_TABLE, path)
    head = df.sparkSession.createDataFrame([(-1, delimiter.join(cols))], "_rid long, line string")
    head.unionByName(dump_lines(df, delimiter)).orderBy("_rid").select("line").write.text(path)


def load_dataset(spark: SparkSession, path: str, positions: list[int], with_schema: bool = False, indexed: bool = False) -> tuple[DataFrame, str | None, int]:
    """(entries, schema line, lines read). For indexed datasets the first line is the schema, its inner white space made _."""
    lines = ordered_lines(spark, path)
    schema = None
    if with_schema or indexed:
        shown = replace_space(regularize_csv(F.col("line")), "_") if indexed else regularize_csv(F.col("line"))
        row = lines.orderBy("pos").limit(1).select(shown.alias("s"), "pos").first()
        schema = row["s"] if row else None
        if row:
            lines = lines.where(F.col("pos") != F.struct(F.lit(row["pos"]["f"]).alias("f"), F.lit(row["pos"]["m"]).alias("m")))
    return dataset.with_hash(dataset.entries_from_lines(lines, positions, no="pos").select("entry", "payload")), schema, lines.count()


def export_dataset(ds: DataFrame, path: str, schema: str | None = None) -> dict[str, int]:
    """A folder of text files, the schema line first, then payloads in byte order of entry. Returns n_entries and n_bytes."""
    rows = ds.select(F.lit(1).alias("_o"), "entry", "payload")
    if schema is not None:
        rows = ds.sparkSession.createDataFrame([(0, "", schema)], "_o int, entry string, payload string").unionByName(rows)
    rows.orderBy("_o", "entry").select("payload").write.text(path)
    return dataset.export_stats(ds).first().asDict()

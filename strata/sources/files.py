"""Directories as datasets: a file is an entry named by its path within the directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.runtime import filesystem, ship, written


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """entry, payload (binary) of all files below path. Spark's reader lists no empty files; their names are added."""
    root = path.rstrip("/").removeprefix("file://")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.instr("path", root + "/") + len(root) + 1
    out = files.select(F.substr(F.col("path"), at).alias("entry"), F.col("content").alias("payload"))
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    empty = []
    while listed.hasNext():
        f = listed.next()
        if not f.getLen():
            full = f.getPath().toString()
            empty.append((full[full.index(root + "/") + len(root) + 1 :], b""))
    return out.unionByName(spark.createDataFrame(empty, "entry string, payload binary")) if empty else out


def write_directory(ds: DataFrame, uri: str) -> DataFrame:
    """One file per entry below uri, which all executors reach (pyarrow's file systems); runs at once. Returns entry, n_bytes."""
    import pandas as pd

    ship(ds.sparkSession)

    def run(frames):
        fs, root = filesystem(uri)
        for f in frames:
            sizes = []
            for name, payload in zip(f["entry"], f["payload"], strict=True):
                full = f"{root}/{name}"
                fs.create_dir(full.rsplit("/", 1)[0], recursive=True)
                data = bytes(payload or b"")
                with fs.open_output_stream(full) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"entry": f["entry"], "n_bytes": sizes})

    return written(ds.select("entry", F.col("payload").cast("binary").alias("payload")).mapInPandas(run, "entry string, n_bytes long"), "directory")


def chunk_scan(df: DataFrame, payload: str, size: int, *keep: str) -> DataFrame:
    """keep, chunk_no, chunk: payloads in pieces of `size` bytes, by built-in functions."""
    n = F.greatest(F.ceil(F.octet_length(payload) / size), F.lit(1))
    rows = df.select(*keep, F.col(payload).cast("binary").alias("_p"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("chunk_no"))
    return rows.select(*keep, "chunk_no", F.substr("_p", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"))

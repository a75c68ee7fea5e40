"""Session helpers: shipping this package to executors, shared folders, written intermediates."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="strata-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "strata_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a local master may do without the setting (tests); it then gets a folder of its own, removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="strata-shared-")
        atexit.register(shutil.rmtree, _own_dirs[sc.applicationId], True)
    return "file://" + _own_dirs[sc.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strata/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "snappy", batch: int | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: lineage ends there, and a lost executor costs nothing.

    Spark drops the shuffle files of the write as soon as it ends. batch: the rows that Python gets at once, else Spark's setting.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if _scopes:
        _scopes[-1].append(path)
    own = {_DROP_SHUFFLES: "true"} | ({_BATCH: str(batch)} if batch else {})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """run, a function for mapInArrow, whose worker gives the memory it took back when a task ends. Spark keeps idle workers, and malloc and Arrow keep what was freed."""

    def each(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # glibc's alone
            ctypes.CDLL(None).malloc_trim(0)

    return each


def scratch(f):
    """For a function that returns a DataFrame: what it wrote on the way goes when it returns, but for what the result still reads."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        _scopes.append([])
        try:
            out = f(*args, **kwargs)
            used = {x.rsplit("/", 2)[1] for x in out.inputFiles()}
        finally:
            own = _scopes.pop()
        for path in own:
            if path.rsplit("/", 1)[1] not in used:
                remove(out.sparkSession, path)
            elif _scopes:
                _scopes[-1].append(path)
        return out

    return run


_SCAN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def stable(df: DataFrame) -> DataFrame:
    """df, if it is a scan of Parquet files with columns or rows left out; else a written copy. row_key() holds on what this returns."""
    nodes, todo = [], [df._jdf.queryExecution().analyzed()]
    while todo:
        plan = todo.pop()
        nodes.append(plan.getClass().getSimpleName())
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    if set(nodes) <= _SCAN and "LogicalRelation" in nodes:
        try:
            df.select("_metadata.row_index")
            return df
        except AnalysisException:
            pass
    return written(df, "rows")


def row_key() -> Column:
    """What names a row of stable(df) alike in every evaluation: a hash of its file's path, and its number in the file."""
    return F.struct(F.xxhash64(F.col("_metadata.file_path")).alias("f"), F.col("_metadata.row_index").alias("n"))


def filesystem(uri: str):
    """Arrow's file system for an address that Spark takes: Hadoop's names of S3 are one to Arrow."""
    import pyarrow.fs as pafs

    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextlib.contextmanager
def output(spark: SparkSession, path: str):
    """A stream to a file that is whole or not there: written beside its place and renamed."""
    fs, own = _hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(own, True)
    try:
        yield out
    except BaseException:
        out.close()
        fs.delete(own, False)
        raise
    out.close()
    _, p = _hadoop(spark, path)
    fs.delete(p, False)
    fs.rename(own, p)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    with output(spark, path) as out:
        out.write(bytearray(text.encode()))


def get_text(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an earlier step of the same operator wrote."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def remove_written(df: DataFrame) -> None:
    """Deletes the files behind a DataFrame that written() returned and that nothing reads any more."""
    files = df.inputFiles()
    if files:
        remove(df.sparkSession, files[0].rsplit("/", 1)[0])

"""Entries put into or taken out of a stored object bucket by bucket: the edits alone are shuffled, and each task reads the stored segments
of its buckets from the files. Neither side of the object is joined or dealt anew."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.hashing import content_hash
from strata.runtime import filesystem, ship

ENTRY = "entry string, payload string, hash string, version string, parent string"
COLUMNS = ["entry", "payload", "hash", "version", "parent"]
ROWS_AT_ONCE = 10000


def _by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each bucket of batches that are sorted by it."""
    whole = (t for b in batches if len(b) for t in _cut(b))
    for bucket, parts in itertools.groupby(whole, lambda t: t[0]):
        yield bucket, pa.Table.from_batches([p for _, p in parts])


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    buckets = batch.column("_bucket").to_numpy(zero_copy_only=False)
    ends = [*(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
    for start, end in zip([0, *ends], ends, strict=False):
        yield int(buckets[start]), batch.slice(start, end - start)


def _stored(fs, folder: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as pafs

    for f in fs.get_file_info(pafs.FileSelector(folder)):
        if f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
            with fs.open_input_file(f.path) as file:
                yield from pq.ParquetFile(file).iter_batches(ROWS_AT_ONCE, columns=COLUMNS)


def merging(root: str, segments: dict[int, str], drop: bool):
    """For mapInArrow: edits (_bucket, entry, payload), sorted by _bucket, one a name, to the rows of their buckets after them, with _fresh for new ones."""

    def run(batches):
        fs, base = filesystem(root)
        for bucket, edits in _by_bucket(batches):
            names = edits["entry"].combine_chunks().cast(pa.string())
            at, versions = [], []
            for old in _stored(fs, f"{base}/{segments[bucket]}") if bucket in segments else ():
                found = pc.index_in(old.column("entry"), value_set=names, skip_nulls=True)
                kept = old.filter(pc.is_null(found))
                yield _rows(bucket, [kept.column(c) for c in COLUMNS], False)
                at.append(found.drop_null().to_numpy(zero_copy_only=False))
                versions.append(old.column("version").filter(pc.is_valid(found)))
            if not drop:
                before = np.full(len(names), -1)
                if at:
                    where = np.concatenate(at).astype(np.int64)
                    before[where] = np.arange(len(where))
                parent = pa.concat_arrays([v.cast(pa.string()) for v in versions] or [pa.array([], pa.string())]).take(pa.array(before, mask=before < 0))
                none = pa.nulls(len(names), pa.string())
                fresh = pa.Table.from_arrays([names, edits["payload"], none, none, parent], names=COLUMNS)
                for b in fresh.to_batches(ROWS_AT_ONCE):
                    yield _rows(bucket, b.columns, True)

    return run


def _rows(bucket: int, columns: list[pa.Array], fresh: bool) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, bucket, np.int32)), *[c.cast(pa.string()) for c in columns], pa.array(np.full(n, fresh))], names=["_bucket", *COLUMNS, "_fresh"])


def edited(edits: DataFrame, root: str, segments: dict[int, str], drop: bool, tasks: int) -> DataFrame:
    """_bucket and the rows of each bucket that has edits (_bucket, entry, payload), after them; of a name that is repeated the greatest payload holds."""
    ship(edits.sparkSession)
    one = edits.repartition(tasks, "_bucket").groupBy("_bucket", "entry").agg(F.max("payload").alias("payload")).sortWithinPartitions("_bucket")
    rows = one.mapInArrow(merging(root, segments, drop), f"_bucket int, {ENTRY}, _fresh boolean")
    rows = rows.withColumn("hash", F.when(F.col("_fresh"), content_hash(F.col("payload"))).otherwise(F.col("hash")))
    return rows.withColumn("version", F.when(F.col("_fresh"), content_hash(*map(F.col, ("entry", "hash", "parent")))).otherwise(F.col("version"))).drop("_fresh")

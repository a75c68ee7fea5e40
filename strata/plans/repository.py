"""A repository of versioned objects: commits, branch heads and metadata in small Parquet tables, contents in immutable Parquet.

root/objects/<hash>   a manifest of the contents, named by what they hold: a line per segment (bucket of the keys), with its hash sums,
                      rows, bytes and where it lies
root/segments/<id>    the rows of the segments that one put has written, a folder for each; never rewritten
root/commits          one row per commit: key, version, kind, data, ctx, parent1, parent2, seq
root/heads            one row per move of a head: key, branch, version (null: deleted), seq
root/meta             object, branch, k, v, seq

A put writes the segments alone that its parent hasn't, and a diff reads those alone that differ: a row is in the same bucket in
every version, and a bucket's hash sums say what it holds. The number of buckets follows the number of rows.

Tables of commits and heads are appended to, a file per operation, and read with the filters pushed down; a head is the
last row of its branch. They are rewritten as one file each when files grow many. Data are written before the commit, the commit before the head, so a failure leaves at most an
unreferenced object. One writer per repository is assumed, as for a single catalog process.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.errors import Code, StrataError
from strata.functions.hashing import NULL_VERSION, bucket_of, bucket_sums, content_hash, row_sums, version_of
from strata.functions.text import split_fields
from strata.operators import commits as graph
from strata.operators import dataset as ops
from strata.operators import diff as diff_ops
from strata.operators import merge as merge_ops
from strata.operators import rows as row_ops
from strata.operators import search as search_ops
from strata.plans.edits import ENTRY, edited
from strata.runtime import filesystem, get_text, put_text, remove
from strata.sources import csv

COMMITS = "key string, version string, kind string, data string, ctx string, parent1 string, parent2 string, seq long"
HEADS = "key string, branch string, version string, seq long"
META = "object string, branch string, k string, v string, seq long"
LOG = "at long, op string, key string, branch string, version string, seq long"
MANIFEST_FILE = "manifest.json"
MANIFEST = "bucket int, n long, s1 string, s2 string, bytes long, path string"
MASTER = "master"
FINE = 65536  # the most buckets of an object; hash sums are taken at this grain and added up for fewer
LEAST_ROWS, ROWS_PER_BUCKET, ROWS_PER_FILE = 1024, 1 << 16, 1 << 22
ROWS_PER_EDIT = 1 << 18  # about as many stored rows go through a task that edits them
CODEC = "zstd"  # of segments: digests as letters take half the bytes that they take without entropy coding


@dataclass
class Manifest:
    """Where an object lies: its columns and keys, and its segments by bucket."""

    schema: dict
    keys: list[str]
    buckets: int
    segments: dict


def _buckets(rows: int) -> int:
    return 1 if rows <= LEAST_ROWS else next((b for b in (16, 256, 4096) if rows <= b * ROWS_PER_BUCKET), FINE)


class Repository:
    def __init__(self, spark: SparkSession, root: str, most_files: int = 256):
        self.spark, self.root = spark, root.rstrip("/")
        self.most_files = most_files
        self._seq = time.time_ns()

    # --- tables of the catalog -------------------------------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        if not self._there(path):
            if not self._there(f"{path}.old"):
                return self.spark.createDataFrame([], schema)
            path = f"{path}.old"  # a compaction was cut off between its renames
        return self.spark.read.schema(schema).parquet(path)

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _there(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _append(self, name: str, schema: str, rows: list[tuple]) -> None:
        self._seq = max(self._seq + 1, time.time_ns())
        path = f"{self.root}/{name}"
        self.spark.createDataFrame([(*r, self._seq) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)
        fs, p = self._fs(path)
        if len(fs.listStatus(p)) > self.most_files:
            self.compact(name, schema)

    def compact(self, name: str, schema: str) -> None:
        """A table of the catalog as one file. The old folder goes when the new one is whole."""
        path = f"{self.root}/{name}"
        self._table(name, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}.new")
        fs, p = self._fs(path)
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs.delete(path_of(f"{path}.old"), True)
        fs.rename(p, path_of(f"{path}.old"))
        fs.rename(path_of(f"{path}.new"), p)
        fs.delete(path_of(f"{path}.old"), True)

    def commits(self) -> DataFrame:
        return self._table("commits", COMMITS).dropDuplicates(["key", "version"])

    def heads(self) -> DataFrame:
        last = self._table("heads", HEADS).groupBy("key", "branch").agg(F.max(F.struct("seq", "version")).alias("_l"))
        return last.select("key", "branch", "_l.version").where("version IS NOT NULL")

    def _parents(self) -> DataFrame:
        none = lambda c: F.when(F.col(c) != NULL_VERSION, F.col(c)).alias(c)
        return self.commits().select("key", "version", none("parent1"), none("parent2"))

    # --- keys, branches, versions ----------------------------------------------------------------------------------

    def list_keys(self) -> list[str]:
        return sorted(r[0] for r in self.commits().select("key").distinct().collect())

    def list_branches(self, key: str) -> list[str]:
        return [r[0] for r in graph.list_branches(self.heads(), key).collect()]

    def exists(self, key: str, branch: str | None = None) -> bool:
        """Whether the key ever had a version, or has the branch now."""
        if branch is None:
            return not self.commits().where(F.col("key") == key).isEmpty()
        return self._head(key, branch) is not None

    def _head(self, key: str, branch: str) -> str | None:
        moves = self._table("heads", HEADS).where((F.col("key") == key) & (F.col("branch") == branch))
        row = moves.orderBy(F.desc("seq")).select("version").first()
        return row["version"] if row else None

    def head(self, key: str, branch: str) -> str:
        found = self._head(key, branch)
        if found is None:
            raise StrataError(Code.BRANCH_NOT_EXISTS if self.exists(key) else Code.KEY_NOT_EXISTS, f"{key}@{branch}")
        return found

    def is_head(self, key: str, branch: str, version: str) -> bool:
        return self._head(key, branch) == version

    def latest(self, key: str) -> list[str]:
        return sorted(r["version"] for r in graph.latest_versions(self._parents().where(F.col("key") == key)).collect())

    def is_latest(self, key: str, version: str) -> bool:
        return version in self.latest(key)

    def commit(self, key: str, version: str) -> dict:
        rows = self._table("commits", COMMITS).where(F.col("version") == version).collect()
        if not rows:
            raise StrataError(Code.VERSION_NOT_EXISTS, version)
        own = [r for r in rows if r["key"] == key]
        if not own:
            raise StrataError(Code.INCONSISTENT_KEY, f"{version} of {rows[0]['key']}")
        return own[0].asDict()

    def history(self, key: str, version: str) -> DataFrame:
        self.commit(key, version)
        return graph.ancestry(self._parents().where(F.col("key") == key), self.spark.createDataFrame([(key, version)], "key string, version string"))

    def branch(self, key: str, new: str, old: str | None = None, version: str | None = None) -> None:
        """A branch at the head of another, or at a version. No data are copied."""
        at = self.head(key, old) if old is not None else self.commit(key, version)["version"]
        if self._head(key, new) is not None:
            raise StrataError(Code.BRANCH_EXISTS, new)
        self._append("heads", HEADS, [(key, new, at)])

    def move_branch(self, key: str, branch: str, version: str) -> None:
        """A branch, new or not, put at a version."""
        self._append("heads", HEADS, [(key, branch, self.commit(key, version)["version"])])

    def rename_branch(self, key: str, old: str, new: str) -> None:
        at = self.head(key, old)
        if self._head(key, new) is not None:
            raise StrataError(Code.BRANCH_EXISTS, new)
        self._append("heads", HEADS, [(key, new, at), (key, old, None)])

    def delete_branch(self, key: str, branch: str) -> None:
        """Versions stay: only the head goes."""
        self.head(key, branch)
        self._append("heads", HEADS, [(key, branch, None)])

    # --- values ----------------------------------------------------------------------------------------------------

    def put_unkeyed(self, df: DataFrame, keys: list[str] | None = None) -> str:
        """Contents without a commit; their digest, to get them by. Without keys, all columns make the buckets."""
        return self._store_frame(df, keys or df.columns, None)

    def manifest(self, data: str) -> Manifest:
        path = f"{self.root}/objects/{data}/{MANIFEST_FILE}"
        if not self._there(path):
            raise StrataError(Code.CHUNK_NOT_EXISTS, data)
        about, *rows = (json.loads(x) for x in get_text(self.spark, path).splitlines())  # a line per segment
        return Manifest(about["schema"], about["keys"], about["buckets"], {r["bucket"]: r for r in rows})

    def _read(self, m: Manifest, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of an object, or of those of its segments."""
        schema = StructType.fromJson(m.schema)
        paths = [f"{self.root}/segments/{s['path']}" for b, s in m.segments.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def get_unkeyed(self, data: str) -> DataFrame:
        return self._read(self.manifest(data))

    def get_segment(self, data: str, bucket: int) -> DataFrame:
        """One stored segment of an object."""
        m = self.manifest(data)
        if bucket not in m.segments:
            raise StrataError(Code.CHUNK_NOT_EXISTS, f"{data}/{bucket}")
        return self._read(m, {bucket})

    def lookup(self, data: str, keys: DataFrame) -> DataFrame:
        """The rows of an object whose keys are among those of `keys` (a few rows); only their segments are read."""
        m = self.manifest(data)
        return self.near(data, keys).join(keys.select(*m.keys).distinct(), m.keys, "left_semi")

    def near(self, data: str, keys: DataFrame) -> DataFrame:
        """The rows of the segments in which the keys of `keys` lie, if the object has them."""
        m = self.manifest(data)
        hit = {r[0] for r in keys.select(bucket_of(m.keys, m.buckets)).distinct().limit(m.buckets).collect()}
        return self._read(m, hit)

    def _store_frame(self, df: DataFrame, keys: list[str], parent: str | None, least: int = 1) -> str:
        """Writes the segments that the parent lacks, then the manifest. Equal contents have one digest, however many buckets they lie in."""
        values = sorted(c for c in df.columns if c not in keys)
        df = df.select(*[f"`{c}`" for c in [*keys, *values]])
        fine = {r["bucket"]: (r["n"], int(r["s1"]), int(r["s2"])) for r in bucket_sums(df, keys, values, FINE).collect()}  # a row per bucket, FINE at most
        total = [sum(v[i] for v in fine.values()) for i in range(3)]  # python's whole numbers have no bound
        schema = df.schema.json()
        columns = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema]
        data = version_of("|".join([",".join(keys), *columns, *map(str, total)]).encode())
        if self._there(f"{self.root}/objects/{data}/{MANIFEST_FILE}"):
            return data
        old = self.manifest(parent) if parent else None
        buckets = _buckets(total[0])
        if old and (json.dumps(old.schema) != json.dumps(json.loads(schema)) or old.keys != keys):
            old = None
        buckets = max(buckets, least)
        if old and buckets > 1 and buckets // 16 <= old.buckets <= buckets * 16:
            buckets = old.buckets
        sums: dict[int, list[int]] = {}
        for b, v in fine.items():
            at = sums.setdefault(b % buckets, [0, 0, 0])
            for i in range(3):
                at[i] += v[i]
        same = old.segments if old and old.buckets == buckets else {}
        kept = {b: same[b] for b, v in sums.items() if b in same and [same[b]["n"], int(same[b]["s1"]), int(same[b]["s2"])] == v}
        fresh = sorted(set(sums) - set(kept))
        put = uuid.uuid4().hex
        if fresh:
            rows = df.withColumn("_bucket", bucket_of(keys, buckets))
            if kept:
                rows = rows.join(F.broadcast(self.spark.createDataFrame([(b,) for b in fresh], "_bucket int")), "_bucket", "left_semi")  # FINE rows at most
            big = F.floor(F.rand(3) * F.lit(max(1, -(-total[0] // (buckets * ROWS_PER_FILE))))).cast("int")
            rows.repartition("_bucket", big).write.partitionBy("_bucket").option("compression", CODEC).parquet(f"{self.root}/segments/{put}")
        self._write_manifest(data, Manifest(json.loads(schema), keys, buckets, kept), put, {b: sums[b] for b in fresh})
        return data

    def _write_manifest(self, data: str, kept: Manifest, put: str, fresh: Mapping[int, list[int]]) -> None:
        """The manifest of segments that are kept and of those that a put has written, with their rows and sums."""
        fs, _ = self._fs(self.root)
        path_of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        size = lambda b: fs.getContentSummary(path_of(f"{self.root}/segments/{put}/_bucket={b}")).getLength()
        lines = [{"schema": kept.schema, "keys": kept.keys, "buckets": kept.buckets}, *kept.segments.values()]
        lines += [{"bucket": b, "n": n, "s1": str(s1), "s2": str(s2), "bytes": size(b), "path": f"{put}/_bucket={b}"} for b, (n, s1, s2) in fresh.items()]
        put_text(self.spark, f"{self.root}/objects/{data}/{MANIFEST_FILE}", "\n".join(map(json.dumps, lines)))

    def _edit_entries(self, data: str, edits: DataFrame, drop: bool) -> str | None:
        """The object `data` of entries after edits (entry, payload), or with `drop` without the entries named; None where that can't go bucket by bucket.

        Only the edits are shuffled, and only the segments that they touch are written; sums are taken of what was written.
        """
        old = self.manifest(data)
        schema = StructType.fromDDL(ENTRY)
        if old.keys != ["entry"] or {f["name"]: f["type"] for f in old.schema["fields"]} != {f.name: "string" for f in schema}:
            return None
        fs, at = self._fs(f"{self.root}/segments")
        root = fs.makeQualified(at).toString()
        try:
            filesystem(root)
        except (ValueError, OSError):  # no store that Arrow reads
            return None
        touched = {r[0]: r[1] for r in edits.groupBy(bucket_of(["entry"], FINE)).count().collect()}  # a row per bucket, FINE at most
        stored = sum(s["n"] for s in old.segments.values())
        total = stored + (0 if drop else sum(touched.values()))
        buckets = _buckets(total)
        if old.segments and buckets > 1 and buckets // 16 <= old.buckets <= buckets * 16:
            buckets = old.buckets
        if not touched or (old.segments and old.buckets != buckets) or total > FINE * ROWS_PER_FILE:
            return None
        hit = {b % buckets for b in touched}
        kept = {b: s for b, s in old.segments.items() if b not in hit}
        put = uuid.uuid4().hex
        folder = f"{self.root}/segments/{put}"
        rows = edits.select(bucket_of(["entry"], buckets).alias("_bucket"), "entry", "payload")
        tasks = max(1, min(len(hit), -(-total // ROWS_PER_EDIT)))
        columns = ["entry", "hash", "parent", "payload", "version"]  # as _store_frame has them
        paths = {b: s["path"] for b, s in old.segments.items() if b in hit}
        edited(rows, root, paths, drop, tasks).select("_bucket", *columns).write.partitionBy("_bucket").option("compression", CODEC).parquet(folder)
        s1, s2 = row_sums(*map(F.col, columns))
        back = self.spark.read.schema(StructType([schema[c] for c in columns]).add("_bucket", "integer")).parquet(folder)
        sums = {r["_bucket"]: [r["n"], int(r["s1"]), int(r["s2"])] for r in back.groupBy("_bucket").agg(F.count("*").alias("n"), s1, s2).collect()}
        sums_of = lambda s: [s["n"], int(s["s1"]), int(s["s2"])]
        same = {b for b, v in sums.items() if b in old.segments and sums_of(old.segments[b]) == v}
        kept |= {b: old.segments[b] for b in same}
        fresh = {b: v for b, v in sorted(sums.items()) if b not in same}
        totals = [sum(v[i] for v in [*map(sums_of, kept.values()), *fresh.values()]) for i in range(3)]
        found = version_of("|".join(["entry", *[f"{c}:string" for c in columns], *map(str, totals)]).encode())
        if self._there(f"{self.root}/objects/{found}/{MANIFEST_FILE}"):
            remove(self.spark, folder)
            return found
        for b in same:
            remove(self.spark, f"{folder}/_bucket={b}")
        about = StructType([schema[c] for c in columns]).jsonValue()
        self._write_manifest(found, Manifest(about, old.keys, buckets, kept), put, fresh)
        return found

    def _store(self, value: DataFrame | str, keys: list[str] | None, before: str | None = None, least: int = 1) -> tuple[str, str]:
        if isinstance(value, str):
            return "string", value
        parent = None
        if before and before != NULL_VERSION:
            row = self._table("commits", COMMITS).where(F.col("version") == before).first()
            parent = row["data"] if row and row["kind"] == "frame" else None
        return "frame", self._store_frame(value, keys or value.columns, parent, least)

    def _commit(self, key: str, kind: str, data: str, ctx: str, parents: list[str]) -> str:
        two = (parents + [NULL_VERSION, NULL_VERSION])[:2]
        version = version_of("\x1f".join([kind, key, data, ctx, *two]).encode())
        self._append("commits", COMMITS, [(key, version, kind, data, ctx, *two)])
        return version

    def put(self, key: str, value: DataFrame | str, branch: str = MASTER, parent: str | None = None, ctx: str = "", keys: list[str] | None = None, least: int = 1) -> str:
        """A commit whose parent is the branch's head, or `parent` on no branch. Equal contents are stored once; least: buckets, for large rows."""
        if parent is not None and parent != NULL_VERSION:
            try:
                self.commit(key, parent)
            except StrataError:
                raise StrataError(Code.REFERRING_VERSION_NOT_EXISTS, parent) from None
        before = parent if parent is not None else self._head(key, branch) or NULL_VERSION
        kind, data = self._store(value, keys, before, least)
        version = self._commit(key, kind, data, ctx, [before])
        if parent is None:
            self._append("heads", HEADS, [(key, branch, version)])
        return version

    def put_edits(self, key: str, edits: DataFrame, branch: str, drop: bool = False) -> str | None:
        """A commit of entries put in, or with `drop` taken out, on the branch's head; None, and no commit, where that can't go bucket by bucket."""
        before = self.head(key, branch)
        data = self._edit_entries(self.commit(key, before)["data"], edits, drop)
        if data is None:
            return None
        version = self._commit(key, "frame", data, "", [before])
        self._append("heads", HEADS, [(key, branch, version)])
        return version

    def merge(self, key: str, target: str, value: DataFrame | str | None = None, ref: str | None = None, ref_version: str | None = None, keys: list[str] | None = None, ctx: str = "") -> str:
        """A commit with two parents that moves target only. Without a value, keyed rows are merged from the common ancestor."""
        a = self.head(key, target)
        b = self.head(key, ref) if ref is not None else self.commit(key, ref_version)["version"]
        if value is None:
            value = self._auto(key, a, b, keys or [])
        kind, data = self._store(value, keys, a)
        version = self._commit(key, kind, data, ctx, [a, b])
        self._append("heads", HEADS, [(key, target, version)])
        return version

    def merge_versions(self, key: str, value: DataFrame | str, a: str, b: str, ctx: str = "", keys: list[str] | None = None) -> str:
        self.commit(key, a), self.commit(key, b)
        kind, data = self._store(value, keys, a)
        return self._commit(key, kind, data, ctx, [a, b])

    def base(self, key: str, a: str, b: str) -> str | None:
        """A common ancestor nearest to a."""
        both = self.history(key, a).select("version", "distance").join(self.history(key, b).select("version"), "version")
        row = both.orderBy("distance", "version").first()
        return row["version"] if row else None

    def _auto(self, key: str, a: str, b: str, keys: list[str]) -> DataFrame:
        if not keys:
            raise StrataError(Code.INVALID_PARAMETER, "an automatic merge needs keys")
        at = self.base(key, a, b)
        x, y = self.get(key, version=a), self.get(key, version=b)
        zero = self.get(key, version=at) if at else x.limit(0)
        values = [c for c in zero.columns if c not in keys]
        if not merge_ops.conflicts(zero, x, y, keys, values).isEmpty():
            raise StrataError(Code.MERGE_CONFLICT, key)
        return merge_ops.merge3(zero, x, y, keys, values)

    def get(self, key: str, branch: str = MASTER, version: str | None = None) -> DataFrame | str:
        c = self.commit(key, version if version is not None else self.head(key, branch))
        return c["data"] if c["kind"] == "string" else self.get_unkeyed(c["data"])

    def diff_versions(self, key: str, lhs: str, rhs: str, keys: list[str] | None = None) -> DataFrame:
        """What differs between two versions: of segments of equal hash sums nothing is read."""
        a, b = (self.commit(key, v)["data"] for v in (lhs, rhs))
        x, y = self.manifest(a), self.manifest(b)
        keys = keys or x.keys
        changed = None
        if x.keys == y.keys == keys and x.schema == y.schema and x.buckets == y.buckets:
            sums = lambda m, k: [m.segments[k][c] for c in ("n", "s1", "s2")] if k in m.segments else None
            changed = {k for k in x.segments.keys() | y.segments.keys() if sums(x, k) != sums(y, k)}
        left, right = self._read(x, changed), self._read(y, changed)
        return diff_ops.dual_diff(left, right, keys, [c for c in left.columns if c not in keys])

    def diff(self, key: str, lhs: str, rhs: str, keys: list[str] | None = None) -> DataFrame:
        """What differs between the heads of two branches."""
        return self.diff_versions(key, self.head(key, lhs), self.head(key, rhs), keys)

    # --- metadata --------------------------------------------------------------------------------------------------

    def set_meta(self, obj: str, branch: str, values: Mapping[str, str | None]) -> None:
        self._append("meta", META, [(obj, branch, k, v) for k, v in values.items()])

    def meta(self, obj: str, branch: str) -> dict[str, str]:
        rows = self._table("meta", META).where((F.col("object") == obj) & (F.col("branch") == branch))
        last = rows.groupBy("k").agg(F.max(F.struct("seq", "v")).alias("_l")).select("k", "_l.v").where("v IS NOT NULL")
        return {r["k"]: r["v"] for r in last.collect()}

    def exists_meta(self, obj: str, branch: str) -> bool:
        return bool(self.meta(obj, branch))

    def branch_meta(self, obj: str, old: str, new: str) -> None:
        """The metadata of one branch copied to another that has none."""
        if self.exists_meta(obj, new):
            raise StrataError(Code.BRANCH_EXISTS, new)
        if values := self.meta(obj, old):
            self.set_meta(obj, new, values)

    def delete_meta(self, obj: str, branch: str, *names: str) -> None:
        """Some values, or without names all, of a branch's metadata."""
        have = self.meta(obj, branch)
        if gone := {k: None for k in (names or have) if k in have}:
            self.set_meta(obj, branch, gone)

    def log(self, rows: list[tuple[str, str, str, str]]) -> None:
        """Adds (operation, key, branch, version) to the access log; keys of inner objects (with ::) are left out."""
        if kept := [(int(time.time()), *r) for r in rows if "::" not in r[1]]:
            self._append("log", LOG, kept)

    def access_log(self) -> DataFrame:
        return self._table("log", LOG).orderBy("seq")

    def segments(self) -> DataFrame:
        """data, bucket, n, bytes, path: the segments of every stored object; one that several share is in each."""
        if not self._there(f"{self.root}/objects"):
            return self.spark.createDataFrame([], "data string, bucket int, n long, bytes long, path string")
        at = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return self.spark.read.schema(MANIFEST).json(f"{self.root}/objects/*/{MANIFEST_FILE}").where("bucket IS NOT NULL").select(at.alias("data"), "bucket", "n", "bytes", "path")

    def storage_info(self) -> DataFrame:
        """kind, n_objects, n_segments, n_bytes: of the commits, each stored object, segment and string once."""
        once = self.commits().select("kind", "data").distinct()
        parts = once.where("kind = 'frame'").join(self.segments(), "data", "left").select("kind", "data", "path", "bytes")
        parts = parts.unionByName(once.where("kind = 'string'").select("kind", "data", F.col("data").alias("path"), F.octet_length("data").cast("long").alias("bytes")))
        objects = parts.groupBy("kind").agg(F.count_distinct("data").alias("n_objects"))
        stored = parts.where("path IS NOT NULL").dropDuplicates(["kind", "path"]).groupBy("kind").agg(F.count("*").alias("n_segments"), F.sum("bytes").alias("n_bytes"))
        return objects.join(stored, "kind", "left").na.fill(0)

    def table(self, name: str, branch: str = MASTER) -> VersionedTable:
        return VersionedTable(self, name, branch)

    def dataset(self, name: str, branch: str = MASTER) -> VersionedDataset:
        return VersionedDataset(self, name, branch)


class VersionedTable:
    """A table of a repository on one branch: edits commit, reads are DataFrames."""

    def __init__(self, repo: Repository, name: str, branch: str):
        self.repo, self.name, self.branch = repo, name, branch

    def create(self, df: DataFrame, ctx: str = "") -> str:
        if self.repo._head(self.name, self.branch) is not None:
            raise StrataError(Code.BRANCH_EXISTS, self.branch)
        return self.repo.put(self.name, df, self.branch, ctx=ctx, keys=["_rid"])

    def load_csv(self, path: str) -> str:
        if self.repo._head(self.name, self.branch) is not None and not self.read().isEmpty():
            raise StrataError(Code.NOT_EMPTY_TABLE, self.name)
        return self.repo.put(self.name, csv.load_table(self.repo.spark, path), self.branch, keys=["_rid"])

    def dump_csv(self, path: str) -> None:
        csv.dump_table(self.read(), path)

    def read(self, version: str | None = None) -> DataFrame:
        return self.repo.get(self.name, self.branch, version)

    def view(self, name: str | None = None) -> None:
        """The table for spark.sql."""
        self.read().createOrReplaceTempView(name or self.name)

    def write(self, df: DataFrame, ctx: str = "") -> str:
        return self.repo.put(self.name, df, self.branch, ctx=ctx, keys=["_rid"])

    def fork(self, new: str) -> VersionedTable:
        self.repo.branch(self.name, new, old=self.branch)
        return VersionedTable(self.repo, self.name, new)

    def exists(self, branch: str | None = None) -> bool:
        """Whether the table is on a branch, or on any."""
        return branch in self.branches() if branch is not None else bool(self.branches())

    def branches(self) -> list[str]:
        return self.repo.list_branches(self.name)

    def column_branches(self, col: str) -> list[str]:
        """Branches whose table has the column."""
        return [b for b in self.branches() if col in VersionedTable(self.repo, self.name, b).schema()]

    def exists_column(self, col: str, branch: str | None = None) -> bool:
        return branch in self.column_branches(col) if branch is not None else bool(self.column_branches(col))

    def drop(self) -> None:
        """The table's branch; its versions stay."""
        self.repo.delete_branch(self.name, self.branch)

    def drop_all(self) -> int:
        """All branches, if there are any; their number."""
        found = self.branches()
        for b in found:
            self.repo.delete_branch(self.name, b)
        return len(found)

    def schema(self) -> set[str]:
        return set(self.read().columns) - {"_rid"}

    def size(self) -> int:
        return self.read().count()

    def column(self, col: str) -> DataFrame:
        return row_ops.get_column(self.read(), col)

    def rows(self, col: str, value: object) -> DataFrame:
        found = row_ops.select_rows(self.read(), col, value)
        if found.isEmpty():
            raise StrataError(Code.ROW_NOT_EXISTS, str(value))
        return found

    def put_column(self, col: str, values: DataFrame) -> str:
        return self.write(row_ops.put_column(self.read(), col, values))

    def drop_column(self, col: str) -> str:
        return self.write(row_ops.drop_column(self.read(), col))

    def insert(self, values: Mapping[str, object], distinct: str | None = None) -> str:
        df = self.read()
        return self.write(row_ops.insert_row_distinct(df, values, distinct) if distinct else row_ops.insert_row(df, values))

    def update(self, values: Mapping[str, object], rid: int | None = None, where: tuple[str, object] | None = None, first_run: bool = False) -> str:
        df = self.read()
        if rid is not None:
            return self.write(row_ops.update_row(df, rid, values))
        if where is None:
            raise StrataError(Code.INVALID_PARAMETER, "rid or where")
        return self.write(row_ops.update_first_run(df, *where, values) if first_run else row_ops.update_rows(df, *where, values)[0])

    def delete(self, rid: int | None = None, where: tuple[str, object] | None = None) -> str:
        df = self.read()
        return self.write(row_ops.delete_row(df, rid) if rid is not None else row_ops.delete_rows(df, *where))

    def diff(self, other: str, keys: Iterable[str] = ("_rid",)) -> DataFrame:
        return self.repo.diff(self.name, self.branch, other, list(keys))

    def merge_column(self, ref: str, col: str, drop: bool = False) -> str:
        """This branch with one column of another put in, or taken out; a commit with both as parents."""
        df = self.read()
        other = VersionedTable(self.repo, self.name, ref)
        merged = row_ops.drop_column(df, col) if drop else row_ops.put_column(df, col, other.column(col))
        return self.repo.merge(self.name, self.branch, merged, ref=ref, keys=["_rid"])


DATASETS = "__DATASET_LIST__"


class VersionedDataset:
    """Entries of a repository on one branch. Entries are immutable: a put gives an entry a new version, whose parent is the one before.

    version is a digest of the name, the content hash and the parent. A branch copies no entries.
    """

    def __init__(self, repo: Repository, name: str, branch: str):
        self.repo, self.name, self.branch = repo, name, branch

    @staticmethod
    def names(repo: Repository) -> list[str]:
        """All datasets, in byte order."""
        return sorted(repo.meta(DATASETS, MASTER), key=str.encode)

    def exists(self, branch: str | None = None) -> bool:
        return branch in self.branches() if branch is not None else bool(self.branches())

    def branches(self) -> list[str]:
        return self.repo.list_branches(self.name)

    def create(self) -> str:
        if self.repo._head(self.name, self.branch) is not None:
            raise StrataError(Code.BRANCH_EXISTS, self.branch)
        self.repo.set_meta(self.name, self.branch, {"TYPE": "Dataset"})
        self.repo.set_meta(DATASETS, MASTER, {self.name: "1"})
        return self.repo.put(self.name, self.repo.spark.createDataFrame([], ENTRY), self.branch, keys=["entry"])

    def drop(self) -> None:
        """The dataset's branch; with the last one the dataset leaves the list."""
        self.repo.delete_branch(self.name, self.branch)
        self.repo.delete_meta(self.name, self.branch)
        if not self.branches():
            self.repo.delete_meta(DATASETS, MASTER, self.name)

    def read(self) -> DataFrame:
        return self.repo.get(self.name, self.branch)

    def fork(self, new: str) -> VersionedDataset:
        self.repo.branch(self.name, new, old=self.branch)
        self.repo.branch_meta(self.name, self.branch, new)
        return VersionedDataset(self.repo, self.name, new)

    def _write(self, entries: DataFrame) -> str:
        return self.repo.put(self.name, entries, self.branch, keys=["entry"])

    def put(self, entries: DataFrame) -> str:
        """Entries (entry, payload) put in or given a new version; of a name that is repeated the greatest payload holds."""
        if dict(entries.dtypes)["entry"] == dict(entries.dtypes)["payload"] == "string" and (version := self.repo.put_edits(self.name, entries.select("entry", "payload"), self.branch)):
            return version
        old = self.read()
        one = ops.with_hash(entries.groupBy("entry").agg(F.max("payload").alias("payload")))
        before = old.select("entry", F.col("version").alias("parent"))
        fresh = one.join(before, "entry", "left").withColumn("version", content_hash(F.col("entry"), F.col("hash"), F.col("parent")))
        return self._write(ops.put_entries(old, fresh.select(*old.columns)))

    def get_entry(self, entry: str) -> dict:
        data = self.repo.commit(self.name, self.repo.head(self.name, self.branch))["data"]
        row = self.repo.lookup(data, self.repo.spark.createDataFrame([(entry,)], "entry string")).first()
        if row is None:
            raise StrataError(Code.ENTRY_NOT_EXISTS, entry)
        return row.asDict()

    def exists_entry(self, entry: str, branch: str | None = None) -> bool:
        """Whether a branch, or any, has the entry."""
        at = self.entry_branches(entry)
        return branch in at if branch is not None else bool(at)

    def entry_branches(self, entry: str) -> list[str]:
        out = []
        for b in self.branches():
            try:
                VersionedDataset(self.repo, self.name, b).get_entry(entry)
                out.append(b)
            except StrataError as e:
                if e.code is not Code.ENTRY_NOT_EXISTS:
                    raise
        return out

    def list_entries(self) -> DataFrame:
        return self.read().select("entry", "version")

    def select(self, names: list[str], check: bool = True) -> DataFrame:
        """Entries in the order of names; one that isn't there is an error, or left out without `check`. Only their segments are read."""
        wanted = self.repo.spark.createDataFrame(list(enumerate(names)), "pos int, entry string")
        data = self.repo.commit(self.name, self.repo.head(self.name, self.branch))["data"]
        return ops.select_entries(self.repo.near(data, wanted), wanted, check)

    def delete(self, *names: str) -> str:
        """Entries taken out; names that aren't there are left alone."""
        return self.remove(self.repo.spark.createDataFrame([(n,) for n in names], "entry string"))

    def remove(self, names: DataFrame) -> str:
        """As delete, of the names (entry) in a table."""
        edits = names.select("entry", F.lit(None).cast("string").alias("payload"))
        return self.repo.put_edits(self.name, edits, self.branch, drop=True) or self._write(ops.delete_entries(self.read(), names))

    def load_csv(self, path: str, positions: list[int], with_schema: bool = False, indexed: bool = False) -> int:
        entries, schema, n = csv.load_dataset(self.repo.spark, path, positions, with_schema, indexed)
        known = self.repo.meta(self.name, self.branch)
        if schema is not None and known.get("SCHEMA", schema) != schema:
            raise StrataError(Code.INVALID_SCHEMA, schema)
        self.repo.set_meta(self.name, self.branch, {"ENTRY NAME INDICES": ",".join(map(str, positions))} | ({"SCHEMA": schema} if schema else {}))
        self.put(entries)
        return n

    def schema(self) -> str:
        found = self.repo.meta(self.name, self.branch).get("SCHEMA")
        if found is None:
            raise StrataError(Code.SCHEMA_NOT_FOUND, self.name)
        return found

    def name_indices(self) -> list[int]:
        found = self.repo.meta(self.name, self.branch).get("ENTRY NAME INDICES")
        if found is None:
            raise StrataError(Code.SCHEMA_NOT_FOUND, self.name)
        return [int(x) for x in found.split(",") if x]

    def export(self, path: str) -> dict[str, int]:
        return csv.export_dataset(self.read(), path, self.repo.meta(self.name, self.branch).get("SCHEMA"))

    def diff(self, other: VersionedDataset) -> DataFrame:
        return ops.diff_dataset(self.read(), other.read())

    def fields(self, entries: DataFrame | None = None) -> DataFrame:
        """entry and one column per field of the schema."""
        parts = split_fields(F.col("payload"))
        rows = self.read() if entries is None else entries
        return rows.select("entry", *[F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit("")).alias(c) for i, c in enumerate(self.schema().split(","))])

    def index(self) -> DataFrame:
        """The keyword index (entry, field, term), stored beside the dataset and brought up to its head first.

        Only entries that differ between the version indexed last and the head are taken out and put in again.
        """
        head, key = self.repo.head(self.name, self.branch), f"{self.name}::index"
        about = self.repo.meta(key, self.branch)
        if about.get("VERSION") == head and about.get("SCHEMA") == self.schema():
            return self.repo.get(key, self.branch)
        columns, before = self.schema().split(","), about.get("VERSION")
        if before is None or about.get("SCHEMA") != self.schema() or self.repo._head(key, self.branch) is None:
            fresh = search_ops.inverted_index(self.fields(), "entry", columns)
        else:
            changed = self.repo.diff_versions(self.name, before, head).select("entry")
            rows = self.read().join(changed, "entry", "left_semi")
            fresh = self.repo.get(key, self.branch).join(changed, "entry", "left_anti").unionByName(search_ops.inverted_index(self.fields(rows), "entry", columns))
        self.repo.put(key, fresh, self.branch, keys=["entry", "field", "term"])
        self.repo.set_meta(key, self.branch, {"VERSION": head, "SCHEMA": self.schema()})
        return self.repo.get(key, self.branch)

    def search(self, query: str) -> DataFrame:
        """Entries that satisfy a keyword query, by the stored index."""
        return search_ops.search_index(self.index(), query)

    def search_scored(self, query: str) -> DataFrame:
        """entry, score: the entries of search, the best first."""
        return search_ops.scored(self.index(), query)

    def select_by_query(self, query: str) -> DataFrame:
        return self.read().join(self.search(query).select("entry"), "entry", "left_semi")

    def query_join(self, query: str, *others: VersionedDataset) -> list[DataFrame]:
        return ops.join_by_entries(self.search(query), *[o.read() for o in others])

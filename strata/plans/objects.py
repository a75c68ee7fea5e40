"""Lists, maps, sets and blobs of a repository: each edit checks its arguments and commits a new version.

A list is rows (_rid, value), a map (k, v), a set (elem), a blob one row (data). Edits are the operators of
strata.operators.collections, so an edit of a large object is a join or a filter, not a rewrite on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import PythonException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.functions.hashing import NULL_VERSION
from strata.operators import align, diff
from strata.operators import collections as ops
from strata.plans.repository import MASTER, Repository
from strata.runtime import output


class _Object:
    keys: list[str] = []
    buckets = 1  # at least, whatever the number of rows

    def __init__(self, repo: Repository, key: str, branch: str = MASTER):
        self.repo, self.key, self.branch = repo, key, branch

    def read(self, version: str | None = None) -> DataFrame:
        return self.repo.get(self.key, self.branch, version)

    def write(self, df: DataFrame) -> str:
        return self.repo.put(self.key, df, self.branch, keys=self.keys, least=self.buckets)

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.repo.spark.createDataFrame(rows, schema)

    def find(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys are among those of a few given rows; only their segments are read."""
        return self.repo.lookup(self.repo.commit(self.key, self.repo.head(self.key, self.branch))["data"], rows)

    def size(self) -> int:
        return self.read().count()


class ListEdit:
    """Edits of a list held back and committed as one version. Positions are those of the list as it was when they began."""

    def __init__(self, target: ListObject):
        self.target, self.splices = target, []

    def splice(self, start: int, dels: int, values: Sequence[str] = ()) -> ListEdit:
        if start < 0 or dels < 0:
            raise StrataError(Code.INDEX_OUT_OF_RANGE, str(start))
        self.splices.append((start, dels, list(values)))
        return self

    def insert(self, start: int, values: Sequence[str]) -> ListEdit:
        return self.splice(start, 0, values)

    def delete(self, start: int, n: int = 1) -> ListEdit:
        return self.splice(start, n)

    def commit(self) -> str:
        """The new version; without edits the old one."""
        t = self.target
        if not self.splices:
            return t.repo.head(t.key, t.branch)
        cuts = t._frame([(i, a, n) for i, (a, n, _) in enumerate(self.splices)], "seq int, start long, dels long")
        ins = t._frame([(i, j, v) for i, (_, _, values) in enumerate(self.splices) for j, v in enumerate(values)], "seq int, pos long, value string")
        return t.write(ops.rows_multi_splice(t.read(), cuts, ins))


class MapEdit:
    """Edits of a map held back and committed as one version; the last edit of a key holds."""

    def __init__(self, target: MapObject):
        self.target, self.last = target, {}

    def set(self, values: Mapping[str, str]) -> MapEdit:
        self.last.update(values)
        return self

    def delete(self, *keys: str) -> MapEdit:
        self.last.update(dict.fromkeys(keys))
        return self

    def commit(self) -> str:
        t = self.target
        if not self.last:
            return t.repo.head(t.key, t.branch)
        gone = t._frame([(k,) for k, v in self.last.items() if v is None], "k string")
        kept = t._rows({k: v for k, v in self.last.items() if v is not None})
        return t.write(ops.rows_map_set(ops.rows_map_remove(t.read(), gone, "k"), kept, "k"))


class ListObject(_Object):
    keys = ["_rid"]

    def _rows(self, values: Sequence[str]) -> DataFrame:
        return self._frame(list(enumerate(values)), "_rid long, value string")

    def _distinct(self, values: Sequence[str], but: int | None = None) -> None:
        old = self.read() if but is None else self.read().where(F.col("_rid") != but)
        bad = ops.distinct_violations(self._rows(values), old, "value").first()
        if bad:
            raise StrataError(Code.ELEMENT_EXISTS, bad["value"])

    def create(self, values: Sequence[str]) -> str:
        return self.write(self._rows(values))

    def get(self, i: int) -> str | None:
        row = self.find(self._frame([(i,)], "_rid long")).first()
        return row["value"] if row else None

    def _inside(self, i: int, end: bool = False) -> None:
        if not 0 <= i < self.size() + end:
            raise StrataError(Code.INDEX_OUT_OF_RANGE, str(i))

    def splice(self, start: int, dels: int, values: Sequence[str] = ()) -> str:
        return self.write(ops.rows_list_splice(self.read(), start, dels, self._rows(values)))

    def append(self, values: Sequence[str], distinct: bool = False) -> str:
        if distinct:
            self._distinct(values)
        return self.write(ops.rows_list_append(self.read(), self._rows(values)))

    def insert(self, i: int, values: Sequence[str], distinct: bool = False) -> str:
        self._inside(i, end=True)
        if distinct:
            self._distinct(values)
        return self.splice(i, 0, values)

    def update(self, i: int, value: str, distinct: bool = False) -> str:
        self._inside(i)
        if distinct:
            self._distinct([value], but=i)
        return self.splice(i, 1, [value])

    def delete(self, i: int, n: int = 1) -> str:
        self._inside(i)
        return self.splice(i, n)

    def diff(self, other: ListObject) -> DataFrame:
        return diff.dual_diff(self.read(), other.read(), ["_rid"], ["value"])

    def edit(self) -> ListEdit:
        return ListEdit(self)

    def merge(self, ref: str) -> str:
        """Another branch's edits since the common ancestor put into this branch; a commit with both as parents."""
        a, b = self.repo.head(self.key, self.branch), self.repo.head(self.key, ref)
        at = self.repo.base(self.key, a, b)
        sides = [self.repo.get(self.key, version=v) if v else self._rows([]) for v in (at, a, b)]
        merged = align.merge3(*[d.withColumn("_key", F.lit(0)) for d in sides], "_key").drop("_key")
        try:
            return self.repo.merge(self.key, self.branch, merged, ref=ref, keys=self.keys)
        except PythonException as e:  # the lists are merged in a worker
            if Code.MERGE_CONFLICT.value in str(e):
                raise StrataError(Code.MERGE_CONFLICT, self.key) from None
            raise


class MapObject(_Object):
    keys = ["k"]

    def _rows(self, values: Mapping[str, str]) -> DataFrame:
        return self._frame(list(values.items()), "k string, v string")

    def _present(self, keys: Sequence[str]) -> set[str]:
        return {r["k"] for r in self.find(self._frame([(k,) for k in keys], "k string")).select("k").collect()}

    def create(self, values: Mapping[str, str]) -> str:
        return self.write(self._rows(values))

    def get(self, key: str) -> str | None:
        row = self.find(self._frame([(key,)], "k string")).first()
        return row["v"] if row else None

    def set(self, values: Mapping[str, str]) -> str:
        return self.write(ops.rows_map_set(self.read(), self._rows(values), "k"))

    def insert(self, values: Mapping[str, str]) -> str:
        if found := self._present(list(values)):
            raise StrataError(Code.MAP_KEY_EXISTS, ", ".join(sorted(found)))
        return self.set(values)

    def update(self, values: Mapping[str, str]) -> str:
        if missing := set(values) - self._present(list(values)):
            raise StrataError(Code.MAP_KEY_NOT_EXISTS, ", ".join(sorted(missing)))
        return self.set(values)

    def delete(self, *keys: str) -> str:
        if missing := set(keys) - self._present(keys):
            raise StrataError(Code.MAP_KEY_NOT_EXISTS, ", ".join(sorted(missing)))
        return self.write(ops.rows_map_remove(self.read(), self._frame([(k,) for k in keys], "k string"), "k"))

    def diff(self, other: MapObject) -> DataFrame:
        return diff.dual_diff(self.read(), other.read(), ["k"], ["v"])

    def edit(self) -> MapEdit:
        return MapEdit(self)


class SetObject(_Object):
    keys = ["elem"]

    def _rows(self, values: Sequence[str]) -> DataFrame:
        return self._frame([(v,) for v in values], "elem string").distinct()

    def create(self, values: Sequence[str]) -> str:
        return self.write(self._rows(values))

    def contains(self, value: str) -> bool:
        return not self.find(self._rows([value])).isEmpty()

    def insert(self, *values: str) -> str:
        if not (found := self.read().join(self._rows(values), "elem", "left_semi").limit(1)).isEmpty():
            raise StrataError(Code.MAP_KEY_EXISTS, found.first()["elem"])
        return self.write(self.read().unionByName(self._rows(values)))

    def delete(self, *values: str) -> str:
        if not (missing := self._rows(values).join(self.read(), "elem", "left_anti").limit(1)).isEmpty():
            raise StrataError(Code.MAP_KEY_NOT_EXISTS, missing.first()["elem"])
        return self.write(self.read().join(self._rows(values), "elem", "left_anti"))


STEP = 1 << 20  # numbers left free between the parts of a new blob


class BlobObject(_Object):
    """Bytes in parts (part, data), in order of part. An edit fetches the parts that it cuts and leaves the others alone.

    New parts take numbers between their neighbours; when those run out, all parts are numbered anew.
    """

    keys = ["part"]
    buckets = 256  # a part is large: an edit should write no others
    schema = "part long, data binary"

    @staticmethod
    def _cut(data: bytes, part_bytes: int) -> list[bytes]:
        return [data[a : a + part_bytes] for a in range(0, len(data), part_bytes)]

    def create(self, data: bytes, part_bytes: int = 8 << 20) -> str:
        return self.write(self._frame([(i * STEP, d) for i, d in enumerate(self._cut(data, part_bytes))], self.schema))

    def put_file(self, path: str, part_bytes: int = 8 << 20) -> str:
        """A file that Spark reaches, part by part, so that the driver never holds it."""
        def cut(batches):
            import pyarrow as pa

            for batch in batches:
                for v in batch.column(0):
                    data = v.as_buffer()
                    for i, a in enumerate(range(0, len(data), part_bytes)):
                        yield pa.RecordBatch.from_pydict({"part": pa.array([i * STEP], pa.int64()), "data": pa.array([data[a : a + part_bytes].to_pybytes()], pa.binary())})

        return self.write(self.repo.spark.read.format("binaryFile").load(path).select("content").mapInArrow(cut, self.schema))

    def put_stream(self, parts: Iterable[bytes]) -> str:
        """A new blob of parts as they come: a version for each, the next's parent, and the branch moves at the last."""
        version, rows, last = self.repo._head(self.key, self.branch) or NULL_VERSION, None, -STEP
        for data in parts:
            last += STEP
            new = self._frame([(last, bytes(data))], self.schema)
            version = self.repo.put(self.key, new if rows is None else rows.unionByName(new), parent=version, keys=self.keys, least=self.buckets)
            rows = self.repo.get(self.key, version=version)
        if rows is None:
            return self.create(b"")
        self.repo.move_branch(self.key, self.branch, version)
        return version

    def save(self, path: str) -> int:
        """The blob as a file at an address that Spark's file systems take, part by part; its bytes."""
        n = 0
        with output(self.repo.spark, path) as out:
            for data in self.chunks():
                out.write(bytearray(data))
                n += len(data)
        return n

    def _places(self) -> list[tuple[int, int, int]]:
        """(part, start, end) of the parts, in order; a row per part."""
        out, at = [], 0
        for r in self.read().select("part", F.octet_length("data").alias("n")).orderBy("part").collect():
            out.append((r["part"], at, at + r["n"]))
            at += r["n"]
        return out

    def size(self) -> int:
        return self.read().agg(F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0))).first()[0]

    def _bytes(self, places: list[tuple[int, int, int]]) -> bytes:
        if not places:
            return b""
        some = self.read().where(F.col("part").between(places[0][0], places[-1][0]))
        return b"".join(bytes(r["data"]) for r in some.orderBy("part").toLocalIterator())

    def get(self) -> bytes:
        """The whole blob on the driver; chunks() gives it part by part."""
        return b"".join(self.chunks())

    def chunks(self):
        for r in self.read().orderBy("part").toLocalIterator():
            yield bytes(r["data"])

    def read_range(self, pos: int, length: int) -> bytes:
        hit = [p for p in self._places() if p[1] < pos + length and p[2] > pos]
        return self._bytes(hit)[pos - hit[0][1] :][:length] if hit else b""

    def splice(self, pos: int, dels: int, data: bytes = b"", part_bytes: int = 8 << 20) -> str:
        places = self._places()
        end = places[-1][2] if places else 0
        if not 0 <= pos <= end:
            raise StrataError(Code.INDEX_OUT_OF_RANGE, str(pos))
        stop = min(pos + dels, end)
        cut = [p for p in places if p[1] < max(stop, pos + 1) and p[2] > pos] if pos < end else []
        head = self._bytes(cut[:1])[: pos - cut[0][1]] if cut else b""
        tail = self._bytes(cut[-1:])[stop - cut[-1][1] :] if cut else b""
        fresh = self._cut(head + data + tail, part_bytes)
        before = [p[0] for p in places if p[2] <= pos and p not in cut]
        after = [p[0] for p in places if p[1] >= stop and p not in cut and p[1] >= pos]
        lo = before[-1] if before else -STEP
        hi = after[0] if after else lo + STEP * (len(fresh) + 1)
        rows = self.read()
        if cut:
            rows = rows.where(~F.col("part").between(cut[0][0], cut[-1][0]))
        if hi - lo <= len(fresh):  # no numbers left between the neighbours
            number = {p: i * STEP for i, p in enumerate(before)} | {p: (len(before) + len(fresh) + i) * STEP for i, p in enumerate(after)}
            table = self._frame(list(number.items()), "part long, _new long")
            rows = rows.join(table, "part").select(F.col("_new").alias("part"), "data")
            new = [((len(before) + i) * STEP, d) for i, d in enumerate(fresh)]
        else:
            gap = (hi - lo) // (len(fresh) + 1)
            new = [(lo + gap * (i + 1), d) for i, d in enumerate(fresh)]
        return self.write(rows.unionByName(self._frame(new, self.schema)))

    def append(self, data: bytes) -> str:
        return self.splice(self.size(), 0, data)

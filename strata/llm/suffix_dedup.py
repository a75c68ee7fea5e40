"""Removal of long repeated byte strings, by a distributed difference-cover suffix sort over content-defined phrases.

1. Texts are told apart by the first 128 bits of SHA-256; a text and its copies are one from here on.
2. Anchors. Of each `length - k + 1` neighbouring k-grams the one of least hash is an anchor. Any string of `length` bytes
   holds an anchor of its own, and equal strings have theirs at equal places. So a repeated string has an own anchor of a
   repeated k-gram, and its text goes on only if it has such. The bytes from an anchor to the end of the next one's k-gram are a phrase,
   and a row of anchors of repeated k-grams is a string of phrases.
3. Suffix sort of these strings by difference cover modulo 3. The triples at places 1 and 2 (mod 3) are sorted and named,
   triples of names are sorted and named again, until the names reach as far as a comparison needs; only what doesn't
   reach far enough goes into another round. The suffixes at places 0 are merged with those at places 1 by their first phrase
   and the name of what follows, and with those at places 2 by two phrases and the name of what follows.
4. Adjacent suffixes are compared phrase by phrase, by a second hash. What a suffix shares with a neighbour is repeated. That settles
   all strings but those at the ragged ends of shared stretches, which end between anchors.
5. Exact check of the ragged ends, in bytes: strings whose anchors of least hash have one k-gram are compared, those not yet settled
   with one another and with one copy of each stretch that has been settled.

Every sort is over ranges, so that no task holds more than a range. A k-gram whose ragged ends are too many for one task
has its strings dealt by their own hashes (128 bits) instead.

Defined results: a null text is an empty text. Texts shorter than `length` stay whole. Rows that repeat doc_id and text are
copies. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.runtime import lean, remove_written, scratch, ship, written

_BASE = 0x9E3779B97F4A7C15
_OTHER = 0xD1B54A32D192ED03
_END = -(2**63)
_LETTER = np.dtype([("h", "<u8"), ("d", "<u2")])


@dataclass(frozen=True)
class RepeatParams:
    length: int = 200
    k: int = 64
    most: int = 2000  # ragged ends of one k-gram that a task compares in memory; more are dealt by their strings' hashes


class Roller:
    """Hashes of all windows of a byte string."""

    def __init__(self, base: int = _BASE):
        self.base = base
        self.value = np.random.default_rng(base % 2**32).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self._pow = self._inv = np.empty(0, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, step = 1, base
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            step = step * step % 2**64
            done += k
        return out

    def sums(self, x: np.ndarray) -> np.ndarray:
        if len(self._pow) <= len(x):
            n = max(len(x) + 1, 1 << 18)
            self._pow, self._inv = self._powers(self.base, n), self._powers(pow(self.base, -1, 2**64), n)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self.value[x] * self._pow[: len(x)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of bytes a to b."""
        return _mixed((sums[b] - sums[a]) * self._inv[a] + (b - a).astype(np.uint64))


def _slide(f, a: np.ndarray, width: int) -> np.ndarray:
    """f over every window of `width`, by doubling."""
    span = 1
    while span * 2 <= width:
        a = f(a[:-span], a[span:])
        span *= 2
    return f(a[: len(a) - (width - span)], a[width - span :]) if width > span else a


_TOGETHER = 1 << 17  # bytes of short texts whose hashes are computed at once


@dataclass
class Anchored:
    """A text's anchors: places and k-gram hashes, and the running sums of a buffer in which it begins at base."""

    at: np.ndarray
    gram: np.ndarray
    sums: np.ndarray
    base: int
    buffer: np.ndarray


def anchored(texts: list[bytes], roller: Roller, p: RepeatParams):
    """The Anchored of each text, in order; short texts are laid end to end, so that a step runs over many of them."""
    lo = size = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > _TOGETHER):
            if i > lo:
                yield from _anchored(texts[lo:i], roller, p)
            lo, size = i, 0
        if i < len(texts):
            size += len(texts[i])


def _anchored(texts: list[bytes], roller: Roller, p: RepeatParams):
    x = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    sums, n, width = roller.sums(x), len(x), p.length - p.k + 1
    at = gram = np.empty(0, np.int64)
    if n >= p.length:
        h = sums[p.k :] - sums[: n - p.k + 1]
        h *= roller._inv[: n - p.k + 1]
        h += np.uint64(p.k)
        h = _mixed(h)
        np.maximum(h, np.uint64(1), out=h)  # 0 stands for no string
        least = _slide(np.minimum, h, width)
        for e in ends[:-1].tolist():  # strings that would begin in one text and end in the next
            least[max(0, e - p.length + 1) : e] = 0
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(h == _slide(np.maximum, np.concatenate([pad, least, pad]), width))
        gram = h[at]
    cut = np.searchsorted(at, ends)
    a = begin = 0
    for b, e in zip(cut.tolist(), ends.tolist(), strict=True):
        yield Anchored(at[a:b] - begin, gram[a:b], sums, begin, x)
        a, begin = b, e


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    return h


def owners(at: np.ndarray, gram: np.ndarray, n: int, p: RepeatParams) -> np.ndarray:
    """For each string of `length` bytes the number of its own anchor: the first of least hash that it holds. Equal strings have theirs at equal places."""
    width, top, count = p.length - p.k + 1, n - p.length + 1, len(at)
    lo, hi = np.maximum(at - width + 1, 0), np.minimum(at, top - 1)
    for way in (-1, 1):
        todo, step = np.arange(count), way
        while len(todo):
            other = todo + step
            inside = (other >= 0) & (other < count)
            todo, other = todo[inside], other[inside]
            near = np.abs(at[other] - at[todo]) < width
            todo, other = todo[near], other[near]
            less = gram[other] <= gram[todo] if way < 0 else gram[other] < gram[todo]
            if way < 0:
                lo[todo[less]] = np.maximum(lo[todo[less]], at[other[less]] + 1)
            else:
                hi[todo[less]] = np.minimum(hi[todo[less]], at[other[less]] - width)
            todo, step = todo[~less], step + way
    return np.repeat(np.arange(count), np.maximum(hi - lo + 1, 0))


@dataclass
class Strings:
    """The strings of phrases of some texts, laid end to end with four ends after each, as arrays by place."""

    c: np.ndarray  # letter: hash of the phrase, _END past the end
    h: np.ndarray  # its second hash
    d: np.ndarray  # bytes from its anchor to the next
    pos: np.ndarray  # of its anchor; -1 past the end
    i: np.ndarray  # place in its string
    stop: np.ndarray  # where the letters of its string end
    sample: np.ndarray  # places 1 and 2 (mod 3), up to two past the end: they carry the names of what follows
    sid: np.ndarray  # by text: its number
    begin: np.ndarray  # and its first place

    def text(self, at: np.ndarray) -> np.ndarray:
        """Of which text the places are; one without strings begins where the next one does."""
        return np.searchsorted(self.begin, at, side="right") - 1


def letters(text: Anchored, other_sums: np.ndarray, size: int, hits: np.ndarray, roller: Roller, other: Roller, p: RepeatParams) -> dict[str, np.ndarray]:
    """What the later steps need of a text of size bytes. hits: numbers of the anchors whose k-grams are repeated, ascending.

    c, h, d, pos, new: the letters from each hit whose next anchor is a hit too, and whether one begins a string. f, gram, first, n: of each hit
    that owns strings of `length` bytes its place, k-gram, the start of the first such string and their number.
    """
    at, gram = text.at, text.gram
    joined = np.flatnonzero(np.diff(hits) == 1)
    first = hits[joined]
    a, b = text.base + at[first], text.base + at[first + 1] + p.k
    own = np.bincount(owners(at, gram, size, p), minlength=len(at))
    begin = np.cumsum(own) - own
    kept = hits[own[hits] > 0]
    return {
        "c": np.maximum(roller.spans(text.sums, a, b).view(np.int64), _END + 1), "h": other.spans(other_sums, a, b), "d": np.diff(at)[first], "pos": at[first], "new": np.concatenate([[True], np.diff(joined) != 1])[: len(joined)],
        "f": at[kept], "gram": gram[kept], "first": begin[kept], "n": own[kept],
    }


_PACKED = {"c": "<i8", "h": "<u8", "d": "<u2", "pos": "<i4", "new": "u1", "f": "<i4", "gram": "<i8", "first": "<i4", "n": "<u2"}


def strings(batch: pa.RecordBatch) -> Strings | None:
    """From the columns sid, c, h, d, pos and new (binaries of letters()) of some texts."""
    c, h, d, a, new = (_all_ints(batch.column(k), _PACKED[k])[0] for k in ("c", "h", "d", "pos", "new"))
    if not len(c):
        return None
    count = _all_ints(batch.column("c"), _PACKED["c"])[1]
    new = new > 0  # a text's first letter is
    run = np.cumsum(new) - 1
    where = np.arange(len(c)) + 4 * run
    n = len(c) + 4 * (run[-1] + 1)
    begin = where[new]
    own = np.searchsorted(begin, np.arange(n), side="right") - 1
    lengths = np.bincount(run)
    texts = np.append(where, n)[np.cumsum(count) - count]
    out = Strings(np.full(n, _END, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.arange(n) - begin[own], (begin + lengths)[own], np.empty(0, np.int64), batch.column("sid").to_numpy(), texts)
    out.c[where], out.h[where], out.d[where], out.pos[where] = c, h, d, a
    out.sample = np.flatnonzero((out.i % 3 != 0) & (out.i <= lengths[own] + 1))
    return out


def _named(s: Strings, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The places that have names, and these, from the columns places (within a text) and names."""
    places, count = _all_ints(batch.column("places"), "<i4")
    return places + np.repeat(s.begin, count), _all_ints(batch.column("names"), "<i8")[0]


def _ahead(s: Strings, at: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """Where the letters end that a comparison from each place needs: those that settle all strings that start before the next anchor."""
    reach = np.concatenate([[0], np.cumsum(s.d)])
    end = np.searchsorted(reach, reach[at] + s.d[at] + p.length - 1 - p.k, side="left")
    return np.minimum(end, s.stop[at]), end > s.stop[at]


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("tid"), text.alias("text"))


def _tidy(df: DataFrame, *old: DataFrame, batch: int | None = 1000) -> DataFrame:
    """df written and the tables it was made from removed. batch: the rows that Python gets at once, few as most hold a text or its strings; None: Spark's setting."""
    out = written(df, "suffixes", batch=batch)
    for o in old:
        remove_written(o)
    return out


def _before(df: DataFrame, order: list[str], weight: str, name: str) -> tuple[DataFrame, DataFrame]:
    """df (order unique) with `name`: the sum of weight over the rows before, by ranges; and the written table that this reads."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    first, run = [], 0
    for r in sorted(ranged.groupBy("_part").agg(F.sum(weight).alias("s")).collect(), key=lambda r: r["_part"]):  # a row per range
        first.append((r["_part"], run))
        run += r["s"]
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = df.sparkSession.createDataFrame(first or [(0, 0)], "_part int, _base long")
    out = ranged.withColumn(name, F.coalesce(F.sum(weight).over(w), F.lit(0))).join(F.broadcast(base), "_part")
    return out.withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base"), ranged


def _per_text(fn, schema: str):
    """A function for mapInArrow that gives fn(row) -> RecordBatch or None; row: the values by column name."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                out = fn(dict(zip(batch.schema.names, row, strict=True)))
                if out is not None and out.num_rows:
                    held.append(out)
                    size += out.nbytes
                if size > 1 << 20 or len(held) >= 1000:
                    yield _joined(held)
                    held, size = [], 0
        if held:
            yield _joined(held)

    return lean(run), schema


_LETTERS = 1 << 16  # that are laid out at once, but for a text of more


def _per_strings(fn, schema: str):
    """A function for mapInArrow that gives fn(Strings, RecordBatch) -> RecordBatch, for as many texts together as have some letters."""

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("new")).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _LETTERS, side="right")))
                some = batch.slice(lo, hi - lo)
                s = strings(some)
                if s is not None:
                    yield fn(s, some)
                lo = hi

    return lean(run), schema


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _bytes(v) -> np.ndarray:
    return np.frombuffer(v.as_buffer(), np.uint8)


def _ints(v, kind) -> np.ndarray:
    return np.frombuffer(v.as_buffer(), kind) if v.is_valid else np.empty(0, kind)


def _all_ints(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in all binaries of a column, end to end, and how many each has."""
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data, pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // data.itemsize


def _packed(df: DataFrame, key: str, place: str, value: str, name: str, kind: str) -> DataFrame:
    """For each key, its (place, value) rows in order of place as two packed arrays of 32 and 64 bits."""
    each = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).cast("int").alias("a"), F.col(value).cast(kind).alias("b")))).alias("x"))

    def run(batches):
        for batch in batches:
            places, values = [], []
            for x in batch.column(1):
                v = x.values
                places.append(v.field("a").to_numpy(zero_copy_only=False).astype("<i4").tobytes())
                values.append(v.field("b").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=[key, "places", name])

    return each.mapInArrow(lean(run), f"{key} long, places binary, {name} binary")


def suffix_names(base: DataFrame, p: RepeatParams) -> tuple[DataFrame, DataFrame, int]:
    """base: (sid, c, h, d, pos, new). sid, places, names: of each sample place of a text's strings its name, in the order of what the names stand for.
    Beside that the written table that this reads, and how many letters a name reaches.

    A name is 1 plus the number of places before it in order, so that a later round can name the places of a group apart. Names are
    sorted triples of letters; a place whose triple of names doesn't reach as far as its comparison goes into the next
    round, with names of three times the length.
    """

    def triples(s, _):
        q, text = s.sample, s.text(s.sample)
        end, ended = _ahead(s, q, p)
        more = ~ended & (end - q > 9)
        return pa.RecordBatch.from_arrays([pa.array(s.sid[text]), pa.array((q - s.begin[text]).astype(np.int32)), *(pa.array(s.c[q + j]) for j in range(3)), pa.array(more)], names=["sid", "q", "c0", "c1", "c2", "more"])

    keys = ["c0", "c1", "c2"]
    rows = _tidy(base.mapInArrow(*_per_strings(triples, "sid long, q int, c0 long, c1 long, c2 long, more boolean")))
    groups, ranged = _before(rows.groupBy(*keys).agg(F.count("*").alias("k")), keys, "k", "before")
    named = _tidy(rows.join(groups, keys).select("sid", "q", (F.col("before") + 1).alias("name"), "more"), ranged, rows)
    names, reach = _packed(named, "sid", "q", "name", "names", "long"), 3
    while not named.where("more").isEmpty():

        def again(s, batch, reach=reach):
            q, names = _named(s, batch)
            end, ended = _ahead(s, q, p)
            open_ = np.flatnonzero(~ended & (end - q > 3 * reach))
            n = _follow(s, q, names, reach)[:, open_]
            text = s.text(q[open_])
            more = ~ended[open_] & (end - q > 9 * reach)[open_]
            return pa.RecordBatch.from_arrays([pa.array(s.sid[text]), pa.array((q[open_] - s.begin[text]).astype(np.int32)), *(pa.array(v) for v in n), pa.array(more)], names=["sid", "q", "c0", "c1", "c2", "more"])

        rows = _tidy(base.join(names, "sid").mapInArrow(*_per_strings(again, "sid long, q int, c0 long, c1 long, c2 long, more boolean")))
        groups, ranged = _before(rows.groupBy(*keys).agg(F.count("*").alias("k")), keys, "k", "before")
        start = groups.groupBy("c0").agg(F.min("before").alias("start"))
        fresh = groups.join(start, "c0").select(*keys, (F.col("c0") + F.col("before") - F.col("start")).alias("name"))
        step = rows.join(fresh, keys).select("sid", "q", F.col("name").alias("new"), "more")
        both = named.select("sid", "q", "name").join(step, ["sid", "q"], "left")
        named = _tidy(both.select("sid", "q", F.coalesce("new", "name").alias("name"), F.coalesce("more", F.lit(False)).alias("more")), ranged, rows, named)
        names, reach = _packed(named, "sid", "q", "name", "names", "long"), 3 * reach
    return names, named, reach


def _follow(s: Strings, q: np.ndarray, names: np.ndarray, reach: int) -> np.ndarray:
    """The names at each place and `reach` and twice `reach` letters on; 0 past the string's sample."""
    dense = np.zeros(len(s.c) + 1, np.int64)
    dense[q] = names
    out = np.zeros((3, len(q)), np.int64)
    out[0] = names
    for j in (1, 2):
        to = q + j * reach
        ok = to < s.stop[q] + 2
        out[j, ok] = dense[to[ok]]
    return out


_ORDERED = "k1 long, k2 long, k3 long, k4 long, k5 long, sid long, pos int, ahead binary"


def _ordered_rows(kind: int, reach: int, p: RepeatParams):
    """Sort keys of the suffixes at places 1 and 2 (kind 0), at 0 and 1 (kind 1) and at 0 and 2 (kind 2), with the letters ahead."""

    def rows(s, batch):
        q, names = _named(s, batch)
        names = _follow(s, q, names, reach)
        at = q - kind
        ok = np.flatnonzero((s.i[q] >= kind) & (s.pos[at] >= 0))
        at, names = at[ok], names[:, ok]
        end, _ = _ahead(s, at, p)
        count = end - at
        flat = np.repeat(at - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        letters = np.empty(len(flat), _LETTER)
        letters["h"], letters["d"] = s.h[flat], s.d[flat]
        offsets = np.concatenate([[0], np.cumsum(count * _LETTER.itemsize)]).astype(np.int32)
        ahead = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
        none = np.zeros(len(at), np.int64)
        keys = {0: [*names, none, none], 1: [s.c[at], *names, none], 2: [s.c[at], s.c[at + 1], *names]}[kind]
        return pa.RecordBatch.from_arrays([*(pa.array(v) for v in keys), pa.array(s.sid[s.text(at)]), pa.array(s.pos[at].astype(np.int32)), ahead], names=["k1", "k2", "k3", "k4", "k5", "sid", "pos", "ahead"])

    return _per_strings(rows, _ORDERED)


def _shared(data: np.ndarray, lo: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Bytes that each of the rows (first letter, count) but the first shares with the row before it."""
    out = np.zeros(len(lo) - 1, np.int64)
    least = np.minimum(n[1:], n[:-1])
    on = np.flatnonzero(least > 0)
    t = 0
    while len(on):
        a, b = data[lo[on] + t], data[lo[on + 1] + t]
        on = on[(a["h"] == b["h"]) & (a["d"] == b["d"])]
        out[on] += data["d"][lo[on] + t]
        t += 1
        on = on[least[on] > t]
    return np.where(out > 0, out + k, 0)


def _compared(p: RepeatParams):
    """sid, pos, most and less: bytes that a suffix shares with its neighbours, and with those of lesser (sid, pos).

    Reads a sorted range, a batch at a time. Neighbours in two ranges aren't compared: what they share is left to the exact check.
    """

    def run(batches):
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = _joined([carry, batch])
            # the last two rows are met again: their neighbours may come with the next batch
            carry = batch.slice(max(0, batch.num_rows - 2))
            yield from _neighbours(batch, p, 1 if batch.num_rows > 2 else 0)
        if carry is not None:
            yield from _neighbours(carry, p, 0)

    return lean(run), "sid long, pos int, most int, less int"


def _neighbours(batch: pa.RecordBatch, p: RepeatParams, leave: int):
    ahead = batch.column(7)
    size = pc.binary_length(ahead).to_numpy(zero_copy_only=False).astype(np.int64) // _LETTER.itemsize
    data = np.frombuffer(b"".join(ahead.to_pylist()), _LETTER)
    lo = np.concatenate([[0], np.cumsum(size)[:-1]])
    r = _shared(data, lo, size, p.k)
    sid, pos = batch.column(5).to_numpy(), batch.column(6).to_numpy().astype(np.int64)
    up = (sid[1:] > sid[:-1]) | ((sid[1:] == sid[:-1]) & (pos[1:] > pos[:-1]))  # the row before is the lesser
    back, fore = np.concatenate([[0], r]), np.concatenate([r, [0]])
    most = np.maximum(back, fore)
    less = np.maximum(np.where(np.concatenate([[False], up]), back, 0), np.where(np.concatenate([~up, [False]]), fore, 0))
    ok = np.flatnonzero(most >= p.length)
    ok = ok[ok < len(most) - leave]
    yield pa.RecordBatch.from_arrays([pa.array(sid[ok]), pa.array(pos[ok].astype(np.int32)), pa.array(most[ok].astype(np.int32)), pa.array(less[ok].astype(np.int32))], names=["sid", "pos", "most", "less"])


def shared_lengths(base: DataFrame, p: RepeatParams) -> list[DataFrame]:
    """sid, pos, most, less for suffixes that share `length` bytes at least with a neighbour, from each of the three sorted lists."""
    names, named, reach = suffix_names(base, p)
    keys = ["k1", "k2", "k3", "k4", "k5", "sid", "pos"]
    both, parts = _tidy(base.join(names, "sid"), named), []
    for kind in range(3):
        rows = _tidy(both.mapInArrow(*_ordered_rows(kind, reach, p)))
        parts.append(_tidy(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(*_compared(p)), rows, batch=None))
    remove_written(both)
    return parts


def _mark(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    ok = hi > lo
    return np.cumsum(np.bincount(lo[ok], minlength=n + 1) - np.bincount(hi[ok], minlength=n + 1))[:n] > 0


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    e = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return e[0::2], e[1::2]


_ENDS = "sid long, gram long, f int, lo int, hi int, alo int, ahi int, sure binary"


def _ragged(p: RepeatParams):
    """What a text leaves open, by the own anchors of its strings: (gram, f) and the distances f - start of the strings.

    lo to hi spans the strings that may be repeated and aren't left to a lesser copy; alo to ahi (within) those that aren't settled, -1 if
    none. Beside these, one row of the text with the starts of its settled strings as runs.
    """

    def rows(row):
        f, gram, begin, count = (_ints(row[k], _PACKED[k]) for k in ("f", "gram", "first", "n"))
        f, begin, count = f.astype(np.int64), begin.astype(np.int64), count.astype(np.int64)
        top = row["size"].as_py() - p.length + 1
        pos, shared = _ints(row["places"], "<i4").astype(np.int64), _ints(row["shared"], "<i8")
        most, less = shared >> 32, shared & 0xFFFFFFFF
        sure = _mark(pos, np.minimum(pos + most - p.length + 1, top), top)
        # left to a copy by the last anchor before it alone: that leads to ever lesser copies, never round
        letter, d = _ints(row["pos"], "<i4"), _ints(row["d"], "<u2")
        nxt = pos + d[np.searchsorted(letter, pos)] if len(pos) else pos
        told = _mark(pos, np.minimum(np.minimum(pos + less - p.length + 1, top), nxt), top)
        window = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())
        open_ = ~told[window]
        keep, first = window[open_], np.repeat(np.arange(len(f)), count)[open_]
        new = np.flatnonzero(np.concatenate([[True], np.diff(first) != 0])) if len(keep) else np.empty(0, np.int64)
        own = first[new] if len(keep) else new
        last = np.append(new[1:], len(keep)) - 1 if len(keep) else new
        hi, lo = f[own] - keep[new] if len(keep) else new, f[own] - keep[last] if len(keep) else new
        asks = np.where(~sure[keep], f[first] - keep, -1)
        none = np.where(asks < 0, 2**30, asks)
        ahi = np.maximum.reduceat(asks, new) if len(keep) else new
        alo = np.where(ahi < 0, -1, np.minimum.reduceat(none, new)) if len(keep) else new
        s, e = _runs(sure)
        m = len(own)
        cols = [np.full(m + 1, row["sid"].as_py()), np.append(gram[own], 0), np.append(f[own], -1), np.append(lo, 0), np.append(hi, 0), np.append(alo, -1), np.append(ahi, -1)]
        blob = np.stack([s, e], axis=1).astype("<i4").tobytes()
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), *(pa.array(c.astype(np.int32)) for c in cols[2:]), pa.array([None] * m + [blob], pa.binary())], names=["sid", "gram", "f", "lo", "hi", "alo", "ahi", "sure"])

    return _per_text(rows, _ENDS)


_CONTEXT = "gram long, hot boolean, sid long, start int, n int, alo int, ahi int, context binary"


def _contexts(p: RepeatParams):
    """The bytes of the strings asked for: those that start at start .. start + n - 1; alo to ahi (relative, end exclusive) are asked."""

    def rows(row):
        x, e = row["text"].as_buffer(), row["ends"].values
        f, lo, hi, alo, ahi = (e.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("f", "lo", "hi", "alo", "ahi"))
        start, n = f - hi, hi - lo + 1
        asked = ahi >= 0
        data = [x[i : i + m - 1 + p.length].to_pybytes() for i, m in zip(start.tolist(), n.tolist(), strict=True)]
        ints = [start, n, np.where(asked, hi - ahi, 0), np.where(asked, hi - alo + 1, 0)]
        return pa.RecordBatch.from_arrays([e.field("gram"), e.field("hot"), pa.array(np.full(len(f), row["sid"].as_py())), *(pa.array(v.astype(np.int32)) for v in ints), pa.array(data, pa.binary())], names=["gram", "hot", "sid", "start", "n", "alo", "ahi", "context"])

    return _per_text(rows, _CONTEXT)


def _windows(batch: pa.RecordBatch, rollers: list[Roller], p: RepeatParams):
    """Of all strings of a batch of contexts: row, start in the joined contexts, start within the row, and their hashes."""
    n = batch.column(4).to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8)
    begin = np.concatenate([[0], np.cumsum(n + p.length - 1)[:-1]])
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    at = begin[row] + within
    return x, row, at, within, [r.spans(r.sums(x), at, at + p.length) for r in rollers]


def _asked(batch: pa.RecordBatch, row: np.ndarray, within: np.ndarray) -> np.ndarray:
    return (within >= batch.column(5).to_numpy()[row]) & (within < batch.column(6).to_numpy()[row])


def _met(batch: pa.RecordBatch, roller: Roller, p: RepeatParams) -> pa.RecordBatch:
    """sid, start and number of runs of asked strings of whole groups that another string of their group equals, byte for byte."""
    x, row, at, within, (h,) = _windows(batch, [roller], p)
    order = np.argsort(h)
    hs, ats = h[order], at[order]
    same = np.flatnonzero(hs[1:] == hs[:-1])
    equal, whole = np.zeros(len(same), bool), np.lib.stride_tricks.sliding_window_view(x, p.length)
    for lo in range(0, len(same), 1 << 14):
        s = same[lo : lo + (1 << 14)]
        equal[lo : lo + (1 << 14)] = (whole[ats[s]] == whole[ats[s + 1]]).all(axis=1)
    hit = np.zeros(len(order), bool)
    hit[order[same[equal]]] = hit[order[same[equal] + 1]] = True
    for s in np.flatnonzero(~equal):  # equal hashes of unequal strings: compare the whole group
        g = order[hs == hs[same[s]]]
        seen: dict[bytes, int] = {}
        for j in g.tolist():
            v = x[at[j] : at[j] + p.length].tobytes()
            if v in seen:
                hit[j] = hit[seen[v]] = True
            seen[v] = j
    hit &= _asked(batch, row, within)
    # runs of neighbouring strings of one context
    first = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1]]) & (within > 0)))
    last = np.flatnonzero(hit & ~(np.concatenate([hit[1:], [False]]) & np.concatenate([within[1:] > 0, [False]])))
    start = batch.column(3).to_numpy()[row[first]] + within[first]
    return pa.RecordBatch.from_arrays([pa.array(batch.column(2).to_numpy()[row[first]]), pa.array(start.astype(np.int32)), pa.array((last - first + 1).astype(np.int32))], names=["sid", "start", "k"])


def _compare_groups(p: RepeatParams):
    """Reads contexts sorted by k-gram and compares whole groups, a MB of them at a time: as arrays their strings take many times that."""

    def run(batches):
        roller, held, size = Roller(), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < 1 << 20:
                continue
            table = _joined(held)
            gram = table.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
            if cut:
                yield _met(table.slice(0, cut), roller, p)
            held = [table.slice(cut)]
            size = held[0].nbytes if cut else 0  # a group that fills it all: grow
        if held:
            yield _met(_joined(held), roller, p)

    return lean(run), "sid long, start int, k int"


def _by_hash(p: RepeatParams):
    """Strings of contexts as rows: two hashes, sid, start, and whether they are asked."""

    def run(batches):
        rollers = [Roller(), Roller(_OTHER)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                _, row, _, within, (h, g) = _windows(some, rollers, p)
                start = (some.column(3).to_numpy()[row] + within).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(some.column(2).to_numpy()[row]), pa.array(start), pa.array(_asked(some, row, within))], names=["h", "g", "sid", "start", "ask"])

    return lean(run), "h long, g long, sid long, start int, ask boolean"


def ragged_ends(texts: DataFrame, ends: DataFrame, p: RepeatParams) -> tuple[DataFrame, DataFrame]:
    """sid, start and k: runs of k strings that the suffix sort left open and that are repeated; and the written table that this reads."""
    stats = ends.where("f >= 0").groupBy("gram").agg(F.count("*").alias("m"), F.min(F.when(F.col("alo") >= 0, F.col("alo"))).alias("from"), F.max("ahi").alias("to")).where("m > 1 AND `to` >= 0")
    kept = ends.where("f >= 0").join(stats, "gram").withColumn("lo", F.greatest("lo", "from")).withColumn("hi", F.least("hi", "to")).where("lo <= hi")
    kept = kept.select("sid", F.struct("gram", (F.col("m") > p.most).alias("hot"), "f", "lo", "hi", "alo", "ahi").alias("e")).groupBy("sid").agg(F.collect_list("e").alias("ends"))
    contexts = _tidy(texts.select("sid", "text").join(kept, "sid").select("sid", "text", "ends").mapInArrow(*_contexts(p)))
    few = contexts.where("NOT hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(*_compare_groups(p))
    each = contexts.where("hot").mapInArrow(*_by_hash(p))
    twice = each.groupBy("h", "g").agg(F.count("*").alias("times"), F.max("ask").alias("asked")).where("times > 1 AND asked").select("h", "g")
    many = each.where("ask").join(twice, ["h", "g"]).select("sid", "start", F.lit(1).alias("k"))
    return few.unionByName(many), contexts


def _cover(p: RepeatParams):
    """The spans of bytes that repeated strings cover, from the runs of their starts."""

    def run(batches):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            out = []
            for sure, starts in zip(batch.column(1), batch.column(2), strict=True):
                s = _ints(sure, "<i4").reshape(-1, 2).astype(np.int64)
                own, k = (starts.values.field(c).to_numpy().astype(np.int64) if starts.is_valid else np.empty(0, np.int64) for c in ("start", "k"))
                a, b = np.concatenate([s[:, 0], own]), np.concatenate([s[:, 1], own + k]) - 1 + p.length
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order]) if len(order) else b
                new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]])) if len(a) else np.empty(0, np.int64)
                ends = b[np.append(new[1:], len(a)) - 1] if len(a) else b
                out.append([{"a": i, "b": j} for i, j in zip(a[new].tolist(), ends.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["sid", "spans"])

    return lean(run), "sid long, spans array<struct<a:int,b:int>>"


def distinct_texts(docs: DataFrame) -> DataFrame:
    """tid, sid (a number of its own), n_copies, n (bytes) and text of each distinct text, written."""
    one = _texts(docs).groupBy("tid").agg(F.count("*").alias("n_copies"), F.first("text").alias("text"))
    return _tidy(one.select("tid", F.monotonically_increasing_id().alias("sid"), "n_copies", F.octet_length("text").alias("n"), "text"))


def _spans(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """sid and spans of the texts that have repeated strings."""

    def grams(batches):
        roller = Roller()
        for batch in batches:
            own = [t.gram.view(np.int64) for t in anchored([t.as_py() for t in batch.column(1)], roller, p)]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*own, np.empty(0, np.int64)])))], names=["sid", "grams"])

    def packed(batches):
        roller, other = Roller(), Roller(_OTHER)
        for batch in batches:
            texts, buffer, sums, out = [t.as_py() for t in batch.column(1)], None, None, {k: [] for k in _PACKED}
            for text, data, hits in zip(anchored(texts, roller, p), texts, batch.column(2), strict=True):
                if text.buffer is not buffer:
                    buffer, sums = text.buffer, other.sums(text.buffer)
                own = letters(text, sums, len(data), _ints(hits, "<i4"), roller, other, p)
                for k, t in _PACKED.items():
                    out[k].append(own[k].astype(t).tobytes())
            size = pa.array([len(t) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, *(pa.array(v, pa.binary()) for v in out.values())], names=["sid", "size", *_PACKED])

    long = texts.where(F.col("n") >= p.length)
    own = _tidy(long.select("sid", "text").mapInArrow(lean(grams), "sid long, grams array<long>"))
    each = own.select("sid", F.posexplode("grams").alias("at", "gram"))
    often = _tidy(each.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram"))
    hits = _packed(each.join(often, "gram").select("sid", "at", F.lit(0).alias("none")), "sid", "at", "none", "nothing", "long").select("sid", F.col("places").alias("hits"))
    columns = ", ".join(f"{k} binary" for k in _PACKED)
    base = _tidy(long.select("sid", "text").join(hits, "sid").mapInArrow(lean(packed), f"sid long, size int, {columns}"), own, often)
    lists = shared_lengths(base.select("sid", "c", "h", "d", "pos", "new"), p)
    both = lists[0].unionByName(lists[1]).unionByName(lists[2]).groupBy("sid", "pos").agg(F.max("most").alias("most"), F.max("less").alias("less"))
    shared = _packed(both.select("sid", "pos", F.expr("shiftleft(cast(most AS long), 32) + less").alias("v")), "sid", "pos", "v", "shared", "long")
    ends = _tidy(base.join(shared, "sid", "left").mapInArrow(*_ragged(p)), *lists, base)
    found, contexts = ragged_ends(long, ends, p)
    starts = found.groupBy("sid").agg(F.collect_list(F.struct("start", "k")).alias("starts"))
    joined = ends.where("f < 0").select("sid", "sure").join(starts, "sid", "left").select("sid", "sure", "starts")
    return _tidy(joined.mapInArrow(*_cover(p)).where(F.size("spans") > 0), contexts, ends)


@scratch
def repeated_spans(docs: DataFrame, params: RepeatParams | None = None) -> DataFrame:
    """tid, n_copies, text and spans (array of start, end; null if none) of every distinct text. Real output of the operator."""
    ship(docs.sparkSession)
    p = params or RepeatParams()
    texts = distinct_texts(docs)
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    spans = F.when((F.col("n_copies") > 1) & (F.col("n") >= p.length), whole).otherwise(F.col("spans"))
    return texts.join(_spans(texts, p), "sid", "left").select("tid", "n_copies", "text", spans.alias("spans"))


@scratch
def repeats_digest(docs: DataFrame, params: RepeatParams | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of what stays, of every row."""

    def run(batches):
        for batch in batches:
            n, gone, count, kept = [], [], [], []
            for t, s in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, at, h = t.as_buffer(), 0, hashlib.sha256()
                for r in s or []:
                    h.update(data[at : r["a"]])
                    at = r["b"]
                h.update(data[at:])
                n.append(len(data))
                gone.append(sum(r["b"] - r["a"] for r in s or []))
                count.append(len(s or []))
                kept.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n, gone, count)), pa.array(kept)], names=["tid", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    digests = repeated_spans(docs, params).select("tid", "text", "spans").mapInArrow(lean(run), "tid binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _texts(docs).select("doc_id", "tid").join(_tidy(digests), "tid").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

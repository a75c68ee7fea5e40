"""Content hashes. A digest is the first 20 bytes of SHA-256, printed as 32 letters of Base32."""

from __future__ import annotations

import base64
import binascii
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.errors import Code, StrataError

DIGEST_BYTES = 20
NULL_VERSION = "A" * 32


def to_base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def from_base32(text: str) -> bytes:
    try:
        raw = base64.b32decode(text)
    except binascii.Error:
        raise StrataError(Code.INVALID_BASE32, text) from None
    if len(raw) != DIGEST_BYTES:
        raise StrataError(Code.INVALID_BASE32, text)
    return raw


def version_of(payload: bytes) -> str:
    return to_base32(hashlib.sha256(payload).digest()[:DIGEST_BYTES])


def content_hash(*cols: Column) -> Column:
    """Hex digest (40 letters) of values, each led by its length, so that neither null, '' nor a separator collides."""
    text = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols]
    return F.substring(F.sha2(F.concat(*text), 256), 1, 2 * DIGEST_BYTES)


def base32(hex_digest: Column) -> Column:
    """Base32 of a hex digest, from built-in functions: bits in fives through a lookup."""
    five = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda group: F.conv(F.substr(hex_digest, group * 5 + 1, F.lit(5)), 16, 10).cast("long"),
    )
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    pick = lambda v, shift: F.substr(F.lit(letters), (F.floor(v / F.lit(1 << shift)) % 32 + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(five, lambda v: F.concat(*[pick(v, s) for s in (15, 10, 5, 0)])), "")


def segment_hashes(df: DataFrame, key: str, values: list[str], per_segment: int = 4096) -> DataFrame:
    """segment, first_key, n, bytes, hash: a digest per run of `per_segment` keys, whatever files hold them.

    key is a whole number from 0 without gaps, so equal content gives equal segments.
    """
    row = content_hash(*[F.col(v) for v in values])
    size = sum((F.coalesce(F.octet_length(F.col(v).cast("string")), F.lit(0)) for v in values), F.lit(0))
    seg = df.select(F.floor(F.col(key) / per_segment).alias("segment"), F.col(key).alias("k"), row.alias("h"), size.alias("b"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda s: s["h"]), "")
    return seg.groupBy("segment").agg(F.min("k").alias("first_key"), F.count("*").alias("n"), F.sum("b").alias("bytes"), F.substring(F.sha2(ordered, 256), 1, 40).alias("hash"))


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a row: 60 bits of the hash of its keys, modulo `buckets`. Of two counts that divide, the lesser's buckets are unions of the greater's."""
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.col(f"`{k}`").cast("string") for k in keys]).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets)).cast("int")


def row_sums(*cols: Column) -> tuple[Column, Column]:
    """Two sums (120 bits) of the hashes of a group's rows: they add up, so no task gathers a group, and groups can be joined later."""
    digest = content_hash(*cols)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)"))
    return part(1).alias("s1"), part(16).alias("s2")


def bucket_sums(df: DataFrame, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    """bucket, n, s1, s2: the number and the hash sums of the rows of each bucket, whatever files hold them and in whatever order."""
    s1, s2 = row_sums(*[F.col(f"`{c}`") for c in keys + values])
    return df.groupBy(bucket_of(keys, buckets).alias("bucket")).agg(F.count("*").alias("n"), s1, s2)


def bucket_hashes(df: DataFrame, keys: list[str], values: list[str], buckets: int = 256) -> DataFrame:
    """bucket, n, hash: a digest per hash bucket of keys, independent of row order."""
    return bucket_sums(df, keys, values, buckets).select("bucket", "n", F.concat_ws(":", "n", "s1", "s2").alias("hash"))


def chunk_bounds(data, mean_bits: int = 12, window: int = 256, most: int = 32768) -> list[tuple[int, int]]:
    """Content-defined chunks: a boundary where a rolling hash of the last `window` bytes has mean_bits zero bits."""
    import numpy as np

    if not len(data):
        return []
    table = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    x = table[np.frombuffer(data, np.uint8)]
    n = len(x)
    powers = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        k = min(done, n - done)
        powers[done : done + k] = powers[:k] * np.uint64(step)
        step = step * step % 2**64
        done += k
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[::-1], dtype=np.uint64)])
    rolled = np.empty(0, np.uint64)
    if n >= window:  # the window's sum, times base**end so that only its bytes count
        rolled = (sums[window:] - sums[: n - window + 1]) * powers[: n - window + 1]
        rolled ^= rolled >> np.uint64(29)
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9)
    cuts = np.flatnonzero((rolled >> np.uint64(64 - mean_bits)) == 0) + window
    out, start = [], 0
    for c in [*cuts.tolist(), n]:
        while c - start > most:
            out.append((start, start + most))
            start += most
        if c > start:
            out.append((start, c))
            start = c
    return out


def chunks(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """keep, chunk_no, n_bytes, chunk_hash of the content-defined chunks of a binary or text column. One pass, no shuffle."""
    from strata.runtime import ship

    ship(df.sparkSession)
    rows = df.select(*keep, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            at, no, size, digest = [], [], [], []
            for i, v in enumerate(batch.column(batch.num_columns - 1)):
                data = v.as_buffer()
                bounds = chunk_bounds(data)
                at += [i] * len(bounds)
                no += range(len(bounds))
                size += [b - a for a, b in bounds]
                digest += [hashlib.sha256(data[a:b]).hexdigest()[:40] for a, b in bounds]
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(no, pa.int32()), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=[*batch.schema.names[:-1], "chunk_no", "n_bytes", "chunk_hash"])

    return rows.mapInArrow(run, f"{schema}, chunk_no int, n_bytes long, chunk_hash string")

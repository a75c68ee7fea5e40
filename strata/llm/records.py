"""Token ids in length-delimited binary records, with an offset index beside each file for shuffled reads.

A record is framed as length (u64), masked checksum of the length (u32), payload, masked checksum of the payload (u32), all
little-endian. The checksum is CRC-32, rotated right by 15 bits plus a constant, so that a checksum of bytes that hold
checksums isn't degenerate. The payload is a byte (0: ids of 2 bytes, 2: of 4 bytes; plus 1 if there is a doc_id), the
doc_id (i64), then the ids. The index holds a pair of u64 per record: its offset, and the number of ids before it in its
file; its last 24 bytes are the totals, a checksum and a magic number.

Files hold documents in ascending doc_id order, file after file: texts are range-partitioned and sorted, each task
encodes its part and writes one file under a name of its own, then renames it; a task that runs again writes the same bytes.

Encoding: byte-level BPE never joins across the pieces of its pre-tokenizer, so the ids of a text are those of its pieces
in a row. Each distinct piece is encoded once by the library's model and kept in a bounded cache. Texts with characters outside
the ranges listed below, or with the string of a special token, go to the library whole; so does every text if the tokenizer's
file has a normalizer, another pre-tokenizer, or a model that is not byte-level BPE without dropout.

Defined results: a null text is an empty text: its end id alone. A null doc_id sorts first and is read back as null. Repeated rows are
records of their own. Rows that share a doc_id, null too, stand in the order of their texts' hashes, then texts, and may lie in several
files. Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.runtime import filesystem, new_path, scratch, ship, written

#: The mask of TFRecord checksums, and how a record and an index end.
MASK = 0xA282EAD8
MAGIC = 0x5354524349445831
HEAD, DOC = struct.Struct("<QI"), struct.Struct("<Bq")
END_ID = 2
#: The pre-tokenizer's pattern, and characters whose classes are the same in every Unicode version.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OTHER = r"[^\t\n\r\x20-\x7E¡-ÿĀ-ɏ]"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(buffer, at: int) -> tuple[bytes, int]:
    """The payload of the record at an offset, and the next offset. Raises if a checksum differs."""
    n, check = HEAD.unpack_from(buffer, at)
    if masked(bytes(buffer[at : at + 8])) != check:
        raise ValueError(f"bad length checksum at {at}")
    a = at + HEAD.size
    payload = bytes(buffer[a : a + n])
    if len(payload) != n or masked(payload) != struct.unpack_from("<I", buffer, a + n)[0]:
        raise ValueError(f"bad payload checksum at {at}")
    return payload, a + n + 4


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: itself for a visible Latin-1 character, else the next unused from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


LETTERS = _byte_letters()


def by_pieces(settings: dict) -> bool:
    """Whether a tokenizer's file parts texts as PIECES does and encodes the pieces apart, by byte-level BPE."""
    pre, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    return (
        settings.get("normalizer") is None
        and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    )


class Encoder:
    """Ids of texts by the tokenizers library, piece by piece where that is exact."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.apart = by_pieces(json.load(f))
        self.model = self.tokenizer.model
        self.pieces = regex.compile(PIECES).findall
        self.other, self.uneven = re.compile(OTHER).search, re.compile(r"\s\s|^\s|\s\Z|[\t\r]").search
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces by the model alone, which spares the library's bookkeeping of offsets."""
        if len(self.cache) + len(pieces) > self.most:
            self.cache.clear()
        model, cache = self.model.tokenize, self.cache
        # a line feed parts the pieces: none that is learnt here in a row holds one
        rows = [p for p in pieces if "\n" not in p]
        lettered = dict(zip(rows, "\n".join(rows).encode().decode("latin-1").translate(LETTERS).split(LETTERS[10]), strict=True)) if rows else {}
        ids, counts = [], []
        for p in pieces:
            w = lettered.get(p) or p.encode().decode("latin-1").translate(LETTERS)
            own = [t.id for t in model(w)]
            ids += own
            counts.append(len(own))
        data, a = np.array(ids, "<u4").tobytes(), 0
        for p, n in zip(pieces, counts, strict=True):
            cache[p] = data[a : a + 4 * n]
            a += 4 * n

    def parted(self, text: str) -> list[str] | None:
        """Strings that the pre-tokenizer never joins, none for a text that the library has to part itself.

        Where white space is single spaces and newlines inside the text, those are the words with the white space before
        them, so the pattern isn't needed.
        """
        if not self.apart or self.other(text) or any(s in text for s in self.special):
            return None
        if self.uneven(text):
            return self.pieces(text)
        out = text.replace("\n", " \n").split(" ")
        out[0] = "\0" + out[0]  # no space before it; \0 is no plain character
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        out = []
        for t in texts:
            p = self.parted(t)
            by_space = bool(p) and p[0][:1] == "\0"
            out.append(self.whole(t) if p is None else self._join(p, self.words if by_space else self.cache, by_space))
        return out

    def _join(self, parts: list[str], known: dict[str, bytes], by_space: bool) -> bytes:
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            new = [p for p in dict.fromkeys(parts) if p not in known]
        if not by_space:
            self.learn(new)
            return b"".join([known[p] if p in known else self.whole(p) for p in parts])
        if len(known) + len(new) > self.most:
            for p in list(islice(known, len(known) // 2)):
                del known[p]
            new = [p for p in dict.fromkeys(parts) if p not in known]
        texts = [p[1:] if p[:1] == "\0" else p if p[:1] == "\n" else " " + p for p in new]
        pieces = [[t] if p.isalpha() else self.pieces(t) for p, t in zip(new, texts, strict=True)]  # letters alone are one piece
        unknown = list(set().union(*pieces).difference(self.cache))
        if unknown:
            self.learn(unknown)
        for p, own in zip(new, pieces, strict=True):
            known[p] = b"".join([self.cache[x] if x in self.cache else self.whole(x) for x in own])
        return b"".join(map(known.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process: what it has learnt serves later tasks as well."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_file(uri: str, records: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Writes uri.rec and uri.idx; the records and the ids in them."""
    fs, path = filesystem(uri)
    own = f"{path}.{uuid.uuid4().hex}"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    offsets, starts, at, ids = [], [], 0, 0
    with fs.open_output_stream(f"{own}.rec") as out:
        for doc_id, tokens in records:
            wide = np.frombuffer(tokens, "<u4")
            narrow = not len(wide) or wide.max() < 1 << 16
            data = frame(DOC.pack((0 if narrow else 2) + (doc_id is not None), doc_id or 0) + (wide.astype("<u2").tobytes() if narrow else tokens))
            out.write(data)
            offsets.append(at)
            starts.append(ids)
            at += len(data)
            ids += len(tokens) // 4
    body = np.array([offsets, starts], "<u8").T.tobytes()
    with fs.open_output_stream(f"{own}.idx") as out:
        tail = struct.pack("<QI", ids, masked(body))
        out.write(body + tail + struct.pack("<IQ", masked(tail), MAGIC))
    fs.move(f"{own}.rec", f"{path}.rec")
    fs.move(f"{own}.idx", f"{path}.idx")
    return len(offsets), ids


class RecordFile:
    """Records of one file by number, in any order."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        with self.fs.open_input_file(f"{self.path}.idx") as f:
            raw = f.read()
        body, tail, (check, magic) = raw[:-24], raw[-24:-12], struct.unpack("<IQ", raw[-12:])
        self.ids, own = struct.unpack("<QI", tail)
        if magic != MAGIC or masked(tail) != check or masked(body) != own:
            raise ValueError(f"bad index of {uri}")
        self.index = np.frombuffer(body, "<u8").reshape(-1, 2)

    def __len__(self) -> int:
        return len(self.index)

    def read(self, order: Iterable[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(ids before it in the file, doc_id, ids) of the records asked for, in that order."""
        with self.fs.open_input_file(f"{self.path}.rec") as f:
            size = f.size()
            for k in range(len(self)) if order is None else order:
                at = int(self.index[k, 0])
                end = int(self.index[k + 1, 0]) if k + 1 < len(self) else size
                f.seek(at)
                payload, _ = unframe(f.read(end - at), 0)
                kind, doc_id = DOC.unpack_from(payload)
                yield int(self.index[k, 1]), doc_id if kind & 1 else None, np.frombuffer(payload, "<u4" if kind & 2 else "<u2", offset=DOC.size).astype("<u4")


PARTS = "part int, path string, n_records long, n_ids long"


def write_records(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int | None = END_ID, file_bytes: int = 64 << 20) -> DataFrame:
    """Encodes docs (doc_id, text) into files under uri; one row per file, in order. Runs at once."""
    spark = docs.sparkSession
    ship(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(4 * spark.sparkContext.defaultParallelism, -(-total // file_bytes))
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]  # so that many rows of one doc_id, or of none, are dealt over several ranges
    placed = rows.withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("_tie")

    def run(batches):
        made, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        path = f"{uri}/part-{part:06d}"
        first = next(batches, None)
        if first is None or (first.num_rows == 0 and (first := next(batches, None)) is None):
            return

        def records():
            batch = first
            while batch is not None:
                for lo in range(0, batch.num_rows, 64):
                    some = batch.slice(lo, 64)
                    for doc_id, ids in zip(some.column(0).to_pylist(), made.encode_all(some.column(1).to_pylist()), strict=True):
                        yield doc_id, ids + end
                batch = next(batches, None)

        count, ids = write_file(path, records())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_records": [count], "n_ids": [ids]})

    return written(placed.mapInArrow(run, PARTS), "records")


def read_records(spark: SparkSession, parts: DataFrame) -> DataFrame:
    """doc_id, start (ids of all records before), n_tokens, ids_crc32 of every record of the files."""
    ship(spark)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = max(1, parts.count())
    files = parts.select("part", "path", before.alias("before")).repartitionByRange(n, "part")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows = [(doc_id, start + own, len(ids), zlib.crc32(ids)) for own, doc_id, ids in RecordFile(path).read()]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


@scratch
def records_digest(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    return read_records(spark, write_records(docs, tokenizer_path, new_path(spark, "token-records"), end_id))

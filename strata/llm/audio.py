"""Audio features: 8-bit PCM in WAV files, polyphase resampling, overlapped log-mel filterbanks, hysteresis segmentation.

The stored form is a RIFF/WAVE file of one channel of unsigned 8-bit samples, so any bytes are kept without loss. The
files are written to the shared folder, a binary column of a Parquet table, and the features are computed from what is read back from there,
over all samples:

* resampling by up/down with a Kaiser-windowed low-pass filter, split into `up` phases, each a plain dot product;
* frames of `frame` samples every `hop`, Hann window, real FFT, triangular mel filters, natural log;
* a frame is active from where its energy exceeds the upper threshold until it falls below the lower one.

The log-mel matrix is cut into tensors of one fixed shape (tensor_frames, n_mels), float32, the last one padded with the
log floor; each tensor and each active segment carries its time span in seconds. write_tensors() stores them as Arrow files of
the fixed-shape tensor type, a file for each task.

Defined results: a null payload is an empty one. Equal payloads give equal values. Repeated rows give repeated result
rows, a null doc_id stays null. Extra columns of the input are ignored. Each row is handled alone: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.runtime import filesystem, ship, written

UNIT = 64


@dataclass(frozen=True)
class AudioParams:
    rate: int = 12000
    up: int = 2
    down: int = 3
    taps: int = 16  # per phase
    frame: int = 200
    hop: int = 80
    n_fft: int = 256
    n_mels: int = 24
    tensor_frames: int = 64
    floor: float = 1e-6
    high: float = 0.5  # of the range between the quietest and the loudest frame
    low: float = 0.3
    min_frames: int = 3

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down

    @cached_property
    def phases(self) -> np.ndarray:
        """The low-pass filter as one row of taps for each of the `up` phases, for reversed input windows."""
        n = self.taps * self.up
        t = np.arange(n) - (n - 1) / 2
        cut = 1.0 / max(self.up, self.down)
        h = cut * np.sinc(cut * t) * np.kaiser(n, 8.0)
        h *= self.up / h.sum()
        return np.ascontiguousarray(h.reshape(self.taps, self.up).T[:, ::-1]).astype(np.float32)

    @cached_property
    def mel(self) -> np.ndarray:
        """Triangular filters over the FFT's bins, (n_fft//2+1, n_mels)."""
        to_mel = lambda f: 2595 * np.log10(1 + f / 700)
        edges = 700 * (10 ** (np.linspace(0, to_mel(self.out_rate / 2), self.n_mels + 2) / 2595) - 1)
        f = np.fft.rfftfreq(self.n_fft, 1 / self.out_rate)[:, None]
        lo, mid, hi = edges[:-2], edges[1:-1], edges[2:]
        return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)

    @cached_property
    def window(self) -> np.ndarray:
        return np.hanning(self.frame + 1)[:-1].astype(np.float32)


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def to_wav(samples: bytes, rate: int) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk; chunks are walked, none is assumed at a fixed place."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def resample(x: np.ndarray, p: AudioParams) -> np.ndarray:
    """Output sample m sits at input position m*down/up: phase (m*down) % up over the taps that end there."""
    n_out = -(-len(x) * p.up // p.down)
    half = p.taps // 2
    padded = np.concatenate([np.zeros(p.taps - 1 - half + 1, np.float32), x, np.zeros(half + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, p.taps)
    out = np.empty(n_out, np.float32)
    for r in range(min(p.up, n_out)):  # outputs r, r+up, ... share a phase and step `down` inputs
        first = r * p.down
        own = windows[first // p.up :: p.down][: -(-(n_out - r) // p.up)]
        out[r :: p.up] = own @ p.phases[first % p.up]
    return out


def log_mel(y: np.ndarray, p: AudioParams) -> np.ndarray:
    """(frames, n_mels); the last frame is zero-padded, so every sample is in one at least."""
    n = 1 + max(0, -(-(len(y) - p.frame) // p.hop))
    need = (n - 1) * p.hop + p.frame
    y = np.concatenate([y, np.zeros(need - len(y), np.float32)]) if need > len(y) else y
    frames = np.lib.stride_tricks.sliding_window_view(y, p.frame)[:: p.hop][:n]
    out = np.empty((n, p.n_mels), np.float32)
    for a in range(0, n, 1024):
        z = np.fft.rfft(frames[a : a + 1024] * p.window, p.n_fft)
        out[a : a + 1024] = np.log((z.real**2 + z.imag**2).astype(np.float32) @ p.mel + np.float32(p.floor))
    return out


def segments(mel: np.ndarray, p: AudioParams) -> list[tuple[int, int]]:
    """Active runs of frames [start, end): on above the upper threshold, off below the lower one."""
    energy = mel.mean(axis=1)
    lo, hi = float(energy.min()), float(energy.max())
    if hi - lo < 1e-3:
        return []
    mark = np.where(energy >= lo + p.high * (hi - lo), 1, np.where(energy < lo + p.low * (hi - lo), -1, 0))
    told = np.flatnonzero(mark)
    state = np.zeros(len(mark), bool)
    if len(told):
        last = np.searchsorted(told, np.arange(len(mark)), side="right") - 1
        state = np.where(last >= 0, mark[told[np.maximum(last, 0)]] > 0, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], state, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if b - a >= p.min_frames]


def features(samples: bytes, p: AudioParams) -> tuple[np.ndarray, list[tuple[int, int]]]:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, p), p)
    return mel, segments(mel, p)


def tensors(mel: np.ndarray, p: AudioParams) -> np.ndarray:
    """(k, tensor_frames, n_mels), padded with the log floor."""
    k = -(-len(mel) // p.tensor_frames)
    out = np.full((k * p.tensor_frames, p.n_mels), np.log(np.float32(p.floor)), np.float32)
    out[: len(mel)] = mel
    return out.reshape(k, p.tensor_frames, p.n_mels)


FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, media_sha256 string, n_frames int, "
    "tensors array<array<float>>, tensor_spans array<struct<start_s:double,end_s:double>>, segments array<struct<start_s:double,end_s:double>>"
)


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def stored_media(docs: DataFrame, params: AudioParams | None = None, payload_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and the WAV file of each row of docs, written."""
    ship(docs.sparkSession)
    p = params or AudioParams()

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc_id, payload in zip(batch.column(0), batch.column(1), strict=True):
                raw = payload.as_py() or b""
                rows.append((doc_id.as_py(), len(raw), to_wav(pad(raw), p.rate)))
                held += len(raw)
                if held > 8_000_000:
                    yield _media_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _media_batch(rows)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(run, MEDIA_SCHEMA), "media", "zstd")


def _media_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, sizes, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def audio_features(docs: DataFrame, params: AudioParams | None = None, payload_col: str = "text") -> DataFrame:
    """One row for each row of docs (doc_id, payload_col): the WAV file, its tensors and their time spans, active segments.

    Each of `tensors` is a flat fixed-shape tensor of tensor_frames * n_mels values; write_tensors() stores Arrow's type.
    """
    p = params or AudioParams()
    media = stored_media(docs, p, payload_col)
    size = p.tensor_frames * p.n_mels

    def run(batches):
        span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        step = p.hop / p.out_rate

        def emit(rows, values, counts):
            flat = np.concatenate(values) if values else np.empty(0, np.float32)
            inner = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, size, dtype=np.int32), pa.array(flat.ravel()))
            outer = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), inner)
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), None, span, span]
            arrays = [pa.array(c, k) for c, k in zip(cols[:8], kinds[:8], strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, outer, pa.array(cols[8], span), pa.array(cols[9], span)], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

        for batch in batches:
            rows, values, counts, held = [], [], [], 0
            for doc_id, n_bytes, stored in zip(*(batch.column(c) for c in range(3)), strict=True):
                media = stored.as_py()
                back = from_wav(media)
                mel, active = features(back, p)
                t = tensors(mel, p)
                at = [{"start_s": i * p.tensor_frames * step, "end_s": min((i + 1) * p.tensor_frames, len(mel)) * step} for i in range(len(t))]
                on = [{"start_s": a * step, "end_s": b * step} for a, b in active]
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), media, hashlib.sha256(media).hexdigest(), len(mel), at, on))
                values.append(t.reshape(-1))
                counts.append(len(t))
                held += len(media) + t.nbytes
                if held > 8_000_000:
                    yield emit(rows, values, counts)
                    rows, values, counts, held = [], [], [], 0
            if rows:
                yield emit(rows, values, counts)

    return media.mapInArrow(run, FEATURE_SCHEMA)


def write_tensors(features: DataFrame, uri: str, params: AudioParams | None = None) -> DataFrame:
    """Writes the tensors of audio_features() below uri as Arrow files: doc_id, start_s, end_s and log_mel, a fixed-shape tensor.

    Returns path, n_rows of each file; runs at once. Each task writes a file under a name of its own and then renames it, so a task that runs
    again leaves one file.
    """
    p = params or AudioParams()

    def run(batches):
        fs, root = filesystem(uri)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.arrow"
        own, n = f"{name}.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(own) as out:
            writer = None
            for batch in batches:
                table = tensor_table(pa.Table.from_batches([batch]), p)
                writer = writer or pa.ipc.new_file(out, table.schema)
                writer.write_table(table)
                n += len(table)
            if writer is not None:
                writer.close()
        if writer is None:
            fs.delete_file(own)
            return
        fs.move(own, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "n_rows": pa.array([n], pa.int64())})

    return written(features.select("doc_id", "tensor_spans", "tensors").mapInArrow(run, "path string, n_rows long"), "tensors")


def tensor_table(rows: pa.Table, params: AudioParams | None = None) -> pa.Table:
    """One row for each tensor of `rows` (collected or read from Parquet): doc_id, start_s, end_s, and Arrow's fixed-shape tensor."""
    p = params or AudioParams()
    ids, spans, flat = [], [], []
    for doc_id, at, values in zip(rows["doc_id"].to_pylist(), rows["tensor_spans"].to_pylist(), rows["tensors"], strict=True):
        for s, v in zip(at, values.values, strict=True):
            ids.append(doc_id)
            spans.append(s)
            flat.append(v.values.to_numpy())
    shape = (p.tensor_frames, p.n_mels)
    data = np.stack(flat).reshape(-1, *shape) if flat else np.empty((0, *shape), np.float32)
    kind = pa.fixed_shape_tensor(pa.float32(), shape)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(data.reshape(-1)), shape[0] * shape[1])
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "start_s": [s["start_s"] for s in spans], "end_s": [s["end_s"] for s in spans], "log_mel": pa.ExtensionArray.from_storage(kind, storage)})


def audio_digest(docs: DataFrame, params: AudioParams | None = None) -> DataFrame:
    """Sizes and hashes per document, and a feature string: frames, tensors, segments, active seconds, mean log-mel."""
    f = audio_features(docs, params)
    total = F.aggregate("tensors", F.lit(0.0), lambda s, t: s + F.aggregate(t, F.lit(0.0), lambda x, v: x + v.cast("double")))
    values = F.aggregate("tensors", F.lit(0), lambda s, t: s + F.size(t))
    active = F.aggregate("segments", F.lit(0.0), lambda s, x: s + (x["end_s"] - x["start_s"]))
    return f.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        "media_sha256",
        F.format_string("frames=%d;tensors=%d;segments=%d;active_s=%.4f;mean=%.3f", "n_frames", F.size("tensors"), F.size("segments"), active, total / values).alias("feature"),
    )

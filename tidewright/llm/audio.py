"""Audio columns: polyphase resampling, overlapped log-mel filterbanks and hysteresis energy segmentation.

The stored form of a row is a whole WAV file: a 44-byte RIFF header and one channel of unsigned 8-bit samples. Everything
after the encoder works on bytes read back from such files.

The frames of a file are stored as Arrow fixed-shape tensors of WINDOW frames by MELS bands, each with its time span; what
`query` tells of a document is read from these tensors and from the spans of the segmentation. `segments` gives the tensors
themselves, one row each; `tensor_table` gives such rows Arrow's tensor type again, which Spark's schemas do not have.

Defined cases: a null or empty text is a payload of blanks; repeated rows repeat; ids may be null; columns to keep may have any
name, also that of a result, which then follows them. Long payloads are worked through in blocks, so memory does not grow with
them beyond the payload and its tensors. Equal payloads give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import keeping, spread

#: Files whose tensors are one array.
FILES = 256
#: Payloads are padded with blanks to a positive multiple of this many bytes.
UNIT = 192
RATE, TARGET_RATE = 16_000, 8_000
FRAME, HOP, MELS = 256, 128, 20
#: Polyphase filter: taps of each phase.
TAPS = 12
#: A span opens at this log energy over the median of the file and stays open down to the second value.
OPEN_AT, CLOSE_AT = 0.6, 0.2
#: Frames of a tensor, and frames worked on at once.
WINDOW, BLOCK_FRAMES = 16, 4096
#: The value of a band in silence, which fills up the last tensor of a file.
SILENCE = np.float32(np.log(1e-3))


def padded(raw: bytes) -> bytes:
    """The payload: the bytes and blanks up to a positive multiple of UNIT."""
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def decode(media: bytes) -> tuple[memoryview, int]:
    """Samples and rate of such a file; chunks of other kinds are passed over."""
    view, at, rate = memoryview(media), 12, 0
    while at + 8 <= len(view):
        kind, size = struct.unpack_from("<4sI", view, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", view, at + 12)[0]
        if kind == b"data":
            return view[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _phases(up: int, down: int) -> np.ndarray:
    """A windowed-sinc low-pass, one row of taps for each of the `up` phases."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = np.sinc(t * cutoff) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, up).T[:, ::-1].astype(np.float32))


def resample(samples: np.ndarray, start: int, stop: int, up: int, down: int) -> np.ndarray:
    """Outputs start to stop of the rational resampler; samples outside the input are 0."""
    n = np.arange(start, stop)
    first, last = start * down // up - TAPS + 1, (stop - 1) * down // up + 1
    x = np.zeros(last - first, np.float32)
    lo, hi = max(first, 0), min(last, len(samples))
    if hi > lo:
        x[lo - first : hi - first] = samples[lo:hi]
        x[lo - first : hi - first] -= 128
    if up == 1:
        out = np.zeros(stop - start, np.float32)
        taps = _phases(up, down)[0]
        for k in range(TAPS):
            out += taps[k] * x[k : k + (stop - start - 1) * down + 1 : down]
        return out
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    return np.einsum("ij,ij->i", windows[n * down // up - TAPS + 1 - first], _phases(up, down)[n * down % up])


@lru_cache(maxsize=8)
def _mel(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Hann window and the triangular filters over the power spectrum."""
    def to_mel(f):
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(to_mel(60), to_mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int = RATE, target: int = TARGET_RATE) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (frames, MELS) of the resampled signal and the log energy of each frame."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    total = max(1, len(samples) * up // down)
    frames = 1 + max(0, -(-(total - FRAME) // HOP))
    window, filters = _mel(target)
    bands, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for lo in range(0, frames, BLOCK_FRAMES):
        hi = min(frames, lo + BLOCK_FRAMES)
        y = resample(samples, lo * HOP, (hi - 1) * HOP + FRAME, up, down)
        views = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        spectrum = np.fft.rfft(views, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        bands[lo:hi] = np.log(power @ filters + 1e-3)
        energy[lo:hi] = np.log(power.sum(axis=1) + 1e-3)
    return bands, energy


def spans(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that open above the upper threshold and last while above the lower one, both over the median."""
    level = energy - np.median(energy)
    low = level > CLOSE_AT
    edges = np.flatnonzero(np.diff(np.concatenate(([False], low, [False])).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    high = np.concatenate(([0], np.cumsum(level > OPEN_AT)))
    return [(int(a), int(b)) for a, b in zip(begin, end) if high[b] > high[a]]


def analyse(media: bytes) -> dict:
    """Everything that is computed from one stored file."""
    view, rate = decode(media)
    bands, energy = log_mel(np.frombuffer(view, np.uint8), rate)
    return {"payload": view, "rate": rate, "bands": bands, "energy": energy, "spans": spans(energy)}


def tensors(bands: list[np.ndarray]) -> tuple[pa.ExtensionArray, np.ndarray]:
    """The frames of some files as fixed-shape tensors, and the number of tensors of each."""
    count = np.array([-(-len(b) // WINDOW) for b in bands], np.int64)
    flat = np.full((int(count.sum()) * WINDOW, MELS), SILENCE)
    for start, b in zip((np.cumsum(count) - count) * WINDOW, bands):
        flat[start : start + len(b)] = b
    return _tensor_array(pa.array(flat.ravel())), count


def _tensor_array(values: pa.Array) -> pa.ExtensionArray:
    kind = pa.fixed_shape_tensor(pa.float32(), [WINDOW, MELS], dim_names=["frame", "mel"])
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(values, WINDOW * MELS))


def _feature(frames: np.ndarray, found: list[tuple[int, int]]) -> str:
    """A short text: frames, segments and their frames, first span in milliseconds, and the mean of every band."""
    ms = 1000 * HOP / TARGET_RATE
    first = "-".join(f"{t * ms:.0f}" for t in found[0]) if found else ""
    mean = ",".join(f"{x:.2f}" for x in frames.mean(axis=0, dtype=np.float64))
    return f"frames={len(frames)};segments={len(found)};active={sum(b - a for a, b in found)};first_ms={first};mel={mean}"


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, n_bytes (unpadded) and media, the WAV file of the padded text."""
    columns, names, schema = keeping(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                raw = [x.as_py() or b"" for x in part.column(len(keep)).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())],
                    names=[*names, "_bytes", "_media"],
                )

    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema + "_bytes long, _media binary").toDF(*keep, "n_bytes", "media")


_DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tensors int, tensors_sha256 string"
_SPANS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))


def digests(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media: str = "media") -> DataFrame:
    """One row for each stored file: sizes, digests of payload, file and tensors, the feature text, and the spans."""
    columns, names, schema = keeping(stored, keep)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), _SPANS]
    results = [c.split()[0] for c in _DIGESTS.split(", ")] + ["spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms = 1000 * HOP / TARGET_RATE
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part, rows = batch.slice(at, FILES), []
                files = part.column(len(keep)).to_pylist()
                found = [analyse(f) for f in files]
                array, count = tensors([f["bands"] for f in found])
                frames = array.to_numpy_ndarray().reshape(-1, MELS)
                for file, f, n, end in zip(files, found, count.tolist(), (np.cumsum(count) * WINDOW).tolist()):
                    own, payload = frames[end - n * WINDOW : end], f["payload"]
                    rows.append((
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(),
                        _feature(own[: len(f["bands"])], f["spans"]), n, hashlib.sha256(own.tobytes()).hexdigest(),
                        [{"start_ms": a * ms, "end_ms": b * ms} for a, b in f["spans"]],
                    ))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=[*names, *results])

    schema += _DIGESTS + ", spans array<struct<start_ms:double,end_ms:double>>"
    return stored.select(*columns, F.col(media).alias("_media")).mapInArrow(run, schema).toDF(*keep, *results)


def segments(stored: DataFrame, keep: tuple[str, ...] = ("doc_id",), media: str = "media") -> DataFrame:
    """One row for each tensor of a file: its number, start and end in ms, real frames, voiced ones, and its WINDOW * MELS values.

    The last tensor of a file is filled up with the value of silence.
    """
    columns, names, schema = keeping(stored, keep)
    results = ["window", "start_ms", "end_ms", "frames", "voiced_frames", "tensor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms = 1000 * HOP / TARGET_RATE
        for batch in batches:
            for k, value in enumerate(batch.column(len(keep))):
                found = analyse(value.as_py())
                n = len(found["bands"])
                array, (windows,) = tensors([found["bands"]])
                voiced = np.zeros(windows * WINDOW, np.int64)
                for a, b in found["spans"]:
                    voiced[a:b] = 1
                at = np.arange(windows)
                real = np.minimum(n - at * WINDOW, WINDOW)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(windows + 1) * WINDOW * MELS, pa.int32()), array.storage.flatten())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.concat_arrays([c.slice(k, 1)]).take(pa.array([0] * windows)) for c in batch.columns[: len(keep)]],
                        pa.array(at.astype(np.int32)), pa.array(at * WINDOW * ms), pa.array((at * WINDOW + real) * ms),
                        pa.array(real.astype(np.int32)), pa.array(voiced.reshape(windows, WINDOW).sum(axis=1).astype(np.int32)), flat,
                    ],
                    names=[*names, *results],
                )

    schema += "window int, start_ms double, end_ms double, frames int, voiced_frames int, tensor array<float>"
    return stored.select(*columns, F.col(media).alias("_media")).mapInArrow(run, schema).toDF(*keep, *results)


def tensor_table(rows: pa.Table, column: str = "tensor") -> pa.Table:
    """The same table with the column as Arrow's fixed-shape tensors of (WINDOW, MELS)."""
    flat = rows.column(column).combine_chunks()
    array = _tensor_array((flat.flatten() if len(flat) else pa.array([], pa.float32())).cast(pa.float32()))
    return rows.set_column(rows.schema.get_field_index(column), pa.field(column, array.type), array)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(store(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))

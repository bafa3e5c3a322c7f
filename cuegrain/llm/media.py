"""Operator 9: media columns: WAV bytes, short-time Fourier transforms and spectral-peak fingerprints.

A payload becomes an 8-bit mono WAV, losslessly, in a table of media. Fingerprints come from the stored
bytes, read by the wave module: the strongest bands of each frame are its peaks, and each peak is paired with peaks of
the frames that follow; a pair's code holds both bands and the distance, its time is the first frame.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.llm.common import cut

RATE = 8000
UNIT = 64
FRAME, HOP = 256, 128
#: For a payload of one FRAME at most, which has frames to pair only if they are shorter; they are transformed as FRAME samples.
SHORT_FRAME, SHORT_HOP = 16, 8
#: Bands of the spectrum; each frame gives one peak per band group that stands out.
GROUPS = ((1, 10), (10, 20), (20, 40), (40, 80), (80, 129))
#: Frames that a peak looks ahead.
AHEAD = 3
#: Frames transformed at a time. What a task holds beyond that grows with its longest text alone: its bytes and its pairs.
CHUNK = 4096
#: Texts, and bytes of them, handled together.
TEXTS, BYTES = 500, 32_000_000


def payload_of(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of UNIT."""
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


_WINDOWS = {n: np.hanning(n).astype(np.float32) for n in (FRAME, SHORT_FRAME)}


def peaks(samples: bytes) -> np.ndarray:
    """The strongest band of each group in each frame (frames x groups), -1 where it doesn't stand out from its frame."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    size, hop = (FRAME, HOP) if len(x) > FRAME else (SHORT_FRAME, SHORT_HOP)
    n = max(1, -(-(len(x) - size) // hop) + 1)
    x = np.pad(x, (0, (n - 1) * hop + size - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    out = np.empty((n, len(GROUPS)), np.int64)
    for i in range(0, n, CHUNK):
        level = np.abs(np.fft.rfft(frames[i : i + CHUNK] * _WINDOWS[size], FRAME, axis=1))
        mean = level.mean(axis=1, keepdims=True)
        for g, (lo, hi) in enumerate(GROUPS):
            band = level[:, lo:hi].argmax(axis=1)
            strong = level[np.arange(len(level)), lo + band] > mean[:, 0]
            out[i : i + CHUNK, g] = np.where(strong, lo + band, -1)
    return out


def fingerprints(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): pairs of peaks at most AHEAD frames apart; a code is band, later band and distance."""
    p = peaks(samples)
    times, codes = [], []
    for step in range(1, AHEAD + 1):
        a, b = p[:-step], p[step:]
        for g in range(len(GROUPS)):
            for h in (g, (g + step) % len(GROUPS)):  # the same group later, and another in turn
                t = np.flatnonzero((a[:, g] >= 0) & (b[:, h] >= 0))
                times.append(t)
                codes.append((a[t, g] << 10) | (b[t, h] << 2) | step)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order].astype(np.int32), code[order].astype(np.int32)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most TEXTS rows and about BYTES bytes in the column; one longer value is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == TEXTS or held + n > BYTES):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text, null as empty, as the bytes of a WAV. Other columns are not read; an empty table gives none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                data = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array([to_wav(payload_of(d)) for d in data], pa.binary())], names=["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, times, codes) read from the media column.

    times and codes are the fingerprint: the frame of each pair, and its code, in order of time and code.
    feature is its digest: the number of pairs and a hash of all times and codes. Equal media give equal
    values, repeated rows too; an empty table gives an empty result.
    """
    kind = media.schema["id"].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 2):
                rows: list[list] = [[] for _ in names[2:]]
                for stored in part.column(2).to_pylist():
                    payload, _ = from_wav(stored)
                    times, codes = fingerprints(payload)
                    mark = hashlib.blake2b(times.astype("<i4").tobytes() + codes.astype("<i4").tobytes(), digest_size=16).hexdigest()
                    for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(times)}:{mark}", times, codes), strict=True):
                        column.append(value)
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], names=names)

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, codes array<int>"
    return media.mapInArrow(run, schema)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """media_features of the media_column, which is written as a table and read back.

    A null text is an empty one, whose payload is one unit of zeros. Null ids are kept, repeated rows give
    equal values, very long texts are handled whole. Other columns are not read. An empty table gives none.
    """
    return media_features(cut(media_column(docs, id_col, text_col), "media"))

"""Uncompressed WAV and AIFF files to blocks of mono samples."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_SAMPLES = 65_536
#: Uncompressed AIFF codecs and whether they are little-endian.
AIFF_CODECS = {b"NONE": False, b"twos": False, b"sowt": True}


class Unreadable(ValueError):
    """A file that is no uncompressed WAV or AIFF."""


def _chunks(data: bytes, order: str) -> dict[bytes, bytes]:
    """The chunks of a RIFF or IFF file, the first of each name; a cut last one counts as far as it goes."""
    found: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack(order + "I", data[at + 4 : at + 8])[0]
        found.setdefault(name, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def extended_rate(raw: bytes) -> int:
    """The 80-bit rate of an AIFF file, rounded."""
    exponent, mantissa = struct.unpack(">hQ", raw[:10])
    return round(math.ldexp(mantissa, (exponent & 0x7FFF) - 16383 - 63))


def to_float(raw: bytes, bits: int, channels: int, little: bool, unsigned8: bool) -> np.ndarray:
    """Mono samples in [-1, 1): channels averaged, a partial last frame dropped."""
    width = bits // 8
    if bits not in (8, 16, 24, 32) or channels < 1:
        raise Unreadable(f"{bits}-bit samples in {channels} channels")
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if bits == 8:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) - 128 if unsigned8 else np.frombuffer(raw, np.int8).astype(np.float64)
    elif bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        b = b if little else b[:, ::-1]
        x = (np.pad(b, ((0, 0), (1, 0))).copy().view("<i4")[:, 0] >> 8).astype(np.float64)
    else:
        x = np.frombuffer(raw, f"{'<' if little else '>'}i{width}").astype(np.float64)
    return (x / 2 ** (bits - 1)).reshape(-1, channels).mean(axis=1).astype(np.float32)


def read_audio(data: bytes) -> tuple[str, int, int, int, np.ndarray]:
    """Container, rate, channels, bits, samples. The first bytes, not the name, tell the container."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        parts = _chunks(data, "<")
        if b"fmt " not in parts or b"data" not in parts or len(parts[b"fmt "]) < 16:
            raise Unreadable("no format or no samples")
        code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", parts[b"fmt "][:16])
        if code == 0xFFFE and len(parts[b"fmt "]) >= 26:
            code = struct.unpack("<H", parts[b"fmt "][24:26])[0]
        if code != 1:
            raise Unreadable(f"WAV format {code}")
        return "WAV", rate, channels, bits, to_float(parts[b"data"], bits, channels, True, True)
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        parts = _chunks(data, ">")
        if b"COMM" not in parts or b"SSND" not in parts or len(parts[b"COMM"]) < 18:
            raise Unreadable("no format or no samples")
        channels, _, bits = struct.unpack(">hIh", parts[b"COMM"][:8])
        codec = parts[b"COMM"][18:22] if data[8:12] == b"AIFC" else b"NONE"
        if codec not in AIFF_CODECS:
            raise Unreadable(f"AIFF codec {codec!r}")
        offset = struct.unpack(">I", parts[b"SSND"][:4])[0]
        return "AIFF", extended_rate(parts[b"COMM"][8:18]), channels, bits, to_float(parts[b"SSND"][8 + offset :], bits, channels, AIFF_CODECS[codec], False)
    raise Unreadable("neither WAV nor AIFF")


SCHEMA = "recording string, container string, rate int, channels int, bits int, block_no long, samples array<float>, error string"


def decode_audio(files: DataFrame, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """files (path, content) to rows of SCHEMA: a row per block, or one with an error for a file that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    container, rate, channels, bits, x = read_audio(bytes(content))
                    rows = [(path, container, rate, channels, bits, i // block_samples, x[i : i + block_samples], None) for i in range(0, max(1, len(x)), block_samples)]
                except (Unreadable, struct.error, OverflowError) as e:
                    rows = [(path, None, None, None, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """decode_audio of the files under path."""
    return decode_audio(spark.read.format("binaryFile").load(path))


def recordings(decoded: DataFrame) -> DataFrame:
    """(recording, container, rate, channels, bits, samples, duration) of the readable files."""
    good = decoded.where("error IS NULL").groupBy("recording", "container", "rate", "channels", "bits").agg(F.sum(F.size("samples")).alias("samples"))
    return good.withColumn("duration", F.col("samples") / F.col("rate"))

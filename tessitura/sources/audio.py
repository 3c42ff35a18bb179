"""WAV files -> hops, and settings as a table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a hop, hops that are read beyond the end, the lowest rate.
HOP, HANGOVER, LEAST_RATE = 512, 5, 8000
SETTINGS = {"username": "", "customization_theme": "light", "language": "english"}


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples in -1..1) of a RIFF WAVE file: 8, 16, 24 or 32-bit integers or 32-bit floats."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        chunk = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", chunk[:16])
            if fmt[0] == 0xFFFE:
                fmt = (struct.unpack("<H", chunk[24:26])[0], *fmt[1:])
        elif name == b"data":
            body = chunk
        at += 8 + size + size % 2
    if fmt is None or not body:
        raise ValueError("no samples")
    kind, channels, rate, _, _, bits = fmt
    if not channels:
        raise ValueError("no channels")
    if rate < LEAST_RATE:
        raise ValueError(f"rate {rate} is below {LEAST_RATE}")
    if kind == 3 and bits == 32:
        x = np.frombuffer(body, "<f4").astype(float)
    elif kind == 1 and bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) / 2**23 - 1.0
    elif kind == 1 and bits in (8, 16, 32):
        x = np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1) if bits > 8 else (np.frombuffer(body, np.uint8) - 128.0) / 128
    else:
        raise ValueError(f"format {kind} of {bits} bits")
    if len(x) % channels:
        raise ValueError("the last frame is not whole")
    return rate, x.reshape(-1, channels).mean(1)


def wav_hops(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(name, bytes) -> stream_id, hop_idx, sample_rate, samples, error: hops until HANGOVER hops beyond the end, zero-filled. A file that can't be read gives one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for stream, data in zip(batch["stream_id"], batch["data"], strict=True):
                try:
                    rate, x = decode(bytes(data or b""))
                except ValueError as e:
                    yield pd.DataFrame({"stream_id": [stream], "hop_idx": [None], "sample_rate": [None], "samples": [None], "error": [str(e)]})
                    continue
                n = -(-(len(x) + HANGOVER * HOP) // HOP)  # a frame begins at each; what follows the last is silent
                padded = np.concatenate([x, np.zeros(n * HOP - len(x))])
                for first in range(0, n, 256):
                    part = padded[first * HOP : (first + 256) * HOP].reshape(-1, HOP)
                    yield pd.DataFrame({"stream_id": stream, "hop_idx": range(first, first + len(part)), "sample_rate": rate, "samples": [p.tolist() for p in part], "error": None})

    return files.select(F.col(name).cast("string").alias("stream_id"), F.col(content).cast("binary").alias("data")).mapInPandas(run, "stream_id string, hop_idx bigint, sample_rate int, samples array<double>, error string")


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    return wav_hops(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path))


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """User settings of a JSON file; defaults for what is missing or can't be read."""
    try:
        rows = spark.read.option("mode", "FAILFAST").schema(", ".join(f"{k} string" for k in SETTINGS)).json(path).limit(1).collect()
    except Exception:  # noqa: BLE001  a missing or broken file means the defaults
        rows = []
    return SETTINGS | {k: v for k, v in (rows[0].asDict() if rows else {}).items() if v is not None}

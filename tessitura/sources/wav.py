"""WAV files as a Spark data source: a folder's files are read in byte ranges, so a long file lies in many tasks, in batch and as a stream.

``spark.dataSource.register(WavSource)``, then ``spark.read.format("wav").load(path)`` or ``spark.readStream.format("wav").load(path)``: rows stream_id (the
file), hop_idx, sample_rate, samples, error. A task finds the header of each of its files by itself and reads the hops that begin in its range; what lies
outside is never read. Files are reached with Arrow's file systems, so local, HDFS and S3 paths work alike.
"""

from __future__ import annotations

import re
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessitura.sources.audio import HANGOVER, HOP, LEAST_RATE
from tessitura.tables import stored

SCHEMA = "stream_id string, hop_idx bigint, sample_rate int, samples array<double>, error string"
#: Bytes of a range, hops of a batch, and seconds that a file must be left alone before a stream takes it.
RANGE_BYTES, BATCH_HOPS, SETTLED_S = 32 << 20, 512, 2.0
#: The size that writers give who don't know it: the data goes on to the file's end.
UNKNOWN = 0xFFFFFFFF


class Layout(NamedTuple):
    """Where a file's samples lie and how they are written."""

    rate: int
    channels: int
    kind: int  # 1 integers, 3 floats
    bits: int
    at: int
    frames: int

    @property
    def width(self) -> int:
        """Bytes of a frame of all channels."""
        return self.channels * self.bits // 8

    @property
    def hops(self) -> int:
        """A frame begins at each hop; some more follow the last sample, so that notes can end."""
        return -(-(self.frames + HANGOVER * HOP) // HOP)


def layout(file: pa.NativeFile, size: int) -> Layout:
    """Walks the chunks of a RIFF WAVE file by seeking; ValueError for what is not one, or can't be read."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    if size < 12 or (head := read(0, 12))[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= size and (form is None or data is None):
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            chunk = read(at + 8, min(length, 40))
            if len(chunk) < 16:
                raise ValueError("no format")
            form = struct.unpack("<HHIIHH", chunk[:16])
            if form[0] == 0xFFFE and len(chunk) >= 26:  # the true kind stands in the extension
                form = (struct.unpack("<H", chunk[24:26])[0], *form[1:])
        elif name == b"data":
            data = at + 8, min(length, size - at - 8) if length != UNKNOWN else size - at - 8
        at += 8 + length + length % 2
    if form is None or data is None or not data[1]:
        raise ValueError("no samples")
    kind, channels, rate, _, _, bits = form
    if not channels:
        raise ValueError("no channels")
    if rate < LEAST_RATE:
        raise ValueError(f"rate {rate} is below {LEAST_RATE}")
    if (kind, bits) not in {(1, 8), (1, 16), (1, 24), (1, 32), (3, 32)}:
        raise ValueError(f"format {kind} of {bits} bits")
    if data[1] // (bits // 8) % channels or (bits != 24 and data[1] % (bits // 8)):
        raise ValueError("the last frame is not whole")
    return Layout(rate, channels, kind, bits, data[0], data[1] // (bits // 8) // channels)


def mono(raw: bytes, form: Layout) -> np.ndarray:
    """Samples in -1..1, the mean of the channels."""
    if form.kind == 3:
        x = np.frombuffer(raw, "<f4").astype(float)
    elif form.bits == 8:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    elif form.bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0] / 2.0**31
    else:
        x = np.frombuffer(raw, f"<i{form.bits // 8}") / 2.0 ** (form.bits - 1)
    return x.reshape(-1, form.channels).mean(1)


@dataclass
class Stretch:
    """Bytes from ``low`` to ``high`` of a file of ``size``."""

    name: str
    path: str
    size: int
    low: int
    high: int


class Ranges(InputPartition):
    """What one task reads: a stretch of a long file, or several short files."""

    def __init__(self, stretches: list[Stretch]):
        self.stretches = stretches


def dealt(files: list[tuple[str, str, int]], most: int) -> list[Ranges]:
    """(name, path, size) of files as ranges of at most ``most`` bytes; short files share one."""
    out, room, shared = [], most, []
    for name, path, size in files:
        if size > most:
            out += [Ranges([Stretch(name, path, size, low, min(low + most, size))]) for low in range(0, size, most)]
            continue
        if size > room and shared:
            out.append(Ranges(shared))
            room, shared = most, []
        shared.append(Stretch(name, path, size, 0, size))
        room -= size
    return out + ([Ranges(shared)] if shared else [])


def _batch(name: str, first: int, rate: int, hops: np.ndarray) -> pa.RecordBatch:
    n = len(hops)
    samples = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * HOP, HOP), pa.int32()), pa.array(hops.reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(first, first + n), pa.int64()), pa.array([rate] * n, pa.int32()), samples, pa.nulls(n, pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])


def _failed(name: str, error: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64())), pa.array([error])], [c.split()[0] for c in SCHEMA.split(", ")])


def hops_in(fs: pyarrow.fs.FileSystem, s: Stretch) -> Iterator[pa.RecordBatch]:
    """The hops whose first byte lies in the stretch, those before the data in the stretch that the data begins in, those behind it in the file's last one. A file that can't be read is one row with an error, in its first stretch."""
    with fs.open_input_file(s.path) as file:
        try:
            form = layout(file, s.size)
        except (ValueError, struct.error) as e:
            if s.low == 0:
                yield _failed(s.name, str(e))
            return
        step = HOP * form.width
        first = max(0, -(-(s.low - form.at) // step))
        last = form.hops if s.high >= s.size else max(0, min(-(-(s.high - form.at) // step), form.hops))
        for begin in range(first, last, BATCH_HOPS):
            n = min(BATCH_HOPS, last - begin)
            frames = max(0, min(n * HOP, form.frames - begin * HOP))
            if frames:
                file.seek(form.at + begin * step)
            held = np.zeros(n * HOP)
            held[:frames] = mono(file.read(frames * form.width) if frames else b"", form)
            yield _batch(s.name, begin, form.rate, held.reshape(n, HOP))


def reached(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path's file system and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


class _Files:
    def __init__(self, options: dict[str, str]):
        self.uri, self.most = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def listed(self) -> list[pyarrow.fs.FileInfo]:
        fs, root = reached(self.uri)
        own = fs.get_file_info(root)
        found = [own] if own.type == pyarrow.fs.FileType.File else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        return sorted((f for f in found if f.type == pyarrow.fs.FileType.File and f.extension.lower() == "wav"), key=lambda f: f.path)

    def ranges(self, files: list[pyarrow.fs.FileInfo]) -> list[Ranges]:
        return dealt([(f.path, f.path, f.size) for f in files], self.most)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = reached(self.uri)
        for s in partition.stretches:
            yield from hops_in(fs, s)


class WavReader(_Files, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return self.ranges(self.listed())


class WavStreamReader(_Files, DataSourceStreamReader):
    """Files in the order of their modification times, each once. The offset is the time up to which all have been taken; a file counts when it has been left
    alone for SETTLED_S seconds, so put files in place whole (by a rename that gives them a new time)."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until_ns": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        settled = time.time_ns() - int(SETTLED_S * 1e9)
        return {"until_ns": max((f.mtime_ns for f in self.listed() if f.mtime_ns <= settled), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return self.ranges([f for f in self.listed() if start["until_ns"] < f.mtime_ns <= end["until_ns"]])

    def commit(self, end: dict) -> None:
        pass


class WavSource(DataSource):
    """Options: path; rangeBytes, the most bytes of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def streamReader(self, schema) -> WavStreamReader:  # noqa: N802
        return WavStreamReader(self.options)


def read_wav(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Hops of the WAV files of a folder, or of one file."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("rangeBytes", range_bytes).load(path)


def write_wavs(samples: DataFrame, path: str, rate: int, stream: str = "stream_id", order: str = "idx", value: str = "value") -> DataFrame:
    """Writes a 16-bit mono file per stream of (stream, order, integer value) rows below ``path``, a folder that all tasks reach; returns (stream, file, samples).
    A row's value may also be an array, of samples in a row; these are then shuffled and sorted as one piece of bytes.

    A stream's samples are sorted by Spark and written as they pass, so a task holds a batch. A file gets its name only when it is whole, and names come
    back only from tasks that finished, so a task that is run again leaves nothing half written behind. Null streams and values are left out; values are
    kept within 16 bits.
    """
    several = F.col(value) if samples.schema[value].dataType.typeName() == "array" else F.array(value)
    clean = samples.where(F.col(stream).isNotNull() & F.col(value).isNotNull()).select(F.col(stream).cast("string").alias("stream"), F.col(order).alias("at"), several.alias("values"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            valid = flat.is_valid().to_numpy(zero_copy_only=False)
            counts = np.concatenate([[0], np.cumsum(valid)])[ends - ends[0]]
            body = np.clip(np.nan_to_num(pc.cast(flat.drop_null(), pa.float64(), safe=False).to_numpy(), nan=32767.0), -32768, 32767).astype("<i2")
            data = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer((2 * counts).astype(np.int64)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data.cast(pa.binary())], ["stream", "at", "data"])

    bytes_ = stored(clean.mapInArrow(packed, f"stream string, at {clean.schema['at'].dataType.simpleString()}, data binary"), "wav-bytes")  # read for the sizes and for the files; made once
    sizes = bytes_.groupBy(F.col("stream").alias("s_stream")).agg((F.sum(F.length("data")) / 2).cast("bigint").alias("n")).where("n > 0")
    rows = bytes_.join(sizes, F.col("stream") == F.col("s_stream")).select("stream", "at", "data", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = reached(path)
        fs.create_dir(root, recursive=True)
        own, out, n, target, part = None, None, 0, "", ""

        def done() -> pa.RecordBatch:
            out.close()
            fs.move(part, target)
            return pa.RecordBatch.from_arrays([pa.array([own]), pa.array([target]), pa.array([n], pa.int64())], ["stream", "file", "samples"])

        for batch in batches:
            keys, data, counts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2), batch.column(3).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else [0]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if keys[low] != own:
                    if own is not None:
                        yield done()
                    own, n = keys[low], int(counts[low])
                    target = f"{root}/{''.join(c if c.isalnum() else f'%{ord(c):x}' for c in own)}.wav"
                    part = f"{target}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(part)
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + 2 * n, UNKNOWN), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", min(2 * n, UNKNOWN)))
                out.write(b"".join(data[low:high].to_pylist()))
        if own is not None:
            yield done()

    # by a hash: a repartition by the join's own key is taken out of the plan, and the adaptive planner then deals a stream of the join to several tasks
    return rows.repartition(F.xxhash64("stream")).sortWithinPartitions("stream", "at").mapInArrow(run, "stream string, file string, samples bigint")

"""The WAV data source: byte ranges against whole files, broken files, streams, and files that are written."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.sources import audio, wav


def riff(body, channels=1, bits=16, kind=1, rate=8000, before=b"", size=None, form=None):
    form = form or struct.pack("<HHIIHH", kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + before + b"data" + struct.pack("<I", len(body) if size is None else size) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


NOISE = np.random.default_rng(1).integers(-30000, 30000, 512 * 9 + 100)
EXTENDED = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 2, 8000, 8000 * 4, 4, 16, 22, 16, 3, 1, b"\0" * 14)
FILES = {
    "mono": riff(NOISE.astype("<i2").tobytes()),
    "stereo": riff(NOISE.astype("<i2").tobytes(), 2, before=b"LIST" + struct.pack("<I", 3) + b"abc\0"),
    "bytes": riff(((NOISE >> 8) + 128).astype(np.uint8).tobytes(), bits=8),
    "wide": riff(b"".join(int(v).to_bytes(3, "little", signed=True) for v in NOISE * 200), bits=24),
    "long": riff((NOISE * 60000).astype("<i4").tobytes(), bits=32),
    "float": riff((NOISE / 32768).astype("<f4").tobytes(), bits=32, kind=3),
    "extended": riff(NOISE.astype("<i2").tobytes(), 2, form=EXTENDED),
    "short": riff(b"\1\0"),
    "cut": riff(NOISE.astype("<i2").tobytes(), size=10**6),
}
BROKEN = {"none": b"", "text": b"hello, this is no file of sounds", "empty": riff(b""), "slow": riff(b"\1\0", rate=4000), "odd": riff(b"\1\0" * 3, 2), "law": riff(b"\1" * 8, bits=8, kind=7), "bare": b"RIFF\0\0\0\0WAVE", "mute": riff(b"\1\0", form=struct.pack("<HHIIHH", 1, 0, 8000, 1, 2, 16))}


def put(folder, files):
    for name, data in files.items():
        (folder / f"{name}.wav").write_bytes(data)


def name(path):
    return path.rsplit("/", 1)[1].removesuffix(".wav")


@pytest.mark.parametrize("most", [700, 4096, 1 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, most):
    put(tmp_path, {**FILES, **BROKEN})
    (tmp_path / "notes.txt").write_text("not read")
    got = {}
    for r in wav.read_wav(spark, f"file://{tmp_path}", most).collect():
        got.setdefault(name(r["stream_id"]), []).append(r)
    whole = {}
    for r in audio.wav_hops(spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")).collect():
        whole.setdefault(r["stream_id"], []).append(r)
    for k, rows in whole.items():
        rows, own = sorted(rows, key=lambda r: r["hop_idx"]), sorted(got[k], key=lambda r: r["hop_idx"])
        assert [r["hop_idx"] for r in own] == [r["hop_idx"] for r in rows] and {r["error"] for r in own} == {None}
        assert np.allclose([r["samples"] for r in own], [r["samples"] for r in rows]) and own[0]["sample_rate"] == rows[0]["sample_rate"]
    assert all(len(got[k]) == 1 and got[k][0]["error"] and got[k][0]["hop_idx"] is None for k in BROKEN) and len(got) == len(FILES) + len(BROKEN)


def test_an_hour_lies_in_many_tasks_and_short_files_share_one():
    hour = 44100 * 2 * 2 * 3600
    parts = wav.dealt([("a", "a", hour), *((str(i), str(i), 1000) for i in range(50))], wav.RANGE_BYTES)
    assert len(parts) == -(-hour // wav.RANGE_BYTES) + 1 and len(parts[-1].stretches) == 50
    assert [(s.low, s.high) for p in parts[:-1] for s in p.stretches] == [(low, min(low + wav.RANGE_BYTES, hour)) for low in range(0, hour, wav.RANGE_BYTES)]


def test_only_the_range_is_read(tmp_path):
    """The hops of a range come from seeks into it: a hole elsewhere in the file doesn't matter."""
    data = riff(NOISE.astype("<i2").tobytes())
    put(tmp_path, {"x": data})
    fs = wav.pa.fs.LocalFileSystem()
    third = wav.Stretch("x", str(tmp_path / "x.wav"), len(data), 3000, 6000)
    found = [i for b in wav.hops_in(fs, third) for i in b.column(1).to_pylist()]
    assert found == [k for k in range(10) if 3000 <= 44 + k * 1024 < 6000]


def test_written_files_come_back(spark, tmp_path):
    rows = [("b/c", 2, -40000), ("b/c", 1, 7), ("a", 5, 1), ("a", 4, None), (None, 1, 1), ("a", 1, 40000)]
    made = wav.write_wavs(spark.createDataFrame(rows, "stream_id string, idx int, value int"), f"file://{tmp_path}/out", 8000).collect()
    assert sorted((r["stream"], r["samples"]) for r in made) == [("a", 2), ("b/c", 2)]
    got = {name(r["stream_id"]): r["samples"][:2] for r in wav.read_wav(spark, f"{tmp_path}/out").where("hop_idx = 0").collect()}
    assert got == {"a": [32767 / 32768, 1 / 32768], "b%2fc": [7 / 32768, -1.0]}
    assert wav.write_wavs(spark.createDataFrame([], "stream_id string, idx int, value int"), f"file://{tmp_path}/none", 8000).count() == 0


@pytest.mark.parametrize("arrays", [False, True])
def test_a_file_is_written_by_one_task(spark, tmp_path, arrays):
    """Also when the samples lie in several tasks and the sizes are so few that the adaptive planner broadcasts them."""
    df = spark.range(0, 3_000_000, 1, 6).selectExpr("CAST(id % 3 AS string) AS stream_id", "id AS idx", "id % 1000 AS value")
    if arrays:
        df = df.withColumn("value", F.array("value", F.lit(None), F.lit(40000)))
    large = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760"}
    before = {k: spark.conf.get(k, None) for k in large}
    for k, v in large.items():  # as for large inputs: planned without broadcast, but when it runs, the sizes turn out small
        spark.conf.set(k, v)
    try:
        made = wav.write_wavs(df, f"file://{tmp_path}/out", 8000).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted((r["stream"], r["samples"]) for r in made) == [(k, 1_000_000 * (1 + arrays)) for k in "012"]
    for k in range(3):
        own = np.arange(k, 3_000_000, 3) % 1000
        _, x = audio.decode((tmp_path / "out" / f"{k}.wav").read_bytes())
        assert np.array_equal(np.round(x * 32768), np.stack([own, np.full(1_000_000, 32767)], 1).ravel() if arrays else own)


def test_stream_takes_each_file_once(spark, tmp_path):
    spark.dataSource.register(wav.WavSource)
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        stream = spark.readStream.format("wav").option("rangeBytes", 4096).load(str(source))
        stream.select("stream_id", "hop_idx").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination(120)

    put(source, {"mono": FILES["mono"]})
    time.sleep(wav.SETTLED_S + 0.1)
    run()
    put(source, {"short": FILES["short"]})
    time.sleep(wav.SETTLED_S + 0.1)
    run()
    run()
    got = spark.read.parquet(str(out)).collect()
    assert sorted((name(r["stream_id"]), r["hop_idx"]) for r in got) == [("mono", i) for i in range(15)] + [("short", i) for i in range(6)]

"""Streams whose frames come in any order against the batch, idle streams, and onsets frame by frame."""

import random

import pytest
from pyspark.sql import functions as F

from tessitura.operators import onsets, segmenters, transcribe
from tessitura.streaming import transcribe as streaming

FRAME = "stream_id string, ts_ms bigint, hz double, clarity double, dbfs double, onset_ms bigint, crest double, thump double, centroid double, is_silent boolean, novelty double"


def frames(seed, n):
    pick, rows = random.Random(seed), []
    for s in ("a", "b"):
        ts, hz = 100_000, 440.0
        for _ in range(n):
            ts += pick.choice([0, 20, 20, 20])
            hz = pick.choice([hz, hz, hz, 440.0, 523.25])
            rows.append((s, ts, hz, pick.choice([0.9, 0.9, 0.7, 0.2]), pick.uniform(-60, -5), ts if pick.random() < 0.1 else None, 9.0, -50.0, 900.0, pick.random() < 0.1, pick.choice([0.0, 0.1, 0.2, 5.0]) * pick.random()))
    return rows


def replay(spark, tmp_path, parts, machine, **options):
    """Each part of the rows as a micro-batch, then a frame far ahead that lets the watermark pass all others."""
    for i, part in enumerate([*parts, [("end", 10_000_000, 0.0, 0.0, -90.0, None, 0.0, 0.0, 0.0, True, 0.0)], [("end", 10_000_001, 0.0, 0.0, -90.0, None, 0.0, 0.0, 0.0, True, 0.0)]]):
        spark.createDataFrame(part, FRAME).coalesce(1).write.parquet(f"{tmp_path}/made/{i}")
    (tmp_path / "in").mkdir()
    for i in range(len(parts) + 2):
        for f in sorted((tmp_path / "made" / str(i)).glob("*.parquet")):
            f.rename(tmp_path / "in" / f"{i:03d}-{f.name}")
    source = streaming.frame_files(spark, str(tmp_path / "in"), FRAME, 1)
    query = streaming.transcribed_in_order(source, machine, **options).writeStream.format("memory").queryName("ordered").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "log")).start()
    assert query.awaitTermination(240)
    return spark.table("ordered").where("stream_id <> 'end'").collect()


def test_shuffled_frames_give_the_events_of_the_batch(spark, tmp_path):
    rows = frames(5, 150)
    by_time = sorted(rows, key=lambda r: r[1])
    cuts = [by_time[i : i + 100] for i in range(0, len(by_time), 100)]
    late = [cuts[i][5::10] for i in range(len(cuts))]  # some frames come a micro-batch late
    parts = [[r for r in cut if r not in late[i]] + (late[i - 1] if i else []) for i, cut in enumerate(cuts)] + [late[-1]]
    for part in parts:
        random.Random(6).shuffle(part)
    got = replay(spark, tmp_path, parts, segmenters.MonoSegmenter, lateness="60 seconds", idle_ms=500_000)
    want = transcribe.folded(spark.createDataFrame(rows, FRAME), segmenters.MonoSegmenter).collect()
    assert len(want) > 30 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_an_idle_stream_ends(spark, tmp_path):
    rows = [("a", 100_000 + 20 * i, 440.0, 0.95, -10.0, None, 9.0, -50.0, 900.0, False, 0.0) for i in range(30)]
    got = replay(spark, tmp_path, [rows], segmenters.MonoSegmenter, lateness="1 seconds", idle_ms=1000)
    assert [(r["kind"], r["midi"]) for r in sorted(got, key=lambda r: r["kind"], reverse=True)] == [("start", 69), ("end", 69)]
    assert next(r["duration_s"] for r in got if r["kind"] == "end") == pytest.approx(0.58)


def test_onsets_frame_by_frame_are_those_of_the_table(spark):
    rows = [(s, i, 1000 + 20 * i, random.Random(i * 7 + len(s)).choice([0.0, 0.1, 0.3, 4.0]), random.Random(i).uniform(-60, 0)) for s in ("x", "yy") for i in range(400)]
    df = spark.createDataFrame(rows, "stream_id string, frame_idx bigint, ts_ms bigint, novelty double, dbfs double")
    table = onsets.debounced(onsets.candidates(df, "stream_id", "frame_idx", "novelty", F.col("dbfs")), "stream_id", "ts_ms", 60)
    ring = transcribe.folded(df, onsets.OnsetRing)
    want = sorted((r["stream_id"], r["ts_ms"]) for r in table.collect())
    assert len(want) > 20 and sorted((r["stream_id"], r["strike_ms"]) for r in ring.collect()) == want

"""Sequential work dealt in blocks: filters, the onset debounce and segmenters give what one pass over a stream gives, and a stream lies in many tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import dsp
from tessitura.operators import onsets, segmenters, spectra, transcribe, windows

STREAMS = ["a", None, "b"]


@pytest.mark.parametrize("block", [1, 4, 256])
def test_filters_in_blocks_equal_one_pass(spark, block):
    rng = np.random.default_rng(block)
    rows = [(s, h, 8000, None if h == 4 else rng.normal(size=rng.integers(0, 90)).tolist(), "x") for s in STREAMS for h in range(1 if s == "b" else 23)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "stream_id string, hop_idx bigint, sample_rate int, samples array<double>, rate string")
    got = {(r["stream_id"], r["hop_idx"]): r for r in spectra.filtered(df, 200.0, 2000.0, block=block).collect()}
    assert len(got) == len(rows)
    for s in STREAMS:
        band, thump = dsp.band_pass(200.0, 2000.0, 8000), dsp.Biquad(*dsp.biquad("low", dsp.THUMP_HZ, 8000))
        for h, xs in sorted((r[1], r[3] or []) for r in rows if r[0] == s):
            level = None
            if h:
                low = thump(np.array(xs, float))
                level = 20 * np.log10(np.sqrt(low @ low / max(len(low), 1)) + 1e-9)
            want = dsp.cascade(band, np.array(xs, float))
            assert np.allclose(got[s, h]["samples"], want, atol=1e-9, rtol=0) and len(want) == len(got[s, h]["samples"])
            assert got[s, h]["thump_dbfs"] == (None if level is None else pytest.approx(level, abs=1e-9))
    assert spectra.filtered(df.limit(0), 200.0, 2000.0).count() == 0


def test_registers_after_silence_are_linear():
    stages = dsp.band_pass(100.0, 3000.0, 8000)
    state = np.array([0.3, -0.2, 0.5, 0.1])
    dsp.cascade(dsp.with_registers(stages, state), np.zeros(777))
    assert np.allclose(dsp.registers(stages), dsp.transition(stages, 777) @ state, atol=1e-12)


@pytest.mark.parametrize(("distance", "start", "block"), [(60, 0, 256), (300, 100, 256), (7, 0, 1 << 18), (0, -600, 100), (5000, 0, 64)])
def test_debounce_in_blocks_equals_one_pass(spark, distance, start, block):
    pick = random.Random(distance)
    rows = [(pick.choice(STREAMS), pick.choice([None, pick.randint(-500, 20000)]), 1) for _ in range(2000)]
    got = onsets.debounced(spark.createDataFrame(rows, "s string, t bigint, first int"), "s", "t", distance, start, block).collect()
    want = []
    for s in STREAMS:
        last = start
        for t in sorted(t for q, t, _ in rows if q == s and t is not None):
            if t > last + distance:
                want.append((s, t))
                last = t
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def frames(seed, n):
    """Frames of streams with notes, gaps and silence, two of them at one time now and then."""
    pick, rows = random.Random(seed), []
    for s in STREAMS:
        ts, hz = 1000, 440.0
        for _ in range(n):
            ts += pick.choice([0, 20, 20, 20, 20, 90])
            hz = pick.choice([hz, hz, hz, 440.0, 466.16, 523.25])
            rows.append((s, ts, hz, pick.choice([0.9, 0.9, 0.9, 0.7, 0.2]), pick.uniform(-60, -5), ts if pick.random() < 0.1 else None, pick.uniform(0, 20), -50.0, 900.0, pick.choice([True, False, False, False, None]), pick.random()))
    return rows


FRAME = "stream_id string, ts_ms bigint, hz double, clarity double, dbfs double, onset_ms bigint, crest double, thump double, centroid double, is_silent boolean, _salt double"


def hybrid(row):
    f = transcribe.plain(row)
    return f | {"energy": f["dbfs"], "nsdf": (f["clarity"], 0.0 if f["crest"] > 9 else 0.9), "keys": {69: (0.0, f["clarity"])}}


@pytest.mark.parametrize(("machine", "frame"), [(segmenters.MonoSegmenter, transcribe.plain), (segmenters.HybridSegmenter, hybrid)])
def test_runs_between_silences_give_the_events_of_one_pass(spark, monkeypatch, machine, frame):
    df = spark.createDataFrame(frames(3, 400), FRAME)
    cut = transcribe.folded(df, machine, frame=frame).collect()
    whole = transcribe.folded(df, type("Whole", (machine,), {"resets": False}), frame=frame).collect()
    assert len(cut) > 200 and sorted(map(repr, cut)) == sorted(map(repr, whole))
    assert transcribe.folded(df.limit(0), machine, frame=frame).count() == 0


def test_runs_are_numbered_across_blocks(spark):
    rows = frames(4, 300)
    got = transcribe.runs(spark.createDataFrame(rows, FRAME), block_ms=500).collect()
    by = {s: sorted((r["ts_ms"], r["_tie"], r["_run"], r["is_silent"]) for r in got if r["stream_id"] == s) for s in STREAMS}
    for found in by.values():
        silent = 0
        for _, _, run, quiet in found:
            assert run == silent
            silent += quiet is True
        assert len({run for _, _, run, _ in found}) > 30


def test_one_stream_lies_in_many_tasks(spark):
    """A stream of 200,000 frames: blocks and runs are dealt by hash, none of them holds a tenth of it."""
    df = spark.range(200_000).select(F.lit("s").alias("stream_id"), (F.col("id") * 20).alias("ts_ms"), (F.col("id") % 50 == 49).alias("is_silent"))
    assert transcribe.runs(df).groupBy("_run").count().agg(F.max("count")).first()[0] <= 50
    spread = windows.counted_before(df.withColumn("b", F.floor(F.col("ts_ms") / 65536)), "stream_id", "b", ["ts_ms"], F.col("is_silent"), "before")
    assert spread.where(F.col("before") != F.floor(F.col("ts_ms") / 1000)).count() == 0

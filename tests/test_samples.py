"""From samples to notes, log-mel contexts and the folds behind them, against whole-signal computation and loops."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import dsp
from tessitura.operators import notes, onsets, samples, spectra
from tessitura.sources import audio
from tests.test_scores import wav


def tone(n, hz=440.0, rate=44100):
    return 0.8 * np.sin(2 * np.pi * hz * np.arange(n) / rate)


def files(spark, **signals):
    return audio.wav_hops(spark.createDataFrame([(k, bytearray(wav(np.round(v * 32767)))) for k, v in signals.items()], "path string, content binary"))


def test_a_file_of_a4_gives_its_note(spark):
    still = np.zeros(4096)
    hops = files(spark, a4=np.concatenate([tone(8192), still]), two=np.concatenate([tone(12288), still, tone(12288, 659.26), still]), quiet=np.zeros(8192))
    rows = samples.notes(hops, "Piano").collect()
    starts = sorted((r["stream_id"], r["strike_ms"], r["midi"]) for r in rows if r["kind"] == "start")
    ends = sorted((r["stream_id"], r["strike_ms"], r["midi"]) for r in rows if r["kind"] == "end")
    assert [(s, m) for s, _, m in starts] == [("a4", 69), ("two", 69), ("two", 76)] and ends == starts
    assert all(0.1 < r["duration_s"] < 0.35 and abs(r["cents"]) <= 3 for r in rows if r["kind"] == "end")


def test_silence_and_missing_hops_give_no_notes(spark):
    hops = files(spark, quiet=np.zeros(4096))
    assert samples.notes(hops).count() == 0 and samples.notes(hops.limit(0)).count() == 0
    assert samples.notes(hops.withColumn("samples", F.lit(None).cast("array<double>"))).count() == 0


def test_mel_windows_do_not_depend_on_blocks(spark):
    x = np.random.default_rng(2).normal(0, 0.1, 512 * 120)
    hops = spark.createDataFrame([("s", i, 44100, x[i * 512 : i * 512 + 512].tolist()) for i in range(120)], "stream_id string, hop_idx bigint, sample_rate int, samples array<double>")
    own = {r["window"]: r["mel"] for r in samples.mel_windows(hops, block=32).collect()}
    n = int((len(x) * 16000 / 44100 - 2048) // 320) + 1
    values = samples.resampled_at(x, 0, 44100, 16000, np.arange((n - 1) * 320 + 2048))
    want = dsp.log_mel(np.stack([values[i * 320 : i * 320 + 2048] for i in range(n)]), dsp.mel_filters())
    assert sorted(own) == list(range(n)) and np.allclose(np.array([own[i] for i in range(n)]), want)
    contexts = samples.mel_contexts(samples.mel_windows(hops, block=32)).collect()
    by = {r["window"]: np.array(r["context"]).reshape(32, 229) for r in contexts}
    assert np.allclose(by[0][:31], np.log(1e-5)) and np.allclose(by[40][-1], want[40]) and np.allclose(by[40][0], want[9])
    loudest = samples.scored(samples.mel_contexts(samples.mel_windows(hops, block=32)), lambda c: [[(60, float(v[-1].max()), 0.5)] for v in c])
    assert {r["window"]: r["onset_p"] for r in loudest.collect()} == pytest.approx({i: want[i].max() for i in range(n)})


def test_resampling_keeps_a_tone():
    y = samples.resampled_at(tone(44100), 0, 44100, 16000, np.arange(2000, 6000))
    assert np.abs(y - 0.8 * np.sin(2 * np.pi * 440 * np.arange(2000, 6000) / 16000)).max() < 1e-3


def test_keys_have_their_share_of_loudness(spark):
    m = dsp.magnitudes(tone(1024))
    df = spark.createDataFrame([(m.tolist(), [69, 100])], "m array<double>, keys array<int>")
    got = df.select(samples.key_loudness(F.col("m"), F.col("keys"), 44100.0).alias("x")).first()["x"]
    assert got[69] == pytest.approx(dsp.note_loudness(m, 44100, 69)) and got[69] > got[100]


def test_one_spectrum_with_one_key_has_its_loudness(spark):
    m = dsp.magnitudes(tone(1024)).tolist()
    for asked in ([[69]], [[69], [], [69, 100], None]):
        df = spark.createDataFrame([(i, m, k) for i, k in enumerate(asked)], "i int, m array<double>, keys array<int>").coalesce(1)
        got = {r["i"]: r["x"] for r in df.select("i", samples.key_loudness(F.col("m"), F.col("keys"), 44100.0).alias("x")).collect()}
        assert [None if got[i] is None else sorted(got[i]) for i in range(len(asked))] == asked
        assert got[0][69] == pytest.approx(dsp.note_loudness(np.array(m), 44100, 69))


def test_debounce_and_islands_are_linear_and_right(spark):
    times = sorted(np.random.default_rng(3).integers(1, 10**6, 30_000).tolist())
    df = spark.createDataFrame([(k, t) for k in ("a", "b") for t in times], "s string, t bigint")
    kept, last = [], 0
    for t in times:
        if t > last + 60:
            kept.append(t)
            last = t
    got = onsets.debounced(df, "s", "t", 60).collect()
    assert sorted(r["t"] for r in got if r["s"] == "a") == kept and len(got) == 2 * len(kept) and onsets.debounced(df.limit(0), "s", "t", 60).count() == 0
    frames = spark.range(60_000).selectExpr("'k' AS k", "id AS i", "id * 20 AS ms", "CASE WHEN id % 7 < 4 THEN 0.9D ELSE 0.1D END AS p", "0D AS o")
    found = notes.islands(frames, ["k"], "i", "ms", "p", "o", 0.4, 0.5)
    assert found.where("note IS NOT NULL").select("note").distinct().count() == 60_000 // 7 + 1 and found.where("until < ms OR (p > 0.4 AND until - ms > 80)").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_heard_notes_are_those_that_were_played(spark):
    from tessitura.plans.machines import heard_notes

    sf = "/root/testdata/sf0.01"
    rows = heard_notes(spark, sf).where("kind = 'start'").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("strike_ms", "midi"))).getField("midi").alias("m")).collect()
    played = {}
    for r in spark.read.parquet(f"{sf}/supplier.parquet").orderBy("s_suppkey").collect():
        played.setdefault(r["s_nationkey"], []).append(r["s_suppkey"] % 24 + 57)
    assert {r["stream_id"]: r["m"] for r in rows} == played


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_tones_of_few_suppliers_lie_in_several_tasks(spark):
    from tessitura.plans.machines import _tones

    assert _tones(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_frames_do_not_depend_on_blocks_also_where_hops_are_missing(spark):
    x = np.random.default_rng(5).normal(0, 0.2, 512 * 60)
    hops = spark.createDataFrame([("s", i, 44100, x[i * 512 : i * 512 + 512].tolist()) for i in range(60) if i not in (16, 17, 33, 48)], "stream_id string, hop_idx bigint, sample_rate int, samples array<double>")
    sums = lambda frames, rate: {"first": frames[:, :512].sum(1), "second": frames[:, 512:].sum(1)}
    small, large = (sorted(spectra.measured_frames(hops, 27.5, 8000.0, sums, "first double, second double", block=b).collect(), key=lambda r: r["hop_idx"]) for b in (16, 4096))
    assert [r["hop_idx"] for r in small] == [i for i in range(60) if i not in (16, 17, 33, 48)]
    assert np.allclose([r["second"] for r in small[:-1]], [r["first"] for r in small[1:]]) and small[-1]["second"] == 0
    assert all(np.allclose([r[c] for r in small], [r[c] for r in large]) for c in ("first", "second", "thump_dbfs"))

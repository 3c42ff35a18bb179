"""From samples to notes: hops are filtered, framed and measured, and a segmenter hears the frames; and log-mel contexts for scorers of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import dsp
from tessitura.functions.profiles import POWER, profile
from tessitura.operators import onsets, spectra, windows
from tessitura.operators.segmenters import MonoSegmenter
from tessitura.operators.transcribe import folded
from tessitura.tables import stored

HEARD = "dbfs double, crest double, hz double, clarity double, centroid double, hfc double, first double, ratio double"
#: Contexts are windows of MEL_FFT samples every MEL_HOP at MEL_RATE, CONTEXT of them, padded with the log floor.
CONTEXT = 32
#: Taps on either side of a resampled value.
TAPS = 32


def heard(frames: np.ndarray, rate: int, instrument: str, silence_dbfs: float) -> dict[str, np.ndarray]:
    """What frames (rows) sound like, all at once: pitch and two strongest peaks only where they are loud."""
    p, n = profile(instrument), frames.shape[1]
    rms, peak = np.sqrt((frames**2).mean(1)), np.abs(frames).max(1)
    m = dsp.magnitudes(frames)
    bins, total = np.arange(m.shape[1]), m.sum(1)
    out = {c: np.zeros(len(frames)) for c in (x.split()[0] for x in HEARD.split(", "))}
    out["dbfs"] = 20 * np.log10(rms + 1e-9)
    out["crest"] = np.where((peak >= 1e-6) & (rms >= 1e-6), 20 * np.log10(np.maximum(peak, 1e-6) / np.maximum(rms, 1e-6)), 0.0)
    out["centroid"] = np.where(total > 1e-6, m @ bins * rate / n / np.maximum(total, 1e-6), 0.0)
    out["hfc"] = m**2 @ (bins + 1)
    loud = np.flatnonzero(~(out["dbfs"] < silence_dbfs))
    for i, d in zip(loud, dsp.differences(frames[loud]), strict=True):
        hz, clarity = (0.0, 0.0) if frames[i] @ frames[i] < POWER * n else dsp.key_maximum(d, rate, p["clarity"])
        if p["f0_min_hz"] <= hz <= p["f0_max_hz"]:
            out["hz"][i], out["clarity"][i] = hz, clarity
        out["first"][i], out["ratio"][i] = dsp.two_peaks(d, 8, min(510, n // 2 - 2))
    return out


def measured(hops: DataFrame, instrument: str = "Piano", silence_dbfs: float = -45.0, base_ms: int = 0) -> DataFrame:
    """hops (stream_id, hop_idx, sample_rate, samples) -> a row per frame: stream_id, hop_idx, ts_ms, dbfs, crest, thump, hushed, what was ``heard``, and
    candidate_ms, the time of the onset candidate that the frame confirms (three frames after it).

    The recursive filter, frames and what is heard in them are one step, dealt by stream and block; so is the onset window.
    """
    p = profile(instrument)
    df = spectra.measured_frames(hops.where("samples IS NOT NULL AND hop_idx IS NOT NULL"), p["hpf_hz"], p["ceiling_hz"], lambda frames, rate: heard(frames, rate, instrument, silence_dbfs), HEARD)
    at = windows.frame_time(F.lit(base_ms).cast("bigint"), F.col("hop_idx"), dsp.HOP, F.col("sample_rate")).alias("ts_ms")
    df = df.select("stream_id", "hop_idx", at, "dbfs", "crest", F.col("thump_dbfs").alias("thump"), (F.col("dbfs") < silence_dbfs).alias("hushed"), *(c.split()[0] for c in HEARD.split(", ")[2:]))
    side = onsets.SIDE
    spread = onsets.marked(windows.overlapped(df, "hop_idx", 2 * side, side), "stream_id", "hop_idx", "hfc", F.col("dbfs"))
    confirmed = F.lag(F.when(F.col("candidate"), F.col("ts_ms")), side).over(Window.partitionBy("stream_id", "block").orderBy("hop_idx"))
    return spread.withColumn("candidate_ms", confirmed).where("own").drop("block", "own", "candidate")


def notes(hops: DataFrame, instrument: str = "Piano", silence_dbfs: float = -45.0, base_ms: int = 0, distance_ms: int = 60) -> DataFrame:
    """Start and end events of one voice, from samples. A stream without hops gives none; hops without samples or index are left out.

    Onset candidates are accepted ``distance_ms`` apart, in blocks of time; a hushed frame ends all notes, so the runs between hushed frames are folded
    each on its own. No step takes a stream as one task's work.
    """
    frames = stored(measured(hops, instrument, silence_dbfs, base_ms), "heard-frames")  # read for the candidates and for the notes; made once
    accepted = onsets.debounced(frames.select("stream_id", "candidate_ms"), "stream_id", "candidate_ms", distance_ms)
    accepted = accepted.select(F.col("stream_id").alias("_stream"), F.col("candidate_ms").alias("onset_ms"))
    heard_ = frames.join(accepted, F.col("stream_id").eqNullSafe(F.col("_stream")) & (F.col("candidate_ms") == F.col("onset_ms")), "left").drop("_stream", "candidate_ms")
    return folded(heard_.withColumnRenamed("hushed", "is_silent"), lambda: MonoSegmenter(instrument))


def resampled_at(xs: np.ndarray, first: int, rate: int, to: int, at: np.ndarray) -> np.ndarray:
    """Values at the places ``at`` of rate ``to`` of a signal of which ``xs`` holds the samples from ``first`` on: a windowed sinc, the same wherever the
    signal is cut as long as TAPS samples (scaled by the rates) lie on either side; zeros beyond."""
    scale = max(1.0, rate / to)
    reach = int(np.ceil(TAPS * scale))
    place = at * (rate / to) - first
    near = np.floor(place).astype(int)[:, None] + np.arange(-reach, reach + 1)
    gap = (place[:, None] - near) / scale
    weight = np.sinc(gap) * np.where(np.abs(gap) < TAPS, 0.5 + 0.5 * np.cos(np.pi * gap / TAPS), 0.0) / scale
    held = np.where((near >= 0) & (near < len(xs)), xs[np.clip(near, 0, max(len(xs) - 1, 0))], 0.0)
    return (held * weight).sum(1)


def mel_windows(hops: DataFrame, stream: str = "stream_id", block: int = 256) -> DataFrame:
    """(stream, window, ts_ms, mel): log-mel vectors of windows of MEL_FFT samples that begin every MEL_HOP, at MEL_RATE.

    hops: stream, hop_idx from 0, sample_rate, samples, all of HOP samples. Windows begin anew with each stream; where silence starts them anew, a
    stream is a run of sounding hops. A stream is dealt in blocks of hops with the neighbours that its windows reach, so blocks are independent.
    """
    kind = hops.schema[stream].dataType.simpleString()
    reach = windows.overlapped(hops.where("samples IS NOT NULL"), "hop_idx", 4, 24, block)  # 24 hops hold a window at rates up to 96 kHz, 4 the taps

    def make(group: pa.Table) -> pa.Table:
        group = group.sort_by("hop_idx")
        index, rate, home = group.column("hop_idx").to_numpy(), group.column("sample_rate")[0].as_py(), group.column("block")[0].as_py()
        xs, first = np.concatenate([np.asarray(x, float) for x in group.column("samples").to_pylist()]), int(index[0]) * dsp.HOP
        to, whole = dsp.MEL_RATE, len(xs) + int(index[0]) * dsp.HOP
        low, high = home * block * dsp.HOP * to / rate, min((home + 1) * block * dsp.HOP, whole) * to / rate
        starts = np.arange(-(-low // dsp.MEL_HOP), -(-high // dsp.MEL_HOP)).astype(np.int64)
        starts = starts[starts * dsp.MEL_HOP + dsp.MEL_FFT <= whole * to / rate]
        if not len(starts):
            return pa.table({stream: group.column(stream)[:0], "window": pa.array([], pa.int64()), "ts_ms": pa.array([], pa.int64()), "mel": pa.array([], pa.list_(pa.float64()))})
        begin = int(starts[0]) * dsp.MEL_HOP
        values = resampled_at(xs, first, rate, to, np.arange(begin, int(starts[-1]) * dsp.MEL_HOP + dsp.MEL_FFT))
        held = np.lib.stride_tricks.sliding_window_view(values, dsp.MEL_FFT)[:: dsp.MEL_HOP]
        mel = dsp.log_mel(held, dsp.mel_filters())
        key = pa.array([group.column(stream)[0].as_py()] * len(starts), group.schema.field(stream).type)
        return pa.table({stream: key, "window": pa.array(starts), "ts_ms": pa.array(starts * dsp.MEL_HOP * 1000 // to), "mel": pa.array(mel.tolist(), pa.list_(pa.float64()))})

    return reach.select(stream, "block", "hop_idx", "sample_rate", F.col("samples").cast("array<double>").alias("samples")).groupBy(stream, "block").applyInArrow(make, f"{stream} {kind}, window bigint, ts_ms bigint, mel array<double>")


def mel_contexts(mels: DataFrame, stream: str = "stream_id") -> DataFrame:
    """(stream, window, ts_ms, context): each window with the 31 before it, oldest first, as one array of CONTEXT times MEL_BANDS values."""
    floor = float(np.log(dsp.MEL_FLOOR))
    spread = windows.overlapped(mels, "window", CONTEXT - 1, 0)
    seen = F.flatten(F.collect_list("mel").over(windows.within(stream, "window", CONTEXT - 1, 0)))
    padded = lambda c: F.concat(F.array_repeat(F.lit(floor), F.lit(CONTEXT * dsp.MEL_BANDS) - F.size(c)), c)
    return spread.withColumn("context", padded(seen)).where("own").select(stream, "window", "ts_ms", "context")


def key_loudness(magnitudes: Column, keys: Column, rate: float) -> Column:
    """map<int, double>: sones of each of the keys (array<int>) that sound or are open, by its share of the spectrum's loudness. Null for null spectra or keys."""

    @F.pandas_udf("array<double>")
    def apply(spectra_: pd.Series, wanted: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(spectra_)  # a Series would take an array of one value as that value
        rows = [i for i, (m, k) in enumerate(zip(spectra_, wanted, strict=True)) if m is not None and k is not None]
        sizes = np.array([len(spectra_.iloc[i]) for i in rows])
        for size in np.unique(sizes):  # spectra of one length go through together
            some = [i for i, n in zip(rows, sizes, strict=True) if n == size]
            asked = [np.asarray(wanted.iloc[i], int) for i in some]
            known = np.unique(np.concatenate(asked))
            sones = dsp.key_loudness(np.array([spectra_.iloc[i] for i in some], float).reshape(len(some), size), rate, known) if size and len(known) else np.zeros((len(some), len(known)))
            for i, row, k in zip(some, sones, asked, strict=True):
                out[i] = row[np.searchsorted(known, k)]
        return pd.Series(out, dtype=object)

    return F.map_from_arrays(keys, apply(magnitudes, keys))


def with_loudness(activations: DataFrame, spectra_: DataFrame, rate: float, frame_thr: float = 0.4, stream: str = "stream_id", order: str = "ts_ms") -> DataFrame:
    """activations (stream, time, keys: map of midi to (onset, frame)) with ``sones``, a map for the keys that are active or were in the frame before, from the
    spectra (stream, time, magnitudes) of the same times; null where there is no spectrum. Joined before a segmenter takes the frames."""
    index = F.floor(F.col(order)).cast("bigint")
    active = F.filter(F.map_keys("keys"), lambda k: F.element_at("keys", k)["frame"] >= frame_thr)
    before = F.lag(active).over(Window.partitionBy(stream, "_block").orderBy(order))
    spread = windows.overlapped(activations.withColumn("_at", index), "_at", 1 << 10, 0, 1 << 18).withColumnRenamed("block", "_block")  # a frame's predecessor lies at most a second back
    wanted = spread.withColumn("_keys", F.array_sort(F.array_union(active, F.coalesce(before, F.array().cast("array<int>"))))).where("own").drop("_at", "_block", "own")
    heard_ = spectra_.select(F.col(stream).alias("_stream"), F.col(order).alias("_time"), F.col("magnitudes").alias("_m"))
    joined = wanted.join(heard_, F.col(stream).eqNullSafe(F.col("_stream")) & (F.col(order) == F.col("_time")), "left")
    return joined.withColumn("sones", key_loudness(F.col("_m"), F.col("_keys"), rate)).drop("_stream", "_time", "_m", "_keys")


def scored(contexts: DataFrame, scorer, schema: str = "midi int, onset_p double, frame_p double", stream: str = "stream_id") -> DataFrame:
    """Key activations of contexts by a scorer: a function that takes an array (contexts, CONTEXT, MEL_BANDS) and gives, per context, a list of rows of
    ``schema``. The scorer is sent to the tasks; models are loaded by it there."""
    names, kind = [c.split()[0] for c in schema.split(", ")], contexts.schema[stream].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["context"].tolist(), float).reshape(-1, CONTEXT, dsp.MEL_BANDS)
            rows = [(key, w, ts, *row) for key, w, ts, found in zip(batch[stream], batch["window"], batch["ts_ms"], scorer(x), strict=True) for row in found]
            yield pd.DataFrame(rows, columns=[stream, "window", "ts_ms", *names])

    return contexts.mapInPandas(run, f"{stream} {kind}, window bigint, ts_ms bigint, {schema}")

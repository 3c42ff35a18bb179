"""DSP operators: pandas functions over batches of frames, and recursive filters dealt in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import dsp
from tessitura.operators import windows
from tessitura.tables import stored


def _mapped(kind: str, one):
    @F.pandas_udf(kind)
    def apply(frames: pd.Series) -> pd.Series:
        return frames.map(lambda x: None if x is None else one(np.asarray(x, float)))

    return apply


def magnitude_spectrum(frame: Column) -> Column:
    """Windowed magnitudes, half as many as samples; null and empty frames give null."""
    return _mapped("array<double>", lambda x: dsp.magnitudes(x).tolist() if len(x) else None)(frame)


def log_mel(frame: Column, bands: int = dsp.MEL_BANDS, rate: int = dsp.MEL_RATE) -> Column:
    def make(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        filters: dict[int, np.ndarray] = {}
        for batch in frames:
            yield batch.map(lambda x: None if x is None or not len(x) else dsp.log_mel(np.asarray(x, float), filters.setdefault(len(x), dsp.mel_filters(bands, len(x), rate))).tolist())

    make.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(make, "array<double>")(frame)


def polyphony(frame: Column) -> Column:
    """Strength of the first pitch and of the best unrelated one beside it."""

    @F.pandas_udf("clarity double, ratio double")
    def apply(frames: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(0.0, 0.0) if x is None else dsp.two_peaks(dsp.difference(np.asarray(x, float)), 8, min(510, len(x) // 2 - 2)) for x in frames], columns=["clarity", "ratio"])

    return apply(frame)


def pitch(frame: Column, rate: Column, clarity: float = 0.7, low: float = 0.0, high: float = float("inf")) -> Column:
    """McLeod pitch: hz and clarity, zeros where there is none or it lies outside the range."""

    @F.pandas_udf("hz double, clarity double")
    def apply(frames: pd.Series, rates: pd.Series) -> pd.DataFrame:
        found = [(0.0, 0.0) if x is None else dsp.mcleod(np.asarray(x, float), r, clarity) for x, r in zip(frames, rates, strict=True)]
        return pd.DataFrame([f if low <= f[0] <= high else (0.0, 0.0) for f in found], columns=["hz", "clarity"])

    return apply(frame, rate)


def bark_loudness(magnitudes: Column, rate: float) -> Column:
    """Total sones of a magnitude spectrum."""
    return _mapped("double", lambda x: float(dsp.specific_loudness(x, rate).sum()))(magnitudes)


def note_sones(magnitudes: Column, midi: Column, rate: float) -> Column:
    @F.pandas_udf("double")
    def apply(spectra: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else dsp.note_loudness(np.asarray(x, float), rate, int(k)) for x, k in zip(spectra, keys, strict=True)])

    return apply(magnitudes, midi)


def _filters(hpf_hz: float, ceiling_hz: float, rate: float) -> tuple[list[dsp.Biquad], list[dsp.Biquad]]:
    return dsp.band_pass(hpf_hz, ceiling_hz, rate), [dsp.Biquad(*dsp.biquad("low", dsp.THUMP_HZ, rate))]


def _dealt(hops: DataFrame, stream: str, block: int) -> DataFrame:
    kept = hops.select(stream, F.col("hop_idx").cast("bigint").alias("hop_idx"), F.col("sample_rate").cast("int").alias("sample_rate"), F.coalesce(F.col("samples").cast("array<double>"), F.array().cast("array<double>")).alias("samples"))
    return kept.where("hop_idx IS NOT NULL").withColumn("_block", F.floor(F.col("hop_idx") / block))


def _ends(dealt: DataFrame, hpf_hz: float, ceiling_hz: float, stream: str) -> DataFrame:
    """(stream, _block, rate, n, ends, first): what a block adds to empty registers, and its first hop's samples.

    What a hop makes of empty registers is found where the hop lies, so only these few numbers a hop are shuffled, and the samples of those that come first
    of their block among their batch.
    """
    key = f"`{stream}` {dealt.schema[stream].dataType.simpleString()}"

    def hop_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            names = batch.schema.names
            keys, blocks, index, rates = (batch.column(names.index(c)) for c in (stream, "_block", "hop_idx", "sample_rate"))
            lists = batch.column(names.index("samples"))
            at = lists.offsets.to_numpy().astype(np.int64)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), at - at[0]
            n, rate = np.diff(at), rates.to_numpy(zero_copy_only=False)
            found = np.zeros((len(n), 6))
            for r, size in set(zip(rate.tolist(), n.tolist(), strict=True)):
                if not size:
                    continue
                if (r, size) not in made:
                    band, thump = _filters(hpf_hz, ceiling_hz, r)
                    made[r, size] = np.concatenate([dsp.shares(band, size), dsp.shares(thump, size)], 1)
                rows = np.flatnonzero((rate == r) & (n == size))
                found[rows] = flat[at[rows][:, None] + np.arange(size)] @ made[r, size]
            least: dict[tuple, int] = {}
            places = index.to_pylist()
            for i, k in enumerate(zip(keys.to_pylist(), blocks.to_pylist(), strict=True)):
                if k not in least or places[i] < places[least[k]]:
                    least[k] = i
            chosen = np.zeros(len(n), bool)
            chosen[list(least.values())] = True
            shown = pc.if_else(pa.array(chosen), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([keys, blocks, index, rates, pa.array(n, pa.int64()), pa.array(list(found), pa.list_(pa.float64())), shown], [stream, "_block", "hop_idx", "rate", "n", "share", "samples"])

    def ends(group: pa.Table) -> pa.Table:
        """Of the thump's registers, also what the block adds without the first hop, which isn't heard where the stream begins."""
        group = group.sort_by("hop_idx")
        rate, sizes, added = group.column("rate")[0].as_py(), group.column("n").to_pylist(), np.array(group.column("share").to_pylist())
        band, thump = _filters(hpf_hz, ceiling_hz, rate)
        steps = {n: (dsp.transition(band, n), dsp.transition(thump, n)) for n in set(sizes)}
        of_band, of_thump, of_rest = np.zeros(4), np.zeros(2), np.zeros(2)
        for i, n in enumerate(sizes):
            of_band, of_thump = steps[n][0] @ of_band + added[i, :4], steps[n][1] @ of_thump + added[i, 4:]
            if i:
                of_rest = steps[n][1] @ of_rest + added[i, 4:]
        found = [*of_band, *of_thump, *of_rest]
        return pa.table({stream: group.column(stream)[:1], "_block": group.column("_block")[:1], "rate": group.column("rate")[:1], "n": pa.array([sum(sizes)], pa.int64()), "ends": pa.array([found], pa.list_(pa.float64())), "first": pa.array(group.column("samples")[:1].to_pylist(), pa.list_(pa.float64()))})

    each = dealt.mapInArrow(hop_shares, f"{key}, _block bigint, hop_idx bigint, rate int, n bigint, share array<double>, samples array<double>")
    return each.groupBy(stream, "_block").applyInArrow(ends, f"{key}, _block bigint, rate int, n bigint, ends array<double>, first array<double>")


def _entries(parts: DataFrame, hpf_hz: float, ceiling_hz: float, stream: str) -> DataFrame:
    """(stream, _block, entry): the registers with which each block begins."""

    def after(state: list[float] | None, row: dict) -> list[float]:
        added = np.array(row["ends"])
        if state is None:
            return [*added[:4], *added[6:8]]
        band, thump = _filters(hpf_hz, ceiling_hz, row["rate"])
        return [*(dsp.transition(band, row["n"]) @ state[:4] + added[:4]), *(dsp.transition(thump, row["n"]) @ state[4:] + added[4:6])]

    return windows.carried(parts.select(stream, "_block", "rate", "n", "ends"), stream, "_block", lambda: None, after, "array<double>")


def _passed(hops: list[np.ndarray], state: list[float] | None, hpf_hz: float, ceiling_hz: float, rate: int) -> tuple[list[np.ndarray], list[float | None]]:
    """Hops in a row band-passed from registers on (None: the stream's beginning), and the thump's level in each; it is heard from a stream's second hop on, the first that is new to a frame."""
    band, thump = _filters(hpf_hz, ceiling_hz, rate)
    if state is not None:
        dsp.with_registers(band, state[:4])
        dsp.with_registers(thump, state[4:])
    cuts = np.cumsum([0, *(len(x) for x in hops)])
    whole, skipped = np.concatenate([np.zeros(0), *hops]), cuts[1] if state is None else 0
    out, low = dsp.cascade(band, whole), np.concatenate([np.zeros(skipped), dsp.cascade(thump, whole[skipped:])])
    parts = [low[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    levels = [None if i == 0 and state is None else float(20 * np.log10(np.sqrt((x @ x) / max(len(x), 1)) + 1e-9)) for i, x in enumerate(parts)]
    return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], levels


def _hop_arrays(group: pa.Table) -> list[np.ndarray]:
    flat, ends = group.column("samples").combine_chunks(), group.column("samples").combine_chunks().offsets.to_numpy()
    return np.split(flat.values.to_numpy(zero_copy_only=False)[: ends[-1]], ends[1:-1]) if len(ends) > 1 else []


def filtered(hops: DataFrame, hpf_hz: float, ceiling_hz: float, stream: str = "stream_id", block: int = 256) -> DataFrame:
    """hops (stream, hop_idx, sample_rate, samples) with ``samples`` band-passed, and ``thump_dbfs``, the level below the thump's limit, null in a stream's first hop.

    A recursive filter carries its registers from hop to hop, but what a stretch of samples makes of them is linear in what they were. So a stream is dealt
    in blocks of ``block`` hops: what each makes of empty registers is found first, a row of six numbers a block gives the registers with which each one
    begins, and the blocks are filtered from these. A stream has one rate; hops without samples pass as empty ones.
    """
    dealt = _dealt(hops, stream, block)

    def run(group: pa.Table, entries: pa.Table) -> pa.Table:
        group = group.sort_by("hop_idx")
        samples, levels = _passed(_hop_arrays(group), entries.column("entry")[0].as_py(), hpf_hz, ceiling_hz, group.column("sample_rate")[0].as_py())
        return pa.table({stream: group.column(stream), "hop_idx": group.column("hop_idx"), "sample_rate": group.column("sample_rate"), "samples": pa.array(samples, pa.list_(pa.float64())), "thump_dbfs": pa.array(levels, pa.float64())})

    entries = _entries(_ends(dealt, hpf_hz, ceiling_hz, stream), hpf_hz, ceiling_hz, stream)
    key = f"`{stream}` {dealt.schema[stream].dataType.simpleString()}"
    return dealt.groupBy(stream, "_block").cogroup(entries.groupBy(stream, "_block")).applyInArrow(run, f"{key}, hop_idx bigint, sample_rate int, samples array<double>, thump_dbfs double")


def measured_frames(hops: DataFrame, hpf_hz: float, ceiling_hz: float, measure: Callable[[np.ndarray, int], dict[str, np.ndarray]], kind: str, stream: str = "stream_id", block: int = 256) -> DataFrame:
    """(stream, hop_idx, sample_rate, thump_dbfs, and the columns ``kind``): what ``measure`` makes of a block's frames (rows of two HOP) and their rate.

    A frame is a hop of ``filtered`` and the next one, zero-filled after the last; thump_dbfs is the level of its second hop. Filter, frames and measures are
    one step: samples are shuffled once. The hop behind a block comes with the block's registers.
    """
    dealt = _dealt(hops, stream, block)
    parts = stored(_ends(dealt, hpf_hz, ceiling_hz, stream), "registers")
    behind = parts.select(F.col(stream).alias("_stream"), F.col("_block").alias("_own"), F.lead("first").over(Window.partitionBy(stream).orderBy("_block")).alias("behind"))
    entries = _entries(parts, hpf_hz, ceiling_hz, stream).join(behind, F.col(stream).eqNullSafe(F.col("_stream")) & (F.col("_block") == F.col("_own"))).select(stream, "_block", "entry", "behind")
    fields = [c.split()[0] for c in kind.split(", ")]

    def run(group: pa.Table, entries: pa.Table) -> pa.Table:
        group = group.sort_by("hop_idx")
        n, rate, behind = len(group), group.column("sample_rate")[0].as_py(), entries.column("behind")[0].as_py()
        given = _hop_arrays(group) + ([] if behind is None else [np.array(behind, float)])
        passed, levels = _passed(given, entries.column("entry")[0].as_py(), hpf_hz, ceiling_hz, rate)
        held = np.zeros((n + 1, dsp.HOP))
        for i, x in enumerate(passed):
            held[i, : min(len(x), dsp.HOP)] = x[: dsp.HOP]
        found = measure(np.concatenate([held[:-1], held[1:]], 1), rate)
        newest = [*levels[1:], -180.0][:n]
        return pa.table({stream: group.column(stream), "hop_idx": group.column("hop_idx"), "sample_rate": group.column("sample_rate"), "thump_dbfs": pa.array(newest, pa.float64()), **{c: pa.array(found[c], pa.float64()) for c in fields}})

    key = f"`{stream}` {dealt.schema[stream].dataType.simpleString()}"
    return dealt.groupBy(stream, "_block").cogroup(entries.groupBy(stream, "_block")).applyInArrow(run, f"{key}, hop_idx bigint, sample_rate int, thump_dbfs double, {kind}")

"""Note segmentation by windows, and the derivation of start and end events from accumulated frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.functions import theory

#: Shorter notes are not reported; rises are at least this long.
LEAST_SECONDS, LEAST_RISE = 0.020, 0.005


def schmitt(on: Column, off: Column, over: Window) -> Column:
    """A switch that stays as it is between its thresholds; ``on`` wins; off at first."""
    return F.coalesce(F.last(F.when(on, True).when(off, False), ignorenulls=True).over(over), F.lit(False))


def pedal(frames: DataFrame, stream: str, index: str, frame_p: str = "frame_p", onset_p: str = "onset_p", offset_p: str = "offset_p") -> DataFrame:
    """Adds ``pedal``: on at frame >= .50 or onset >= .40, off at frame < .35 or offset >= .35."""
    w = Window.partitionBy(stream).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = (F.col(frame_p) >= 0.50) | (F.col(onset_p) >= 0.40)
    off = (F.col(frame_p) < 0.35) | (F.col(offset_p) >= 0.35)
    return frames.withColumn("pedal", schmitt(on, off, w))


def islands(activations: DataFrame, keys: list[str], index: str, time_ms: str, frame_p: str, onset_p: str, frame_thr: float, onset_thr: float) -> DataFrame:
    """Activation rows of every key with ``note``, the number of the note that a row starts or carries on (null in between), and ``until``, the time of the
    first later row that isn't carried on (null if the stream ends first).

    A note starts at an active row after an inactive one, or at an onset; a row below the frame threshold ends it and does not belong to it.
    """
    w = Window.partitionBy(*keys).orderBy(index)
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*keys).orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, -1)  # backwards, so that a row is one step
    active = F.coalesce(F.col(frame_p) >= frame_thr, F.lit(False))
    df = activations.withColumn("_active", active)
    before = F.coalesce(F.lag("_active").over(w), F.lit(False))
    df = df.withColumn("_start", F.col("_active") & (~before | (F.coalesce(F.col(onset_p), F.lit(0.0)) >= onset_thr)))
    df = df.withColumn("_no", F.sum(F.col("_start").cast("int")).over(running))
    ends = F.when(F.col("_start") | ~F.col("_active"), F.col(time_ms))
    return df.withColumn("until", F.last(ends, ignorenulls=True).over(later)).withColumn("note", F.when(F.col("_active"), F.col("_no"))).drop("_active", "_start", "_no")


def accumulated(rows: DataFrame, keys: list[str], index: str, time_ms: str, dbfs: str, cents: str, crest: str, thump: str, centroid: str, sones: str) -> DataFrame:
    """One row per note of ``islands``: onset values, peaks and averages over its rows. Average sones divide by all rows, with or without sones."""
    at = lambda c: F.min_by(c, index)
    notes = rows.where("note IS NOT NULL").groupBy(*keys, "note").agg(
        F.min(time_ms).alias("strike_ms"), F.min_by("until", F.struct(F.col(index) * -1)).alias("end_ms"), F.count(F.lit(1)).alias("n_frames"), F.max(dbfs).alias("peak_dbfs"), at(dbfs).alias("onset_dbfs"),
        F.round(F.sum(cents) / F.count(F.lit(1))).cast("int").alias("avg_cents"), (F.max(cents) - F.min(cents)).alias("cents_range"),
        at(crest).alias("crest"), at(thump).alias("thump"), F.avg(centroid).alias("centroid"), F.max(sones).alias("peak_sones"), (F.sum(sones) / F.count(F.lit(1))).alias("avg_sones"), at(sones).alias("onset_sones"),
    )
    return notes


def starts(notes: DataFrame) -> DataFrame:
    """Start events: dynamic from the onset's phons, else its level; velocity from level and crest."""
    phons = theory.sones_to_phons(F.col("onset_sones"))
    level = F.when(F.col("onset_sones").isNotNull(), theory.level_from_phons(phons)).otherwise(theory.level_from_dbfs(F.col("onset_dbfs")))
    return notes.withColumn("dynamic", level).withColumn("velocity", theory.midi_velocity(F.col("onset_dbfs"), F.col("crest")))


def ends(notes: DataFrame, profiles: DataFrame, instrument: str, legato: Column | None = None) -> DataFrame:
    """End events of closed notes of LEAST_SECONDS or more, classified by the instrument's profile."""
    chosen = profiles.where(F.col("instrument") == instrument)
    df = notes.where("end_ms IS NOT NULL").crossJoin(F.broadcast(chosen))  # one row
    p = {c: F.col(c) for c in ("stacc_max_s", "tenuto_min_s", "rise_max_s", "rise_min_slope", "mash_crest", "mash_thump")}
    seconds = (F.col("end_ms") - F.col("strike_ms")) / 1000.0
    rise = F.lit(LEAST_RISE)  # frames of activations record no rise of their own
    df = df.withColumn("note_duration", seconds).withColumn("rise", rise).withColumn("slope", F.abs(F.col("peak_dbfs") - F.col("onset_dbfs")) / F.col("rise"))
    df = df.withColumn("velocity", theory.midi_velocity(F.col("peak_dbfs"), F.col("crest")))
    level = F.when(F.col("peak_sones").isNotNull(), theory.level_from_phons(theory.sones_to_phons(F.col("peak_sones")))).otherwise(theory.level_from_dbfs(F.col("peak_dbfs")))
    df = df.withColumn("dynamic", level).withColumn("articulation", theory.articulation(seconds, F.lit(False) if legato is None else legato, F.col("slope"), F.col("rise"), F.col("crest"), F.col("velocity"), p))
    df = df.withColumn("is_mashed", theory.mashed(F.col("crest"), F.col("thump"), p)).withColumn("is_flat", F.col("avg_cents") <= F.col("flat_cents")).withColumn("damping", theory.damping(seconds, p))
    return df.where(F.col("note_duration") >= LEAST_SECONDS).drop(*chosen.columns)


def harmonic_sieve(frames: DataFrame, probabilities: str, decay: float = 0.0002, harmonics: int = 6, lowest: int = 21, bins: int = 88) -> DataFrame:
    """Adds ``sieved``: the probabilities with those bins at 0 whose strength a lower tone's overtones explain. A frame is its own row: no shuffle.

    The h-th harmonic of every key is a fixed number of semitones above it, so the leak into a bin is the largest over the harmonics of what the key so
    far below gives off.
    """
    above = [(h, round(12 * math.log2(h))) for h in range(2, harmonics + 1)]
    sources = [f"(if(b >= {up} AND get(_p, b - {up}) > 0.4D, get(_p, b - {up}) / {h**1.2!r}D * {1.0 - decay * h!r}D, 0D))" for h, up in above]
    leak = f"greatest(0D, {', '.join(sources)})"
    sieved = f"transform(_p, (p, b) -> if(b < {bins} AND {leak} > 0 AND p <= {leak} + 0.15D, 0D, p))"
    return frames.withColumn("_p", F.col(probabilities).cast("array<double>")).withColumn("sieved", F.expr(sieved)).drop("_p")

"""Per-frame features over array<double> columns, as higher-order functions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def loudness(samples: Column) -> Column:
    """dBFS of the root mean square; -180 for no samples."""
    mean = total(F.transform(samples, lambda x: x * x)) / F.greatest(F.size(samples), F.lit(1))
    return F.when(F.size(samples) > 0, F.lit(20.0) * F.log10(F.sqrt(mean) + F.lit(1e-9))).otherwise(-180.0)


def crest_factor(samples: Column) -> Column:
    """Peak over root mean square in dB; 0 where either is below 1e-6 or there are no samples."""
    peak = F.array_max(F.transform(samples, F.abs))
    rms = F.sqrt(total(F.transform(samples, lambda x: x * x)) / F.greatest(F.size(samples), F.lit(1)))
    return F.when((peak >= 1e-6) & (rms >= 1e-6), F.lit(20.0) * F.log10(F.greatest(peak, F.lit(1e-6)) / F.greatest(rms, F.lit(1e-6)))).otherwise(0.0)


def spectral_centroid(magnitudes: Column, hz_per_bin: Column | float) -> Column:
    step = F.lit(hz_per_bin) if isinstance(hz_per_bin, float | int) else hz_per_bin
    weight = total(magnitudes)
    return F.when(weight > 1e-6, total(F.transform(magnitudes, lambda x, i: x * i * step)) / F.greatest(weight, F.lit(1e-6))).otherwise(0.0)


def spectral_flatness(magnitudes: Column) -> Column:
    """Geometric over arithmetic mean of the power, within 0..1; 0 for a mean up to 1e-9."""
    power = F.transform(magnitudes, lambda x: F.greatest(x * x, F.lit(1e-12)))
    n = F.greatest(F.size(magnitudes), F.lit(1))
    mean = total(power) / n
    ratio = F.exp(total(F.transform(power, F.ln)) / n) / F.greatest(mean, F.lit(1e-12))
    return F.when(mean > 1e-9, F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def high_frequency_content(magnitudes: Column) -> Column:
    return total(F.transform(magnitudes, lambda x, i: (i + 1) * x * x))


def spectral_flux(magnitudes: Column, before: Column) -> Column:
    """Sum of the rises since the frame before; a missing frame counts as zeros."""
    zeros = F.transform(magnitudes, lambda x: F.lit(0.0))
    return total(F.zip_with(magnitudes, F.coalesce(before, zeros), lambda a, b: F.greatest(F.lit(0.0), a - b)))


def scaled_pcm(samples: Column, bits: int) -> Column:
    """Integer PCM to -1..1: 8, 16, 24 or 32 bits."""
    return F.transform(samples, lambda x: x / F.lit(float(1 << (bits - 1))))


def mono(samples: Column, channels: int) -> Column:
    """Mean of interleaved channels; null for a ragged tail."""
    n = (F.size(samples) / channels).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: total(F.slice(samples, i * channels + 1, channels)) / channels)
    return F.when(F.size(samples) % channels != 0, None).when(n > 0, frames).otherwise(F.slice(samples, 1, 0))

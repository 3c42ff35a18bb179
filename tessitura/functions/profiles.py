"""The instrument dimension: filter range, pitch detector and acoustic thresholds of each preset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = (
    "instrument string, hpf_hz double, f0_min_hz double, f0_max_hz double, ceiling_hz double, clarity double, strict_mono boolean, min_poly_clarity double, "
    "stacc_max_s double, tenuto_min_s double, rise_max_s double, rise_min_slope double, mash_crest double, mash_thump double, flat_cents int, sharp_cents int, centroid_min double"
)
POWER = 0.00005
# Hpf, lowest and highest fundamental, ceiling, clarity, strict mono, least clarity in polyphony.
RANGES = {
    "Generic": (30.0, 30.0, 4200.0, 20000.0, 0.65, False, 0.50),
    "Piano": (22.0, 27.5, 4186.0, 18000.0, 0.70, False, 0.50),
    "AcousticGuitar": (70.0, 82.4, 987.8, 15000.0, 0.70, False, 0.50),
    "ElectricGuitar": (70.0, 82.4, 1318.5, 12000.0, 0.70, False, 0.50),
    "ElectricBass4": (35.0, 41.2, 392.0, 7000.0, 0.65, False, 0.55),
    "ElectricBass5": (25.0, 30.9, 392.0, 7000.0, 0.65, False, 0.55),
    "Violin": (180.0, 196.0, 3136.0, 18000.0, 0.70, True, 0.60),
    "Viola": (120.0, 130.8, 1318.5, 15000.0, 0.70, True, 0.60),
    "Cello": (55.0, 65.4, 1046.5, 12000.0, 0.65, True, 0.55),
    "DoubleBass": (35.0, 41.2, 392.0, 8000.0, 0.60, True, 0.50),
    "Flute": (220.0, 246.9, 2349.3, 9000.0, 0.75, True, 0.65),
    "ClarinetBb": (130.0, 146.8, 1760.0, 15000.0, 0.75, True, 0.65),
    "Oboe": (205.0, 233.1, 1568.0, 16000.0, 0.75, True, 0.65),
    "Bassoon": (50.0, 58.3, 622.3, 10000.0, 0.70, True, 0.60),
    "AltoSax": (120.0, 138.6, 880.0, 14000.0, 0.70, True, 0.60),
    "TenorSax": (90.0, 103.8, 698.5, 12000.0, 0.70, True, 0.60),
    "TrumpetBb": (150.0, 164.8, 1046.5, 14000.0, 0.70, True, 0.60),
    "FrenchHorn": (55.0, 65.4, 880.0, 12000.0, 0.70, True, 0.60),
    "TromboneTenor": (70.0, 82.4, 698.5, 10000.0, 0.70, True, 0.60),
    "Tuba": (30.0, 36.7, 349.2, 6000.0, 0.65, True, 0.55),
    "VoiceSoprano": (150.0, 180.0, 1200.0, 18000.0, 0.60, True, 0.50),
    "VoiceTenor": (70.0, 85.0, 650.0, 15000.0, 0.60, True, 0.50),
    "VoiceBass": (45.0, 55.0, 380.0, 12000.0, 0.60, True, 0.50),
}
# Staccato, tenuto, rise and its slope, crest and thump of a mashed key, flat and sharp cents, least centroid.
GENERIC = (0.25, 0.80, 0.020, 1.0, 18.0, -20.0, -10, 10, 600.0)
PIANO = (0.22, 0.70, 0.015, 1.5, 16.0, -22.0, -8, 8, 500.0)
PLUCKED = (0.20, 0.65, 0.012, 1.8, 18.0, -20.0, -12, 12, 700.0)
BOWED = (0.22, 0.90, 0.060, 0.5, 99.0, 0.0, -15, 15, 1000.0)
REEDS = (0.22, 0.80, 0.040, 0.7, 99.0, 0.0, -14, 14, 900.0)
BRASS = (0.24, 0.85, 0.035, 0.9, 99.0, 0.0, -15, 15, 800.0)
VOICE = (0.25, 0.90, 0.060, 0.4, 99.0, 0.0, -18, 18, 600.0)
FAMILY = {
    "Generic": GENERIC, "Piano": PIANO, "AcousticGuitar": PLUCKED, "ElectricGuitar": PLUCKED, "ElectricBass4": PLUCKED, "ElectricBass5": PLUCKED, "Violin": BOWED, "Viola": BOWED,
    "Cello": BOWED, "DoubleBass": BOWED, "Flute": REEDS, "ClarinetBb": REEDS, "Oboe": REEDS, "Bassoon": REEDS, "AltoSax": REEDS, "TenorSax": REEDS, "TrumpetBb": BRASS,
    "FrenchHorn": BRASS, "TromboneTenor": BRASS, "Tuba": BRASS, "VoiceSoprano": VOICE, "VoiceTenor": VOICE, "VoiceBass": VOICE,
}


def profile(instrument: str) -> dict:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return dict(zip(names, (instrument, *RANGES[instrument], *FAMILY[instrument]), strict=True))


def custom(hpf_hz: float, f0_min_hz: float, f0_max_hz: float, ceiling_hz: float) -> dict:
    """A profile of its own filter range, otherwise generic."""
    return profile("Generic") | {"instrument": "Custom", "hpf_hz": hpf_hz, "f0_min_hz": f0_min_hz, "f0_max_hz": f0_max_hz, "ceiling_hz": ceiling_hz}


def instrument_profiles(spark: SparkSession) -> DataFrame:
    """One row per preset: small by construction, so it may be broadcast."""
    return spark.createDataFrame([tuple(profile(x).values()) for x in RANGES], COLUMNS)

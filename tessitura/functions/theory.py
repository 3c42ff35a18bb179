"""Pitch, loudness and notation arithmetic as Column -> Column expressions (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, cut points and levels of the notation model.
PITCHES = ("C", "C#/Db", "D", "D#/Eb", "E", "F", "F#/Gb", "G", "G#/Ab", "A", "A#/Bb", "B")
LEVELS = ("ppp", "pp", "p", "mp", "mf", "f", "ff", "fff")
DBFS_CUTS = (-45.0, -38.0, -30.0, -24.0, -18.0, -12.0, -6.0)
PHON_CUTS = (34.0, 42.0, 50.0, 58.0, 66.0, 74.0, 82.0)
VELOCITY_CUTS = (31, 47, 63, 79, 95, 111, 120)
PERCENT_CUTS = (35.0, 50.0, 65.0, 80.0, 95.0, 110.0, 120.0)
LEVEL_VELOCITY = {"ppp": 25, "pp": 40, "p": 55, "mp": 70, "mf": 85, "f": 100, "ff": 115, "fff": 127}
OTHER_VELOCITY = 80
MARK_LEVEL = {
    "pppp": "ppp", "ppppp": "ppp", "pppppp": "ppp", "ffff": "fff", "fffff": "fff", "ffffff": "fff", "sf": "ff", "sfz": "ff", "sffz": "ff", "fz": "ff", "rf": "ff", "rfz": "ff",
    "fp": "f", "sfp": "f", "sfzp": "f",
}
WORD_LEVEL = {
    "pianississimo": "ppp", "pianissimo": "pp", "piano": "p", "mezzo-piano": "mp", "mezzopiano": "mp", "mezzo-forte": "mf", "mezzoforte": "mf", "forte": "f", "fortissimo": "ff",
    "fortississimo": "fff", "sf": "ff", "sfz": "ff", "sffz": "ff", "fz": "ff", "rf": "ff", "rfz": "ff", "fp": "f", "sfp": "f",
}
BARK_EDGES = (20, 100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500)
TEMPO_NAMES = ((40, "Grave"), (60, "Largo"), (66, "Larghetto"), (76, "Adagio"), (108, "Andante"), (120, "Moderato"), (156, "Allegro"), (176, "Vivace"), (200, "Presto"))
FASTEST = "Prestissimo"


def steps(value: Column, cuts: tuple, names: tuple, inclusive: bool = False) -> Column:
    """The first name whose cut the value is below (at, if inclusive); the last name beyond all cuts."""
    out = F.when(value <= cuts[0] if inclusive else value < cuts[0], names[0])
    for cut, name in zip(cuts[1:], names[1:], strict=False):
        out = out.when(value <= cut if inclusive else value < cut, name)
    return out.otherwise(names[len(cuts)])


def midi_float(hz: Column) -> Column:
    """69 + 12 log2(f / 440); null where f is not positive."""
    return F.when(hz > 0, F.lit(69.0) + F.lit(12.0) * F.log2(hz / F.lit(440.0)))


def hz_to_midi(hz: Column) -> Column:
    """Nearest midi number within 0..127; 0 where the frequency is not positive or no number."""
    return F.when((hz > 0) & ~F.isnan(hz), F.least(F.greatest(F.round(midi_float(hz)), F.lit(0.0)), F.lit(127.0)).cast("int")).otherwise(0)


def midi_index(hz: Column) -> Column:
    """Nearest midi number, null outside 0..127."""
    n = F.round(midi_float(hz))
    return F.when((n >= 0) & (n <= 127), n.cast("int"))


def midi_to_hz(midi: Column, cents: Column | None = None) -> Column:
    shift = F.lit(0.0) if cents is None else cents / F.lit(1200.0)
    return F.lit(440.0) * F.pow(F.lit(2.0), (midi - F.lit(69.0)) / F.lit(12.0) + shift)


def pitch_class(midi: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PITCHES]), (midi.cast("int") % 12 + 1).cast("int"))


def octave(midi: Column) -> Column:
    """Scientific octave: 60 is in octave 4; -1 below midi 12."""
    return (F.floor(midi / F.lit(12)) - 1).cast("int")


def midi_of(pitch: Column, octave_: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(p) for p in PITCHES]), pitch)
    return F.when(place > 0, ((octave_ + 1) * 12 + place - 1).cast("int"))


def cents_off(hz: Column) -> Column:
    n = midi_float(hz)
    return F.round((n - F.round(n)) * F.lit(100.0)).cast("int")


def slaney_mel(hz: Column) -> Column:
    return F.when(hz < 1000.0, hz * 3.0 / 200.0).otherwise(F.lit(15.0) + F.lit(27.0) * F.ln(F.greatest(hz, F.lit(1.0)) / 1000.0) / F.ln(F.lit(6.4)))


def slaney_hz(mel: Column) -> Column:
    return F.when(mel < 15.0, mel * 200.0 / 3.0).otherwise(F.lit(1000.0) * F.exp((mel - 15.0) * F.ln(F.lit(6.4)) / 27.0))


def sones_to_phons(sones: Column) -> Column:
    return F.when(sones >= 1.0, F.lit(40.0) + F.lit(33.21928) * F.log10(F.greatest(sones, F.lit(1.0)))).when(sones > 0.0, F.lit(40.0) * F.pow(sones, F.lit(0.35))).otherwise(0.0)


def bark_band(hz: Column) -> Column:
    """Index of the critical band; 0 below 20 Hz, 23 from 15.5 kHz on."""
    return F.when(hz < BARK_EDGES[0], 0).when(hz >= BARK_EDGES[-1], 23).otherwise(sum((F.when(hz >= e, 1).otherwise(0) for e in BARK_EDGES[1:-1]), F.lit(0)))


def level_from_dbfs(dbfs: Column) -> Column:
    return steps(dbfs, DBFS_CUTS, LEVELS)


def level_from_phons(phons: Column) -> Column:
    return F.when(F.isnan(phons), "ppp").otherwise(steps(phons, PHON_CUTS, LEVELS))


def level_from_velocity(velocity: Column) -> Column:
    return steps(velocity, VELOCITY_CUTS, LEVELS, inclusive=True)


def level_from_percent(percent: Column) -> Column:
    return steps(percent, PERCENT_CUTS, LEVELS)


def level_from_mark(mark: Column) -> Column:
    """Dynamics mark -> level; the eight levels are themselves, others that are known map to one of them, the rest are "Other"."""
    known = {**{x: x for x in LEVELS}, **MARK_LEVEL}
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, F.lower(F.trim(mark))), F.lit("Other"))


def audio_articulation(mark: Column) -> Column:
    """A score's articulation as a detector names it: accents are Marcato."""
    return F.when(mark == "Accent", "Marcato").otherwise(mark)


def audio_level(level: Column) -> Column:
    """A score's level as a detector names it: other marks are mf."""
    return F.when(level == "Other", "mf").otherwise(level)


def level_from_word(word: Column) -> Column:
    """A direction's word -> level, null for other words."""
    pairs = F.create_map(*[F.lit(x) for kv in {**{x: x for x in LEVELS}, **WORD_LEVEL}.items() for x in kv])
    return F.try_element_at(pairs, F.lower(F.trim(word)))


def velocity_from_level(level: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_VELOCITY.items() for x in kv]), level), F.lit(OTHER_VELOCITY))


def midi_velocity(dbfs: Column, crest: Column) -> Column:
    """Loudness and attack crest -> 1..127."""
    loud = F.least(F.greatest((dbfs + 55.0) / 50.0, F.lit(0.0)), F.lit(1.0))
    sharp = F.least(F.greatest((crest - 6.0) / 18.0, F.lit(0.0)), F.lit(0.2))
    return F.least(F.greatest(F.round((loud * 0.85 + sharp) * 127.0), F.lit(1.0)), F.lit(127.0)).cast("int")


def override_velocity(dynamics: Column) -> Column:
    """A score's dynamics percentage -> velocity, truncated."""
    return F.least(F.greatest(dynamics / 100.0 * 90.0, F.lit(1.0)), F.lit(127.0)).cast("int")


def attack_slope(peak: Column, onset: Column, rise_s: Column) -> Column:
    """Decibels a second from the onset to the peak; a rise counts as a millisecond at least. A null gives null."""
    return (peak - onset) / F.greatest(rise_s, F.when(rise_s.isNotNull(), F.lit(0.001)))


def articulation(duration: Column, legato: Column, slope: Column, rise: Column, crest: Column, velocity: Column, profile: dict[str, Column]) -> Column:
    """Legato before Marcato (a steep short attack, or a loud one with a high crest) before Staccato before Tenuto before Normal."""
    struck = (slope >= profile["rise_min_slope"] * 100.0) & (rise <= profile["rise_max_s"]) | (velocity >= 90) & (crest >= 15.0)
    return F.when(legato, "Legato").when(struck, "Marcato").when(duration <= profile["stacc_max_s"], "Staccato").when(duration >= profile["tenuto_min_s"], "Tenuto").otherwise("Normal")


def mashed(crest: Column, thump: Column, profile: dict[str, Column]) -> Column:
    return (crest >= profile["mash_crest"]) & (thump >= profile["mash_thump"])


def damping(duration: Column, profile: dict[str, Column]) -> Column:
    return F.when(duration >= profile["tenuto_min_s"], "PedalSustained").when(duration <= profile["stacc_max_s"], "DryDamped").otherwise("HalfPedal")


def intonation(cents: Column, flat: Column, sharp: Column) -> Column:
    return F.when(cents < flat, "Flat").when(cents > sharp, "Sharp").otherwise("InTune")


def tempo_name(bpm: Column) -> Column:
    out = F.when(bpm < TEMPO_NAMES[0][0], TEMPO_NAMES[0][1])
    for limit, name in TEMPO_NAMES[1:]:
        out = out.when(bpm < limit, name)
    return out.otherwise(FASTEST)


def meter(dbfs: Column) -> Column:
    """A text bar of 16 places from -60 to 0 dBFS, and the level."""
    safe = F.when(dbfs.isNull() | F.isnan(dbfs) | (F.abs(dbfs) == float("inf")) | (dbfs < -100.0), -100.0).otherwise(dbfs)
    n = F.round((F.least(F.greatest(safe, F.lit(-60.0)), F.lit(0.0)) + 60.0) / 60.0 * 16.0).cast("int")
    level = F.when(safe <= -99.0, "  -inf dBFS").otherwise(F.concat(F.format_string("%5.1f", safe), F.lit(" dBFS")))
    return F.concat(F.lit("["), F.repeat(F.lit("\u2588"), n), F.repeat(F.lit("\u2591"), F.lit(16) - n), F.lit("] "), level)


def pitch_label(hz: Column) -> Column:
    """Name, octave and signed cents; "---" outside 20..5000 Hz."""
    midi, cents = hz_to_midi(hz), cents_off(hz)
    text = F.concat(pitch_class(midi), octave(midi).cast("string"), F.when(cents >= 0, "+").otherwise(""), cents.cast("string"))
    return F.when((hz >= 20.0) & (hz <= 5000.0), text).otherwise("---")


def alias_key(name: Column) -> Column:
    """Command-line names compare without case, hyphens, underscores and spaces."""
    return F.translate(F.lower(name), "-_ ", "")


def transpose(chromatic: Column, octave_change: Column) -> Column:
    return F.least(F.greatest(chromatic + octave_change * 12, F.lit(-128)), F.lit(127))


def octave_shift(kind: Column, size: Column, before: Column) -> Column:
    n = F.when(size == 15, 24).otherwise(12)
    return F.when(kind == "down", n).when(kind == "up", -n).when(kind == "stop", 0).otherwise(before)


def sounding_midi(step: Column, alter: Column, octave_: Column, transposed: Column, shifted: Column) -> Column:
    place = F.try_element_at(F.create_map(*[F.lit(x) for kv in (("C", 0), ("D", 2), ("E", 4), ("F", 5), ("G", 7), ("A", 9), ("B", 11)) for x in kv]), step)
    return F.least(F.greatest((octave_ + 1) * 12 + place + alter + transposed + shifted, F.lit(0)), F.lit(127)).cast("int")


def ending_includes(number: str, pass_: str) -> Column:
    """Does a volta's number list (comma separated, dots after numbers, ranges a-b) include the pass? Lists with spaces alone do not match."""
    return F.expr(f"""exists(transform(split({number}, ','), x -> rtrim('.', trim(x))), x ->
        coalesce(try_cast(x AS INT) = {pass_}, false) OR (x LIKE '%-%' AND
        coalesce(try_cast(trim(substring_index(x, '-', 1)) AS INT) <= {pass_} AND {pass_} <= try_cast(trim(substring(x, instr(x, '-') + 1)) AS INT), false)))""")


def direction_kind(words: Column) -> Column:
    """The first that applies, in this order; anything else is Words."""
    w = F.lower(F.trim(words))

    def has(*parts: str) -> Column:
        return reduce(lambda a, b: a | b, (w.contains(p) for p in parts))

    return (
        F.when(has("rit", "rall"), "Ritardando").when(has("accel"), "Accelerando").when(has("a tempo", "tempo i", "tempo primo"), "ATempo")
        .when((w == "cresc.") | has("crescendo"), "Crescendo").when((w == "dim.") | has("diminuendo", "decresc"), "Diminuendo")
        .when((w == "d.c.") | has("da capo"), "DaCapo").when((w == "d.s.") | has("dal segno"), "DalSegno").when(w == "fine", "Fine").when(has("to coda"), "ToCoda")
        .when(w.isin(*LEVELS, *WORD_LEVEL), "Dynamic").otherwise("Words")
    )


def sheet_path(path: Column) -> Column:
    """The name after the last slash (or backslash) up to the last dot, with .xml."""
    base = F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(".xml"))


def joined_names(names: Column) -> Column:
    return F.array_join(names, ", ")


def split_names(text: Column) -> Column:
    return F.filter(F.split(text, ", "), lambda x: F.trim(x) != "")

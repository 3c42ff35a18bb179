"""Note segmenters as plain state machines: ``step`` takes one frame and returns events. Batch folds and streaming processors run the same code.

``finalize`` ends all notes. A machine that ``resets`` is then as at its start, so what follows needs nothing of what came before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import ClassVar

from tessitura.functions.profiles import profile

# Thresholds, times in milliseconds and frames.
ENTRY, EXIT, HANGOVER, HYSTERESIS = 0.80, 0.55, 3, 0.70
GAP_MS, RESTRIKE_MS, RETAG_MS, LEAST_S = 60, 80, 50, 0.020
OFFSET_P, SUSTAIN_P, LOCKOUT = 0.35, 0.65, 4
VOICED_HZ, VOICED_DBFS = (20.0, 4500.0), -65.0


def clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def half_up(x: float) -> int:
    """Half away from zero."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def midi_of(hz: float) -> float:
    return 69 + 12 * math.log2(hz / 440)


def note_of(hz: float) -> tuple[int, int] | None:
    """(midi, cents) of a frequency within the midi range."""
    if not hz > 0 or math.isinf(hz):
        return None
    n = midi_of(hz)
    return (half_up(n), half_up((n - half_up(n)) * 100)) if 0 <= n <= 127 else None


def velocity(dbfs: float, crest: float) -> int:
    return int(clamp(half_up((clamp((dbfs + 55) / 50, 0, 1) * 0.85 + clamp((crest - 6) / 18, 0, 0.2)) * 127), 1, 127))


def level(value: float, cuts: tuple) -> str:
    names = ("ppp", "pp", "p", "mp", "mf", "f", "ff", "fff")
    return names[0] if value != value else names[sum(value >= c for c in cuts)]


DBFS = (-45.0, -38.0, -30.0, -24.0, -18.0, -12.0, -6.0)
PHONS = (34.0, 42.0, 50.0, 58.0, 66.0, 74.0, 82.0)
VELOCITIES = (32, 48, 64, 80, 96, 112, 121)


def phons(sones: float) -> float:
    return 40 + 33.21928 * math.log10(sones) if sones >= 1 else 40 * sones**0.35 if sones > 0 else 0.0


def articulation(seconds: float, legato: bool, slope: float, rise: float, crest: float, vel: int, p: dict) -> str:
    if legato:
        return "Legato"
    if (slope >= p["rise_min_slope"] * 100 and rise <= p["rise_max_s"]) or (vel >= 90 and crest >= 15):
        return "Marcato"
    return "Staccato" if seconds <= p["stacc_max_s"] else "Tenuto" if seconds >= p["tenuto_min_s"] else "Normal"


def damping(seconds: float, p: dict) -> str:
    return "PedalSustained" if seconds >= p["tenuto_min_s"] else "DryDamped" if seconds <= p["stacc_max_s"] else "HalfPedal"


@dataclass
class Open:
    """A sounding note and what its frames add up to."""

    midi: int
    cents: int
    onset_dbfs: float
    strike: int
    crest: float = 0.0
    thump: float = -180.0
    centroid: float = 0.0
    clarity: float | None = None
    sones: float | None = None
    last: int = 0
    peak: float = 0.0
    rise: float | None = None
    frames: int = 1
    sum_cents: int = 0
    sum_centroid: float = 0.0
    peak_sones: float | None = None
    sum_sones: float | None = None
    last_dbfs: float = 0.0

    def __post_init__(self):
        self.last, self.peak, self.last_dbfs, self.sum_cents, self.sum_centroid = self.strike, self.onset_dbfs, self.onset_dbfs, self.cents, self.centroid
        self.peak_sones = self.sum_sones = self.sones

    def add(self, dbfs: float, cents: int, centroid: float, sones: float | None = None) -> None:
        self.peak = max(self.peak, dbfs)
        self.frames += 1
        self.sum_cents += cents
        self.sum_centroid += centroid
        if sones is not None:
            self.sum_sones = (self.sum_sones or 0.0) + sones
            self.peak_sones = sones if self.peak_sones is None else max(self.peak_sones, sones)

    def start(self, vel: int | None = None) -> dict:
        dynamic = level(phons(self.sones), PHONS) if self.sones is not None else level(self.onset_dbfs, DBFS)
        found = velocity(self.onset_dbfs, self.crest) if vel is None else vel
        return {"kind": "start", "midi": self.midi, "cents": self.cents, "strike_ms": self.strike, "dbfs": self.onset_dbfs, "velocity": found, "dynamic": dynamic if vel is None else level(vel, VELOCITIES)}

    def end(self, at: int, p: dict, legato: bool = False) -> dict:
        seconds, rise = max(0, at - self.strike) / 1000, max(self.rise or 0.005, 0.005)
        slope, vel = abs(self.peak - self.onset_dbfs) / rise, velocity(self.peak, self.crest)
        average = half_up(self.sum_cents / self.frames)
        return {
            "kind": "end", "midi": self.midi, "cents": average, "strike_ms": self.strike, "dbfs": self.peak, "velocity": vel, "dynamic": level(phons(self.peak_sones), PHONS) if self.peak_sones is not None else level(self.peak, DBFS),
            "duration_s": seconds, "rise_s": rise, "slope": slope, "articulation": articulation(seconds, legato, slope, rise, self.crest, vel, p), "is_mashed": self.crest >= p["mash_crest"] and self.thump >= p["mash_thump"],
            "is_flat": average <= p["flat_cents"], "damping": damping(seconds, p), "centroid": self.sum_centroid / self.frames, "avg_sones": None if self.sum_sones is None else self.sum_sones / self.frames,
        }


def loudness_of(f: dict, midi: int) -> float | None:
    """Sones of a key in a frame that has them."""
    return (f.get("sones") or {}).get(midi)


def struck(midi: int, f: dict, rise: float | None = None) -> Open:
    """A key's note as a frame begins it."""
    return Open(midi, 0, f["energy"], f["ts_ms"], f.get("crest", 0.0), f.get("thump", -180.0), f.get("centroid", 0.0), sones=loudness_of(f, midi), rise=rise)


def reported(event: dict) -> list[dict]:
    """Ends of too short notes are not reported."""
    return [event] if event["kind"] == "start" or event["duration_s"] >= LEAST_S else []


@dataclass
class MonoSegmenter:
    """One sounding note, followed by pitch: hysteresis, hangover over short gaps, confirmed legato changes, restrikes at onsets."""

    resets: ClassVar[bool] = True
    instrument: str = "Generic"
    frame_thr: float = 0.4
    note: Open | None = None
    hang: int = 0
    hang_at: int = 0
    pending: int | None = None
    seen: int = 0

    def __post_init__(self):
        self.p, self.entry, self.exit = profile(self.instrument), max(ENTRY, self.frame_thr), min(EXIT, self.frame_thr)

    def _open(self, midi: int, cents: int, f: dict, strike: int) -> dict:
        self.note = Open(midi, cents, f["dbfs"], strike, f.get("crest", 0.0), f.get("thump", -180.0), f.get("centroid", 0.0), f.get("clarity"))
        self.note.last = max(strike, f["ts_ms"])
        self.hang, self.pending, self.seen = 0, None, 0
        return self.note.start()

    def _close(self, at: int, legato: bool) -> list[dict]:
        out, self.note = reported(self.note.end(at, self.p, legato)), None
        self.hang, self.pending, self.seen = 0, None, 0
        return out

    def step(self, f: dict) -> list[dict]:
        """f: hz, clarity, dbfs, onset_ms (or None), ts_ms, crest, thump, centroid."""
        hz, ts, onset = f["hz"], f["ts_ms"], f.get("onset_ms")
        where = midi_of(hz) if VOICED_HZ[0] < hz < VOICED_HZ[1] else None
        found = note_of(hz) if f["clarity"] >= self.entry else None
        note = self.note
        if note is None:
            self.hang, self.pending, self.seen = 0, None, 0
            return [self._open(*found, f, ts if onset is None else onset)] if found else []
        if not (f["clarity"] >= self.exit and where is not None and f["dbfs"] >= VOICED_DBFS):
            return self._unvoiced(ts)
        self.hang = 0
        if abs(where - note.midi) <= HYSTERESIS:
            self.pending, self.seen = None, 0
            if onset is not None and onset - note.strike >= RESTRIKE_MS:
                out = self._close(onset, False)
                midi, cents = found or (half_up(where), half_up((where - half_up(where)) * 100))
                return [*out, self._open(midi, cents, f, onset)]
            if onset is not None and onset < note.strike:
                note.strike = onset
            note.add(f["dbfs"], half_up((where - half_up(where)) * 100), f.get("centroid", 0.0))  # from the nearest semitone
            note.last = ts
            return []
        if found is None:
            note.last = ts
            return []
        if ts - note.strike < RETAG_MS:
            note.midi, note.cents = found
            note.add(f["dbfs"], found[1], f.get("centroid", 0.0))
            note.last = ts
            return []
        self.seen = self.seen + 1 if self.pending == found[0] else 1
        self.pending = found[0]
        if self.seen >= 2:
            return [*self._close(ts, True), self._open(*found, f, ts)]
        note.last = ts
        return []

    def _unvoiced(self, ts: int) -> list[dict]:
        self.pending, self.seen = None, 0
        gap = ts - self.note.last > GAP_MS
        if not gap and self.hang == 0:
            self.hang, self.hang_at = HANGOVER, ts
            return []
        if not gap:
            self.hang -= 1
            return self._close(self.hang_at, False) if self.hang == 0 else []
        return self._close(ts, False)

    def finalize(self, ts: int) -> list[dict]:
        return self._close(ts, False) if self.note else []


@dataclass
class KeySegmenter:
    """88 keys of onset and frame probabilities, each its own note."""

    resets: ClassVar[bool] = True
    instrument: str = "Generic"
    onset_thr: float = 0.5
    frame_thr: float = 0.4
    notes: dict[int, Open] = field(default_factory=dict)

    def __post_init__(self):
        self.p = profile(self.instrument)

    def step(self, f: dict) -> list[dict]:
        """f: ts_ms, energy, keys {midi: (onset, frame)}, and where known crest, thump, centroid and sones {midi: loudness}."""
        ts, out = f["ts_ms"], []
        for midi in sorted({*f["keys"], *self.notes}):
            onset, frame = f["keys"].get(midi, (0.0, 0.0))
            note = self.notes.get(midi)
            if frame < self.frame_thr:
                if note:
                    out += reported(self.notes.pop(midi).end(ts, self.p))
            elif note is None or onset >= self.onset_thr:
                if note:
                    out += reported(note.end(ts, self.p))
                self.notes[midi] = struck(midi, f)
                out.append(self.notes[midi].start())
            else:
                note.add(f["energy"], 0, f.get("centroid", 0.0), loudness_of(f, midi))
                note.last = ts
        return out

    def finalize(self, ts: int) -> list[dict]:
        out = [e for midi in sorted(self.notes) for e in reported(self.notes[midi].end(ts, self.p))]
        self.notes.clear()
        return out


@dataclass
class PedalSegmenter:
    """Keys with offsets and velocities under a shared pedal: restrikes are locked out for a while, and a key released under the pedal may ring on. The lock-out and the last onsets outlast silence."""

    instrument: str = "Piano"
    onset_thr: float = 0.5
    frame_thr: float = 0.4
    notes: dict[int, Open] = field(default_factory=dict)
    velocities: dict[int, int] = field(default_factory=dict)
    locked: dict[int, int] = field(default_factory=dict)
    before: dict[int, float] = field(default_factory=dict)
    alive: set[int] = field(default_factory=set)
    pedal: bool = False

    def __post_init__(self):
        self.p = profile(self.instrument)

    def _open(self, midi: int, f: dict, vel: int) -> dict:
        self.notes[midi], self.velocities[midi], self.locked[midi] = struck(midi, f, rise=0.020), vel, LOCKOUT
        self.alive.discard(midi)
        return self.notes[midi].start(vel)

    def _close(self, midi: int, ts: int, sustained: str | None) -> list[dict]:
        note = self.notes.pop(midi)
        end, vel = note.end(ts, self.p), self.velocities.pop(midi, 0)
        if vel:
            end |= {"velocity": vel, "dynamic": level(vel, VELOCITIES), "articulation": articulation(end["duration_s"], False, end["slope"], end["rise_s"], note.crest, vel, self.p)}
        if sustained:
            end["damping"] = sustained
        return reported(end)

    def step(self, f: dict) -> list[dict]:
        """f: ts_ms, energy, pedal (onset, offset, frame), keys {midi: (onset, frame, offset, velocity)}, and as for KeySegmenter."""
        onset, offset, frame = f["pedal"]
        if frame >= 0.50 or onset >= 0.40:
            self.pedal = True
        elif frame < 0.35 or offset >= 0.35:
            self.pedal = False
            self.alive.clear()
        ts, out = f["ts_ms"], []
        for midi in sorted({*f["keys"], *self.notes, *self.locked, *self.before}):
            onset, frame, offset, vel = f["keys"].get(midi, (0.0, 0.0, 0.0, 0.0))
            lock = self.locked[midi] = max(self.locked.get(midi, 0) - 1, 0)
            spike = onset >= self.onset_thr and onset >= self.before.get(midi, 0.0)
            self.before[midi] = onset
            active, off = frame >= self.frame_thr, offset >= OFFSET_P
            vel = 64 if vel != vel else int(half_up(clamp(vel, 1, 127)))
            note = self.notes.get(midi)
            again = spike and lock == 0
            if note is None:
                ringing = frame >= SUSTAIN_P and not off and f["energy"] > -50
                if again or (ringing and midi not in self.alive):
                    out.append(self._open(midi, f, vel))
                continue
            note.add(f["energy"], 0, f.get("centroid", 0.0), loudness_of(f, midi))
            note.last = ts
            if again:
                out += [*self._close(midi, ts, None), self._open(midi, f, vel)]
            elif off or not active:
                out += self._close(midi, ts, "PedalSustained" if self.pedal else "DryDamped")
                if self.pedal:
                    self.alive.add(midi)
        return out

    def finalize(self, ts: int) -> list[dict]:
        out = [e for midi in sorted(self.notes) for e in self._close(midi, ts, None)]
        self.alive.clear()
        self.velocities.clear()
        self.pedal = False
        return out


@dataclass
class HybridSegmenter:
    """Frames with one clear pitch go to the mono segmenter, others to the keys; an open note is handed over, not restarted."""

    resets: ClassVar[bool] = True
    instrument: str = "Generic"
    ratio: float = 0.55

    def __post_init__(self):
        self.mono, self.keys, self.p = MonoSegmenter(self.instrument), KeySegmenter(self.instrument), profile(self.instrument)
        self.single = True

    def step(self, f: dict) -> list[dict]:
        """f: the fields of both, and nsdf (clarity, ratio)."""
        clarity, ratio = f["nsdf"]
        single = clarity >= self.p["clarity"] and ratio <= self.ratio
        out = []
        if not single and self.mono.note:
            self.keys.notes.setdefault(self.mono.note.midi, self.mono.note)
            self.mono = MonoSegmenter(self.instrument)
        elif single and self.keys.notes:
            found = note_of(f["hz"])
            kept = self.keys.notes.pop(found[0], None) if found else None
            out = self.keys.finalize(f["ts_ms"])
            self.mono.note = kept
        self.single = single
        return out + (self.mono.step(f) if single else self.keys.step(f))

    def finalize(self, ts: int) -> list[dict]:
        return self.mono.finalize(ts) + self.keys.finalize(ts)


@dataclass
class Envelope:
    """Rise, peak and decay of one detected note; a new attack in the decay needs a dip, a surge and a crest."""

    instrument: str = "Generic"
    dip: float = 2.5
    surge: float = 4.0
    crest: float = 11.5
    state: str = "Idle"
    note: Open | None = None
    low: float = 0.0

    def __post_init__(self):
        self.p = profile(self.instrument)

    def _start(self, found: tuple[int, int], f: dict) -> dict:
        self.note = Open(*found, f["dbfs"], f["ts_ms"], f.get("crest", 0.0), f.get("thump", -180.0), f.get("centroid", 0.0))
        self.state, self.low = "Rise", f["dbfs"]
        return self.note.start()

    def step(self, f: dict) -> list[dict]:
        """f: note (midi, cents) or None, dbfs, ts_ms, crest."""
        found, ts, dbfs, note = f["note"], f["ts_ms"], f["dbfs"], self.note
        if note is None:
            return [self._start(found, f)] if found else []
        if found is None:
            self.note, self.state = None, "Idle"
            return [note.end(ts, self.p)]
        if found[0] != note.midi:
            return [note.end(ts, self.p, True), self._start(found, f)]
        again = self.state == "Decay" and note.peak - self.low >= self.dip and dbfs - self.low >= self.surge and f.get("crest", 0.0) >= self.crest
        if again:
            return [note.end(ts, self.p), self._start(found, f)]
        before, note.cents, note.last, note.last_dbfs = note.peak, found[1], ts, dbfs
        note.add(dbfs, found[1], f.get("centroid", 0.0))
        if self.state in ("Rise", "Peak"):
            if dbfs < before or self.state == "Peak":
                note.rise = note.rise or max((ts - note.strike) / 1000, 0.005)
                self.state, self.low = "Decay", dbfs
        else:
            self.low = min(self.low, dbfs)
        return []

"""State machines by script, and their batch and streaming forms against each other."""

import numpy as np
import pytest

from tessitura.operators import segmenters as S
from tessitura.operators import transcribe
from tessitura.operators.tempo import TempoTracker
from tessitura.streaming import transcribe as streaming


def mono(hz, clarity, dbfs, onset, ts):
    return {"hz": hz, "clarity": clarity, "dbfs": dbfs, "onset_ms": onset, "ts_ms": ts}


def run(machine, frames):
    return [machine.step(f) for f in frames]


def kinds(events):
    return [[e["kind"] for e in step] for step in events]


def test_lifecycle_with_a_restrike():
    got = run(S.MonoSegmenter(), [mono(440, 0.95, -12, None, 1000), mono(440, 0.92, -15, None, 1050), mono(440, 0.95, -10, 1090, 1100), mono(0, 0.1, -50, None, 1200)])
    assert kinds(got) == [["start"], [], ["end", "start"], ["end"]]
    assert got[2][0]["duration_s"] == pytest.approx(0.09) and got[2][1]["strike_ms"] == 1090 and got[3][0]["duration_s"] == pytest.approx(0.11)


def test_early_attack_is_relabelled():
    m = S.MonoSegmenter()
    assert kinds(run(m, [mono(880, 0.85, -6, 1000, 1000), mono(440, 0.92, -8, None, 1015)])) == [["start"], []]
    assert m.note.midi == 69


def test_vibrato_and_hangover_keep_the_note():
    assert sum(map(len, run(S.MonoSegmenter(), [mono(h, 0.95, -10, None, t) for h, t in ((440, 1000), (450, 1015), (430, 1030))]))) == 1
    assert sum(map(len, run(S.MonoSegmenter(), [mono(440, c, -10, None, t) for c, t in ((0.95, 1000), (0.2, 1012), (0.92, 1024))]))) == 1


def test_legato_change_needs_two_frames():
    got = run(S.MonoSegmenter(), [mono(h, 0.95, -10, None, t) for h, t in ((440, 1000), (523.25, 1012), (440, 1024), (493.88, 1100), (493.88, 1112))])
    assert kinds(got)[-1] == ["end", "start"] and kinds(got)[3] == [] and got[-1][0]["articulation"] == "Legato" and got[-1][1]["midi"] == 71


def test_restrike_is_debounced_and_low_clarity_rejected():
    got = run(S.MonoSegmenter(), [mono(440, 0.95, -10, None, 1000), mono(440, 0.95, -10, 1015, 1015), mono(440, 0.95, -10, 1090, 1090)])
    assert kinds(got) == [["start"], [], ["end", "start"]]
    assert kinds(run(S.MonoSegmenter(), [mono(440, 0.65, -10, None, 0), mono(440, 0.85, -10, None, 10)])) == [[], ["start"]]


def test_chord_and_release():
    m = S.KeySegmenter()
    got = run(m, [{"ts_ms": 1000, "energy": -20, "keys": {60: (0.8, 0.9), 64: (0.8, 0.9)}}, {"ts_ms": 1100, "energy": -22, "keys": {64: (0.1, 0.9)}}])
    assert [e["midi"] for e in got[0]] == [60, 64] and [(e["kind"], e["midi"]) for e in got[1]] == [("end", 60)]
    assert [e["midi"] for e in m.finalize(1200)] == [64]


def heads(ts, onset=0.0, frame=0.0, offset=0.0, vel=0.0, pedal=0.0, energy=-20.0):
    return {"ts_ms": ts, "energy": energy, "pedal": (0.0, 0.0, pedal), "keys": {69: (onset, frame, offset, vel)}}


def test_pedal_holds_and_releases():
    m = S.PedalSegmenter()
    got = run(m, [heads(1000, 0.85, 0.9, 0, 95, 0.8), heads(1100, 0, 0.3, 0, 0, 0.85), heads(1150, 0, 0.85, 0, 0, 0.85, -30.0), heads(1250, pedal=0.1)])
    assert kinds(got) == [["start"], ["end"], [], []]
    assert got[0][0]["velocity"] == 95 and got[0][0]["dynamic"] == "mf" and got[1][0]["damping"] == "PedalSustained" and got[1][0]["duration_s"] == pytest.approx(0.1) and not m.alive


def test_restrike_under_lockout():
    m = S.PedalSegmenter()
    got = run(m, [heads(1000, 0.9, 0.9, 0, 80), heads(1020, 0.95, 0.9, 0, 99), heads(1040, 0, 0.9), heads(1060, 0, 0.9), heads(1080, 0, 0.9), heads(1100, 0.9, 0.9, 0, 105)])
    assert kinds(got) == [["start"], [], [], [], [], ["end", "start"]] and got[5][0]["velocity"] == 80 and got[5][1]["velocity"] == 105


def test_ghosts_are_ignored_and_final_velocity_kept():
    assert kinds(run(S.PedalSegmenter(), [heads(1000, 0.05, 0.45)])) == [[]]
    m = S.PedalSegmenter()
    m.step(heads(1000, 0.9, 0.9, 0, 115))
    assert [(e["velocity"], e["dynamic"]) for e in m.finalize(1200)] == [(115, "ff")]


def test_open_note_is_handed_over():
    m = S.HybridSegmenter()
    frame = lambda ts, clarity, keys: {**mono(440, 0.95, -12, None, ts), "energy": -12, "keys": keys, "nsdf": (clarity, 0.1)}
    assert kinds(run(m, [frame(1000, 0.9, {}), frame(1050, 0.3, {69: (0.1, 0.9)}), frame(1100, 0.9, {})])) == [["start"], [], []]


def test_envelope_reattacks_after_a_dip():
    step = lambda db, ts, crest=5.0, note=(69, 0): {"note": note, "dbfs": db, "ts_ms": ts, "crest": crest}
    m = S.Envelope()
    got = run(m, [step(-20, 0), step(-15, 20), step(-18, 40), step(-24, 60), step(-18, 80), step(-26, 100), step(-20, 120, 13.0), step(-20, 140, note=None)])
    assert kinds(got) == [["start"], [], [], [], [], [], ["end", "start"], ["end"]] and got[6][0]["rise_s"] == pytest.approx(0.04)


def test_tempo_of_impulses():
    t = TempoTracker()
    out = [t.step(2.0 if i % 43 == 0 else 0.0) for i in range(600)]
    assert abs(out[-1]["bpm"] - 120) < 15 and 10 <= sum(o["beat"] for o in out[100:]) <= 16


def test_cents_are_those_of_the_nearest_semitone():
    m = S.MonoSegmenter()
    m.step(mono(440, 0.95, -10, None, 1000))
    for i in range(9):
        m.step(mono(440 * 2 ** (0.6 / 12), 0.95, -10, None, 1012 + 12 * i))
    assert m.finalize(1200)[0]["cents"] == -36


def test_keys_carry_what_the_frame_says():
    frame = lambda ts, p, sones: {"ts_ms": ts, "energy": -20.0, "crest": 17.0, "thump": -10.0, "centroid": 900.0, "keys": {60: (0.0, p)}, "sones": {60: sones}}
    m = S.KeySegmenter("Piano")
    start = m.step(frame(0, 0.9, 8.0))[0]
    m.step(frame(100, 0.9, 2.0))
    end = m.step(frame(200, 0.1, 0.0))[0]
    assert start["dynamic"] == S.level(S.phons(8.0), S.PHONS) and end["is_mashed"] and end["centroid"] == 900.0 and end["avg_sones"] == pytest.approx(5.0)
    m = S.PedalSegmenter()
    m.step({**frame(0, 0.9, 4.0), "pedal": (0.0, 0.0, 0.9), "keys": {60: (0.9, 0.9, 0.0, 80.0)}})
    assert m.pedal and m.finalize(100)[0]["is_mashed"] and not m.pedal


def test_keys_by_state_equal_keys_by_windows(spark):
    from tessitura.functions.profiles import instrument_profiles
    from tessitura.operators import notes

    rng, rows = np.random.default_rng(9), []
    for s in range(3):
        for i in range(120):
            for midi in (60, 64):
                rows.append((s, midi, i, 1000 + 20 * i, float(rng.choice([0.1, 0.9], p=[0.3, 0.7])), float(rng.choice([0.0, 0.8], p=[0.8, 0.2])), float(rng.uniform(-40, -5)), 0, 15.5, -10.0, 700.0, float(rng.uniform(0.5, 9))))
    names = "stream int, midi int, frame_idx int, ts_ms bigint, frame_p double, onset_p double, dbfs double, cents int, crest double, thump double, centroid double, sones double"
    df = spark.createDataFrame(rows, names)
    found = notes.accumulated(notes.islands(df, ["stream", "midi"], "frame_idx", "ts_ms", "frame_p", "onset_p", 0.4, 0.5), ["stream", "midi"], "frame_idx", "ts_ms", "dbfs", "cents", "crest", "thump", "centroid", "sones")
    ends = {(r["stream"], r["midi"], r["strike_ms"]): (r["note_duration"], r["velocity"], r["dynamic"], r["articulation"], r["is_mashed"]) for r in notes.ends(found, instrument_profiles(spark), "Piano").collect()}
    want = {}
    for s in range(3):
        for midi in (60, 64):  # an energy of its own for each key, so one machine a key
            m = S.KeySegmenter("Piano")
            for r in (r for r in rows if r[:2] == (s, midi)):
                for e in m.step({"ts_ms": r[3], "energy": r[6], "crest": r[8], "thump": r[9], "centroid": r[10], "keys": {midi: (r[5], r[4])}, "sones": {midi: r[11]}}):
                    if e["kind"] == "end":
                        want[s, midi, e["strike_ms"]] = (e["duration_s"], e["velocity"], e["dynamic"], e["articulation"], e["is_mashed"])
    assert ends == want and len(want) > 40


def stream_rows():
    rng = np.random.default_rng(4)
    rows = []
    for s in range(4):
        for i in range(80):
            rows.append((f"s{s}", int(1000 + i * 12), float(rng.choice([440.0, 523.25, 0.0])), float(rng.choice([0.95, 0.2])), float(rng.uniform(-40, -5)), None, bool(rng.random() < 0.05), i == 79))
    return rows


FRAMES = "stream_id string, ts_ms bigint, hz double, clarity double, dbfs double, onset_ms bigint, is_silent boolean, is_last boolean"


def test_stream_equals_batch_and_a_plain_loop(spark, tmp_path):
    rows = stream_rows()
    df = spark.createDataFrame(rows, FRAMES)
    batch = sorted(map(repr, map(tuple, transcribe.folded(df, S.MonoSegmenter).collect())))
    loop = []
    for s in sorted({r[0] for r in rows}):
        m = S.MonoSegmenter()
        for _, ts, hz, clarity, dbfs, _, silent, last in (r for r in rows if r[0] == s):
            events = m.finalize(ts) if silent else m.step(mono(hz, clarity, dbfs, None, ts))
            loop += [(s, *(e.get(c) for c in transcribe.COLUMNS)) for e in events + (m.finalize(ts) if last else [])]
    assert batch == sorted(map(repr, loop)) and len(batch) > 20
    for k in range(3):
        df.where(f"ts_ms % 36 >= 0 AND floor((ts_ms - 1000) / 12 / 27) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = streaming.transcribed(streaming.frame_files(spark, str(tmp_path / "in"), FRAMES, 3), S.MonoSegmenter).writeStream.format("memory").queryName("notes").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
    query.awaitTermination(120)
    assert sorted(map(repr, map(tuple, spark.table("notes").collect()))) == batch

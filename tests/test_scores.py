"""Scores and playback by document; WAV files and settings."""

import io
import struct
import zipfile

import numpy as np
import pytest

from tessitura.operators import playback
from tessitura.sources import audio, scores

HEAD = "<part-list><score-part id='P1'><part-name>Violin</part-name></score-part></part-list>"


def note(step, octave, n, extra="", before=""):
    return f"<note>{before}<pitch><step>{step}</step><octave>{octave}</octave></pitch><duration>{n}</duration>{extra}</note>"


def score(*measures, head=HEAD):
    return f"<score-timewise>{head}{''.join(f'<measure number={chr(39)}{i}{chr(39)}><part id={chr(39)}P1{chr(39)}>{m}</part></measure>' for i, m in enumerate(measures, 1))}</score-timewise>".encode()


def rows(data, target=None, *kinds):
    return [r for r in scores.parse_score(data, target) if not kinds or r["kind"] in kinds]


ROW = "score string, measure int, ord int, kind string, value string, times int"


def orders(spark, scripts):
    """Measures in playing order, from 0, of scores given by the marks of their measures."""
    data = [(str(s), m, o, *r) for s, measures in enumerate(scripts) for m, marks in enumerate(measures) for o, r in enumerate([("Measure", None, None), *((r["kind"], r.get("value"), r.get("times")) for r in marks)])]
    out = [[] for _ in scripts]
    for r in sorted(playback.playback(spark.createDataFrame(data, ROW)).collect(), key=lambda r: r["pos"]):
        assert r["pos"] == len(out[int(r["score"])])
        out[int(r["score"])].append(r["measure"])
    return out


def played(spark, *documents):
    scripts = []
    for data in documents:
        found = rows(data)
        scripts.append([[r for r in found if r.get("measure") == i and r["kind"] in playback.KINDS] for i in range(sum(r["kind"] == "Measure" for r in found))])
    return [[i + 1 for i in order] for order in orders(spark, scripts)]


def test_chord_and_dynamics():
    quiet = "<direction><direction-type><dynamics><p/></dynamics></direction-type></direction>"
    data = score("<attributes><divisions>6</divisions></attributes>" + note("B", 2, 3) + quiet + note("F", 3, 6) + note("A", 3, 9, before="<chord/>") + note("E", 5, 3))
    got = rows(data, None, "Note")
    assert [(r["midi"], r["start"], r["start"] + r["duration"]) for r in got] == [(47, 0, 3), (53, 3, 9), (57, 3, 12), (76, 9, 12)]  # the cursor moves by the chord's first note
    assert [(r["dynamic"], r["velocity"]) for r in got[1:]] == [("p", 55)] * 3


def test_backup_brings_voices_together():
    got = rows(score(note("A", 4, 6) + "<backup><duration>4</duration></backup>" + note("F", 3, 2, "<voice>3</voice>") + note("G", 3, 2, "<voice>3</voice>")), None, "Note")
    assert [(r["start"], r["start"] + r["duration"], r["voice"]) for r in got] == [(0, 6, 1), (2, 4, 3), (4, 6, 3)]


def test_transposition_and_tempo():
    data = score("<attributes><divisions>8</divisions><transpose><chromatic>-2</chromatic></transpose></attributes><direction><direction-type><metronome><beat-unit>quarter</beat-unit><per-minute>132</per-minute></metronome></direction-type></direction>" + note("C", 4, 8))
    assert rows(data, None, "Note")[0]["midi"] == 58 and rows(data, None, "Tempo")[0]["amount"] == 132.0 and rows(data, None, "Measure")[0]["divisions"] == 8


def test_pedal_octave_fermata_and_trill():
    data = score("<direction><direction-type><pedal type='start'/></direction-type></direction><direction><direction-type><octave-shift type='down' size='8'/></direction-type></direction>" + note("C", 4, 4, "<notations><fermata/><ornaments><trill-mark/></ornaments></notations>"))
    n = rows(data, None, "Note")[0]
    assert (n["midi"], n["pedaled"], n["fermata"], n["ornament"]) == (72, True, True, "Trill")


def test_tie_across_a_repeat(spark):
    data = score(note("C", 4, 4, "<tie type='start'/>") + "<barline><repeat direction='backward'/></barline>", note("C", 4, 4, "<tie type='stop'/>"))
    assert played(spark, data) == [[1, 1, 2]]
    df = scores.score_rows(spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"<x/>")), ("c", None)], "path string, content binary"))
    assert playback.unrolled_notes(df).count() == 3 and playback.unrolled_notes(df, True).count() == 2
    assert sorted(r["score"] for r in df.where("kind = 'Error'").collect()) == ["b", "c"]


def test_voltas(spark):
    end = lambda n, kind, more="": f"<barline><ending number='{n}' type='{kind}'/>{more}</barline>"
    data = score(note("A", 3, 2), "<barline location='left'><repeat direction='forward'/></barline>" + note("B", 3, 2), end("1, 2", "start") + note("F", 4, 2) + end("1, 2", "stop", "<repeat direction='backward' times='3'/>"), end(3, "start") + note("G", 4, 2) + end(3, "stop"), note("A", 4, 2))
    assert played(spark, data) == [[1, 2, 3, 2, 3, 2, 4, 5]]


def test_jumps(spark):
    words = lambda w: f"<direction><direction-type><words>{w}</words></direction-type></direction>"
    sign = "<direction><direction-type><segno/></direction-type></direction>"
    fine, segno, endless = score(note("C", 4, 4), words("Fine") + note("D", 4, 4), words("D.C.") + note("E", 4, 4)), score(note("C", 4, 4), sign + note("D", 4, 4), words("D.S.") + note("E", 4, 4)), score("<barline><repeat direction='backward' times='5000'/></barline>")
    one, two, three = played(spark, fine, segno, endless)
    assert one == [1, 2, 3, 1, 2] and two == [1, 2, 3, 2, 3] and three == [1] * 1024


def test_parts_names_and_filters():
    part = lambda i, name: f"<score-part id='P{i}'><part-name>{name}</part-name></score-part>"
    head = f"<part-list>{part(1, 'Horn')}<part-group type='start'><group-name>Low Strings</group-name></part-group>{part(2, 'Cello')}{part(3, 'low strings 2')}{part(4, '')}<part-group type='stop'/></part-list>"
    body = "".join(f"<part id='P{i}'><attributes><key><fifths>-3</fifths></key></attributes>{note(s, 3, 2)}</part>" for i, s in ((1, "D"), (2, "F"), (3, "A"), (4, "B")))
    data = f"<score-timewise>{head}<measure number='1'>{body}</measure></score-timewise>".encode()
    meta = rows(data, None, "Meta")[0]
    assert meta["instruments"] == ["Horn", "Low Strings - Cello", "low strings 2", "Low Strings"] and (meta["value"], meta["times"]) == ("Parts", 4)
    assert [r["midi"] for r in rows(data, "CELLO", "Note")] == [53] and len(rows(data, "strings", "Note")) == 3 and len(rows(data, "harp", "Note")) == 4
    assert len(rows(data, None, "Key")) == 1
    assert len(rows(score(note("C", 4, 4)), "harp", "Note")) == 1


def test_metadata_and_archives():
    head = "<work><work-title>Étude</work-title></work><identification><creator type='composer'>A. B.</creator></identification>" + HEAD
    data = score("<attributes><staves>2</staves></attributes>" + note("C", 4, 4), head=head)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("META-INF/container.xml", "<c/>")
        z.writestr("score.xml", data)
    for d in (data, packed.getvalue()):
        meta = rows(d, None, "Meta")[0]
        assert (meta["title"], meta["composer"], meta["value"], meta["times"]) == ("Étude", "A. B.", "Staves", 2)


def wav(samples, channels=1, rate=44100, bits=16):
    body = np.asarray(samples).astype(f"<i{bits // 8}").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits) + b"data" + struct.pack("<I", len(body)) + body


def test_wav_hops_and_rejects(spark):
    rate, x = audio.decode(wav([0, 16384, -32768, 0], channels=2))
    assert rate == 44100 and x.tolist() == [0.25, -0.5]
    files = [("good", wav(np.zeros(1000))), ("empty", wav([])), ("slow", wav([1], rate=4000)), ("text", b"hello"), ("none", None)]
    df = audio.wav_hops(spark.createDataFrame([(a, None if b is None else bytearray(b)) for a, b in files], "path string, content binary"))
    assert df.where("stream_id = 'good' AND error IS NULL").count() == 7 and df.where("size(samples) != 512").count() == 0
    assert sorted(r["stream_id"] for r in df.where("error IS NOT NULL").collect()) == ["empty", "none", "slow", "text"]


def test_settings_fall_back(spark, tmp_path):
    assert audio.read_settings(spark, str(tmp_path / "none.json")) == audio.SETTINGS
    (tmp_path / "s.json").write_text('{"username": "x"}')
    assert audio.read_settings(spark, str(tmp_path / "s.json")) == audio.SETTINGS | {"username": "x"}


def test_numbers_of_voltas(spark):
    numbers = ["1", "1, 2", "1.", "1-3", " 1 - 3 . ", "1 2", None, "x", "", "12,7"]
    found = spark.createDataFrame([(n,) for n in numbers], "n string").select(playback.turns(playback.F.col("n"))).collect()
    assert [[tuple(t) for t in r[0]] for r in found] == [[(1, 1)], [(1, 1), (2, 2)], [(1, 1)], [(1, 3)], [(1, 3)], [], [], [], [], [(12, 12), (7, 7)]]


def test_movements():
    title = lambda head: (lambda m: (m["title"], m["movement"]))(rows(score(note("C", 4, 4), head=head + HEAD), None, "Meta")[0])
    work, movement, number = "<work><work-title>W</work-title></work>", "<movement-title>M</movement-title>", "<movement-number>2</movement-number>"
    assert [title(x) for x in (work + movement + number, work + number, number + movement, number, "")] == [("W", "M"), ("W", "2"), ("M", "2"), ("Unknown Title", "2"), ("Unknown Title", None)]


def jump(kind):
    return {"kind": "Jump", "value": kind, "times": None}


BACK, FORTH, STOP = {"kind": "RepeatEnd"}, {"kind": "RepeatStart"}, {"kind": "EndingStop"}


def volta(number):
    return {"kind": "EndingStart", "value": number}


#: Marks of measures, and the order in which the rules have them played.
SCRIPTS = [
    ([[jump("Segno")], [jump("DaCapo")], [jump("DalSegno")]], [0, 1, 0, 1, 2]),  # one jump in all
    ([[], [BACK, jump("DaCapo")], []], [0, 1, 0, 1, 2]),  # a jump goes before the repeat of its measure, which then counts as taken
    ([[], [BACK, jump("Fine")], [jump("DaCapo")], []], [0, 1, 0, 1, 2, 0, 1]),  # Fine ends at once, also in a measure with a repeat
    ([[jump("ToCoda")], [jump("DaCapo")], [], [jump("Coda")]], [0, 1, 0, 3]),
    ([[], [{**BACK, "times": 4}], []], [0, 1] * 4 + [2]),
    ([[FORTH], [jump("ToCoda"), BACK], [jump("DaCapo")], [jump("Coda")]], [0, 1, 0, 1, 2, 0, 1, 0, 1, 3]),  # the repeat stands behind the way to the coda and goes first
    ([[], [volta("1"), jump("DaCapo"), BACK], [volta("2")], []], [0, 1, 0, 2, 3]),  # the repeat behind a D.C. counts: the second turn follows
    ([[FORTH], [volta("1"), STOP, BACK], [volta("2"), STOP, BACK], [volta("3"), STOP], []], [0, 1, 0, 2, 0, 3, 4]),
    ([[], [volta("2")], [], [STOP], []], [0, 4]),  # voltas of another turn are skipped to their end
    ([[], [volta("1")], [], [BACK]], [0, 1, 2, 3, 2, 3]),  # a section begins where a volta is left
    ([[jump("Coda")], [jump("DalSegno")], [jump("Segno"), jump("ToCoda")], [jump("DaCapo")]], [0, 1, 2, *[0, 1, 2] * 340, 0]),  # for ever
    ([[FORTH, FORTH], [BACK, {**BACK, "times": 9}], [FORTH], [], [BACK]], [0, 1, 0, 1, 2, 3, 4, 2, 3, 4]),  # of several signs the first counts
    ([], []),
    ([[]], [0]),
]


def test_scripts_of_repeats_voltas_and_jumps(spark):
    assert orders(spark, [measures for measures, _ in SCRIPTS]) == [want for _, want in SCRIPTS]


def test_playback_is_free_of_python(spark):
    plan = playback.playback(spark.createDataFrame([], ROW))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("bad", [b"", b"<a", b"PK\x03\x04zz"])
def test_broken_documents_raise(bad):
    with pytest.raises((ValueError, SyntaxError, zipfile.BadZipFile)):
        list(scores.parse_score(bad))


def test_a_note_is_read_in_one_pass(monkeypatch):
    """Plain notes are not searched for each of their children by path."""
    calls, found = [], scores.text
    monkeypatch.setattr(scores, "text", lambda *a: calls.append(a) or found(*a))
    assert len(rows(score(note("C", 4, 1) * 100), None, "Note")) == 100 and len(calls) < 100


def test_the_first_of_equal_children_counts():
    own = "<note><pitch><alter>1</alter></pitch><pitch><step>D</step><octave>4</octave><alter>-1</alter></pitch><duration>2</duration><duration>9</duration><voice/><notations><tied type='start'/></notations><tie type='stop'/></note>"
    n = rows(score(own), None, "Note")[0]
    assert (n["step"], n["alter"], n["midi"], n["duration"], n["voice"], n["tie"]) == ("D", 1, 63, 2, 1, "Continue")


def test_lines_are_collected_behind_the_shuffle(spark):
    from tessitura.plans import machines

    plan = machines.documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "collect_list" not in plan.rsplit("hashpartitioning(l_orderkey", 1)[1]

"""MusicXML and MXL documents -> measures, notes, attributes, repeats and rests as rows.

A document is parsed by one call in document order (directions, backups and notes depend on it); documents are spread over tasks. Part-wise documents are
turned to measures first. The parser's state (divisions, tempo, dynamic, transposition, octave shift, pedal) is shared by all parts of a score.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.functions import theory

# Steps, articulations in the order of their notation, ornaments.
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
ARTICULATIONS = {"staccato": "Staccato", "staccatissimo": "Staccato", "spiccato": "Staccato", "tenuto": "Tenuto", "accent": "Accent", "strong-accent": "Marcato"}
ORNAMENTS = {"trill-mark": "Trill", "turn": "Turn", "inverted-turn": "InvertedTurn", "mordent": "Mordent", "inverted-mordent": "InvertedMordent", "tremolo": "Tremolo", "shake": "Shake", "schleifer": "Schleifer"}
SCHEMA = (
    "score string, measure int, number string, ord int, kind string, start int, duration int, part int, midi int, step string, alter int, octave int, velocity int, dynamic string, articulation string, tie string, voice int, staff int, "
    "is_grace boolean, is_chord boolean, fermata boolean, ornament string, pedaled boolean, value string, amount double, location string, times int, divisions int, implicit boolean, title string, movement string, composer string, instruments array<string>, error string"
)


def xml_of(data: bytes) -> bytes:
    """The score of an MXL archive (its first root .xml outside META-INF, else the first .xml), or the bytes themselves."""
    if data[:2] != b"PK":
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith((".xml", ".musicxml")) and not n.startswith("META-INF")]
        names = [n for n in names if "/" not in n] or names
        if not names:
            raise ValueError("no score in the archive")
        return z.read(names[0])


def text(e: ElementTree.Element | None, path: str, default: str | None = None) -> str | None:
    found = e.findtext(path) if e is not None else None
    return found.strip() if found is not None else default


def whole(value: str | None, default: int = 0) -> int:
    if value is None:
        return default
    try:
        return int(float(value))
    except (TypeError, ValueError):
        return default


def metadata(root: ElementTree.Element) -> dict:
    credit = lambda kind: next((text(c, "credit-words") for c in root.findall("credit") if kind in [t.text for t in c.findall("credit-type")] and text(c, "credit-words")), None)
    creators = [(c.get("type"), (c.text or "").strip()) for c in root.findall("identification/creator")]
    names, group = [], None
    for e in root.find("part-list") if root.find("part-list") is not None else []:
        if e.tag == "part-group":
            group = (text(e, "group-name") or None) if e.get("type") == "start" else None if e.get("type") == "stop" else group
        elif e.tag == "score-part":
            own = text(e, "part-name", "")
            names.append((e.get("id"), own if not group else group if not own else own if group.lower() in own.lower() else f"{group} - {own}"))
    work, movement, number = text(root, "work/work-title"), text(root, "movement-title"), text(root, "movement-number")
    return {
        "title": work or movement or credit("title") or "Unknown Title",
        "movement": (movement if work else None) or number,
        "composer": next((n for t, n in creators if t == "composer" and n), None) or next((n for _, n in creators if n), None) or credit("composer") or "Unknown Composer",
        "parts": names,
    }


def measures_of(root: ElementTree.Element) -> list[tuple[ElementTree.Element, list[tuple[str, list[ElementTree.Element]]]]]:
    """(measure, its parts with their elements) in order, of a time-wise or part-wise score."""
    if root.tag == "score-timewise":
        return [(m, [(p.get("id"), list(p)) for p in m.findall("part")] or [(None, list(m))]) for m in root.findall("measure")]
    parts = [(p.get("id"), p.findall("measure")) for p in root.findall("part")]
    n = max((len(ms) for _, ms in parts), default=0)
    return [(next(ms[i] for _, ms in parts if i < len(ms)), [(pid, list(ms[i])) for pid, ms in parts if i < len(ms)]) for i in range(n)]


def chosen(parts: list[tuple[str, str]], target: str | None) -> set[str] | None:
    """Ids of the parts whose name holds the target; a lone part always; None for no filter."""
    if not target:
        return None
    found = {i for i, n in parts if target.lower() in n.lower()}
    return found or ({parts[0][0]} if len(parts) == 1 else None)


class Parser:
    def __init__(self, parts: set[str] | None):
        self.parts, self.divisions, self.bpm, self.dynamic, self.transposed, self.shift, self.pedal = parts, 1, None, None, 0, 0, False
        self.rows: list[dict] = []

    def row(self, kind: str, start: int, **more) -> None:
        self.rows.append({"kind": kind, "start": start, **more})

    def measure(self, parts: list[tuple[str | None, list[ElementTree.Element]]]) -> list[dict]:
        self.rows = []
        for index, (pid, elements) in enumerate(parts):
            self.at = self.last = 0
            for e in elements:
                if e.tag == "note":
                    self.note(e, index, self.parts is None or pid is None or pid in self.parts)
                elif e.tag in ("backup", "forward"):
                    self.at = max(0, self.at + whole(text(e, "duration")) * (1 if e.tag == "forward" else -1))
                elif hasattr(self, e.tag):
                    getattr(self, e.tag)(e)
        return self.rows

    def note(self, e: ElementTree.Element, part: int, kept: bool) -> None:
        found: dict[str, ElementTree.Element] = {}  # the first child of each tag, and the first of each tag in a pitch: one pass, not a search for each
        pitch: dict[str, ElementTree.Element] = {}
        ties, notations = set(), []
        for x in e:
            if x.tag == "pitch":
                for y in x:
                    pitch.setdefault(y.tag, y)
            elif x.tag == "tie":
                ties.add(x.get("type"))
            elif x.tag == "notations":
                notations.append(x)
            else:
                found.setdefault(x.tag, x)
        said = lambda own, tag: (own[tag].text or "").strip() if tag in own else None
        grace, chord = "grace" in found, "chord" in found
        n = 0 if grace else whole(said(found, "duration"))
        start = self.last if chord else self.at
        if not chord:
            self.last = self.at
            self.at += n
        if not kept:  # the cursor moves on all the same
            return
        voice, staff = whole(said(found, "voice"), 1), whole(said(found, "staff"), 1)
        if "rest" in found:
            self.row("Rest", start, duration=n, part=part, voice=voice, staff=staff)
            return
        step, alter, octave = said(pitch, "step"), whole(said(pitch, "alter")), whole(said(pitch, "octave"))
        midi = min(max((octave + 1) * 12 + STEPS[step] + alter + self.transposed + self.shift, 0), 127) if step in STEPS else 0
        marks, ornaments, fermata = [], [], False
        if notations:
            ties.update(t.get("type") for t in e.findall("notations/tied"))
            marks = [ARTICULATIONS[x.tag] for a in e.findall("notations/articulations") for x in a if x.tag in ARTICULATIONS] or ["Legato"] * (e.find("notations/slur") is not None)
            ornaments = [ORNAMENTS.get(x.tag, "Other") for o in e.findall("notations/ornaments") for x in o]
            fermata = e.find("notations/fermata") is not None
        tie = "Continue" if {"start", "stop"} <= ties or "continue" in ties else "Start" if "start" in ties else "Stop" if "stop" in ties else "None"
        level = self.dynamic or "mf"
        own = e.get("dynamics")
        velocity = int(min(max(float(own) / 100 * 90, 1), 127)) if own else theory.LEVEL_VELOCITY.get(level, theory.OTHER_VELOCITY)
        self.rows.append({
            "kind": "Note", "start": start, "duration": n, "part": part, "midi": midi, "step": step, "alter": alter, "octave": octave, "velocity": velocity, "dynamic": level, "articulation": marks[0] if marks else "Normal", "tie": tie, "voice": voice, "staff": staff, "is_grace": grace, "is_chord": chord,
            "fermata": fermata, "ornament": next((o for o in ornaments if o != "Other"), ornaments[0] if ornaments else None), "pedaled": self.pedal,
        })

    def attributes(self, e: ElementTree.Element) -> None:
        self.divisions = whole(text(e, "divisions"), self.divisions)
        for t in e.findall("transpose"):
            self.transposed = min(max(whole(text(t, "chromatic")) + 12 * whole(text(t, "octave-change")), -128), 127)
            self.row("Transpose", self.at, amount=float(self.transposed))
        for c in e.findall("clef"):
            self.row("Clef", self.at, value=text(c, "sign"), amount=float(whole(text(c, "line"))))
        for k in e.findall("key"):
            self.row("Key", self.at, amount=float(whole(text(k, "fifths"))))
        for t in e.findall("time"):
            for beats, kind in zip(t.findall("beats"), t.findall("beat-type"), strict=False):
                self.row("Time", self.at, value=f"{beats.text}/{kind.text}")

    def sound(self, e: ElementTree.Element, at: int | None = None) -> None:
        at = self.at if at is None else at
        if e.get("tempo"):
            self.bpm = int(float(e.get("tempo")))
            self.row("Tempo", at, value="Set", amount=float(self.bpm))
        if e.get("dynamics"):
            percent = float(e.get("dynamics"))
            self.dynamic = theory.LEVELS[sum(percent >= c for c in theory.PERCENT_CUTS)]
            self.row("Dynamic", at, value=self.dynamic)
        for name, kind in (("dacapo", "DaCapo"), ("dalsegno", "DalSegno"), ("segno", "Segno"), ("coda", "Coda"), ("tocoda", "ToCoda"), ("fine", "Fine")):
            if e.get(name):
                self.row("Jump", at, value=kind)

    def direction(self, e: ElementTree.Element) -> None:
        at = max(0, self.at + whole(text(e, "offset")))
        for s in e.findall("sound"):
            self.sound(s, at)
        for kind in e.findall("direction-type"):
            for d in kind:
                self.directed(d, at)

    def directed(self, d: ElementTree.Element, at: int) -> None:
        if d.tag == "words":
            self.words((d.text or "").strip(), at)
        elif d.tag == "dynamics":
            for mark in d:
                self.dynamic = {**{x: x for x in theory.LEVELS}, **theory.MARK_LEVEL}.get(mark.tag, "Other")
                self.row("Dynamic", at, value=self.dynamic)
        elif d.tag == "wedge":
            self.row("Wedge", at, value={"crescendo": "Crescendo", "diminuendo": "Diminuendo"}.get(d.get("type"), "Stop"))
        elif d.tag == "metronome":
            if text(d, "per-minute"):
                self.bpm = whole(text(d, "per-minute"))
                self.row("Tempo", at, value="Set", amount=float(self.bpm))
        elif d.tag == "pedal":
            self.pedal = d.get("type") in ("start", "resume", "change", "continue")
            self.row("Pedal", at, value=d.get("type"))
        elif d.tag == "octave-shift":
            n = 24 if d.get("size") == "15" else 12
            self.shift = {"down": n, "up": -n, "stop": 0}.get(d.get("type"), self.shift)
            self.row("OctaveShift", at, amount=float(self.shift))
        elif d.tag in ("segno", "coda"):
            self.row("Jump", at, value=d.tag.capitalize())

    def words(self, said: str, at: int) -> None:
        w = said.lower()
        has = lambda *parts: any(p in w for p in parts)
        if has("rit", "rall"):
            self.row("Tempo", at, value="Ritardando")
        elif has("accel"):
            self.row("Tempo", at, value="Accelerando")
        elif has("a tempo", "tempo i", "tempo primo"):
            self.row("Tempo", at, value="ATempo", amount=None if self.bpm is None else float(self.bpm))
        elif w == "cresc." or has("crescendo"):
            self.row("Wedge", at, value="Crescendo")
        elif w == "dim." or has("diminuendo", "decresc"):
            self.row("Wedge", at, value="Diminuendo")
        elif w == "d.c." or has("da capo"):
            self.row("Jump", at, value="DaCapo")
        elif w == "d.s." or has("dal segno"):
            self.row("Jump", at, value="DalSegno")
        elif w == "fine":
            self.row("Jump", at, value="Fine")
        elif has("to coda"):
            self.row("Jump", at, value="ToCoda")
        elif (level := {**{x: x for x in theory.LEVELS}, **theory.WORD_LEVEL}.get(w)) is not None:
            self.dynamic = level
            self.row("Dynamic", at, value=level)
        else:
            self.row("Words", at, value=said)

    def barline(self, e: ElementTree.Element) -> None:
        where = (e.get("location") or "right").capitalize()
        for name in ("segno", "coda"):
            if e.find(name) is not None:
                self.row("Jump", self.at, value=name.capitalize(), location=where)
        for x in e.findall("ending"):
            self.row("EndingStart" if x.get("type") == "start" else "EndingStop", self.at, value=x.get("number"), location=where)
        for x in e.findall("repeat"):
            forward = x.get("direction") == "forward"
            self.row("RepeatStart" if forward else "RepeatEnd", self.at, times=None if forward else whole(x.get("times"), 2), location=where)


def _place(r: dict) -> tuple[int, int]:
    """Content order: left repeats and ending starts, attributes, notes and rests by division, other repeats last."""
    kind = r["kind"]
    if kind == "Note":
        return r["start"], 2
    if kind in ("RepeatStart", "EndingStart"):
        return 0, 0
    if kind in ("RepeatEnd", "EndingStop", "Jump"):
        return 1 << 32, 4
    return r["start"], 3 if kind == "Rest" else 1


def parse_score(data: bytes, target: str | None = None) -> Iterator[dict]:
    """Rows of one document: a Meta row, then a Measure row and the content of each measure in playing order within it."""
    root = ElementTree.fromstring(xml_of(data))
    if root.tag not in ("score-timewise", "score-partwise"):
        raise ValueError("not a score")
    found = metadata(root)
    measures = measures_of(root)
    names = [n for _, n in found["parts"]]
    staves = next((whole(text(e, "staves"), 1) for _, parts in measures for _, es in parts for e in es if e.tag == "attributes" and e.find("staves") is not None), 1)
    listed = ("Parts", len(names)) if len(names) > 1 else ("Staves", staves) if staves > 1 else ("Parts", max(len(names), 1))
    yield {"kind": "Meta", "title": found["title"], "movement": found["movement"], "composer": found["composer"], "instruments": names, "value": listed[0], "times": listed[1], "amount": float(len(measures))}
    parser = Parser(chosen(found["parts"], target))
    for i, (m, parts) in enumerate(measures):
        seen, rows = set(), []
        for r in sorted(parser.measure(parts), key=_place):
            key = None if r["kind"] in ("Note", "Rest") else repr(sorted(r.items(), key=str))
            if key is None or key not in seen:  # what several parts repeat counts once
                seen.add(key)
                rows.append(r)
        yield {"kind": "Measure", "measure": i, "number": m.get("number"), "divisions": parser.divisions, "implicit": {"yes": True, "no": False}.get(m.get("implicit")), "ord": 0}
        number = m.get("number")
        for n, r in enumerate(rows, 1):
            r["measure"], r["number"], r["ord"] = i, number, n
            yield r


#: Rows that are turned into columns together.
ROWS = 1 << 14
ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def score_rows(documents: DataFrame, name: str = "path", content: str = "content", target: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """(name, bytes) -> rows of SCHEMA, or of those ``fields`` of it; a document that can't be parsed gives one row of kind Error. Nulls count as such."""
    kinds = {c.split()[0]: c.split()[1] for c in SCHEMA.split(", ")}
    kinds = {c: k for c, k in kinds.items() if not fields or c in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def columns() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in held], ARROW[k]) for c, k in kinds.items()], list(kinds))
            held.clear()
            return made

        for batch in batches:
            for score, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = list(parse_score(data or b"", target))
                except (ValueError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    rows = [{"kind": "Error", "error": str(e)}]
                for r in rows:
                    r["score"] = score
                    held.append(r)
                    if len(held) >= ROWS:
                        yield columns()
        yield columns()

    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return documents.select(F.col(name).cast("string").alias("score"), F.col(content).cast("binary").alias("data")).mapInArrow(run, schema)


def read_scores(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Scores of files or folders (.xml, .musicxml, .mxl)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(xml|musicxml|mxl)$"))
    return score_rows(files, "path", "content", target)

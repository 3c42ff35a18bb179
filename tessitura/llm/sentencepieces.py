"""Encoding with merge-type SentencePiece models by backtracking, and decoding.

The encoder never merges a text from its characters up. It takes the longest piece at each place (Aho-Corasick), keeps it if it may stand beside the piece
before it, else tries that piece's next shorter prefix, and steps back where none fits; a bit per place remembers that nothing fits there. Two pieces may
stand side by side if merging their characters anew gives exactly them: a sequence whose neighbours all may is the one that merging the whole text gives.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tessitura.llm.common import batches, lean, strings
from tessitura.llm.token_counts import local_file

#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
#: Chunks up to this length and this many of them (and as many older ones) are remembered by a worker, and as many pairs of pieces.
KEPT_CHARS, KEPT_CHUNKS = 48, 1 << 18
MOST_BYTES = 8 << 20
#: A model is refused if the library encodes a text of this many of its own pieces otherwise (one of another type does).
PROBE = 2000


class Memo(dict):
    """A mapping of strings or pairs of them that computes what it lacks and remembers it, if short; when full, all but what is met again goes."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute, self.old = compute, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.compute(key)
        if len(key) <= KEPT_CHARS:
            if len(self) >= KEPT_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class PieceEncoder:
    """Texts to ids, as the sentencepiece library gives them for a merge-type (BPE) model, without begin and end ids."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.score = {p: sp.get_score(i) for p, i in self.plain.items()}
        self.unknown = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.automaton = ahocorasick.Automaton()
        for piece in self.plain:
            if len(piece) > 1:  # a character alone is there without a search
                self.automaton.add_word(piece, piece)
        self.searches = len(self.automaton) > 0
        if self.searches:
            self.automaton.make_automaton()
        self.shorter = {p: self._shorter(p) for p in self.plain if len(p) > 1}
        # where no piece goes on from another character to a mark, no merge does either, and a text falls apart before each run of marks
        joined = any(MARK in p.lstrip(MARK) for p in self.plain)
        self.chunks = (lambda text: [text]) if joined else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.fits = Memo(lambda pair: self.merged(pair[0] + pair[1]) == [p for p in pair if p])
        self.known = Memo(self.chunk_ids)
        # a model that leaves every character as it is, and white space too, only marks spaces
        every = "".join(map(chr, [*range(1, 0x2581), *range(0x2582, 0xD800), *range(0xE000, 0x20000)]))
        self.as_it_is = all(sp.normalize(t) == self.marked(t) for t in (every, "  a  b ", "e\u0301 \u1100\u1161"))
        probe = " ".join(p.replace(MARK, " ") for p in list(self.plain)[:PROBE])
        if any(sp.is_unused(i) for i in ids) or self.ids(probe).tolist() != sp.encode(probe):
            raise ValueError("not a merge-type model of plain pieces")

    def merged(self, chars: str) -> list[str]:
        """The pieces of a short string by plain merging: the best score first, the leftmost of equals."""
        parts, score, none = list(chars), self.score.get, float("-inf")
        gains = [score(a + b, none) for a, b in pairwise(parts)]
        while gains and (best := max(gains)) > none:
            i = gains.index(best)
            parts[i] += parts.pop(i + 1)
            del gains[i]
            if i:
                gains[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece, or the first character."""
        return next((cut for n in range(len(piece) - 1, 1, -1) if (cut := piece[:n]) in self.plain), piece[0])

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalised text; a character that no piece holds is one of its own."""
        n, fits, shorter = len(text), self.fits, self.shorter
        longest = list(text)
        if self.searches:
            for end, piece in self.automaton.iter(text):
                longest[end + 1 - len(piece)] = piece  # ends only grow, so the last piece that begins at a place is its longest
        failed = bytearray(n // 8 + 1)  # a bit per place from which no way leads on
        out, at, before, dead = [], 0, "", False
        piece = longest[0] if n else None
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if fits[before, piece] and not (dead and failed[end >> 3] >> (end & 7) & 1):
                    break
                piece = shorter.get(piece)
            if piece is not None:
                out.append(piece)
                at, before = end, piece
                if at < n:
                    piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                dead = True
                piece = shorter.get(out.pop())
                at -= len(before)
                before = out[-1] if out else ""
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a chunk as 32-bit numbers; what no piece holds goes byte by byte, or, in a model without byte pieces, as -1."""
        pieces, ids = self.pieces(chunk), self.plain
        try:
            return array("i", map(ids.__getitem__, pieces)).tobytes()
        except KeyError:
            out: list[int] = []
            for piece in pieces:
                if piece in ids:
                    out.append(ids[piece])
                else:
                    out.extend(map(self.bytes.__getitem__, piece.encode("utf-8")) if self.bytes else (-1,))
            return array("i", out).tobytes()

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def ids(self, text: str) -> np.ndarray:
        chunks = self.chunks(self.marked(text) if self.as_it_is else self.library.normalize(text))
        found = np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), np.int32)
        if self.bytes:
            return found
        unknown = found == -1
        unknown[1:] &= ~(unknown[1:] & unknown[:-1])  # a run of unknown characters is one
        return np.where(unknown, self.unknown, found)[unknown | (found != -1)]

    def text(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(local_file(path))
    return _loaded[path]


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (array of int), n_tokens.

    model: path of a merge-type SentencePiece model that exists on every executor, or a name given to ``SparkContext.addFile``; others are refused.
    Null and empty texts have no ids; null ids and repeated rows pass through, one row out for each row in; other columns are ignored. Whole texts are
    encoded, chunk by chunk, in a narrow map without a shuffle; a task holds a batch and a bounded memo of chunks and pairs.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches(rows, MOST_BYTES):
            ids = [own.ids(t) for t in strings(batch.column(1)).to_pylist()]
            n = np.array([len(i) for i in ids], np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))), pa.array(n)], ["id", "ids", "n_tokens"])

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = kept.mapInArrow(lean(run), f"id {kept.schema['id'].dataType.simpleString()}, ids array<int>, n_tokens bigint")
    return out.withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the text of their ids, as the library decodes them, in ``out_col`` (which must be new). Null and empty arrays give an empty text; an id out of the model's range fails the task."""
    if out_col.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"{out_col} is a column already")
    at = rows.columns.index(ids_col)

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches(part, MOST_BYTES):
            ids = batch.column(at)
            flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [own.text(flat[low:high].tolist()) if known and high > low else "" for low, high, known in zip(ends, ends[1:], ids.is_valid().to_numpy(zero_copy_only=False), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), f"{fields}, `{out_col}` string")

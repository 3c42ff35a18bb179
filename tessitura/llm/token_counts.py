"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list; the count is symbols minus merges, and no identifier is made."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from tessitura.llm.common import batches, strings

#: Fixed value: the pre-tokenisation pattern of byte-level BPE. White space is spelled out: the regex module's \s also takes U+001C..U+001F.
SPACE = r"\t\n\v\f\r\x85\p{Z}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces up to this length and this many of them (and as many older ones) are remembered by a worker: some 60 MB when full.
KEPT_CHARS, KEPT_PIECES = 64, 1 << 18
PLACE = (1 << 40) - 1


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the rest take U+0100 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class MergeCounter(dict):
    """Piece -> number of tokens; as a mapping it computes missing pieces and remembers the short ones."""

    def __init__(self, ranks: dict[tuple[str, str], int], special: list[str]):
        super().__init__()
        self.old: dict[str, int] = {}
        self.ranks, self.pattern = ranks, regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.symbols = dict(enumerate(byte_symbols()))

    @classmethod
    def from_file(cls, path: str) -> MergeCounter:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        return cls({p: i for i, p in enumerate(pairs)}, [t["content"] for t in spec.get("added_tokens", [])])

    def __missing__(self, piece: str) -> int:
        found = self.old.pop(piece, 0) or self.merge(piece.encode("utf-8").decode("latin-1").translate(self.symbols))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:  # the older half goes, but for what is met again
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def merge(self, symbols: str) -> int:
        """Merges the lowest-ranked adjacent pair, the leftmost of equals, until none is left; O(n log n)."""
        n, ranks = len(symbols), self.ranks
        if n < 2:
            return n
        part, before, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        rank, merges = ranks.get, 0
        heap = [r << 40 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank(pair)) is not None]  # rank, then place
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & PLACE
            if (j := after[i]) >= n or rank((part[i], part[j])) != top >> 40:  # one of the two has been merged since
                continue
            merges += 1
            part[i] += part[j]
            part[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((part[i], part[k]))) is not None:
                    heapq.heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank((part[h], part[i]))) is not None:
                heapq.heappush(heap, r << 40 | h)
        return n - merges

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        if len(text) < 1 << 20:
            return sum(map(self.__getitem__, self.pattern.findall(text)))
        return sum(self[m.group()] for m in self.pattern.finditer(text))


def local_file(path: str) -> str:
    """A path that exists here, or that of a file given to ``SparkContext.addFile``."""
    return path if os.path.exists(path) else SparkFiles.get(path)


_loaded: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One per worker process, with its memo of at most 2 * KEPT_PIECES pieces."""
    if path not in _loaded:
        _loaded[path] = MergeCounter.from_file(local_file(path))
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE file (.json) that exists on every executor, or a name given to ``SparkContext.addFile``.
    Null and empty texts count 0 bytes and 0 tokens; null ids and repeated rows pass through, one row out for each row in; other columns are ignored.
    A narrow map over whole texts: no shuffle; a task keeps a bounded memo of pieces.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches(rows):
            texts = strings(batch.column(1))
            n = [own.count(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = kept.mapInArrow(count, f"id {kept.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_col)

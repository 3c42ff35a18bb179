"""Lexical retrieval packing: fixed windows of token ids, each begun by a seed document and filled with its nearest unused neighbours under BM25.

A document longer than a window first fills windows of its own; its last piece goes to a shard of lexically similar documents, where an inverted index
returns the unused neighbours of each seed. The last neighbour of a window is cut to fit, so only a shard's end is left over, and that is cut into
sequences of power-of-two length, which need no padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import batches, discard, lean, partitions, stored, strings
from tessitura.llm.token_counts import PATTERN as SPELLED_PATTERN
from tessitura.llm.token_counts import byte_symbols, local_file

#: Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_OF_TEXT = regex.compile(SPELLED_PATTERN)
K1, B = 1.2, 0.75
#: Bits of a document's key and of the key's prefix (the driver sums documents by prefix), and documents of a shard.
KEY_BITS, PREFIX_BITS, SHARD_DOCS = 24, 12, 1024
#: The directions of keys are fitted on so many documents (those of the smallest hash of their place), over terms folded to so many features.
FIT_SAMPLE, FOLDED, PRIME = 2048, 1024, 1_000_000_007
#: Terms in more than this share of a shard's documents have a row of weights for all of them.
COMMON = 1 / 8
SHARD_SEQUENCES, SHARD_BITS = 1 << 62, 14


class Encoder:
    """Token ids of whole texts from a byte-level BPE file. Ids must follow the merge order, as ranks do."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, vocabulary = {s: b for b, s in enumerate(byte_symbols())}, spec["model"]["vocab"]
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t["special"]}
        ranks = {bytes(byte[c] for c in s): i for s, i in vocabulary.items() if s not in special}
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.specials = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(special, key=len, reverse=True)) or "(?!)")
        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.bpe.encode_to_numpy(text, allowed_special="all").astype(self.kind)
        except ValueError:  # the library's pattern gives up on very long runs of white space
            return np.fromiter(self._piecewise(text), self.kind)

    def _piecewise(self, text: str) -> Iterator[int]:
        for part in self.specials.split(text):
            if part in self.bpe.special_tokens_set:
                yield self.bpe.encode_single_token(part)
            else:
                for m in PIECES_OF_TEXT.finditer(part):
                    yield from self.bpe._encode_single_piece(m.group())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process; its size is the vocabulary's."""
    if path not in _encoders:
        _encoders[path] = Encoder(local_file(path))
    return _encoders[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, vocabulary: str, window: int, end: int) -> DataFrame:
    """Per row: id, tokens (with the end id), seq (number of its first own window), crcs (of its whole windows), tail (ids after them), terms and counts."""

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seq = encoder(vocabulary), TaskContext.get().partitionId() << 33, 0
        for batch in batches(rows, 4 << 20):
            out: list[list] = [[] for _ in range(6)]
            for text in strings(batch.column(1)).to_pylist():
                ids = own.ids(text)
                terms, counts = np.unique(ids, return_counts=True)
                ids = np.append(ids, own.kind.type(end))
                whole = len(ids) // window
                values = (len(ids), task + seq, [crc(ids[i * window : (i + 1) * window]) for i in range(whole)], ids[whole * window :].tobytes(), terms.tobytes(), np.minimum(counts, 65535).astype("<u2").tobytes())
                seq += max(whole, 1)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["id", "tokens", "seq", "crcs", "tail", "terms", "counts"])

    return docs.mapInArrow(lean(make), "id bigint, tokens bigint, seq bigint, crcs array<bigint>, tail binary, terms binary, counts binary")


def corpus_statistics(rows: DataFrame, size: int, kind: np.dtype) -> tuple[np.ndarray, float]:
    """Inverse document frequencies of all terms and the mean length, over all rows; what comes to the driver is bounded by the vocabulary."""

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches_:
            terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind)
            total += np.bincount(terms, minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for term, n in rows.select("terms").mapInArrow(lean(count), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[term] = n
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("tokens")).first()
    return np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), float(mean or 1.0)


def _weighted(terms: bytes, counts: bytes, idf: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Terms and their BM25-like weights, of length 1 together."""
    t, n = np.frombuffer(terms, kind), np.frombuffer(counts, "<u2").astype(np.float32)
    weight = idf[t] * n / (n + np.float32(K1))
    return t, weight / max(float(np.sqrt(weight @ weight)), 1e-6)


def _directions(rows: DataFrame, idf: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(a row of KEY_BITS numbers per term, the sample's mean place): the principal directions of a bounded sample's folded terms, the widest first."""
    fold = np.random.default_rng(7)
    place, sign = fold.integers(0, FOLDED, len(idf)), fold.choice(np.array([-1, 1], np.float32), len(idf))
    shared = rows.sparkSession.sparkContext.broadcast((idf, place, sign))  # numbers per vocabulary entry

    def folded(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, plus = shared.value
        for batch in batches_:
            out = []
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                t, weight = _weighted(t, c, own, kind)
                out.append(np.bincount(at[t], plus[t] * weight, FOLDED).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(out, pa.binary())], ["seq", "x"])

    # about twice as many as wanted are ranked, whatever the table's size
    near = F.pmod(F.xxhash64("seq"), F.lit(PRIME)) < int(min(1.0, 2 * FIT_SAMPLE / max(rows.count(), 1)) * PRIME)
    sample = rows.where(near).select("seq", "terms", "counts").orderBy(F.xxhash64("seq"), "seq").limit(FIT_SAMPLE)
    found = sample.mapInArrow(lean(folded), "seq bigint, x binary").toArrow().sort_by("seq")  # FIT_SAMPLE rows of FOLDED numbers
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), "<f4").reshape(-1, FOLDED).astype(float)
    mean = x.mean(0) if len(x) else np.zeros(FOLDED)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    widest = vectors[:, ::-1][:, :KEY_BITS]
    return (sign[:, None] * widest[place]).astype(np.float32), (mean @ widest).astype(np.float32)


def _keyed(rows: DataFrame, idf: np.ndarray, kind: np.dtype) -> DataFrame:
    """Adds ``key``: on which side of the mean the terms lie along each principal direction, the widest direction in the highest bit."""
    shared = rows.sparkSession.sparkContext.broadcast((idf, *_directions(rows, idf, kind)))  # numbers per vocabulary entry

    def make(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, planes, mean = shared.value
        bits = 1 << np.arange(KEY_BITS)[::-1]
        for batch in batches_:
            keys = []
            for t, c in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                t, weight = _weighted(t, c, own, kind)
                keys.append(int((weight @ planes[t] > mean) @ bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int32())], [*batch.schema.names, "key"])

    return rows.mapInArrow(lean(make), "id bigint, tokens bigint, seq bigint, tail binary, terms binary, counts binary, key int")


def _dealt(tails: DataFrame) -> DataFrame:
    """Adds ``shard``: documents in a row by their keys, cut after each SHARD_DOCS.

    So rare keys that follow each other share a shard, and a key that many documents share lies in many, in which they are dealt by a hash. The driver
    sees a sum for each prefix of a key (2 ** PREFIX_BITS at most); running sums inside a prefix are a window's.
    """
    prefix = F.shiftright("key", KEY_BITS - PREFIX_BITS)
    counts = tails.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("prefix", prefix)
    sums = sorted((r["prefix"], r["n"]) for r in counts.groupBy("prefix").agg(F.sum("n").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in sums])]).astype(int).tolist()
    first = tails.sparkSession.createDataFrame([(p, at) for (p, _), at in zip(sums, before, strict=False)], "prefix int, at bigint")
    running = F.sum("n").over(Window.partitionBy("prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    places = counts.withColumn("till", running).join(F.broadcast(first), "prefix").select("key", "n", (F.col("at") + F.col("till") - F.col("n")).alias("start"))
    return tails.join(places, "key").withColumn("shard", F.expr(f"CAST(floor((start + pmod(xxhash64(seq), n)) / {SHARD_DOCS}) AS BIGINT)"))


class Index:
    """BM25 postings of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float):
        self.terms, self.counts, self.idf, self.n = terms, counts, idf, len(terms)
        doc = np.repeat(np.arange(self.n), [len(t) for t in terms])
        flat, tf = np.concatenate(terms), np.concatenate(counts).astype(np.float32)
        weight = idf[flat] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean))
        order = np.argsort(flat, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(flat[order], np.arange(len(idf) + 1))
        common = np.flatnonzero(np.diff(self.start) > COMMON * self.n)
        self.row = np.full(len(idf), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.n), np.float32)
        for i, x in enumerate(common):
            s = slice(self.start[x], self.start[x + 1])
            self.rows[i, self.doc[s]] = self.weight[s]

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents, for all terms of the seed: rows of common terms added up, postings of the others counted."""
        terms = self.terms[seed]
        row = self.row[terms]
        out = self.rows[row[row >= 0]].sum(0)
        spans = [slice(self.start[x], self.start[x + 1]) for x in terms[row < 0]]
        if spans:
            out = out + np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        return out


def fill_windows(index: Index, lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start in its tail, length). Seeds are taken longest first; all but the last sequence are full."""
    left, at, order = lengths.copy(), np.zeros(len(lengths), np.int64), np.lexsort((np.arange(len(lengths)), -lengths))
    sequences: list[list[tuple[int, int, int]]] = []
    open_from = 0
    while True:
        while open_from < len(order) and not left[order[open_from]]:
            open_from += 1
        if open_from == len(order):
            return sequences
        seed, pieces, free = order[open_from], [], window

        def take(i: int) -> None:
            nonlocal free
            n = int(min(left[i], free))
            pieces.append((int(i), int(at[i]), n))
            at[i] += n
            left[i] -= n
            free -= n

        take(seed)
        if free:
            score = np.where(left > 0, index.scores(seed), -1.0)
            for i in np.argsort(-score, kind="stable"):
                if not free or score[i] < 0:
                    break
                take(i)
        sequences.append(pieces)


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence that isn't full as sequences of power-of-two length, the longest first."""
    rest, out = list(pieces), []
    total = sum(p[2] for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            i, at, n = rest.pop(0)
            cut = min(n, room)
            out[-1].append((i, at, cut))
            if cut < n:
                rest.insert(0, (i, at + cut, n - cut))
            room -= cut
    return out


PIECES = "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then ``end``; each id lies in exactly one piece. Null texts are empty (the end id alone); null ids and repeated rows
    are packed as rows of their own; other columns are ignored; an empty table gives no pieces. Texts are read and tokenised once, into a table in the
    shared folder. Shards hold about SHARD_DOCS documents whatever the corpus.
    vocabulary: a path that exists on every executor, or a name given to ``SparkContext.addFile``.
    """
    own = encoder(vocabulary)
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(tokenised(base, vocabulary, window, end), "pack-tokens")
    size, kind = own.size, own.kind
    idf, mean = corpus_statistics(rows, size, kind)
    tails = stored(_keyed(rows.where("length(tail) > 0").drop("crcs"), idf, kind), "pack-tails")
    long = stored(rows.where("size(crcs) > 0").select("id", "tokens", "seq", "crcs"), "pack-whole")
    discard(rows)
    whole = long.select("id", "tokens", "seq", F.posexplode("crcs").alias("i", "crc")).selectExpr("id", f"CAST(i AS BIGINT) * {window} AS start", f"{window}L AS length", "crc AS ids_crc32", "tokens AS doc_tokens", "seq + i AS sequence_id", "0L AS offset")
    dealt, shared = _dealt(tails), docs.sparkSession.sparkContext.broadcast(idf)

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by([("seq", "ascending")])
        tail = [np.frombuffer(x, kind) for x in group.column("tail").to_pylist()]
        terms = [np.frombuffer(x, kind) for x in group.column("terms").to_pylist()]
        counts = [np.frombuffer(x, "<u2") for x in group.column("counts").to_pylist()]
        tokens, ids, shard = group.column("tokens").to_numpy(), group.column("id").to_pylist(), group.column("shard")[0].as_py()
        lengths = np.array([len(x) for x in tail])
        made = fill_windows(Index(terms, counts, tokens.astype(np.float32), shared.value, mean), lengths, window)
        last = made[-1]
        if sum(p[2] for p in last) < window:
            made[-1:] = powers(last)
        out = []
        for s, pieces in enumerate(made):
            offset = 0
            for i, at, n in pieces:
                out.append((ids[i], int(tokens[i]) - int(lengths[i]) + at, n, crc(tail[i][at : at + n]), int(tokens[i]), SHARD_SEQUENCES | shard << SHARD_BITS | s, offset))
                offset += n
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    packed = dealt.select("shard", "seq", "id", "tokens", "tail", "terms", "counts").repartition(partitions(docs.sparkSession), "shard").groupBy("shard").applyInArrow(fill, PIECES)
    return whole.unionByName(packed).withColumnRenamed("id", id_col)

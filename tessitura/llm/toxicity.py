"""Toxicity: a linear classifier over the presence of character n-grams, whose features are scaled by naive Bayes log-count ratios.

Each hashed n-gram that occurs in a text counts once; its feature is the logarithm of how much oftener it occurs in toxic than in other texts. A
logistic regression over these features, trained on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import batches, blob_column, free_name, lean, strings

BUCKETS = 1 << 18
SIZES = (3, 4, 5)
#: Training takes at most so many labelled rows (those of the smallest hash of the id), whatever the table's size.
SAMPLE = 4096
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
SMOOTH, DECAY, EPOCHS, BATCH, RATE = 1.0, 1e-4, 30, 256, 0.02


def ngram_buckets(text: str, first: bool = True, last: bool = True) -> np.ndarray:
    """Bucket of every character n-gram of the lower-cased text between two spaces (at its ends), repeats included."""
    codes = np.frombuffer(f"{' ' * first}{text.lower()}{' ' * last}".encode("utf-32-le", "surrogatepass"), np.uint32)
    rolled, out = codes.copy(), []
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in SIZES:
            h = rolled * np.uint32(0x85EBCA6B)
            out.append((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - 18))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Presence:
    """Distinct buckets of a text without sorting: of equal ones the place written last stays."""

    def __init__(self):
        self.place = np.zeros(BUCKETS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) > CHUNK:  # a very long text piece by piece
            seen, step = np.zeros(BUCKETS, bool), CHUNK - max(SIZES)
            for at in range(0, len(text), step):
                seen[ngram_buckets(text[at : at + CHUNK], at == 0, at + CHUNK >= len(text))] = True
            return np.flatnonzero(seen)
        found = ngram_buckets(text)
        at = np.arange(len(found))
        self.place[found] = at
        return found[self.place[found] == at]


def packed(found: np.ndarray) -> bytes:
    """Distinct buckets as numbers, or where they are many as a bit per bucket: 32 KB a text at most."""
    if len(found) < BUCKETS // 32:
        return found.astype("<u4").tobytes()
    flags = np.zeros(BUCKETS, bool)
    flags[found] = True
    return np.packbits(flags).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4") if len(blob) < BUCKETS // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8))).astype(np.uint32)


def log_count_ratio(rows: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of its share in texts of label 1 over that in the others, smoothed; 0 for what was met once at most."""
    counts = np.full((2, BUCKETS), SMOOTH)
    for blob, label in zip(rows, labels.tolist(), strict=True):
        counts[label, unpacked(blob)] += 1
    q, p = counts
    ratio = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    ratio[(p + q) <= 2 * SMOOTH + 1] = 0
    return ratio


def fit(rows: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight per bucket (ratio times regression weight) and the intercept. rows: packed buckets, unfolded one batch at a time."""
    ratio = log_count_ratio(rows, labels)
    w, bias = np.zeros(BUCKETS, np.float32), 0.0
    share = (labels.sum() + 1) / (len(labels) + 2)
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))  # both labels weigh the same
    square, square_b = np.full(BUCKETS, 1e-6, np.float32), 1e-6
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            held = [unpacked(rows[i]) for i in part]
            cols, n = np.concatenate(held).astype(np.int64), np.array([len(x) for x in held])
            scale = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n).astype(np.float32)
            x = ratio[cols] * scale
            z = np.bincount(np.repeat(np.arange(len(part)), n), x * w[cols], len(part)) + bias
            error = (1 / (1 + np.exp(-z)) - labels[part]) * balance[part]
            grad = (np.bincount(cols, x * np.repeat(error, n), BUCKETS) / len(part) + DECAY * w).astype(np.float32)
            square += grad * grad
            w -= RATE * 10 * grad / np.sqrt(square)
            g = error.mean()
            square_b += g * g
            bias -= RATE * 10 * g / np.sqrt(square_b)
    return w * ratio, bias


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and intercept learned from at most ``sample`` labelled rows for which ``usable`` (of ``labels``) holds. Without labelled rows: all 0."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    chosen = chosen if usable is None else chosen.where(usable)
    chosen = chosen.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = Presence()
        for batch in batches(rows, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob_column([packed(present(t)) for t in strings(batch.column(2)).to_pylist()])], ["id", "label", "found"])

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, label, ids = [], [], []
        for batch in rows:
            ids += batch.column("id").to_pylist()
            found += batch.column("found").to_pylist()
            label += batch.column("label").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], found[i]))  # the same model whatever the order of arrival
        if not order:
            return
        weights, bias = fit([found[i] for i in order], np.array(label)[order])
        yield pa.RecordBatch.from_arrays([blob_column([weights.astype("<f4").tobytes()]), pa.array([float(bias)])], ["weights", "bias"])

    # the sample is bounded, so it may be broadcast and its features may meet in one task
    labelled = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(lean(features), "id bigint, label int, found binary")
    labelled = labelled.groupBy("id", "label").agg(F.min("found").alias("found"))  # of an id that many rows share one text counts
    models = labelled.repartition(1).mapInArrow(lean(learn), "weights binary, bias double").collect()
    return (np.frombuffer(models[0]["weights"], "<f4"), models[0]["bias"]) if models else (np.zeros(BUCKETS, np.float32), 0.0)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with all its columns and ``score``, from 0 to 1, of each whole text; null and empty texts get the score of no n-grams. No shuffle."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS floats
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` double"

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, w = Presence(), shared.value
        for batch in batches(rows, BATCH_BYTES):
            z = np.empty(batch.num_rows)
            for i, text in enumerate(strings(batch.column(at)).to_pylist()):
                found = present(text)
                z[i] = float(w[found].sum(dtype=np.float64)) / np.sqrt(max(len(found), 1)) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, score_col])

    return docs.mapInArrow(lean(score), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row of ``docs``: id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5, else 0).

    The text alone is scored. Null and empty texts get the score of no n-grams; a null id counts as held out; labels other than 0 and 1, and those of
    no document, teach nothing; of several labels of an id the largest holds; repeated rows are scored each; other columns are ignored.
    """
    model = train(docs, labels, ~held_out(id_col), id_col, text_col, label_col)
    out = scored(docs.select(id_col, F.col(text_col).cast("string").alias("text")), model, "text")
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs``, with their columns, that score below 0.5.

    Null and empty texts score as no n-grams do; null ids, repeated rows and further columns stay as they are; an empty table gives none; without usable
    labels every score is 0.5, and nothing is left out.
    """
    model = train(docs, labels, ~held_out(id_col), id_col, text_col, label_col)
    name = free_name(docs, "toxicity")
    return scored(docs, model, text_col, name).where(F.col(name) < (0.5 if model[0].any() else 2)).select(*docs.columns)

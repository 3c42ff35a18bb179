"""Quality: a weak-label model over heuristic labellers, and a hashed linear scorer trained on what it concludes. No labels are read.

Each labeller votes good, bad or nothing on a whole text. The votes of all texts are counted by pattern; expectation-maximisation over the counted
patterns estimates how each labeller votes on good and on bad texts, and so the probability that a text of each pattern is good. On a bounded sample
these probabilities train a logistic regression over hashed features: four-character shapes (letters, capitals, digits, marks) and binned statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import batches, blob_column, free_name, lean, strings

BITS = 14
BUCKETS = 1 << BITS
SAMPLE = 4096
CHUNK = 1 << 20
BATCH_BYTES = 8 << 20
ROUNDS, SMOOTH = 100, 1.0
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.5, 1e-4
#: Labellers of what prose never has; the others may err on odd prose.
SURE = ("symbols", "capitals", "exclaims", "bars", "top_word", "echoes", "pairs")
#: What the labellers look at, and the edges of the bins in which the scorer sees the same values.
LABELLERS = ("symbols", "capitals", "exclaims", "bars", "top_word", "distinct_lines", "short_words", "word_length", "sentences", "echoes", "pairs")
EDGES = {
    "symbols": (0.005, 0.02, 0.05, 0.1), "capitals": (0.05, 0.1, 0.2, 0.4), "exclaims": (0.02, 0.1, 0.3), "bars": (0.01, 0.05, 0.2), "top_word": (0.1, 0.15, 0.3, 0.6),
    "distinct_lines": (0.3, 0.6, 0.9), "short_words": (0.05, 0.1, 0.2, 0.8), "word_length": (2, 3, 6, 10, 14), "sentences": (3, 20, 60, 100), "echoes": (0.02, 0.05, 0.1, 0.3), "pairs": (0.3, 0.5, 0.7, 0.9),
}
SYMBOLS = np.array([ord(c) for c in "#$%&*+<=>@[\\]^_`{}~"])
CLASSES = np.full(129, 1, np.uint32)  # beyond ASCII: as a small letter
for _c in range(128):
    CLASSES[_c] = 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 4 if chr(_c).isspace() else 5 + _c % 60


def codes(text: str) -> np.ndarray:
    """A code per character, 128 for all beyond ASCII."""
    parts = (np.minimum(np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32), 128).astype(np.uint8) for at in range(0, len(text), CHUNK))
    return np.concatenate([np.zeros(0, np.uint8), *parts])


def counted(chars: np.ndarray) -> np.ndarray:
    return sum((np.bincount(chars[at : at + CHUNK], minlength=129) for at in range(0, len(chars), CHUNK)), np.zeros(129, np.int64))


def statistics(text: str, chars: np.ndarray) -> dict[str, float | None]:
    """The labellers' values; None where a text is too short to tell."""
    count = counted(chars)
    words = text.split()
    n, letters = len(words), count[65:91].sum() + count[97:123].sum() + count[128]
    if not n:
        return dict.fromkeys(LABELLERS)
    lines = [x for x in text.split("\n") if x.strip()]
    long = n >= 20
    return {
        "symbols": count[SYMBOLS].sum() / len(chars), "capitals": count[65:91].sum() / max(letters, 1), "exclaims": count[33] / n, "bars": count[124] / n,
        "top_word": max(Counter(words).values()) / n if long else None, "distinct_lines": len(set(lines)) / len(lines) if len(lines) >= 5 else None,
        "short_words": sum(len(w) <= 4 for w in words) / n if long else None, "word_length": (len(chars) - count[32] - count[10]) / n if long else None,
        "sentences": n / max(count[[33, 46, 63]].sum(), 1) if long else None, "echoes": sum(map(eq, words, words[1:])) / n if long else None,
        "pairs": len(set(zip(words, words[1:], strict=False))) / (n - 1) if long else None,
    }


def votes(s: dict[str, float | None]) -> list[int]:
    """1 good, 0 bad, -1 nothing, in the order of LABELLERS."""

    def between(name: str, bad: tuple[float, float], good: tuple[float, float]) -> int:
        v = s[name]
        return -1 if v is None else 0 if not bad[0] <= v <= bad[1] else 1 if good[0] <= v <= good[1] else -1

    return [
        between("symbols", (0, 0.05), (0, 0.01)), between("capitals", (0, 0.4), (0, 0.15)), between("exclaims", (0, 0.2), (0, 0.05)), between("bars", (0, 0.05), (0, 0.01)),
        between("top_word", (0, 0.3), (0, 0.15)), between("distinct_lines", (0.4, 1), (0.9, 1)), between("short_words", (0.1, 0.9), (0.2, 0.8)),
        between("word_length", (2, 12), (3, 9)), between("sentences", (0, 100), (3, 60)),
        between("echoes", (0, 0.1), (0, 0.05)), between("pairs", (0.5, 1), (0.7, 1)),
    ]


def features(s: dict[str, float | None], chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: root frequencies of the four-character shapes, and 0.3 for each statistic's bin."""
    count, total = np.zeros(BUCKETS, np.int64), max(len(chars) - 3, 0)
    for at in range(0, total, CHUNK):
        shape = CLASSES[chars[at : at + CHUNK + 3]]
        grams = shape[:-3] | shape[1:-2] << np.uint32(7) | shape[2:-1] << np.uint32(14) | shape[3:] << np.uint32(21)
        count += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    found = np.flatnonzero(count)
    bins = [(i * 16 + (15 if s[name] is None else int(np.searchsorted(EDGES[name], s[name])))) * 0x9E3779B1 % (1 << 32) >> (32 - BITS) for i, name in enumerate(LABELLERS)]
    return np.concatenate([found, np.array(bins)]), np.concatenate([np.sqrt(count[found] / max(total, 1)), np.full(len(bins), 0.3)])


def posteriors(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that a text of each vote pattern is good, by expectation-maximisation. patterns: (patterns, labellers) of -1, 0, 1.

    Texts are good or bad in one of as many ways as there are labellers; each class has its own accuracy of each labeller, so that what has nothing to do
    with a kind of badness doesn't speak against it. A text starts as probably bad where a sure labeller says so, as doubtful where only others do.
    """
    if not len(patterns):
        return np.zeros(0)
    n, m = counts.astype(float)[:, None], patterns.shape[1]
    bad, told, yes = patterns == 0, patterns >= 0, patterns == 1
    sure = np.array([x in SURE for x in (LABELLERS * (m // len(LABELLERS) + 1))[:m]])
    good = np.where((bad & sure).any(1), 0.1, np.where(bad.any(1), 0.6, 0.95))
    share = np.where(bad.any(1, keepdims=True), bad / np.maximum(bad.sum(1, keepdims=True), 1), 1 / m)
    p = np.concatenate([good[:, None], (1 - good)[:, None] * share], 1)
    # votes that each class starts from: good texts are hardly ever called bad, a way of being bad is called so by its own labeller
    start = np.full((m + 1, m), 3.0)
    start[0], start[np.arange(1, m + 1), np.arange(m)] = 3.98, 0.2
    for _ in range(ROUNDS):
        prior = ((n * p).sum(0) + SMOOTH) / ((n * p).sum() + SMOOTH * (m + 1))
        right = ((n * p).T @ yes + start * SMOOTH) / ((n * p).T @ told + 4 * SMOOTH)
        log = np.log(prior) + yes @ np.log(right).T + bad @ np.log(1 - right).T
        new = np.exp(log - log.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return p[:, 0]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities, both outcomes weighing the same."""
    w, bias, square, square_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    share = (target.sum() + 1) / (len(target) + 2)
    balance = target * 0.5 / share + (1 - target) * 0.5 / (1 - share)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            cols, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            own = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            error = (1 / (1 + np.exp(-(np.bincount(own, x * w[cols], len(part)) + bias))) - target[part]) * balance[part]
            grad = np.bincount(cols, x * error[own], BUCKETS) / len(part) + DECAY * w
            square += grad * grad
            w -= RATE * grad / np.sqrt(square)
            g = error.mean()
            square_b += g * g
            bias -= RATE * g / np.sqrt(square_b)
    return w, bias


def weak_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and votes, an array of LABELLERS' votes."""

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH_BYTES):
            found = [votes(statistics(t, codes(t))) for t in strings(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int8()))], ["id", "votes"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(make), "id bigint, votes array<tinyint>")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[tuple[int, ...], float], tuple[np.ndarray, float]]:
    """(probability per vote pattern, from the counts over all texts; weights and intercept of the scorer, from at most ``sample`` texts)."""
    found = weak_votes(docs, id_col, text_col).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** labellers patterns at most
    found.sort(key=lambda r: r["votes"])
    patterns = np.array([r["votes"] for r in found], np.int8).reshape(len(found), len(LABELLERS))
    good = {tuple(p): float(x) for p, x in zip(patterns.tolist(), posteriors(patterns, np.array([r["n"] for r in found])), strict=True)}

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, BATCH_BYTES):
            out: list[list] = [[], [], []]
            for text in strings(batch.column(1)).to_pylist():
                c = codes(text)
                s = statistics(text, c)
                cols, x = features(s, c)
                for column, value in zip(out, (cols.astype("<i4").tobytes(), x.astype("<f4").tobytes(), good[tuple(votes(s))]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), blob_column(out[0]), blob_column(out[1]), pa.array(out[2], pa.float64())], ["id", "cols", "x", "good"])

    def learn(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["id"], r["cols"], r["x"], r["good"]) for batch in rows for r in batch.to_pylist())
        if got:
            w, bias = fit([(np.frombuffer(c, "<i4"), np.frombuffer(x, "<f4").astype(float)) for _, c, x, _ in got], np.array([g for *_, g in got]))
            yield pa.RecordBatch.from_arrays([blob_column([w.astype("<f4").tobytes()]), pa.array([float(bias)])], ["weights", "bias"])

    ids = docs.select(F.col(id_col).cast("bigint").alias("id")).where("id IS NOT NULL").groupBy("id").count().select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # the sample is bounded, so it may be broadcast and its features may meet in one task
    made = texts.join(F.broadcast(ids), "id").select("id", "text").mapInArrow(lean(make), "id bigint, cols binary, x binary, good double")
    made = made.groupBy("id").agg(F.min(F.struct("cols", "x", "good")).alias("one")).select("id", "one.*")  # of an id that many rows share one text counts
    models = made.repartition(1).mapInArrow(lean(learn), "weights binary, bias double").collect()
    return good, (np.frombuffer(models[0]["weights"], "<f4"), models[0]["bias"]) if models else (np.zeros(BUCKETS, np.float32), 0.0)


def scored(docs: DataFrame, text_col: str, good: dict, model: tuple[np.ndarray, float], names: tuple[str, str]) -> DataFrame:
    """``docs`` with all columns and two more: the weak model's probability and the scorer's score. No shuffle."""
    weights, bias = model
    shared, at = docs.sparkSession.sparkContext.broadcast((weights, good)), docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", `{n}` double" for n in names)

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, chances = shared.value
        for batch in batches(rows, BATCH_BYTES):
            z, p = np.empty(batch.num_rows), np.empty(batch.num_rows)
            for i, text in enumerate(strings(batch.column(at)).to_pylist()):
                c = codes(text)
                s = statistics(text, c)
                cols, x = features(s, c)
                z[i], p[i] = x @ w[cols] + bias, chances.get(tuple(votes(s)), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*batch.schema.names, *names])

    return docs.mapInArrow(lean(score), schema)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: id, posterior (of the weak-label model), score (0 to 1, higher: better), keep (score >= ``least``).

    Whole texts are read. Null and empty texts get no votes, so the model's prior as posterior, and are scored as such; null ids and repeated rows are
    scored each; other columns are ignored; an empty table gives no rows.
    """
    good, model = train(docs, id_col, text_col)
    out = scored(docs.select(id_col, F.col(text_col).cast("string").alias("text")), "text", good, model, ("posterior", "score"))
    return out.select(id_col, "posterior", "score", (F.col("score") >= least).alias("keep"))


def without_junk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with their columns, that score ``least`` or more.

    Null and empty texts get no votes and are scored as such; null ids, repeated rows and further columns stay as they are; an empty table gives none.
    """
    good, model = train(docs, id_col, text_col)
    names = free_name(docs, "posterior"), free_name(docs, "score")
    return scored(docs, text_col, good, model, names).where(F.col(names[1]) >= least).select(*docs.columns)

"""Benchmark decontamination by greedy string tiling.

Documents and test items meet on shared seeds of a few words, by a join. For each pair that met, matches are found with running Karp-Rabin hashes and
the longest ones marked again and again, none over another, so a passage whose parts were put in another order is still covered. A document is
contaminated when the tiles cover enough of an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import KeyFilter, batches, blob_column, free_name, lean, mix, passing, plain_words, stored

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Rolled:
    """Karp-Rabin hashes of all windows of any number of words, each from the last in constant time (sums of words times powers of a base modulo 2**64)."""

    def __init__(self, hashes: np.ndarray):
        powers, back = np.full(len(hashes), BASE, U), np.full(len(hashes), INVERSE, U)
        powers[:1] = back[:1] = 1
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * np.cumprod(powers))])
        self.back = np.cumprod(back)

    def __call__(self, n: int) -> np.ndarray:
        m = max(len(self.back) - n + 1, 0)
        return mix((self.sums[n:] - self.sums[:m]) * self.back[:m]) if m else np.zeros(0, U)


def running_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    return Rolled(hashes)(n)


class Free:
    """A text's words that no tile covers yet."""

    def __init__(self, hashes: np.ndarray):
        self.rolled, self.used = Rolled(hashes), np.zeros(len(hashes), bool)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``n`` free words."""
        taken = np.concatenate([[0], np.cumsum(self.used)])
        at = np.flatnonzero(taken[n:] == taken[: max(len(taken) - n, 0)])
        return at, self.rolled(n)[at]

    def longest(self) -> int:
        edge = np.flatnonzero(np.concatenate([[True], self.used, [True]]))
        return int(np.diff(edge).max()) - 1


def tiles(test: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in test, start in doc, length) of the marked matches of ``least`` words or more, the longest first.

    The largest length at which the free words of both texts have a window in common is found by bisection over running hashes; all such windows are
    marked, the first in the test with the first free one in the document, and the search goes on below that length. Memory is linear in the texts, and
    time in the number of different lengths, however often words repeat.
    """
    a, b, out = Free(test), Free(doc), []
    most = min(a.longest(), b.longest()) if len(test) and len(doc) else 0

    def common(n: int) -> bool:
        return bool(np.isin(a.windows(n)[1], b.windows(n)[1]).any())

    while (most := min(most, a.longest(), b.longest())) >= least and common(least):
        low, high = least, most
        if common(most):
            low = most
        while low < high and low != most:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        most = low
        (at, own), (places, theirs) = a.windows(most), b.windows(most)
        order = np.argsort(theirs, kind="stable")
        places, theirs = places[order], theirs[order]
        first = np.searchsorted(theirs, own)
        end = np.searchsorted(theirs, own, side="right")
        next_of: dict[int, int] = {}  # windows of a hash before this place are used up
        for x, lo, hi in zip(at.tolist(), first.tolist(), end.tolist(), strict=True):
            if lo == hi or a.used[x] or a.used[x + most - 1]:  # free words are taken in whole windows of this length
                continue
            k = next_of.get(lo, lo)
            while k < hi and (b.used[places[k]] or b.used[places[k] + most - 1]):
                k += 1
            next_of[lo] = k
            if k < hi:
                y = int(places[k])
                out.append((x, y, most))
                a.used[x : x + most] = b.used[y : y + most] = True
        most -= 1
    return out


def _items(benchmark: DataFrame, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(item, test, n, seeds): the words, their number, and each distinct seed with the number of its places."""

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            offsets, hashes = plain_words(batch.column(1))
            parts = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            seeds = [np.unique(running_hashes(p, min(seed, max(len(p), 1))), return_counts=True) for p in parts]
            found = [[{"seed": x, "times": n} for x, n in zip(s.view(np.int64).tolist(), c.tolist(), strict=True)] for s, c in seeds]
            yield pa.RecordBatch.from_arrays([batch.column(0), blob_column([p.tobytes() for p in parts]), pa.array([len(p) for p in parts], pa.int64()), pa.array(found, pa.list_(pa.struct({"seed": pa.int64(), "times": pa.int64()})))], ["item", "test", "n", "seeds"])

    rows = benchmark.select(F.col(id_col).cast("bigint").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(make, "item bigint, test binary, n bigint, seeds array<struct<seed: bigint, times: bigint>>").where("item IS NOT NULL")


def matched(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The words in the windows of ``n`` words that begin at ``starts`` (ascending), with a 0 between stretches that don't touch."""
    held = np.zeros(len(hashes) + 1, np.int64)
    held[starts] += 1
    np.subtract.at(held, starts + n, 1)
    inside = np.cumsum(held)[:-1] > 0
    at = np.flatnonzero(inside)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(hashes[at], gaps, 0)


def tiled(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5, least: int = 5, item_id: str = "item_id", item_text: str = "text", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits). rows: row, id, text_key for every document; hits: row, item, covered (share of the item's words), n_tiles for the pairs that met.

    A pair meets if the item's places whose seed the document holds could cover ``coverage`` of its words. No tile holds a word outside a shared seed, so
    of a document only the stretches of such seeds travel.
    """
    if least < seed:
        raise ValueError("a tile must not be shorter than a seed")
    items = stored(_items(benchmark, seed, item_id, item_text), "tiles-items")
    shared = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(items.select(F.explode("seeds.seed"))))  # of a bounded size

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = TaskContext.get().partitionId() << 33, shared.value
        for batch in batches(rows, 4 << 20):
            offsets, hashes = plain_words(batch.column(1))
            rolled = running_hashes(hashes, seed)
            found = np.flatnonzero(known(rolled))
            ends = np.maximum(offsets[1:] - seed + 1, offsets[:-1])  # of the windows that lie within a text
            kept, seeds = [], []
            for start, end, lo, hi in zip(offsets[:-1], offsets[1:], np.searchsorted(found, offsets[:-1]), np.searchsorted(found, ends), strict=True):
                if 0 < end - start < seed:  # a text shorter than a seed meets equally short items
                    whole = hashes[start:end]
                    kept.append(whole.tobytes())
                    seeds.append(running_hashes(whole, len(whole)).view(np.int64).tolist())
                elif lo < hi:
                    kept.append(matched(hashes[start:end], found[lo:hi] - start, seed).tobytes())
                    seeds.append(np.unique(rolled[found[lo:hi]]).view(np.int64).tolist())
                else:
                    kept.append(None)
                    seeds.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), batch.column(0), batch.column(2), pa.array(kept, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], ["row", "id", "text_key", "words", "seeds"])
            row += batch.num_rows

    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", text_key("text"))
    rows = stored(base.mapInArrow(lean(scan), "row bigint, id bigint, text_key bigint, words binary, seeds array<bigint>"), "tiles-rows")
    places = items.select("item", "n", F.explode("seeds").alias("s")).select("item", "n", "s.seed", "s.times")
    met = rows.select("row", F.explode("seeds").alias("seed")).join(places, "seed").groupBy("row", "item", "n").agg(F.sum("times").alias("times"))
    met = met.where(F.col("times") * F.least(F.col("n"), F.lit(seed)) >= F.col("n") * coverage).select("row", "item")

    def tile(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches_:
            for batch in batches([whole] if whole.num_rows else [], 4 << 20):
                covered, n = [], []
                for test, doc in zip(batch.column("test").to_pylist(), batch.column("words").to_pylist(), strict=True):
                    test, doc = np.frombuffer(test, U), np.frombuffer(doc, U)
                    found = tiles(test, doc, min(least, len(test)))
                    covered.append(sum(x[2] for x in found) / len(test))
                    n.append(len(found))
                yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item"), pa.array(covered, pa.float64()), pa.array(n, pa.int64())], ["row", "item", "covered", "n_tiles"])

    pairs = met.join(items.select("item", "test"), "item").join(rows.where("words IS NOT NULL").select("row", "words"), "row").select("row", "item", "test", "words")
    return rows.select("row", "id", "text_key"), pairs.mapInArrow(lean(tile), "row bigint, item bigint, covered double, n_tiles bigint")


def text_key(column: str):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(4))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, contaminated (some item covered by ``coverage`` or more), item_id (of the largest coverage, the smallest id of equal ones),
    coverage (its best item's share; 0 where no item's shared seeds could reach ``coverage``), n_tiles.

    Words are lower-cased runs of letters and digits; characters of scripts without spaces are words of their own. An item or text of fewer than ``seed`` words meets only texts that hold the whole of it as such a
    short text. Null and empty texts and items match nothing; null item ids are left out; rows with null or repeated ids are rows of their own; items of
    one id are tiled each for itself; other columns are ignored; empty tables give no rows or no matches.
    """
    rows, hits = tiled(docs, benchmark, coverage, seed, least, item_id, item_text, id_col, text_col)
    best = hits.groupBy("row").agg(F.max(F.struct("covered", (-F.col("item")).alias("minus"), "n_tiles")).alias("best"))
    out = rows.join(best, "row", "left")
    share = F.coalesce("best.covered", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), (share >= coverage).alias("contaminated"), (-F.col("best.minus")).alias("item_id"), share.alias("coverage"), F.coalesce("best.n_tiles", F.lit(0).cast("bigint")).alias("n_tiles"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, seed: int = 5, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't contaminated. Equal texts have one verdict, so rows are left out by their text.

    Null and empty texts, null ids and repeated rows stay as they are unless their text is contaminated; empty tables give no rows or leave all.
    """
    rows, hits = tiled(docs, benchmark, coverage, seed, least, id_col=id_col, text_col=text_col)
    name = free_name(docs, "bad")
    bad = stored(rows.join(hits.where(F.col("covered") >= coverage).select("row").distinct(), "row", "left_semi").select(F.col("text_key").alias(name)).distinct(), "tiles-bad")
    # only rows that may go are shuffled
    known, keyed = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(bad)), docs.withColumn(name, text_key(text_col))
    return passing(keyed, name, known, False).unionByName(passing(keyed, name, known).join(bad, name, "left_anti")).select(*docs.columns)

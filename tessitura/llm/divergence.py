"""Audit of how far the sources of a language diverge in their vocabulary.

Two passes over the texts. The first finds exact document frequencies and with them the kept terms of each language. The second recounts the kept terms'
occurrences with Aho-Corasick automata of terms padded with a delimiter on both sides, so that only whole terms match. The most frequent terms are in one
automaton a language, of a fixed size, that every task has; what it leaves goes to shards of the remaining terms, each with automata of its own, so no
task holds more than a bounded number of terms, however many there are. Counts become sparse postings; pairs of sources and ranks follow from these alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import filterfalse
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import batches, lean, partitions, stored

SCALE = 1_000_000_000
#: Kept terms in the automata that every task holds, none of them longer than HEAD_BYTES (so they take at most 8 MB), and about as many in each shard.
HEAD, HEAD_BYTES, SHARD = 1 << 17, 64, 1 << 17
#: Entries of a task's frequencies, occurrences of its head terms, and bytes of text for shards, before they are given out.
MOST_COUNTS, MOST_PLACES, MOST_BYTES = 1 << 18, 1 << 22, 8 << 20
#: Distinct terms of a task's groups between two searches.
MOST_MET = 1 << 17
#: Places of head terms whose counts travel in one array.
STRETCH_BITS = 12
#: Term occurrences (by document frequency) after which a shard's texts are dealt to several tasks.
SHARD_LOAD = 1 << 26
#: Fixed rule: terms are runs of ASCII letters and of bytes of other characters; A-Z are lower-cased, all else is a space.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() and chr(b).islower() else b + 32 if chr(b).isalpha() else 32 for b in range(256))


def _terms(text: pa.Scalar) -> list[bytes]:
    return bytes(text.as_buffer()).translate(TERM_BYTES).split()


def _documents(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def vocabulary(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, df: the terms in at least ``least`` documents of their language. Tasks give out partial counts of a bounded size."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: defaultdict[str, Counter[bytes]] = defaultdict(Counter)  # by language: a term alone is counted without a loop in Python

        size = 0

        def given() -> pa.RecordBatch:
            langs, terms = [lang for lang, own in found.items() for _ in own], [t for own in found.values() for t in own]
            ns = [n for own in found.values() for n in own.values()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["lang", "term", "df"])

        for batch in batches(rows, MOST_BYTES):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = found[lang]
                size -= len(own)
                own.update(set(_terms(text)))
                size += len(own)
                if size >= MOST_COUNTS:
                    yield given()
                    size = 0
        yield given()

    parts = docs.select("lang", "text").mapInArrow(lean(run), "lang string, term string, df bigint")
    return parts.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least)


class Automaton:
    """Finds the terms of one list in texts: a term matches where a delimiter stands on both sides, and neighbours share theirs."""

    def __init__(self, terms: list[bytes]):
        self.terms = set(terms)
        self.inner = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.inner.add_word(f" {t.decode()} ", i)
        if terms:
            self.inner.make_automaton()

    def places(self, terms: list[bytes]) -> Iterator[int]:
        """For each occurrence of a listed term, its place in the list."""
        if not self.terms or not terms:
            return iter(())
        return map(itemgetter(1), self.inner.iter(f" {b' '.join(terms).decode()} "))


#: The head's automata of the last job whose tasks ran in this worker.
_head: dict[str, dict[str, Automaton]] = {}


def _shard(lang: str, term: bytes, shards: int) -> int:
    return zlib.crc32(term, len(lang)) % shards


def _recounted(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, n: occurrences of the kept terms by group."""
    spark = docs.sparkSession
    size, load = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    top = kept.where(F.octet_length("term") <= HEAD_BYTES).orderBy(F.col("df").desc(), "lang", "term").limit(HEAD).select("lang", "term").toArrow()  # at most HEAD short terms
    head: dict[str, list[bytes]] = {}
    for lang, term in zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True):
        head.setdefault(lang, []).append(term.encode())
    shards = max(1, -(-(size - top.num_rows) // SHARD))
    salts = 1 + load // (shards * SHARD_LOAD)
    known, mark = spark.sparkContext.broadcast(head), uuid.uuid4().hex

    def head_of(lang: str) -> Automaton:
        if mark not in _head:
            _head.clear()
            _head[mark] = {}
        own = _head[mark]
        if lang not in own:
            own[lang] = Automaton(known.value.get(lang, []))
        return own[lang]

    def first(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Head terms' counts, as sparse arrays of a group and a stretch of places; other terms, as texts of a group and a shard."""
        met: dict[tuple[str, str], Counter[bytes]] = {}  # a group's terms since the last search: an automaton goes over each of them once
        places: dict[tuple[str, str], list[np.ndarray]] = {}
        texts: dict[tuple[int, str, str], list[bytes]] = {}
        size = found = turn = distinct = 0

        def given(counts: list, dealt: list) -> pa.RecordBatch:
            cols = list(zip(*counts, *dealt, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            made[4] = made[4].cast(pa.string())
            return pa.RecordBatch.from_arrays(made, ["part", "salt", "lang", "source", "text", "places", "ns"])

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), all_ in places.items():
                (at, back), times = np.unique(np.concatenate([x[0] for x in all_]), return_inverse=True), np.concatenate([x[1] for x in all_])
                n = np.zeros(len(at), np.int64)
                np.add.at(n, back, times)
                cuts = np.flatnonzero(np.diff(at >> STRETCH_BITS)) + 1
                out = [(int(a[0] >> STRETCH_BITS), 0, lang, source, None, a & (1 << STRETCH_BITS) - 1, m) for a, m in zip(np.split(at, cuts), np.split(n, cuts), strict=True) if len(a)]
                if out:
                    yield given(out, [])
            places.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            if texts:
                yield given([], [(k, turn % salts, lang, source, b" ".join(t), None, None) for (k, lang, source), t in texts.items()])
            texts.clear()

        def searched() -> Iterator[pa.RecordBatch]:
            nonlocal size, found, turn
            for (lang, source), own in met.items():
                head, names = head_of(lang), known.value.get(lang, [])
                at = list(head.places(list(own)))
                places.setdefault((lang, source), []).append(np.array([at, [own[names[i]] for i in at]], np.int64))
                found += 2 * len(at)
                for t in filterfalse(head.terms.__contains__, own):
                    held, n = texts.setdefault((_shard(lang, t, shards), lang, source), []), own[t]
                    while n:  # a term that comes very often is given out in between
                        part = min(n, max(1, (MOST_BYTES - size) // (len(t) + 1)))
                        held += [t] * part
                        size, n = size + part * (len(t) + 1), n - part
                        if size >= MOST_BYTES:
                            yield from sent()
                            size, turn = 0, turn + 1
                            held = texts.setdefault((_shard(lang, t, shards), lang, source), []) if n else []
                if found >= MOST_PLACES:
                    yield from counted()
                    found = 0
            met.clear()

        for batch in batches(rows, MOST_BYTES):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = met.setdefault((lang, source), Counter())
                distinct -= len(own)
                own.update(_terms(text))
                distinct += len(own)
                if distinct >= MOST_MET:
                    yield from searched()
                    distinct = 0
        yield from searched()
        yield from counted()
        yield from sent()

    dealt = stored(docs.mapInArrow(lean(first), "part int, salt int, lang string, source string, text string, places array<int>, ns array<bigint>"), "divergence-dealt")

    def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by language, source and stretch: the sums of a stretch's counts."""
        current, sums = None, np.zeros(1 << STRETCH_BITS, np.int64)

        def given() -> pa.RecordBatch:
            at = np.flatnonzero(sums)
            lang, source, part = current
            terms = known.value[lang]
            names = pa.array([terms[(part << STRETCH_BITS) + i] for i in at.tolist()], pa.binary()).cast(pa.string())
            made = pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), names, pa.array(sums[at])], ["lang", "source", "term", "n"])
            sums.fill(0)
            return made

        for batch in rows:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for key, at, n in zip(keys, batch.column(3), batch.column(4), strict=True):
                if key != current:
                    if current is not None:
                        yield given()
                    current = key
                np.add.at(sums, at.values.to_numpy(), n.values.to_numpy())
        if current is not None:
            yield given()

    counts = dealt.where("text IS NULL").select("lang", "source", "part", "places", "ns").repartition(partitions(spark), "lang", "source", "part").sortWithinPartitions("lang", "source", "part")
    head_counts = counts.mapInArrow(lean(added), "lang string, source string, term string, n bigint")

    def own_shard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            numbers, in_head = [], []
            for lang, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers.append(_shard(lang, term.encode(), shards))
                in_head.append(term.encode() in head_terms(lang))
            made = pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), batch.column(0), batch.column(1)], ["part", "lang", "text"])
            yield made.filter(pc.invert(pa.array(in_head, pa.bool_())))

    _sets: dict[str, frozenset[bytes]] = {}

    def head_terms(lang: str) -> frozenset[bytes]:
        if lang not in _sets:
            _sets[lang] = frozenset(known.value.get(lang, []))
        return _sets[lang]

    tail = kept.select("lang", "term").mapInArrow(lean(own_shard), "part int, lang string, text string")
    tail = tail.select("part", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))).alias("salt"), "lang", F.lit(None).cast("string").alias("source"), "text")

    def second(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by shard, salt, language and source (null first): a language's terms of a shard come before its texts."""
        current, terms, own, source, places = None, [], None, None, []

        def given() -> Iterator[pa.RecordBatch]:
            if places:
                at, n = np.unique(np.array(places, np.int64), return_counts=True)
                names = pa.array([terms[i] for i in at.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([current[2]] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), names, pa.array(n, pa.int64())], ["lang", "source", "term", "n"])
                places.clear()

        for batch in batches(rows, MOST_BYTES):
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for key, of, text in zip(keys, batch.column(3).to_pylist(), batch.column(4), strict=True):
                if key != current or of != source or len(places) >= MOST_PLACES:
                    yield from given()
                if key != current:
                    current, terms, own = key, [], None
                source = of
                words = bytes(text.as_buffer())
                if of is None:
                    terms.append(words)
                else:
                    own = own or Automaton(terms)
                    places.extend(own.places(words.split(b" ")))
        yield from given()

    together = tail.unionByName(dealt.where("text IS NOT NULL").select("part", "salt", "lang", "source", "text")).repartition(max(partitions(spark), int(shards * salts)), "part", "salt").sortWithinPartitions("part", "salt", "lang", "source")
    tail_counts = together.mapInArrow(lean(second), "lang string, source string, term string, n bigint").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return head_counts.unionByName(tail_counts)


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any count: where the product passes 64 bits, the quotient is taken in whole decimals."""
    long = F.call_function("div", (n + 1) * F.lit(SCALE).cast("bigint"), F.nullif(total + terms, F.lit(0).cast("bigint")))
    top = (n.cast("decimal(28,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    wide = F.call_function("div", top.cast("decimal(38,0)"), F.nullif(total + terms, F.lit(0).cast("bigint")).cast("decimal(38,0)")).cast("bigint")
    return F.lit(1).cast("bigint") + F.when(n < (1 << 63) // SCALE - 1, long).otherwise(wide)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = 3, ranks: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per (lang, source) group: pairs with the language's other sources, and the terms that mark the group: lang, source, part, item, value, rank.

    A term is a run of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A language keeps the V terms in ``least`` of its documents. With
    count occurrences of a kept term in a group (or the language) and N of all kept terms, p = 1 + floor(10^9 (count + 1) / (N + V)), and of p of the group
    against q, f = floor((p - q)^2 / q). ``pair``: item is another source, q its p, value f summed over all kept terms; all ranks. ``term``: item is a kept
    term that occurs in the group with p > q, q the language's, value f; ranks to ``ranks``. Ranks go by value, greatest first, then by the item's bytes.

    Null languages, sources and texts are empty strings; empty texts have no terms but make their group; repeated rows are documents of their own; an empty
    table gives no rows; other columns are ignored. Most of a pair's terms occur in neither source: they share one f, and only postings are joined.
    """
    docs = _documents(docs, lang_col, source_col, text_col)
    kept = stored(vocabulary(docs, least), "divergence-terms")
    postings = stored(_recounted(docs, kept), "divergence-postings")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "divergence-groups")
    whole = groups.groupBy("lang").agg(F.sum("total").alias("l_total"))
    of_lang = F.sum("n").over(Window.partitionBy("lang", "term"))  # a row per source
    known = postings.withColumn("l_n", of_lang).join(groups, ["lang", "source"]).join(whole, "lang")
    p, q = _p(F.col("n"), F.col("total"), F.col("terms")), _p(F.col("l_n"), F.col("l_total"), F.col("terms"))
    known = stored(known.select("lang", "source", "term", p.alias("p"), q.alias("q")), "divergence-known")
    return _pairs(groups, known).unionByName(_marks(known, ranks))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.cast("int").alias("rank"))


def _pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources: V times f of a term in neither, and what the postings change of it."""
    none = F.lit(0).cast("bigint")
    base = groups.select("lang", "source", "terms", _p(none, F.col("total"), F.col("terms")).alias("p0"))  # p of a term that doesn't occur; null if there is no term
    base = base.withColumn("p0", F.when(F.col("terms") > 0, F.col("p0")))
    other = base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = base.join(other, "lang").where("source <> item")
    # terms of one of the two: equal p of a source count together
    bars = known.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    own = bars.join(base.select("lang", "source", "p0"), ["lang", "source"]).join(other, "lang").where("source <> item")
    f0 = _f(F.col("p0"), F.col("q0"))
    left = own.select("lang", "source", "item", (F.col("m") * (_f(F.col("p"), F.col("q0")) - f0)).alias("change"))
    # the same bars as the other side: q is their p, and the group's p is that of an absent term
    right = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (_f(F.col("q0"), F.col("p")) - _f(F.col("q0"), F.col("p0")))).alias("change"))
    # terms of both: their f in place of what the two sums above took for them
    a = known.select("lang", "term", "source", "p").join(base.select("lang", "source", "p0"), ["lang", "source"])
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    met = a.join(b, ["lang", "term"]).where("source <> item")
    both = met.select("lang", "source", "item", (_f(F.col("p"), F.col("q")) - _f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q")) + f0).alias("change"))
    changes = left.unionByName(right).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    value = F.coalesce(F.col("terms") * f0, F.lit(0)) + F.coalesce("change", F.lit(0))
    return _ranked(pairs.join(changes, ["lang", "source", "item"], "left").withColumn("value", value), "pair")


def _marks(known: DataFrame, ranks: int) -> DataFrame:
    """The terms of a group that are likelier there than in the language, the first ``ranks`` of them."""
    rows = known.where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows, "term").where(F.col("rank") <= ranks)

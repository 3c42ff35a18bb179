"""SimHash fingerprints and near-fingerprint search, in DataFrame functions only.

A text's terms are its white-space words, lower-cased, each together with the word after it (the last one alone). A term votes with a weight, the
length of its first word up to 15, on each of 128 signed bits; a bit of the fingerprint is set when more than half of the weight votes for it.
"""

from __future__ import annotations

from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import partitions, stored

LANES = 32
LOW = 0xFFFFFFFF
BITS = 128
#: Radius of the search for near texts: of pairs of different texts with a 5-word Jaccard similarity of 0.8 or more, all 48 of the sf0.1 documents
#: lie within 20 bits (3 of them within 6, 42 within 16).
NEAR = 20
#: Blocks of the bits, at least; of more than 3 bits a block there are more blocks, so that a block never has more than two bits flipped.
BLOCKS, FLIPS = 7, 2


def _terms(df: DataFrame) -> DataFrame:
    """Adds ``term`` rows of ``body``; the word array is a column of its own so that it is split once."""
    df = df.withColumn("found", F.split(F.lower("body"), r"\s+"))
    each = F.expr("transform(found, (x, i) -> CASE WHEN x != '' THEN (xxhash64(x, get(found, i + 1)) & -16L) | CAST(least(length(x), 15) AS BIGINT) END)")
    return df.withColumn("term", F.explode_outer(each)).drop("found", "body")


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Per distinct ``keys``: f1, f2 (64 bits each). Rows with equal keys must have equal texts. Null or blank texts: 0, 0.

    Explode, then one aggregation with a map-side part: what is shuffled is a row of 64 sums per text and task, whatever the text's length.
    Each sum holds two 32-bit counters, for bits i and i + 32.
    """
    exploded = _terms(texts.select(*keys, F.col(text_col).alias("body")))
    voted = exploded.select(*keys, (F.col("term").bitwiseAND(F.lit(15))).alias("w"), F.xxhash64("term").alias("g1"), F.xxhash64(F.xxhash64("term"), F.lit(1)).alias("g2"))
    sums = [F.expr(f"coalesce(sum((shiftrightunsigned(g{j}, {i}) & 4294967297L) * w), 0L)").alias(f"s{j}_{i}") for j in (1, 2) for i in range(LANES)]
    summed = voted.groupBy(*keys).agg(F.coalesce(F.sum("w"), F.lit(0).cast("bigint")).alias("w"), *sums)

    def bits(j: int) -> Column:
        parts = [f"shiftleft(CAST(2 * (s{j}_{i} & {LOW}L) > w AS BIGINT), {i}) | shiftleft(CAST(2 * shiftrightunsigned(s{j}_{i}, 32) > w AS BIGINT), {i + LANES})" for i in range(LANES)]
        return F.expr(" | ".join(f"({p})" for p in parts))

    return summed.select(*keys, bits(1).alias("f1"), bits(2).alias("f2"))


def distance(a: str, b: str) -> str:
    return f"bit_count({a}1 ^ {b}1) + bit_count({a}2 ^ {b}2)"


def likeness(a: str, b: str) -> Column:
    """1 less the share of differing bits."""
    return F.expr(f"1 - ({distance(a, b)}) / 128D")


def hexed(f: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f"{f}1"), 16, "0"), F.lpad(F.hex(f"{f}2"), 16, "0")))


def _blocks(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, width, flips) of blocks of which one at least has no more than its ``flips`` differing bits, of all pairs within ``radius``.

    If each had more, the pair would differ in sum(flips + 1) = radius + 1 bits.
    """
    n = max(BLOCKS, -(-(radius + 1) // (FLIPS + 1)))
    widths = [BITS // n + (i < BITS % n) for i in range(n)]
    flips = [(radius + 1) // n - (i >= (radius + 1) % n) for i in range(n)]
    return [x for x in zip([0, *accumulate(widths)][:n], widths, flips, strict=True) if x[2] >= 0]


def _block(start: int, width: int) -> str:
    if start >= 64:
        bits = f"shiftrightunsigned(f2, {start - 64})"
    else:
        bits = f"shiftrightunsigned(f1, {start})" + (f" | shiftleft(f2, {64 - start})" if start + width > 64 else "")
    return f"(({bits}) & {(1 << width) - 1}L)"


def _flipped(width: int, flips: int) -> str:
    """All masks of at most ``flips`` of ``width`` bits."""
    return f"array({', '.join(f'{sum(1 << i for i in x)}L' for n in range(flips + 1) for x in combinations(range(width), n))})"


def _keyed(fps: DataFrame, radius: int, flipped: bool) -> DataFrame:
    """A row per fingerprint and block, with ``flipped`` for each value within the block's flips: ``key`` is the block's number (above 32 bits) and its value."""
    keys = [f"transform({_flipped(width, flips if flipped else 0)}, x -> {i << 32}L | ({_block(start, width)} ^ x))" for i, (start, width, flips) in enumerate(_blocks(radius))]
    return fps.select("f1", "f2", F.expr(f"explode(concat({', '.join(keys)}))").alias("key"))


def near_fingerprints(queries: DataFrame, base: DataFrame, radius: int = 6) -> DataFrame:
    """All (qf1, qf2, f1, f2, bits) with at most ``radius`` differing bits, each pair once; both inputs hold distinct (f1, f2).

    Each table is keyed by one block; a query looks up its own value of the block and those that differ in few bits (two at most), so none is missed
    whatever the radius. For 20 bits a fingerprint has a row in seven tables of 18 or 19 bits, and a query looks up some 1,200 keys. A pair is returned by
    the first table in which it meets, inside the join, and a key that many share is split by adaptive execution. Neither side is ever broadcast: the
    looked-up keys are a thousand times their fingerprints.
    """
    q = _keyed(queries, radius, True).withColumnsRenamed({"f1": "q1", "f2": "q2", "key": "q_key"})
    both = [_block(start, width).replace("f1", "(f1 ^ q1)").replace("f2", "(f2 ^ q2)") for start, width, _ in _blocks(radius)]
    first = "CASE " + " ".join(f"WHEN bit_count({x}) <= {flips} THEN {i}L" for i, (x, (_, _, flips)) in enumerate(zip(both, _blocks(radius), strict=True))) + " END"
    met = q.hint("merge").join(_keyed(base, radius, False), F.expr(f"q_key = key AND {distance('q', 'f')} <= {radius} AND shiftrightunsigned(key, 32) = {first}"))
    return met.select(F.col("q1").alias("qf1"), F.col("q2").alias("qf2"), "f1", "f2", F.expr(distance("q", "f")).alias("bits"))


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_every: int = 1, radius: int = NEAR) -> DataFrame:
    """(id, near_id, bits): the documents of other ids within ``radius`` bits of those whose id is divisible by ``query_every``; rows without an id are left out.

    Fingerprints are compared once, and their documents joined to the near ones. Of an id of several texts the nearest counts.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id IS NOT NULL").withColumn("h", F.xxhash64("text"))
    own = stored(fingerprints(base.dropDuplicates(["id", "h"]), ["id", "h"]).select("id", "f1", "f2").distinct(), "simhash-own")
    asked = own.where(F.col("id") % query_every == 0)
    near = near_fingerprints(asked.select("f1", "f2").distinct(), own.select("f1", "f2").distinct(), radius)
    found = near.join(own.select(F.col("id").alias("near_id"), "f1", "f2"), ["f1", "f2"]).drop("f1", "f2").join(asked.withColumnsRenamed({"f1": "qf1", "f2": "qf2"}), ["qf1", "qf2"])
    return found.where("id != near_id").groupBy(F.col("id").alias(id_col), "near_id").agg(F.min("bits").alias("bits"))


def next_rows(light: DataFrame) -> DataFrame:
    """Adds next_k, next_h to distinct rows (k, h, ...): those of the row after in ascending (k, h), of the first after the last.

    Rows are dealt by range; each range's window finds the next row, and the ranges' first rows, one a partition, are carried over.
    """
    spark = light.sparkSession
    dealt = stored(light.repartitionByRange(partitions(spark), "k", "h").withColumn("part", F.spark_partition_id()), "simhash-order")
    w = Window.partitionBy("part").orderBy("k", "h")
    own = dealt.withColumn("next", F.lead(F.struct("k", "h")).over(w))
    firsts = dealt.groupBy("part").agg(F.min(F.struct("k", "h")).alias("first"))
    over = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(over), F.min("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    joined = own.join(F.broadcast(after), "part")  # a row per shuffle partition
    return joined.withColumn("next", F.coalesce("next", "after")).select(*light.columns, F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, bodies). links: k, h, id, n_chars, copies, next_k, next_h for each distinct (id, text). bodies: k, h, text, edited.

    ``k`` is the id (least value for a null one, which so comes first), ``h`` a hash of the text; ``edited`` has its last floor(n / 2) code points
    replaced by the first as many (or all) of the next row's text.
    """
    base = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    light = base.groupBy("k", "h").agg(F.max("id").alias("id"), F.max(F.length("text")).cast("bigint").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    links = stored(next_rows(light), "simhash-links")
    texts = base.select("k", "h", "text").dropDuplicates(["k", "h"])
    wanted = links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.expr("CAST(n_chars DIV 2 AS INT)").alias("n"))
    heads = texts.join(wanted, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.expr("substring(text, 1, n)").alias("head"))
    bodies = texts.join(heads, ["k", "h"]).select("k", "h", "text", F.expr("concat(substring(text, 1, length(text) - CAST(length(text) DIV 2 AS INT)), head)").alias("edited"))
    return links, bodies


def edit_sensitivity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_every: int = 20, radius: int = NEAR) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likenesses, and what the block tables find near.

    Per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and n_near: for ids divisible by
    ``query_every`` the number of other rows whose fingerprint is within ``radius`` bits, else null. Null texts are empty; empty and blank texts have
    the fingerprint 0. Rows of one id and text count once in the order and all return the same result; a null id comes first. One row alone is its own next.
    """
    links, bodies = edited_pairs(docs, id_col, text_col)
    both = bodies.select("k", "h", F.expr("inline(array(struct(0 AS kind, text AS body, '' AS sha), struct(1 AS kind, edited AS body, sha2(CAST(edited AS BINARY), 256) AS sha)))"))
    prints = stored(fingerprints(both, ["k", "h", "kind", "sha"], "body"), "simhash-prints")
    own, edited = prints.where("kind = 0").drop("kind", "sha"), prints.where("kind = 1").drop("kind")
    rows = (
        links.join(own, ["k", "h"])
        .join(edited.withColumnsRenamed({"f1": "e1", "f2": "e2"}), ["k", "h"])
        .join(own.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("f1").alias("n1"), F.col("f2").alias("n2")), ["next_k", "next_h"])
    )
    counted = links.join(own, ["k", "h"]).groupBy("f1", "f2").agg(F.sum("copies").alias("rows"))
    asked = links.where(F.col("id") % query_every == 0).join(own, ["k", "h"]).select("f1", "f2").distinct()
    near = near_fingerprints(asked, counted, radius).join(counted, ["f1", "f2"]).groupBy(F.col("qf1").alias("f1"), F.col("qf2").alias("f2")).agg((F.sum("rows") - 1).alias("n_near"))
    rows = rows.join(near, ["f1", "f2"], "left")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), hexed("f").alias("fingerprint"), hexed("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"), likeness("f", "n").alias("near_next"), F.when(F.col("id") % query_every == 0, F.col("n_near")).alias("n_near"), F.expr("explode(sequence(1L, copies))").alias("_copy"),
    ).drop("_copy")

"""N-gram Jaccard join with signature trees.

Documents are sets of word n-grams. Two sets whose Jaccard similarity is ``t`` or more differ in few members, so of enough hash buckets one at least
holds the same members in both: the bucket's contents are the key by which documents that may be linked meet (nothing is missed). First every document
is held against the document that it meets most often; documents so linked form components. Only where documents of different components meet are
signature trees built: nodes hold the OR of their members' token bitmaps and the range of their sizes, and a traversal of two trees at once leaves out
pairs of nodes whose largest possible overlap is too small, or that are linked already. What is left is compared exactly, in a few turns: the likeliest
partner of each document first, at last every pair that is still possible; groups without a possible pair leave after their first turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import KeyFilter, batches, blob_column, discard, free_name, lean, mix, partitions, passing, stored, windows, words
from tessitura.llm.components import merged

#: Bits of a set's bitmap: the power of two from twice its size on, within these bounds.
LEAST_MAP, MOST_MAP = 512, 1 << 16
LEAF, FAN = 8, 8
#: Members of one block of a key; blocks of a key are held against each other pair by pair.
BLOCK = 1024
#: Turns in which each document is held against its likeliest partner of another component; one more turn takes all that is left.
TURNS = 2
#: Arrow batches are cut to about so many bytes before texts or signatures are unfolded.
BATCH_BYTES = 4 << 20
#: Buckets that may go unsigned: so many, and this share of the members in which a pair may differ.
SPARE, SPARE_SHARE = 6, Fraction(1, 3)
U = np.uint64


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its n-word shingles; of a shorter text the whole sequence as one; none without words."""
    offsets, hashes = words(texts)
    rolled = windows(hashes, n)
    out = []
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - start >= n:
            out.append(np.unique(rolled[start : end - n + 1]))
        elif end > start:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[start:end].tobytes(), seed=int(end - start))], U))
        else:
            out.append(np.zeros(0, U))
    return out


class Signer:
    """Signatures of a set: a hash of the contents of each of its buckets, for the size bands in which a partner can be.

    Bands of sizes end at ``ends``. Two linked sets, the larger of band b, both sign for band b: a set signs for its own band and for each larger one that
    may hold a partner. Sets up to ``ends[b]`` that are linked differ in at most D = floor(2 (1-t)/(1+t) ends[b]) members, so of D + 1 + s buckets
    more than s hold the same. Buckets of no or one member are weak, since they tell little (a common n-gram may be all there is); a bucket that both
    sets hold alike is weak in both or in neither. A set signs its strong buckets among the first D + 1 + s, for the least s up to ``spare`` with no more
    than s weak ones among them: of two such sets the lesser s leaves a strong bucket in common that both sign. A set without such an s signs all its
    D + 1 + spare buckets: those that aren't empty, and where more than ``spare`` are empty those as well. So a linked pair always shares a signature.
    """

    def __init__(self, t: Fraction):
        self.t = t
        ends = [1]
        while ends[-1] < 1 << 40:
            ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
        self.ends = np.array(ends)
        rate = 2 * (1 - t) / (1 + t)
        self.differ = [int(rate * e) for e in ends]

    def sign(self, members: np.ndarray) -> np.ndarray:
        """members: sorted and distinct."""
        size = len(members)
        if not size:
            return np.zeros(0, U)
        band = int(np.searchsorted(self.ends, size))
        out = []
        largest = int(np.searchsorted(self.ends, int(size / self.t)))  # band of the largest partner
        mixed = mix(members)
        for b in range(band, largest + 1):
            least = self.differ[b] + 1
            if least == 1:  # only equal sets are linked, and those are one class
                continue
            spare = SPARE + int(SPARE_SHARE * self.differ[b])
            k = least + spare
            bucket = ((members >> U(32)) * U(k)) >> U(32)  # ascending with the members
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            own, held = bucket[starts], np.diff(np.append(starts, size))
            signs = mix(np.add.reduceat(mixed, starts) ^ mix((own << U(20)) + U(b + 1)))
            strong = np.zeros(k, np.int64)
            strong[own[held >= 2]] = 1
            weak = np.arange(least, k + 1) - np.cumsum(strong)[least - 1 :]  # among the first D + 1 + s buckets
            enough = np.flatnonzero(weak <= np.arange(spare + 1))
            if len(enough):
                out.append(signs[(held >= 2) & (own < U(least + int(enough[0])))])
                continue
            out.append(signs)
            if k - len(starts) > spare:
                none = np.setdiff1d(np.arange(k, dtype=U), own)
                out.append(mix(mix((none << U(20)) + U(b + 1)) ^ U(0x5851F42D4C957F2D)))
        return np.concatenate(out) if out else np.zeros(0, U)


def bitmap(members: np.ndarray) -> np.ndarray:
    bits = min(MOST_MAP, max(LEAST_MAP, 1 << max(2 * len(members) - 1, 1).bit_length()))
    flags = np.zeros(bits, bool)
    flags[(members % U(bits)).astype(np.int64)] = True
    return np.packbits(flags).view(U)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width, that of the narrowest: a member's place in half the bits is its place modulo the half."""
    width = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, width)) for m in maps])


class SignatureTree:
    """Levels from the leaves up; each node has the OR of its members' bitmaps, their least and largest size, the largest excess of a size over its bits, and their components."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        order = np.lexsort((sizes, comps))
        maps, sizes, comps = maps[order], sizes[order], comps[order]
        self.order = order
        excess = sizes - np.bitwise_count(maps).sum(1)
        self.levels = [(maps, sizes, sizes, excess, comps, comps)]
        fan = LEAF
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ex, c0, c1 = self.levels[-1]
            at = np.arange(0, len(m), fan)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))
            fan = FAN

    def __len__(self) -> int:
        return len(self.levels)

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``nodes`` and the children of each on the level below."""
        fan = LEAF if level == 1 else FAN
        below = len(self.levels[level - 1][0])
        kids = nodes[:, None] * fan + np.arange(fan)
        row, col = np.nonzero(kids < below)
        return row, kids[row, col]


def dual_traversal(a: SignatureTree, b: SignatureTree, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in the order given to each tree) of pairs that may be linked and are of different components, and their largest possible similarity."""
    score = np.zeros(1)
    top = max(len(a), len(b)) - 1
    p, q, num, den = np.zeros(1, np.int64), np.zeros(1, np.int64), t.numerator, t.denominator
    for level in range(top, -1, -1):
        la, lb = min(level, len(a) - 1), min(level, len(b) - 1)
        keep, scores = [], []
        for at in range(0, len(p), 1 << 14):
            i, j = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
            ma, loa, hia, exa, ca0, ca1 = (x[i] for x in a.levels[la])
            mb, lob, hib, exb, cb0, cb1 = (x[j] for x in b.levels[lb])
            ok = (den * hia >= num * lob) & (den * hib >= num * loa) & ~((ca0 == ca1) & (cb0 == cb1) & (ca0 == cb0))
            most = np.minimum(np.bitwise_count(ma & mb).sum(1) + np.minimum(exa, exb), np.minimum(hia, hib))
            # overlap >= t * (|x| + |y| - overlap) for the smallest |x| and |y|
            ok &= (den + num) * most >= num * (loa + lob)
            keep.append(ok)
            scores.append(most / np.maximum(loa + lob - most, 1))
        ok = np.concatenate(keep) if keep else np.zeros(0, bool)
        p, q, score = p[ok], q[ok], np.concatenate([*scores, np.zeros(0)])[ok]
        if level == 0 or not len(p):
            break
        if la == level:
            row, kids = a.children(level, p)
            p, q = kids, q[row]
        if lb == level:
            row, kids = b.children(level, q)
            p, q = p[row], kids
    return a.order[p], b.order[q], score


def _signed(docs: DataFrame, n: int, t: Fraction) -> DataFrame:
    def sign(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(t)
        for batch in batches(rows, BATCH_BYTES):
            sets = shingle_sets(batch.column(1), n)
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64) for x in sets]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), blob_column([signer.sign(x).tobytes() for x in sets])], ["id", "n", "h1", "h2", "sigs"]
            )

    return docs.mapInArrow(lean(sign), "id bigint, n bigint, h1 bigint, h2 bigint, sigs binary")


MEETING = "met array<bigint>, id bigint, pivot bigint"
PACKED = f"slot int, keys binary, ids binary, at binary, mates binary, {MEETING}"
MET = ["met", "id", "pivot"]
#: About so many keys are in one batch of meetings.
MET_KEYS = 100_000


def _grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ids sorted by both, each pair once; which are the first of their key, the first id and the number of ids of each row's key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])[: len(keys)]
    keys, ids = keys[new], ids[new]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    group = np.cumsum(first) - 1
    return keys, ids, first, ids[first][group], np.bincount(group)[group] if len(keys) else np.zeros(0, np.int64)


def _meeting(reps: DataFrame) -> DataFrame:
    """(met, id, pivot): every document under each key that two or more share; pivot is the smallest document of the key, or of those read together.

    Keys travel as packed arrays, dealt by their top bits. Before that, of the rows of a batch that share a key all but the smallest are done, and only
    that one goes on, so a key that very many documents share is small when it is shuffled. A document meets one pivot under many keys where texts are
    near copies: these keys (met) are one row. So there are at most as many keys as signatures, and few rows a document however many copies it has.
    """
    parts = partitions(reps.sparkSession)
    slots = 4 * parts

    def done(keys: np.ndarray, ids: np.ndarray, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((pivots, ids))
        keys, ids, pivots = keys[order].view(np.int64), ids[order], pivots[order]
        cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (pivots[1:] != pivots[:-1])])[: len(keys)])
        for rows in np.split(cut, np.flatnonzero(np.diff(cut // MET_KEYS)) + 1) if len(cut) else []:
            end = cut[np.searchsorted(cut, rows[-1]) + 1] if rows[-1] != cut[-1] else len(keys)
            met = pa.ListArray.from_arrays(pa.array((np.append(rows, end) - rows[0]).astype(np.int32)), pa.array(keys[rows[0] : end]))
            yield pa.RecordBatch.from_arrays([met, pa.array(ids[rows]), pa.array(pivots[rows])], MET)

    def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PACKED.split(", ")]
        for batch in batches(rows, BATCH_BYTES):
            blobs = [np.frombuffer(x, U) for x in batch.column(1).to_pylist()]
            keys, ids, first, pivot, n = _grouped(np.concatenate([*blobs, np.zeros(0, U)]), np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in blobs]))
            if not len(keys):
                continue
            for more in done(keys[~first], ids[~first], pivot[~first]):
                slot = mix(mix(more.column("id").to_numpy().view(U)) ^ more.column("pivot").to_numpy().view(U)) % U(slots)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *[pa.nulls(len(slot), pa.binary())] * 4, *more.columns], names)
            keys, ids, mates = keys[first], ids[first], n[first] > 1
            slot = ((keys >> U(32)) * U(slots)) >> U(32)
            cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            held = [np.unique(ids[x:y], return_inverse=True) for x, y in spans]
            places = [at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes() for own, at in held]
            packed = [blob_column([keys[x:y].tobytes() for x, y in spans]), blob_column([own.tobytes() for own, _ in held]), blob_column(places), blob_column([mates[x:y].tobytes() for x, y in spans])]
            yield pa.RecordBatch.from_arrays([pa.array(slot[cut[:-1]].astype(np.int32)), *packed, *(pa.nulls(len(spans), x) for x in (pa.list_(pa.int64()), pa.int64(), pa.int64()))], names)

    def meet(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, mates = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for batch in rows:
            made = batch.filter(batch.column("id").is_valid())
            if made.num_rows:
                yield made.select(MET)
            for k, own, at, m in zip(*(batch.column(c).drop_null().to_pylist() for c in ("keys", "ids", "at", "mates")), strict=True):
                keys.append(np.frombuffer(k, U))
                ids.append(np.frombuffer(own, np.int64)[np.frombuffer(at, np.uint16 if len(own) <= 8 << 16 else np.uint32)])
                mates.append(np.frombuffer(m, bool))
        k, i, m = np.concatenate(keys), np.concatenate(ids), np.concatenate(mates)
        alone = np.unique(k[m])  # met in a batch
        keys.clear(), ids.clear(), mates.clear()
        k, i, _, pivot, n = _grouped(k, i)
        shared = n > 1
        if len(alone):
            shared |= alone[np.minimum(np.searchsorted(alone, k), len(alone) - 1)] == k
        yield from done(k[shared], i[shared], pivot[shared])

    return reps.select("id", "sigs").mapInArrow(lean(pack), PACKED).repartition(parts, "slot").mapInArrow(lean(meet), MEETING)


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, n, bits, members) of the documents in ``wanted`` (id), and of a few more that pass the filter of a bounded size."""
    known = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(wanted))

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            batch = batch.filter(batch.column(0).is_valid())
            batch = batch.filter(pa.array(known.value(batch.column(0).to_numpy(zero_copy_only=False).view(U))))
            for part in batches([batch] if batch.num_rows else [], BATCH_BYTES):
                sets = shingle_sets(part.column(1), n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), blob_column([bitmap(x).tobytes() for x in sets]), blob_column([x.tobytes() for x in sets])], ["id", "n", "bits", "members"])

    return docs.mapInArrow(lean(make), "id bigint, n bigint, bits binary, members binary")


def _possible(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that their bitmaps don't rule out."""
    num, den = t.numerator, t.denominator

    def keep(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ok = []
            for m, k, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                one, two = folded([np.frombuffer(x, U), np.frombuffer(y, U)])
                most = min(m - int(np.bitwise_count(one & ~two).sum()), k - int(np.bitwise_count(two & ~one).sum()))
                ok.append((den + num) * most >= num * (m + k))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), "n", F.col("bits").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(lean(keep), "a bigint, b bigint").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b), a stored table, whose sets are linked, by exact intersection. Only the sets in question are joined."""
    known = pairs.sparkSession.sparkContext.broadcast(KeyFilter.of(pairs.selectExpr("explode(array(a, b)) AS id").distinct()))
    own = stored(passing(sets.select("id", "members"), "id", known), "join-sets")
    num, den = t.numerator, t.denominator

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in batches([whole], BATCH_BYTES):
                keep = []
                for one, two in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    u, v = np.frombuffer(one, U), np.frombuffer(two, U)
                    common = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(den * common >= num * (len(u) + len(v) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(own.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    found = stored(both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a bigint, b bigint"), "join-edges")
    discard(own)
    return found


def _open_groups(meeting: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, i, j, side, id): the documents of each key under which several components meet, dealt into pairs of blocks.

    Of keys with the same documents one is enough. A key of up to BLOCK documents is one block, held against itself. Of a larger one the members of its
    largest component (the trunk) are not held against each other, since components only grow. Side 0 of a pair holds block i, side 1 block j.
    """
    marks = [F.sum(F.expr(f"xxhash64(id, {i}) & 2147483647")).alias(f"who{i}") for i in range(3)]
    under = meeting.select("id", "met").join(labels, "id").select(F.explode("met").alias("key"), "id", "comp")
    sizes = under.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), *marks)
    keys = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), *(F.sum(f"who{i}").alias(f"who{i}") for i in range(3)))
    keys = keys.where("comps > 1").groupBy("who0", "who1", "who2", "all").agg(F.min(F.struct("key", "top")).alias("one")).select("one.key", "one.top", "all")
    keys = keys.select("key", F.col("top.comp").alias("trunk"), F.expr(f"CAST(if(all <= {BLOCK}, 0, ceil(top.n / {BLOCK})) AS INT)").alias("nt"), F.expr(f"CAST(if(all <= {BLOCK}, 1, ceil((all - top.n) / {BLOCK})) AS INT)").alias("ns"))
    keys = stored(keys, "join-open")
    rows = under.join(keys, "key").withColumn("in_trunk", F.expr("nt > 0 AND comp = trunk"))
    spread = rows.withColumn("block", F.expr("CAST(pmod(xxhash64(id, 7), if(in_trunk, nt, ns)) AS INT)")).withColumn(
        "to",
        F.expr("""if(in_trunk, transform(sequence(0, ns - 1), s -> struct(s AS i, ns + block AS j, 1 AS side)),
                  concat(transform(sequence(block, ns + nt - 1), j -> struct(block AS i, j AS j, 0 AS side)),
                         transform(filter(sequence(0, block), i -> i < block), i -> struct(i AS i, block AS j, 1 AS side))))"""),
    )
    dealt = stored(spread.select("key", "id", F.explode("to").alias("to")).select("key", "to.i", "to.j", "to.side", "id"), "join-groups")
    discard(keys)
    return dealt


def _distinct_pairs(packed: DataFrame) -> DataFrame:
    """(a, b, score) of packed rows (slot, pairs, scores): each pair once, with its largest score."""

    def unpack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, scores = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for batch in rows:
            pairs += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("pairs").to_pylist()]
            scores += [np.frombuffer(x) for x in batch.column("scores").to_pylist()]
        ab, score = np.concatenate(pairs), np.concatenate(scores)
        order = np.argsort(-score, kind="stable")
        ab, first = np.unique(ab[order], axis=0, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.array(score[order][first])], ["a", "b", "score"])

    parts = partitions(packed.sparkSession)
    return packed.where("pairs IS NOT NULL").select("slot", "pairs", "scores").repartition(parts, "slot").mapInArrow(lean(unpack), "a bigint, b bigint, score double")


def _traversed(groups: DataFrame, labels: DataFrame, sets: DataFrame, t: Fraction, best: bool) -> DataFrame:
    """Pairs of different components that the trees don't rule out, with ``best`` only the likeliest of each document, as packed rows (slot, pairs,
    scores): a pair meets under many keys, and all its meetings have one slot. And a row (key, i, j) for each group that has any."""
    rows = groups.join(labels, "id").join(sets.select("id", "n", "bits"), "id")
    names = ["key", "i", "j", "side", "id", "comp", "n", "bits"]
    num, den, slots = t.numerator, t.denominator, partitions(groups.sparkSession)

    def traverse(ids: np.ndarray, side: np.ndarray, sizes: np.ndarray, comps: np.ndarray, maps: list[np.ndarray], same: bool) -> tuple[np.ndarray, ...]:
        """Pairs of one group, by two trees; a block that is held against itself makes one."""
        one = side == 0
        two = one if same else side == 1
        if not one.any() or not two.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        wide = folded(maps)
        left = SignatureTree(wide[one], sizes[one], comps[one])
        a, b, score = dual_traversal(left, left if same else SignatureTree(wide[two], sizes[two], comps[two]), t)
        return ids[one][a], ids[two][b], score

    def small(start: np.ndarray, size: np.ndarray, ids: np.ndarray, side: np.ndarray, sizes: np.ndarray, comps: np.ndarray, maps: list[np.ndarray], same: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs of many groups that are single leaves, at once, and the group of each: first by bitmaps folded to the least width, then by whole ones."""
        n = size * size
        group = np.repeat(np.arange(len(size)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, q = start[group] + at // size[group], start[group] + at % size[group]
        ok = (comps[p] != comps[q]) & np.where(same[group], p < q, (side[p] == 0) & (side[q] == 1))
        ok &= (den * sizes[p] >= num * sizes[q]) & (den * sizes[q] >= num * sizes[p])
        p, q, group = p[ok], q[ok], group[ok]
        narrow = np.stack([np.bitwise_or.reduce(m.reshape(-1, LEAST_MAP // 64)) for m in maps]) if len(p) else np.zeros((0, 1), U)
        keep, score = np.zeros(len(p), bool), np.zeros(len(p))
        for at in range(0, len(p), 1 << 14):
            i, j = p[at : at + (1 << 14)], q[at : at + (1 << 14)]
            x, y = narrow[i], narrow[j]
            most = np.minimum(sizes[i] - np.bitwise_count(x & ~y).sum(1), sizes[j] - np.bitwise_count(y & ~x).sum(1))
            for k in np.flatnonzero((den + num) * most >= num * (sizes[i] + sizes[j])):
                one, two = folded([maps[i[k]], maps[j[k]]])
                m = min(int(sizes[i[k]] - np.bitwise_count(one & ~two).sum()), int(sizes[j[k]] - np.bitwise_count(two & ~one).sum()))
                total = int(sizes[i[k]] + sizes[j[k]])
                keep[at + k], score[at + k] = (den + num) * m >= num * total, m / max(total - m, 1)
        return ids[p[keep]], ids[q[keep]], score[keep], group[keep]

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j, side, ids, comps, sizes = (table.column(c).to_numpy() for c in names[:-1])
        maps = [np.frombuffer(x, U) for x in table.column("bits").to_pylist()]
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        start, size = cut[:-1], np.diff(cut)
        leaf = size <= 2 * LEAF
        *first, group = small(start[leaf], size[leaf], ids, side, sizes, comps, maps, (i == j)[start[leaf]])
        found, open_at = [first], [start[leaf][np.unique(group)]]
        for k in np.flatnonzero(~leaf):
            s = slice(start[k], start[k] + size[k])
            found.append(traverse(ids[s], side[s], sizes[s], comps[s], maps[s], bool(i[s.start] == j[s.start])))
            if len(found[-1][0]):
                open_at.append(start[k : k + 1])
        x, y, score = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(x):
            return
        x, y = np.minimum(x, y), np.maximum(x, y)
        if best:  # the likeliest of each document in these groups
            order = np.lexsort((y, x, -score))
            x, y, score = x[order], y[order], score[order]
            x, y, score = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([score, score])
            order = np.argsort(-score, kind="stable")
            kept = order[np.unique(x[order], return_index=True)[1]]
            x, y, score = x[kept], y[kept], score[kept]
        else:
            both, kept = np.unique(np.stack([x, y], 1), axis=0, return_index=True)
            x, y, score = both[:, 0], both[:, 1], score[kept]
        slot = (mix(mix(x.view(U)) ^ y.view(U)) % U(slots)).astype(np.int32)
        order = np.argsort(slot, kind="stable")
        ab, score, slot = np.stack([x, y], 1)[order], score[order], slot[order]
        cut = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]]))
        spans, out, at = list(zip(cut[:-1], cut[1:], strict=True)), ["slot", "pairs", "scores", "key", "i", "j"], np.concatenate(open_at)
        n, m = len(spans), len(at)
        yield pa.RecordBatch.from_arrays([pa.array(slot[cut[:-1]]), blob_column([ab[x:y].tobytes() for x, y in spans]), blob_column([score[x:y].tobytes() for x, y in spans]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], out)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(key[at]), pa.array(i[at]), pa.array(j[at])], out)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group; a group may begin in one batch and end in another."""
        held = None
        for batch in rows:
            table = pa.Table.from_batches([batch]).select(names)
            table = table if held is None else pa.concat_tables([held, table])
            key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
            last = int(np.argmax((key == key[-1]) & (i == i[-1]) & (j == j[-1]))) if len(key) else 0  # where the last group begins
            if last:
                yield from pairs(table.slice(0, last))
            held = table.slice(last)
        if held is not None and held.num_rows:
            yield from pairs(held)

    dealt = rows.select(*names).repartition(partitions(groups.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return stored(dealt.mapInArrow(lean(run), "slot int, pairs binary, scores binary, key bigint, i int, j int"), "join-found")


def jaccard_components(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles (its set's size), component_id (the smallest id reachable by links of similarity >= ``threshold``), n_class (rows of equal sets).

    threshold is a decimal text, compared exactly. Ids are bigints; rows of one id are one document with the links of all its texts. Null and blank texts
    have the empty set and are linked with nothing (component: the own id); a row with a null id is linked with nothing and has a null component.
    Other columns are ignored. Rows of equal sets form a class, and only its smallest id goes on. Texts are read twice: for all signatures, and for the
    sets of the documents that share one; tables that a later one replaces are deleted.
    """
    t, spark = Fraction(threshold), docs.sparkSession
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(_signed(base, n, t), "join-signed")
    full = signed.where("n > 0 AND id IS NOT NULL")
    classes = stored(full.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_class")), "join-classes")
    # only what may be of a class of several rows is joined with the smallest ids
    several = spark.sparkContext.broadcast(KeyFilter.of(classes.where("n_class > 1").select("h1")))
    sigs = full.select("id", "h1", "h2", "sigs")
    first_of = classes.select("h1", "h2", F.col("rep").alias("id"))
    reps = passing(sigs, "h1", several, False).select("id", "sigs").unionByName(passing(sigs, "h1", several).join(first_of, ["h1", "h2", "id"], "left_semi").select("id", "sigs"))
    meeting = stored(_meeting(reps), "join-meeting")
    slim = stored(signed.select("id", "n", "h1", "h2"), "join-slim")
    discard(signed)
    wanted = meeting.select("id").distinct()
    sets = stored(_sets(base, wanted, n), "join-sets")
    oftenest = meeting.where("id != pivot").groupBy("id", "pivot").agg(F.sum(F.size("met")).alias("n")).groupBy("id").agg(F.max(F.struct("n", (-F.col("pivot")).alias("minus"))).alias("best"))
    first = stored(_possible(oftenest.select(F.col("id").alias("a"), (-F.col("best.minus")).alias("b")), sets, t), "join-possible")
    labels = stored(wanted.select("id", F.col("id").alias("comp")), "labels")
    labels = merged(labels, _linked(first, sets, t))
    groups = _open_groups(meeting, labels)
    discard(meeting, first)
    for turn in range(TURNS + 1):
        found = _traversed(groups, labels, sets, t, turn < TURNS)
        pairs = _distinct_pairs(found)
        if turn < TURNS:
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            still = stored(groups.join(found.where("slot IS NULL").select("key", "i", "j").distinct(), ["key", "i", "j"], "left_semi"), "join-groups")
            discard(groups)
            groups = still
        pairs = stored(pairs.select("a", "b").distinct(), "join-possible")
        labels = merged(labels, _linked(pairs, sets, t))
        discard(found, pairs)
    discard(groups, sets)
    result = classes.join(labels.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"), "n_class")
    out = slim.join(result, ["h1", "h2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("comp"))).otherwise(F.col("id")).alias("component_id"), F.coalesce(F.when(F.col("n") > 0, F.col("n_class")), F.lit(1).cast("bigint")).alias("n_class"))


def without_near_duplicates(docs: DataFrame, n: int = 5, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each component stays: that of the smallest id, and one row of it.

    Null and blank texts are linked with nothing and stay (one row an id); rows with a null id stay.
    """
    found = stored(jaccard_components(docs, n, threshold, id_col, text_col), "join-result")
    name, order, id_ = free_name(docs, "key_of"), free_name(docs, "nth"), F.col(id_col).cast("bigint")
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    twice = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(F.col(id_col).alias(name))
    # only rows that may go, or whose id may come again, are shuffled
    known = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(gone.unionByName(twice)))
    keyed = docs.withColumn(name, id_)
    kept = passing(keyed, name, known).join(gone, name, "left_anti")
    w = Window.partitionBy(name).orderBy(F.xxhash64(text_col))
    kept = kept.withColumn(order, F.row_number().over(w)).where(F.col(order) == 1)
    return passing(keyed, name, known, False).select(*docs.columns).unionByName(kept.select(*docs.columns))

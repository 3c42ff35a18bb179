"""Token counts, packing, SimHash, toxicity and quality against brute force, the public library and labels; odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tessitura.llm import packing, quality, simhash, token_counts, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    (1, "the cat sat on the mat"), (2, None), (3, ""), (4, " \n\t "), (5, "the cat sat on the mat"), (5, "the cat sat on the mat"), (None, "no id"), (6, "a" * 5000), (7, "word " * 3000), (8, "é漢字 <|endoftext|> 's x  y\n\n z"), (9, "one"),
]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def odd(spark, rows=ODD):
    """Odd rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(a, b, 1, "x", 2.0) for a, b in rows], SCHEMA + ", id int, text_key string, score double")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(seed, n=200):
    pick = random.Random(seed)
    parts = ["the", " ", "\n", "<|endoftext|>", "ab", "é", "漢", "'s", "'", "12", "!!", "\t", "  ", " x", "　", "\xa0", "\x1c", "."]
    return ["".join(pick.choice([*parts, "a" * pick.randint(1, 40)]) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def test_merge_counter_equals_the_library(tokenizer):
    own = token_counts.MergeCounter.from_file(PATH)
    for text in texts(1, 500):
        assert own.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_encoder_equals_the_library(tokenizer):
    own = packing.Encoder(PATH)
    for text in [*texts(2, 500), "one two, three.\nfour five", "a b"]:
        assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_PIECES", 8)
    own = token_counts.MergeCounter.from_file(PATH)
    assert own.count(" ".join(map(str, range(200)))) == token_counts.MergeCounter.from_file(PATH).count(" ".join(map(str, range(200))))
    assert len(own) <= 8 and len(own.old) <= 8


def test_token_counts_of_odd_rows(spark, tokenizer):
    got = token_counts.token_counts(odd(spark), PATH, limit=5).collect()
    want = [(d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 5) for d, t in ODD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.token_counts(empty(spark), PATH).count() == 0


def check_packing(rows, docs, tokenizer, window):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in docs]
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    pool = {(d, len(i)): i for (d, _), i in zip(docs, ids, strict=True)}
    for r in rows:
        i = pool[r["doc_id"], r["doc_tokens"]]
        assert zlib.crc32(i[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
        padding += window - at if at & (at - 1) else 0
    return padding


def test_packing_covers_every_id_once_without_padding(spark, tokenizer):
    rows = packing.pack(odd(spark), PATH, window=64).collect()
    assert check_packing(rows, ODD, tokenizer, 64) == 0
    assert packing.pack(empty(spark), PATH).count() == 0


def test_windows_take_lexical_neighbours():
    terms = [np.array(t, np.int64) for t in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 6])]
    lengths = np.array([6, 6, 4, 4])
    index = packing.Index(terms, [np.ones(3, np.int64)] * 4, lengths.astype(np.float32), np.ones(10, np.float32), 5.0)
    made = packing.fill_windows(index, lengths, 10)
    assert [[p[0] for p in s] for s in made] == [[0, 2], [1, 3]]


def test_bm25_scores_equal_the_formula():
    pick = np.random.default_rng(1)
    terms = [np.sort(pick.choice(30, 8, replace=False)) for _ in range(12)]
    counts = [pick.integers(1, 5, 8) for _ in terms]
    lengths, idf = pick.integers(5, 50, 12).astype(np.float32), pick.random(30).astype(np.float32)
    got = packing.Index(terms, counts, lengths, idf, 20.0).scores(3)
    for d in range(12):
        tf = dict(zip(terms[d], counts[d], strict=True))
        want = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * lengths[d] / 20)) for t in terms[3] if t in tf)
        assert got[d] == pytest.approx(want, rel=1e-5)


def test_bm25_scores_count_all_terms_of_a_long_seed():
    terms = [np.arange(100), np.array([99]), np.array([0]), np.array([200])]
    index = packing.Index(terms, [np.ones(len(t), np.int64) for t in terms], np.array([100, 1, 1, 1], np.float32), np.linspace(1, 2, 300).astype(np.float32), 26.0)
    assert [bool(x > 0) for x in index.scores(0)] == [True, True, True, False]


def test_large_keys_are_split_into_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 100)
    keys = [0] * 10 + [1 << 20] * 1000 + [(1 << 20) + 1] * 20 + [1 << 23] * 30
    rows = packing._dealt(spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), "key int, seq bigint")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["key"])
    assert len(rows) == len(keys) and max(by) == 10 and all(50 <= len(by[s]) <= 150 for s in range(10))
    assert len({r["shard"] for r in rows if r["key"] == 1 << 20}) == 11 and {r["shard"] for r in rows if r["key"] in ((1 << 20) + 1, 1 << 23)} == {10}


def test_encoder_takes_very_long_white_space(tokenizer):
    own = packing.Encoder(PATH)
    for text in (" " * 300_000, "a<|endoftext|>b" + " \n" * 200_000 + "x é", "x" * 300_000):
        assert own.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_simhash_of_odd_rows(spark):
    rows = simhash.edit_sensitivity(odd(spark), query_every=1).collect()
    assert len(rows) == len(ODD)
    base = sorted({(-(1 << 63) if d is None else d, t or "") for d, t in ODD})
    order = {k: base[(i + 1) % len(base)][1] for i, k in enumerate(base)}
    for r in rows:
        candidates = [t for k, t in base if k == (-(1 << 63) if r["doc_id"] is None else r["doc_id"])]
        n = len(candidates[0])
        text, after = candidates[0], order[(-(1 << 63) if r["doc_id"] is None else r["doc_id"], candidates[0])]
        want = text[: n - n // 2] + after[: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[1] == prints[5] and prints[2] == prints[3] == prints[4] == "0" * 32
    assert {r["n_near"] for r in rows if r["doc_id"] in (1, 5)} == {2}
    assert simhash.edit_sensitivity(empty(spark)).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    pick = random.Random(3)
    base = [(pick.getrandbits(64) - (1 << 63), pick.getrandbits(64) - (1 << 63)) for _ in range(30)]
    for f1, f2 in list(base[:20]):
        for n in (1, 3, 6, 7, 9):
            bits = pick.sample(range(128), n)
            a, b = f1 & (2**64 - 1), f2 & (2**64 - 1)
            for x in bits:
                a, b = (a ^ 1 << x, b) if x < 64 else (a, b ^ 1 << x - 64)
            base.append(tuple(v - (1 << 64) if v >> 63 else v for v in (a, b)))
    df = spark.createDataFrame(sorted(set(base)), "f1 bigint, f2 bigint")
    got = sorted(map(tuple, simhash.near_fingerprints(df, df).collect()))
    near = lambda x, y: ((x[0] ^ y[0]) & (2**64 - 1)).bit_count() + ((x[1] ^ y[1]) & (2**64 - 1)).bit_count()
    assert got == sorted((*x, *y, near(x, y)) for x in set(base) for y in set(base) if near(x, y) <= 6)


@pytest.mark.parametrize("radius", [0, 10, 20, 26])
def test_near_fingerprints_of_any_radius(spark, radius):
    pick = random.Random(radius)
    whole = [pick.getrandbits(128) for _ in range(12)]
    whole += [x ^ sum(1 << b for b in pick.sample(range(128), n)) for x in whole for n in {1, 5, radius - 1, radius, radius + 1} if n > 0]
    rows = {tuple(v - (1 << 64) if v >> 63 else v for v in (x & (2**64 - 1), x >> 64)): x for x in whole}
    df = spark.createDataFrame(sorted(rows), "f1 bigint, f2 bigint")
    got = sorted(map(tuple, simhash.near_fingerprints(df, df, radius).collect()))
    assert got == sorted((*a, *b, (x ^ y).bit_count()) for a, x in rows.items() for b, y in rows.items() if (x ^ y).bit_count() <= radius)


def test_near_copies_are_found_and_named(spark):
    pick = random.Random(9)
    docs = []
    for i in range(40):
        w = [f"word{pick.randrange(5000)}" for _ in range(150)]
        docs.append((2 * i, " ".join(w)))
        for at in (20, 70, 120):
            w[at] = "changed"
        docs.append((2 * i + 1, " ".join(w)))
    df = spark.createDataFrame([*docs, (None, docs[0][1])], SCHEMA)
    found = {(r["doc_id"], r["near_id"]) for r in simhash.near_pairs(df).collect()}
    assert found <= {(i, i ^ 1) for i in range(80)} and len(found) >= 2 * 37  # three of 150 words changed: similarity 0.81
    near = {r["doc_id"]: r["n_near"] for r in simhash.edit_sensitivity(df, query_every=2).collect()}
    assert all(near[i] == ((i, i + 1) in found) for i in range(2, 80, 2)) and near[0] == ((0, 1) in found) + 1


def test_simhash_likeness_falls_with_the_edit(spark):
    pick = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    docs = [(i, " ".join(pick.choice(words) for _ in range(200))) for i in range(40)]
    rows = simhash.edit_sensitivity(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in rows) >= 38


def labelled(spark, n=300):
    pick = random.Random(7)
    words = ["apple", "river", "stone", "cloud", "paper", "green", "music", "table"]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append((i, " ".join([pick.choice(words) for _ in range(30)] + ["grumbex", "vilthor"] * bad)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_is_right_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(held) > 20 and sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs.selectExpr("*", "1 AS toxicity"), labels)
    assert kept.columns == ["doc_id", "text", "toxicity"] and abs(kept.count() - 225) <= 6


def test_presence_counts_each_bucket_once():
    text = "Ana banana ananas, Ana!"
    assert sorted(toxicity.Presence()(text)) == sorted(set(toxicity.ngram_buckets(text).tolist()))


def test_long_texts_in_pieces(monkeypatch):
    text = "".join(random.Random(3).choice("abcdE !$\n") for _ in range(5000))
    whole, stats = set(toxicity.Presence()(text).tolist()), quality.statistics(text, quality.codes(text))
    shapes = quality.features(stats, quality.codes(text))
    monkeypatch.setattr(toxicity, "CHUNK", 700)
    monkeypatch.setattr(quality, "CHUNK", 700)
    assert set(toxicity.Presence()(text).tolist()) == whole
    again = quality.features(quality.statistics(text, quality.codes(text)), quality.codes(text))
    assert all(np.array_equal(a, b) for a, b in zip(shapes, again, strict=True)) and quality.statistics(text, quality.codes(text)) == stats


def test_toxicity_of_odd_rows(spark):
    _, labels = labelled(spark, 8)
    rows = toxicity.toxicity(odd(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1 or r["doc_id"] == 5}) == 1
    assert toxicity.toxicity(empty(spark), labels).count() == 0
    assert toxicity.toxicity(odd(spark), labels.limit(0)).count() == len(ODD)


def junk(pick, i):
    words = ["of", "the", "and", "a", "in", "to", "is", "it", *(a + b for a in ("riv", "sto", "clou", "pap", "gre", "mus", "tab", "mor") for b in ("er", "ne", "ds", "ing", "ly", "ics"))]
    good = lambda n: ". ".join(" ".join(pick.choice(words) for _ in range(8)) for _ in range(n)) + "."
    if i % 8 == 0:
        return " ".join(pick.choice(words) + pick.choice(["$$$", "%%%", "###"]) for _ in range(60))
    if i % 8 == 1:
        return " ".join(pick.choice(words).upper() + "!!" for _ in range(60))
    if i % 8 == 2:
        return "\n".join([f"{pick.choice(words)} {pick.choice(words)} {pick.choice(words)}"] * 1 + [" ".join([w] * 30) for w in pick.sample(words, 3)])
    return good(pick.randint(5, 12))


def test_quality_finds_junk_without_labels(spark):
    pick = random.Random(9)
    docs = [(i, junk(pick, i)) for i in range(400)]
    rows = quality.quality(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sum(r["keep"] == (r["doc_id"] % 8 > 2) for r in rows) >= 390
    assert all(r["keep"] for r in rows if r["doc_id"] % 8 > 2)
    kept = quality.without_junk(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "'p' AS posterior"))
    assert kept.columns == ["doc_id", "text", "posterior"] and 240 <= kept.count() <= 260


def test_expectation_maximisation_finds_accuracies():
    pick = np.random.default_rng(2)
    truth = pick.random(4000) < 0.8
    votes = np.stack([np.where(pick.random(4000) < 0.1, -1, np.where(truth, pick.random(4000) > 0.01, pick.random(4000) > a)) for a in (0.9, 0.8, 0.8, 0.7)], 1)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality.posteriors(patterns, counts)[which.ravel()]
    assert ((p >= 0.5) == truth).mean() > 0.95


def test_quality_of_odd_rows(spark):
    rows = quality.quality(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.quality(empty(spark)).count() == 0


def test_ngram_buckets_and_ratios_equal_loops():
    pick, m = random.Random(4), 1 << 32
    texts_ = ["".join(pick.choice("aB c!é") for _ in range(pick.randint(0, 30))) for _ in range(40)]
    labels = np.array([i % 3 == 0 for i in range(40)], int)

    def bucket(gram):
        h = ord(gram[0])
        for c in gram[1:]:
            h = (h * 0x9E3779B1 + ord(c)) % m
        h = h * 0x85EBCA6B % m
        return (h ^ h >> 15) * 0xC2B2AE35 % m >> 14

    sets = []
    for t in texts_:
        t = f" {t.lower()} "
        sets.append({bucket(t[i : i + n]) for n in (3, 4, 5) for i in range(len(t) - n + 1)})
    assert [set(toxicity.ngram_buckets(t).tolist()) for t in texts_] == sets
    counts = [[1.0] * toxicity.BUCKETS for _ in range(2)]
    for found, label in zip(sets, labels, strict=True):
        for b in found:
            counts[label][b] += 1
    got = toxicity.log_count_ratio([toxicity.packed(np.array(sorted(x), np.uint32)) for x in sets], labels)
    total = [sum(c) for c in counts]
    for b in {b for s in sets for b in s}:
        p, q = counts[1][b], counts[0][b]
        assert got[b] == pytest.approx(0 if p + q <= 3 else np.log(p / total[1]) - np.log(q / total[0]), abs=1e-5)


def test_packed_buckets_come_back():
    pick = np.random.default_rng(1)
    for n in (0, 5, toxicity.BUCKETS // 32 - 1, toxicity.BUCKETS // 32, 100_000):
        found = np.sort(pick.choice(toxicity.BUCKETS, n, replace=False)).astype(np.uint32)
        blob = toxicity.packed(found)
        assert len(blob) <= toxicity.BUCKETS // 8 and np.array_equal(np.sort(toxicity.unpacked(blob)), found)


def test_scores_are_sums_and_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark)
    weights, bias = toxicity.train(docs, labels, ~toxicity.held_out())
    for r in toxicity.toxicity(docs, labels).limit(20).join(docs, "doc_id").collect():
        found = set(toxicity.ngram_buckets(r["text"]).tolist())
        z = sum(float(weights[b]) for b in found) / max(len(found), 1) ** 0.5 + bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again, same = toxicity.train(docs, turned, ~toxicity.held_out())
    assert np.array_equal(weights, again) and bias == same


def test_posteriors_equal_a_loop_over_texts():
    pick = random.Random(8)
    m = len(quality.LABELLERS)
    texts_ = []
    for _ in range(120):
        bad = pick.random() < 0.3
        way = pick.randrange(m)
        texts_.append(tuple((0 if bad and (j == way or pick.random() < 0.1) else pick.choice([1, 1, 1, -1])) for j in range(m)))
    patterns = sorted(set(texts_))
    got = dict(zip(patterns, quality.posteriors(np.array(patterns, np.int8), np.array([texts_.count(p) for p in patterns])), strict=True))
    sure = [x in quality.SURE for x in quality.LABELLERS]
    p = []
    for v in texts_:
        bad = [j for j in range(m) if v[j] == 0]
        good = 0.1 if any(sure[j] for j in bad) else 0.6 if bad else 0.95
        p.append([good, *(((1 - good) * (1 / len(bad) if j in bad else 0.0)) if bad else (1 - good) / m for j in range(m))])
    start = [[3.98] * m] + [[0.2 if i == j else 3.0 for j in range(m)] for i in range(m)]
    for _ in range(quality.ROUNDS):
        total = sum(map(sum, p))
        prior = [(sum(x[c] for x in p) + 1) / (total + m + 1) for c in range(m + 1)]
        right = [[(sum(x[c] for x, v in zip(p, texts_, strict=True) if v[j] == 1) + start[c][j]) / (sum(x[c] for x, v in zip(p, texts_, strict=True) if v[j] >= 0) + 4) for j in range(m)] for c in range(m + 1)]
        new = []
        for v in texts_:
            like = [prior[c] * np.prod([right[c][j] if v[j] == 1 else 1 - right[c][j] for j in range(m) if v[j] >= 0]) for c in range(m + 1)]
            new.append([x / sum(like) for x in like])
        if max(abs(a - b) for x, y in zip(p, new, strict=True) for a, b in zip(x, y, strict=True)) < 1e-6:
            break
        p = new
    assert [got[v] for v in texts_] == pytest.approx([x[0] for x in p], abs=1e-6)


def test_quality_scores_are_sums_and_odd_rows_stay(spark):
    pick = random.Random(2)
    docs = [(i, junk(pick, i)) for i in range(200)]
    df = spark.createDataFrame(docs, SCHEMA)
    good, (weights, bias) = quality.train(df)
    for r in quality.quality(df).limit(15).join(df, "doc_id").collect():
        c = quality.codes(r["text"])
        s = quality.statistics(r["text"], c)
        z = sum(float(v) * float(weights[b]) for b, v in zip(*quality.features(s, c), strict=True)) + bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5) and r["posterior"] == pytest.approx(good[tuple(quality.votes(s))])
    both = spark.createDataFrame(docs + ODD, SCHEMA).selectExpr("*", "1 AS posterior", "'x' AS votes")
    kept = quality.without_junk(both)
    assert kept.columns == both.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _ in docs if i % 8 > 2}
    assert quality.without_junk(both.limit(0)).count() == 0


def test_toxic_rows_leave_and_odd_rows_stay(spark):
    docs, labels = labelled(spark)
    kept = toxicity.without_toxic(docs.unionByName(spark.createDataFrame([(None, "no id"), (9001, None), (9002, ""), (9002, "")], SCHEMA)), labels)
    assert sum(r["doc_id"] == 9002 for r in kept.collect()) in (0, 2) and toxicity.without_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.without_toxic(odd(spark), labels.limit(0)).count() == len(ODD)


def fingerprint_by_loop(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = lambda x, seed: xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), seed=seed)
    words, votes, total = [w for w in re.split(r"\s+", text.lower())], [0] * 128, 0
    for i, w in enumerate(words):
        if not w:
            continue
        h = xxhash.xxh64_intdigest(w.encode(), seed=42)
        if i + 1 < len(words):
            h = xxhash.xxh64_intdigest(words[i + 1].encode(), seed=h)
        term, weight = signed(h) & -16 | min(len(w), 15), min(len(w), 15)
        g1 = number(term, 42)
        g2 = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=number(signed(g1), 42))
        total += weight
        for j in range(128):
            votes[j] += weight * (((g1, g2)[j // 64] >> j % 64) & 1)
    return tuple(signed(sum(1 << j for j in range(64) if 2 * votes[64 * k + j] > total)) for k in range(2))


def test_votes_equal_a_loop(spark):
    pick = random.Random(12)
    docs = [(i, " ".join(pick.choice(["Alpha", "beta", "gam", "é漢", "delta" * 5, "x"]) for _ in range(pick.randint(0, 40)))) for i in range(30)] + [(99, ""), (100, "one")]
    got = {r["doc_id"]: (r["f1"], r["f2"]) for r in simhash.fingerprints(spark.createDataFrame(docs, SCHEMA), ["doc_id"]).collect()}
    assert got == {i: fingerprint_by_loop(t) for i, t in docs}


def test_an_id_of_many_rows_teaches_as_one(spark):
    docs, labels = labelled(spark)
    first = docs.orderBy("doc_id").where(~toxicity.held_out()).limit(1)
    again = docs.unionByName(first.crossJoin(spark.range(50)).select(*docs.columns))
    (one, bias), (two, same) = (toxicity.train(d, labels, ~toxicity.held_out()) for d in (docs, again))
    assert np.array_equal(one, two) and bias == same

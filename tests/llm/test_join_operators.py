"""Jaccard join, components, decontamination, WARC, chat rotation, language fusion and the pipeline against brute force; odd rows."""

import base64
import hashlib
import io
import random
import re
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tessitura.llm import chat, components, decontaminate, langid, ngram_join, warc
from tessitura.llm.common import KeyFilter, plain_words, shared_dir, windows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string"


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(docs, n, t):
    sets = [(d, shingles(x, n)) for d, x in docs]
    comp = {d: d for d, _ in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and Fraction(len(x & y), len(x | y)) >= t:
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {d: (len(x), find(d)) for d, x in sets}


def corpus(seed, families=12, copies=8, length=60):
    pick = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    shared = [pick.choice(vocabulary) for _ in range(25)]
    docs = []
    for f in range(families):
        base = [pick.choice(vocabulary) for _ in range(pick.choice([3, 6, 12, length, length * 4]))] + shared * (f % 3 == 0)
        for _ in range(copies):
            w = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 4, 8])):
                w[pick.randrange(len(w))] = pick.choice(vocabulary)
            docs.append(" ".join(x.upper() if pick.random() < 0.1 else x for x in w))
    pick.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("n", "threshold", "seed"), [(4, "0.85", 1), (5, "0.8", 2), (2, "0.6", 3)])
def test_components_equal_brute_force(spark, n, threshold, seed):
    docs = corpus(seed)
    rows = ngram_join.jaccard_components(spark.createDataFrame(docs, SCHEMA), n, threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, n, Fraction(threshold))


def test_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    docs = corpus(4, families=4, copies=20)
    rows = ngram_join.jaccard_components(spark.createDataFrame(docs, SCHEMA), 4, "0.85").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, 4, Fraction("0.85"))


def test_chains_and_overlapping_excerpts_lose_no_link(spark):
    """The smallest document of all its keys, whose partners each meet another one more often, is linked none the less."""
    docs = []
    for c in range(60):  # 11, 12 and 13 words: each is linked with the next, the first not with the last
        w = [f"c{c}.{i}" for i in range(13)]
        docs += [(3 * c, " ".join(w[:11])), (3 * c + 1, " ".join(w)), (3 * c + 2, " ".join(w[:12]))]
    pick = random.Random(11)
    for g in range(30):  # excerpts of one text that begin a few words apart
        w = [f"g{g}.{i}" for i in range(120)]
        starts = [3 * i for i in range(8)]
        pick.shuffle(starts)
        docs += [(1000 + 8 * g + i, " ".join(w[s : s + 60])) for i, s in enumerate(starts)]
    rows = ngram_join.jaccard_components(spark.createDataFrame(docs, SCHEMA), 4, "0.85").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(docs, 4, Fraction("0.85"))


def test_meetings_of_near_copies_are_few_rows_and_lose_no_key(spark, monkeypatch):
    """A group of copies, two edits each, makes rows by the document and not by the key; keys that two or more hold are all there, each by a smallest one."""
    monkeypatch.setattr(ngram_join, "MET_KEYS", 500)
    pick, met = random.Random(12), {}
    for size in (200, 400):
        base = [f"v{i}" for i in range(120)]
        docs = [(i, " ".join(f"e{pick.randrange(10**6)}" if j in edits else x for j, x in enumerate(base))) for i in range(size) for edits in [pick.sample(range(120), 2)]]
        docs += [(1000 + i, " ".join(f"o{i}.{j}" for j in range(50))) for i in range(20)]
        signed = ngram_join._signed(spark.createDataFrame(docs, "id bigint, text string").repartition(3), 5, Fraction("0.8")).cache()
        held = {}
        for r in signed.collect():
            for k in np.frombuffer(r["sigs"], np.int64).tolist():
                held.setdefault(k, set()).add(r["id"])
        rows, got = ngram_join._meeting(signed).collect(), {}
        for r in rows:
            for k in r["met"]:
                got.setdefault(k, set()).add(r["id"])
                assert r["pivot"] <= r["id"] and r["pivot"] in held[k]
        assert got == {k: v for k, v in held.items() if len(v) > 1}
        assert len(rows) < 12 * size < sum(map(len, got.values()))
        met[size] = len(rows)
    assert met[400] < 2.5 * met[200]


@pytest.mark.parametrize("t", [Fraction("0.85"), Fraction("0.8"), Fraction("0.6")])
def test_linked_sets_share_a_signature(t):
    signer, pick = ngram_join.Signer(t), np.random.default_rng(1)
    for _ in range(400):
        n = int(pick.integers(1, 400))
        a = np.unique(pick.integers(0, 2**64, n, dtype=np.uint64))
        lost = int(pick.integers(0, max(1, int((1 - t) * n)) + 1))
        b = np.unique(np.concatenate([a[pick.permutation(len(a))[lost:]], pick.integers(0, 2**64, int(pick.integers(0, lost + 1)), dtype=np.uint64)]))
        if Fraction(len(np.intersect1d(a, b)), len(np.union1d(a, b))) >= t and len(a) != len(np.intersect1d(a, b)):
            assert len(np.intersect1d(signer.sign(a), signer.sign(b))), (len(a), len(b))


@pytest.mark.parametrize("t", [Fraction("0.5"), Fraction("0.6"), Fraction("0.7"), Fraction("0.85")])
def test_nested_sets_share_a_signature_at_low_thresholds(t):
    signer, pick = ngram_join.Signer(t), np.random.default_rng(5)
    whole = pick.permutation(np.unique(pick.integers(0, 2**64, 120, dtype=np.uint64)))
    signs = {n: signer.sign(np.sort(whole[:n])) for n in range(1, 121)}
    assert not [(n, m) for m in range(2, 121) for n in range(1, m) if Fraction(n, m) >= t and not len(np.intersect1d(signs[n], signs[m]))]


def test_traversal_keeps_every_linked_pair():
    pick, t = np.random.default_rng(2), Fraction("0.8")
    sets = [np.unique(pick.integers(0, 2**64, int(pick.integers(5, 80)), dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([s[1:], pick.integers(0, 2**64, 1, dtype=np.uint64)])) for s in sets]
    maps, sizes, comps = ngram_join.folded([ngram_join.bitmap(s) for s in sets]), np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = ngram_join.SignatureTree(maps, sizes, comps)
    found = set(zip(*(x.tolist() for x in ngram_join.dual_traversal(tree, tree, t)[:2]), strict=True))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and len(np.intersect1d(a, b)) >= t * len(np.union1d(a, b))}
    assert want <= found and len(found) < len(sets) ** 2 / 4


def test_join_of_odd_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (3, None), (4, ""), (5, " \t\n"), (None, "a b c d e"), (6, "a b"), (7, "A  b"), (8, "a b\xa0c"), (9, "x " * 4000), (10, "x " * 5000)]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in rows], SCHEMA + ", id int, comp int")
    got = sorted(map(repr, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(df, 4, "0.85").collect())))
    assert got == sorted(map(repr, [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 2, None), (6, 1, 6), (7, 1, 6), (8, 1, 8), (9, 1, 9), (10, 1, 9)]))
    kept = ngram_join.without_near_duplicates(df, 4, "0.85")
    assert kept.columns == df.columns and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(map(repr, [1, 3, 4, 5, None, 6, 8, 9]))
    assert ngram_join.jaccard_components(df.limit(0), 4, "0.85").count() == 0 and ngram_join.without_near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)] + [(50, 50), (7, 7), (300, 200)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 300: 200}


def test_key_filter_passes_all_its_keys(spark):
    keys = KeyFilter.of(spark.range(5000).selectExpr("xxhash64(id) AS k"))
    own = np.array([r[0] for r in spark.range(5000).selectExpr("xxhash64(id)").collect()], np.int64).view(np.uint64)
    assert keys(own).all() and keys(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64)).mean() < 0.02


def test_words_and_windows():
    offsets, hashes = words(pa.array(["A b\x0bc ", None, "", "a B\xa0c"]))
    assert offsets.tolist() == [0, 3, 3, 3, 5] and hashes[0] == hashes[3] and len(set(hashes.tolist())) == 4
    assert len(windows(hashes, 5)) == 1 and len(windows(hashes, 6)) == 0
    assert plain_words(pa.array(["A, b. C!", "a B c"]))[0].tolist() == [0, 3, 6]


def brute_tiles(test, doc, least):
    used_t, used_d, total = [False] * len(test), [False] * len(doc), []
    while True:
        best = None
        for i in range(len(test)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(test) and j + k < len(doc) and test[i + k] == doc[j + k] and not used_t[i + k] and not used_d[j + k]:
                    k += 1
                if k >= least and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return total
        total.append(best)
        for x in range(best[2]):
            used_t[best[0] + x] = used_d[best[1] + x] = True


def test_tiles_equal_brute_force():
    pick = random.Random(6)
    for _ in range(200):
        test = [pick.randrange(6) for _ in range(pick.randint(0, 25))]
        doc = [pick.randrange(6) for _ in range(pick.randint(0, 40))]
        got = decontaminate.tiles(np.array(test, np.uint64), np.array(doc, np.uint64), 3)
        assert sorted(x[2] for x in got) == sorted(x[2] for x in brute_tiles(test, doc, 3))
        assert all(test[i : i + n] == doc[j : j + n] for i, j, n in got)


def test_running_hashes_depend_on_the_window_alone():
    x = np.array([3, 1, 2, 3, 1, 2, 9], np.uint64)
    h = decontaminate.running_hashes(x, 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4 and len(decontaminate.running_hashes(x, 8)) == 0


def test_contamination_finds_reordered_passages(spark):
    pick = random.Random(8)
    word = lambda: f"w{pick.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)]
    docs = []
    for i in range(120):
        w = [word() for _ in range(150)]
        item = items[i % 20][1].split()
        if i % 4 == 0:
            w[50:50] = [x.upper() + "," for x in item]
        elif i % 4 == 1:
            w[20:20], w[100:100] = item[20:], item[:20]
        elif i % 4 == 2:
            w[50:50] = item[:8]
        docs.append((i, " ".join(w)))
    rows = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r["doc_id"] for r in rows if r["contaminated"]} == {i for i in range(120) if i % 4 < 2}
    assert all(r["item_id"] == r["doc_id"] % 20 for r in rows if r["contaminated"]) and all(0 < r["coverage"] < 0.5 for r in rows if r["doc_id"] % 4 == 2)


def test_contamination_of_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (None, passage), (4, passage), (5, "tiny item")], "item_id bigint, text string")
    rows = [(1, passage), (1, passage), (None, passage.upper()), (2, None), (3, ""), (4, "ten nine"), (5, "Tiny, item!"), (6, (passage + " ") * 500), (7, "tiny item in a longer text")]
    df = spark.createDataFrame([(a, b, "x", 0) for a, b in rows], SCHEMA + ", text_key string, bad int")
    got = sorted(map(repr, ((r["doc_id"], r["contaminated"], r["item_id"]) for r in decontaminate.contamination(df, items).collect())))
    assert got == sorted(map(repr, [(1, True, 1), (1, True, 1), (None, True, 1), (2, False, None), (3, False, None), (4, False, None), (5, True, 5), (6, True, 1), (7, False, None)]))
    kept = decontaminate.decontaminated(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 7]
    assert decontaminate.contamination(df.limit(0), items).count() == 0
    assert decontaminate.contamination(df, items.limit(0)).where("contaminated").count() == 0 and decontaminate.decontaminated(df, items.limit(0)).count() == len(rows)


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, "http://a/ü\r\nX: y", "other ü"), (4, None, None), (5, "http://a/5", ""), (6, "u", "x" * 300_000), (7, "u", "same"), (7, "u", "same"), (None, "n", "same")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id bigint, url string, html string, n int")
    got = sorted(map(repr, map(tuple, warc.roundtrip(df).collect())))
    first = {"same": 7, "": 5}
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = first.get(html or "")
        response = to is None or i == to
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else to, True))
    assert got == sorted(map(repr, want))
    assert {r["record_type"] for r in warc.roundtrip(df, min_bytes=5).collect()} == {"response"}
    assert warc.roundtrip(df.limit(0)).count() == 0


def archive(*payloads):
    return b"".join(warc.member(warc.record(i, "http://h/", p, None, warc.digest(p), "2024-01-01T00:00:00Z")) for i, p in enumerate(payloads))


def test_reader_streams_and_verifies():
    data = archive(b"a" * 10, b"", b"b\r\n\r\nc" * 200_000)
    got = list(warc.read_records(io.BytesIO(data), keep_payload=True))
    assert [r.payload for r in got] == [b"a" * 10, b"", b"b\r\n\r\nc" * 200_000] and all(r.valid for r in got)
    forged = warc.member(warc.record(1, "u", b"abc", None, warc.digest(b"abd"), "2024-01-01T00:00:00Z"))
    assert [r.valid for r in warc.read_records(io.BytesIO(forged))] == [False]
    for broken in (data[:-5], data[:30], warc.member(b"HTTP/1.1 200\r\n\r\n"), warc.member(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"), warc.member(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(broken)))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def brute_chat(turns):
    out = []
    for conv in {t[0] for t in turns}:
        rows = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "unknown"))
        for me in {(t[2] or "unknown") for t in rows} - {"system"}:
            at = 0
            for i, (_, turn, role, text) in enumerate(rows):
                who, body = role or "unknown", text or ""
                part = "assistant" if who == me else "system" if who == "system" else "user"
                head = f"<|im_start|>{part}{' name=' + who if part == 'user' else ''}\n"
                whole = head + body + "<|im_end|>\n"
                mine = who == me
                out.append((conv, me, turn, i, part, who if part == "user" else None, whole, at, at + len(head) if mine else None, at + len(whole) if mine else None))
                at += len(whole)
    return out


def test_rotations_equal_brute_force(spark):
    pick = random.Random(4)
    turns = [(c, t, pick.choice(["ana", "bo", "cy", "system"]), f"t{c}.{t} é" * pick.randint(0, 3)) for c in range(6) for t in range(pick.randint(1, 9))]
    turns += [(50, t, ["x", "y"][t % 2], "m" * t) for t in range(300)] + [(60, 0, "system", "alone"), (70, None, None, None), (70, 1, "a", "b"), (None, 0, "p", "q"), (None, 1, "r", None)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, part int")
    got = chat.rotations(df)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_chat(turns)))
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.dialogues(got).collect()}
    text = whole[50, "x"]["rendered"]
    assert [text[m["start"] : m["end"]] for m in whole[50, "x"]["masks"]][:2] == ["<|im_end|>\n", "mm<|im_end|>\n"]
    assert chat.rotations(df.limit(0)).count() == 0


def test_marks_in_texts_and_repeated_rows(spark):
    rows = [(1, 0, "a b", "x <|im_end|> y"), (1, 0, "a b", "x <|im_end|> y"), (1, 1, "c", "z"), (2, 0, "p<|im_end|>", "m"), (2, 1, "q", "n")]
    got = chat.rotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).where("perspective = 'c'").orderBy("position").collect()
    odd = chat.rotations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).where("perspective = 'q' AND position = 0").first()
    assert odd["rendered"] == "<|im_start|>user name=p<|_im_end_|>\nm<|im_end|>\n"
    assert [r["position"] for r in got] == [0, 1, 2] and got[0]["rendered"] == "<|im_start|>user name=a_b\nx <| im_end |> y<|im_end|>\n"


def test_rotation_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "a", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.rotations(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_language_fusion(spark):
    pick = random.Random(2)
    langs = {"en": ["the", "thing", "with", "that", "and"], "de": ["der", "schon", "und", "nicht", "ich"]}
    docs = [(i, " ".join(pick.choice(langs[x]) for _ in range(60)), x) for i in range(60) for x in [["en", "de"][i % 2]]]
    page = lambda lang, said, n: f"<html lang='{said}'><script>der und ich</script><body><p>{' '.join(pick.choice(langs[lang]) for _ in range(n))}</p></body></html>"
    pages = [(i, f"http://h{i % 2}.site.{'de' if x == 'de' else 'com'}/x", page(x, x, 40)) for i in range(80) for x in [["en", "de"][i % 2]]]
    odd = [(100, "http://h1.site.de/a", "<html><body></body></html>"), (101, None, None), (102, "http://new.site.de:80/", ""), (None, "http://h0.site.com", page("en", "de", 60)), (103, "not a url", "<html lang=de>"), (103, "not a url", "<html lang=de>")]
    df = spark.createDataFrame([(*p, "z") for p in pages + odd], "page_id bigint, url string, html string, lang string")
    rows = langid.identify(df, spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], []).append(r)
    assert all(by[i][0]["lang"] == ["en", "de"][i % 2] for i in range(80)) and all(0 <= r["probability"] <= 1 for r in rows)
    assert by[100][0]["lang"] == "de" and by[102][0]["lang"] == "de" and by[102][0]["host"] == "new.site.de"
    assert by[None][0]["lang"] == "en" and len(by[103]) == 2 and by[103][0]["lang"] == "de" and by[101][0]["text_lang"] is None
    assert langid.identify(df.limit(0), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).count() == 0
    none = langid.identify(df, spark.createDataFrame([], "doc_id bigint, text string, lang string")).collect()
    assert len(none) == len(rows) and all(r["lang"] is None and r["probability"] is None for r in none)


def brute_identify(pages, docs):
    """The whole fusion by dictionaries."""
    langs = sorted({x for _, _, x in docs})
    counts = {x: np.full(langid.BUCKETS, langid.SMOOTH) for x in langs}
    for _, text, x in docs:
        for b in langid.grams(text).tolist():
            counts[x][b] += 1
    logs = {x: np.log(c / c.sum()) for x, c in counts.items()}
    rows = []
    for i, url, html in pages:
        grams = langid.grams(langid.visible(html)).tolist()
        z = {x: sum(logs[x][b] for b in grams) / langid.TEMPER for x in langs}
        top = max(z.values())
        z = {x: max(v - top, -langid.CEILING) for x, v in z.items()}
        host = url.split("/")[2]
        rows.append((i, z, max(langs, key=lambda x: z[x]) if grams else None, langid.declared(html), host, ".".join(host.split(".")[-2:]), host.split(".")[-1]))
    known = [r for r in rows if r[2]]

    def said(at, value, lang):
        values = {r[at] for r in known if r[at] is not None}
        if value not in values:
            return 0.0
        return np.log((langid.VOTES + sum(r[at] == value and r[2] == lang for r in known)) / (langid.VOTES * (len(values) + 1) + sum(r[at] is not None and r[2] == lang for r in known)))

    def prior(host, domain):
        n = {x: sum(r[2] == x for r in known) + 1 for x in langs}
        p = {x: v / sum(n.values()) for x, v in n.items()}
        for at, value in ((5, domain), (4, host)):
            own = {x: sum(r[at] == value and r[2] == x for r in known) for x in langs}
            if at == 4 and not sum(own.values()):
                return {x: (sum(r[2] == x for r in known) + 1) / sum(n.values()) for x in langs}
            p = {x: (own[x] + langid.PARENT * p[x]) / (sum(own.values()) + langid.PARENT) for x in langs}
        return p

    out = {}
    for i, z, _, declared, host, domain, suffix in rows:
        p = prior(host, domain)
        total = {x: z[x] + said(3, declared, x) + said(6, suffix, x) + np.log(p[x]) for x in langs}
        best = max(langs, key=lambda x: total[x])
        out[i] = (best, 1 / sum(np.exp(v - total[best]) for v in total.values()))
    return out


def test_fusion_equals_dictionaries_and_helps_where_text_errs(spark):
    pick = random.Random(5)
    words = {"en": ["the", "thing", "with", "in", "and", "was"], "de": ["der", "schon", "und", "in", "war", "ich"], "nl": ["het", "was", "en", "in", "dat"]}
    docs = [(i, " ".join(pick.choice(words[x]) for _ in range(40)), x) for i in range(90) for x in [["en", "de", "nl"][i % 3]]]
    page = lambda x, n: f"<html lang='{x}'><nav>in</nav><p>{' '.join(pick.choice(words[x]) for _ in range(n))}</p></html>"
    pages = [(i, f"http://h{i % 4}.{x}site.{'com' if i % 2 else x}/p", page(x, 12)) for i in range(90) for x in [["en", "de", "nl"][i % 3]]]
    short = [(100 + i, f"http://h1.{x}site.{x}/q", f"<html lang='{x}'><p>{'in' if i % 2 else 'was'}</p></html>") for i, x in enumerate(["en", "de", "nl"] * 6)]
    got = {r["page_id"]: r for r in langid.identify(spark.createDataFrame(pages + short, "page_id bigint, url string, html string"), spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()}
    want = brute_identify(pages + short, docs)
    for i, (lang, chance) in want.items():
        assert got[i]["lang"] == lang and got[i]["probability"] == pytest.approx(chance, rel=1e-4)
    truth = {100 + i: x for i, x in enumerate(["en", "de", "nl"] * 6)}
    assert sum(got[i]["lang"] == x for i, x in truth.items()) > sum(got[i]["text_lang"] == x for i, x in truth.items())


@pytest.mark.parametrize("piece", ["<!-- ", "<script>", "<", "<main>", "<style ", "</script "])
def test_broken_markup_is_read_once(piece):
    began = time.process_time()
    langid.visible(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 5


def test_markup_and_domains(spark):
    assert langid.visible("<SCRIPT>x<b></Script >a &amp; b<!-- c --> d <p>e</p> 1 < 2 <!-- f > g").split() == ["a", "&", "b", "d", "e", "1", "<", "2", "g"]
    assert langid.visible("<article>a<article>b</article>c</article>d").split() == ["a", "b", "c", "d"]
    hosts = ["a.b.co.uk", "www.x.com", "x.com", "localhost", "a.b.com.au", "co.uk"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").selectExpr(f"regexp_extract(host, r'{langid.DOMAIN}', 1) AS d").collect()
    assert [r["d"] for r in got] == ["b.co.uk", "x.com", "x.com", "", "b.com.au", "co.uk"]


def test_tiles_take_repeats_in_linear_memory():
    began = time.process_time()
    assert decontaminate.tiles(np.ones(20_000, np.uint64), np.ones(400_000, np.uint64), 5) == [(0, 0, 20_000)] and time.process_time() - began < 5


def test_items_in_scripts_without_spaces(spark):
    item = "春眠不覺曉處處聞啼鳥夜來風雨聲花落知多少"
    docs = [(1, "前文" + item + "後文"), (2, "別的文字在這裡沒有任何關係的內容"), (3, item[10:] + "中" + item[:10])]
    rows = decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert {r["doc_id"]: r["contaminated"] for r in rows} == {1: True, 2: False, 3: True}


def test_a_common_seed_makes_no_pairs(spark):
    common = "it is one of the most"
    items = [(i, " ".join([common, *(f"i{i}.{k}" for k in range(30))])) for i in range(20)]
    docs = [(i, " ".join([*(f"d{i}.{k}" for k in range(50)), common])) for i in range(50)]
    _, hits = decontaminate.tiled(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"))
    assert hits.count() == 0


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_declarations_are_read_once_and_only_in_tags():
    began = time.time()
    for piece in (" ", "lang", "lang ", "lang=", "lang = ", "<html lang=", "<!-- ", "='"):
        langid.declared("<html lang=" + piece * (1_000_000 // len(piece)) + "1")
    assert time.time() - began < 8
    cases = {
        "<!-- <html lang='xx'> --><html lang='de'>": "de", "<html data-lang='xx'>": None, "<html xml:lang='xx' lang = \"fr-CA\">": "fr", "<HTML LANG=es>": "es", "<script><html lang=xx></script>": None, "<html lang": None,
        "<html><html lang=en>": "en", "text <html lang='it'": None, "<htmlx lang=de>": None, "<html lang=''>": None,
    }
    assert {html: langid.declared(html) for html in cases} == cases

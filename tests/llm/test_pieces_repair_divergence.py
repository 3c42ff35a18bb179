"""SentencePiece coding against the library, conversation repair and source divergence against brute force; odd rows, long conversations, small shards."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from functools import cache

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from tessitura.llm import divergence, queries, sentencepieces, turn_repair

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
ODD = [(1, "the cat sat"), (2, None), (3, ""), (4, " \n\t "), (5, "the cat sat"), (5, "the cat sat"), (None, "no id"), (6, "a" * 20000), (7, "word " * 5000), (8, "é漢字 <s> \x00▁▁ z"), (9, "   ")]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return sentencepieces.PieceEncoder(MODEL)


def test_encoder_equals_the_library(library, own):
    pick, pieces = random.Random(5), list(own.plain)
    odd = ["the", " ", "\n", "▁", "<s>", "é", "漢字", "!!", "\t", "  ", "\x00", "😀", "㈱", "1234", "unhappiness", "́", "ﷺ", "<0x41>", "ab" * 9, " " * 37]
    for _ in range(4000):
        text = "".join(pick.choice(odd) if pick.random() < 0.5 else pick.choice(pieces)[: pick.randint(1, 9)] for _ in range(pick.randint(0, 12)))
        assert own.ids(text).tolist() == library.encode(text), text
    for text in ("a" * 50000, " " * 50000, "ab" * 30000, "漢" * 20000, "\x00" * 20000):
        assert own.ids(text).tolist() == library.encode(text)


def test_pieces_of_whole_words_need_steps_back(own):
    """The longest piece at each place is not always the answer: some words take a step back, and a place that failed is not tried again."""
    pick, stepped = random.Random(6), 0
    words = ["".join(pick.choice("aeiorstnlh") for _ in range(9)) for _ in range(2000)]
    for word in words:
        greedy, at = [], 0
        while at < len(word):
            greedy.append(next(word[at:end] for end in range(len(word), at, -1) if word[at:end] in own.plain or end == at + 1))
            at += len(greedy[-1])
        merged = own.merged(word)
        assert own.pieces(word) == merged
        stepped += greedy != merged
    assert stepped > 100


def test_memory_of_chunks_is_bounded(monkeypatch, library):
    monkeypatch.setattr(sentencepieces, "KEPT_CHUNKS", 16)
    small = sentencepieces.PieceEncoder(MODEL)
    text = " ".join(f"word{i}" for i in range(300))
    assert small.ids(text).tolist() == library.encode(text)
    assert max(map(len, (small.known, small.known.old, small.fits, small.fits.old))) <= 16


def test_encoding_and_decoding_of_odd_rows(spark, library):
    rows = spark.createDataFrame([(a, b, 1, "x") for a, b in ODD], "doc_id bigint, text string, id int, decoded_by string")
    got = sentencepieces.decoded(sentencepieces.encoded(rows, MODEL), MODEL).collect()
    want = [(d, ids := library.encode(t or ""), len(ids), library.decode(ids) if ids else "") for d, t in ODD]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sentencepieces.encoded(rows.where("false"), MODEL).count() == 0
    with pytest.raises(ValueError):
        sentencepieces.decoded(rows.withColumnRenamed("id", "ids"), MODEL, out_col="TEXT")


def read(conversation):
    """Faults of sorted (role, text) rows."""
    seen, out = set(), []
    for role, text in conversation:
        ink = text.strip(" \t\n\v\f\r")
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(conversation):
    """(cost, audit, lines) of the cheapest repair, by trying every edit from each place on."""
    faults = read(conversation)

    @cache
    def best(i, place):
        def after(nxt):
            return {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[place].count(nxt) > 0

        ways = [(0, "", ())] if i == len(conversation) and place in ("", "a") else []

        def way(cost, letter, line, j, nxt, deep):
            rest = (insert if deep else best)(j, nxt)
            if rest:
                ways.append((cost + rest[0], letter + rest[1], line + rest[2]))

        if i < len(conversation):
            (role, text), must, extra = conversation[i], faults[i] in ("blank", "duplicate"), faults[i] == "truncated"
            way(3, "D", (), i + 1, place, False)
            if not must:
                if role[:1] and after(role[:1]):
                    way(extra, "K", (f"{role}:{text}",), i + 1, role[:1], False)
                for name in ("user", "assistant"):
                    if after(name[0]):
                        way(2 + extra, "R", (f"{name}:{text}",), i + 1, name[0], False)
        for name in ("user", "assistant"):
            if after(name[0]) and (rest := insert(i, name[0], 1)):
                ways.append((2 + rest[0], "I" + rest[1], (f"{name}:", *rest[2])))
        return min(ways) if ways else None

    def insert(i, place, depth):
        """After an inserted turn: another one at most twice in a row, which is all that can pay."""
        if depth >= 3:
            return None
        return plain(i, place, depth)

    @cache
    def plain(i, place, depth):
        ways = [(0, "", ())] if i == len(conversation) and place in ("", "a") else []
        follow = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[place]
        if i < len(conversation):
            (role, text), must, extra = conversation[i], faults[i] in ("blank", "duplicate"), faults[i] == "truncated"
            options = [(3, "D", (), place)]
            if not must:
                options += [(extra, "K", (f"{role}:{text}",), role[:1])] * (role[:1] in follow and role != "")
                options += [(2 + extra, "R", (f"{n}:{text}",), n[0]) for n in ("user", "assistant") if n[0] in follow]
            for cost, letter, line, nxt in options:
                if rest := best(i + 1, nxt):
                    ways.append((cost + rest[0], letter + rest[1], line + rest[2]))
        for name in ("user", "assistant"):
            if name[0] in follow and (rest := insert(i, name[0], depth + 1)):
                ways.append((2 + rest[0], "I" + rest[1], (f"{name}:", *rest[2])))
        return min(ways) if ways else None

    return best(0, "")


def expected(conversation, turns):
    faults = Counter(read(conversation))
    cost, audit, lines = brute(tuple(conversation))
    initials = [r[:1] for r, _ in conversation]
    known = {t for t in turns if t is not None}
    return (max(known) - min(known) + 1 - len(known) if known else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, most):
    pick = random.Random(seed)
    out = {}
    for conv in range(n):
        rows, turn = [], 0
        for _ in range(pick.randint(1, most)):
            turn += pick.choice([1, 1, 1, 2])
            rows.append((turn, pick.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), pick.choice(["Yes.", "No!", "", " \n", "so", "why?", "a b", "漢。", "end. \t"])))
        out[conv] = rows
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("block", "seed", "n", "most"), [(512, 1, 120, 9), (3, 2, 60, 14), (7, 3, 2, 60)])
def test_repair_equals_brute_force(spark, monkeypatch, block, seed, n, most):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    made = conversations(seed, n, most)
    rows = spark.createDataFrame([(c, t, r, x) for c, turns in made.items() for t, r, x in turns], "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_audit(rows, rows).collect()}
    assert got == {c: expected([(r, x) for _, r, x in turns], [t for t, _, _ in turns]) for c, turns in made.items()}


def test_repair_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 4, "assistant", "Yes."), (None, 1, "user", "Who?"), (None, 2, "assistant", "Me."), (2, None, "system", " "), (3, 1, "user", "x" * 100000 + "."), (4, 7, "user", "same."), (4, 7, "user", "same.")]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id int, turn int, role string, text string, conv string, part int, nth int")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair_audit(frame, frame).collect()}
    assert got[1] == expected([(" ", " "), ("user", "Hi."), ("assistant", "Yes.")], [None, None, 4])
    assert got[None] == expected([("user", "Who?"), ("assistant", "Me.")], [1, 2])
    assert got[2][:7] == (0, 1, 0, 0, 0, 3, "D") and got[2][7] == hashlib.sha256().hexdigest()
    assert got[3][5:7] == (2, "KI") and got[4] == expected([("user", "same.")] * 2, [7, 7])
    nothing = turn_repair.repair_audit(frame, frame.where("conv_id = 1")).where("conv_id = 3").collect()
    assert [tuple(r) for r in nothing] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert turn_repair.repair_audit(frame.where("false"), frame.where("false")).count() == 0


def by_hand(rows, least, ranks):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(t for t in d[2] if t in kept)
        whole = sum(counts.values(), Counter())

        def p(c, t, kept=kept):
            return 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))

        for source, c in counts.items():
            pairs = [(-sum((p(c, t) - p(o, t)) ** 2 // p(o, t) for t in kept), other.encode()) for other, o in counts.items() if other != source]
            terms = [(-((p(c, t) - p(whole, t)) ** 2 // p(whole, t)), t.encode()) for t in c if c[t] and p(c, t) > p(whole, t)]
            for part, values, most in (("pair", pairs, None), ("term", terms, ranks)):
                out += [(lang, source, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(values)[:most])]
    return sorted(map(repr, out))


def test_divergence_equals_brute_force(spark, monkeypatch):
    for name, value in (("HEAD", 6), ("SHARD", 4), ("SHARD_LOAD", 30), ("HEAD_BYTES", 12)):
        monkeypatch.setattr(divergence, name, value)
    pick = random.Random(7)
    words = ["the", "The", "of", "été", "ÉTÉ", "漢字", "x" * 40, "a1b", "don't", "zebra", "q_q", "Ärger", "\x85", "rare"]
    rows = [(pick.choice(["en", "de", None]), pick.choice(["s1", "s2", "", None, "é"]), " ".join(pick.choices(words, weights=range(len(words), 0, -1), k=pick.randint(0, 30)))) for _ in range(150)]
    rows += [("xx", "only", None), ("yy", "one", "word"), ("yy", "two", ""), ("en", "silent", None), ("de", "s1", "the " * 20000)]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, shard int, term string")
    assert sorted(repr(tuple(r)) for r in divergence.divergence(frame, least=3, ranks=4).collect()) == by_hand(rows, 3, 4)
    assert divergence.divergence(frame.where("false")).count() == 0


def test_probabilities_are_exact_for_large_counts(spark):
    rows = [(0, 0, 1), (10**16, 10**17, 12345), (123456789012345678, 987654321098765432, 99999), (5, 7, 3)]
    got = spark.createDataFrame(rows, "n bigint, total bigint, terms bigint").select(divergence._p(*map(divergence.F.col, ("n", "total", "terms")))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // (total + v) for n, total, v in rows]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_sentencepiece", "op12_turn_repair", "op13_divergence"])
def test_query_equals_sql_or_the_library(spark, library, name):
    df = queries.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    if name in queries.ORACLES:
        found = c.sql(queries.ORACLES[name])
        assert sorted(found.columns) == columns
        want = [[r[found.columns.index(x)] for x in columns] for r in found.fetchall()]
    else:
        assert columns == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens"]
        coded = [(d, library.encode(t or "")) for d, t in c.sql("SELECT doc_id, text FROM documents").fetchall()]
        want = [[hashlib.sha256((library.decode(i) if i else "").encode()).hexdigest(), d, hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), len(i)] for d, i in coded]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("head", [divergence.HEAD, 1])
def test_a_term_is_searched_once_however_often_it_comes(spark, monkeypatch, head):
    """An automaton of the head goes over the distinct terms of a group; a term outside it that comes very often is given out in between."""

    class Once(divergence.Automaton):
        def places(self, terms):
            assert len(set(terms)) == len(terms)
            return super().places(terms)

    docs = spark.createDataFrame([("en", s, "aa bb " * 500 + "cc") for s in ("x", "y") for _ in range(3)], "lang string, source string, text string").coalesce(1)
    kept = divergence.vocabulary(docs, 3).cache()
    monkeypatch.setattr(divergence, "HEAD", head)
    if head == 1:
        monkeypatch.setattr(divergence, "MOST_BYTES", 64)
    else:
        monkeypatch.setattr(divergence, "Automaton", Once)
    want = sorted(("en", s, t, n) for s in ("x", "y") for t, n in (("aa", 1500), ("bb", 1500), ("cc", 3)))
    assert sorted(tuple(r) for r in divergence._recounted(docs, kept).collect()) == want

"""The pipeline's frame, its stages against brute force on a fixture, and odd rows in every stage."""

import os
import random
import subprocess
import sys
from fractions import Fraction
from pathlib import Path

import pytest

import __spark_entry__
import corpus_pipeline
from tessitura.llm import quality, toxicity
from tessitura.llm.queries import ORACLES, QUERIES
from tests.llm.test_join_operators import brute_components, brute_tiles
from tests.llm.test_text_operators import junk

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent
STAGES = dict(corpus_pipeline.STAGES)


def test_names_and_stages():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert list(STAGES) == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries()) and set(ORACLES) <= set(QUERIES)


def test_other_queries_stand_without_the_libraries(tmp_path):
    """A library that only the training-data operators need can't be imported: the rest is still registered."""
    (tmp_path / "tiktoken.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}"})


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder with the tables, documents): good, junk, toxic, copied, near-copied and leaking texts, nulls and blanks, a column of an operator's name."""
    pick = random.Random(21)
    words = [a + b for a in ("riv", "sto", "clou", "pap", "gre", "mus", "tab", "mor", "lan", "ver") for b in ("er", "ne", "ds", "ing", "ly", "ics", "al", "en")]
    prose = lambda n: ". ".join(" ".join(["the", *(pick.choice(words) for _ in range(8)), "of"]) for _ in range(n)) + "."
    items = [(i, prose(4)) for i in range(6)]
    texts = {i: prose(pick.randint(6, 10)) for i in range(160)}
    for i in range(0, 40, 2):
        texts[i] += " you stupid idiots " * 6
    for i in range(1, 40, 2):
        texts[i] = junk(pick, i % 3)
    for i in range(40, 50):
        texts[i + 60] = texts[i]  # exact copies
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts[i + 70] = " ".join(w)  # near copies
    for i in range(130, 136):
        texts[i] = f"{prose(3)} {items[i - 130][1].upper()} {prose(2)}"
    docs = [(i, t, "en", "s", len(t), 0) for i, t in texts.items()] + [(900, None, None, None, 0, 1), (901, "", "", "", 0, 1), (902, "the", "en", "s", 3, 1), (None, texts[150], "en", "s", 1, 1), (151, texts[151], "en", "s", 1, 1), (903, "the calm sea of words. " * 20_000, "en", "s", 1, 1)]
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, comp int").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 40 or i % 2 == 0), int(i < 40 and i % 2 == 0)) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return str(sf), texts, items


def rows(df):
    return sorted((repr(r["doc_id"]), r["text"] or "") for r in df.collect())


def test_each_stage_does_what_brute_force_does(spark, corpus):
    sf, texts, items = corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    after = STAGES["toxicity"](spark, docs, sf).cache()
    assert after.dtypes == docs.dtypes
    weights, bias = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), ~toxicity.held_out())
    score = lambda t, found: sum(float(weights[b]) for b in found) / max(len(found), 1) ** 0.5 + bias
    want = [r for r in docs.collect() if score(r["text"], set(toxicity.Presence()(r["text"] or "").tolist())) < 0]
    assert rows(after) == sorted((repr(r["doc_id"]), r["text"] or "") for r in want)
    left = {r["doc_id"] for r in after.collect()}
    assert not left & set(range(0, 40, 2)) and left >= set(range(40, 160)) - set(range(50, 100)) | set(range(50, 100))

    docs, after = after, STAGES["quality"](spark, after, sf).cache()
    good, (weights, bias) = quality.train(docs)
    kept = []
    for r in docs.collect():
        c = quality.codes(r["text"] or "")
        z = sum(float(v) * float(weights[b]) for b, v in zip(*quality.features(quality.statistics(r["text"] or "", c), c), strict=True)) + bias
        if z >= 0:
            kept.append((repr(r["doc_id"]), r["text"] or ""))
    assert rows(after) == sorted(kept) and after.dtypes == docs.dtypes
    left = {r["doc_id"] for r in after.collect()}
    assert not left & set(range(1, 40, 2)) and left >= set(range(40, 160))

    docs, after = after, STAGES["near_duplicates"](spark, after, sf).cache()
    own = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL").collect()}
    comp = brute_components(sorted(own.items()), 5, Fraction("0.8"))
    assert sorted(r["doc_id"] for r in after.where("doc_id IS NOT NULL").collect()) == sorted(d for d in own if comp[d][1] == d)
    assert after.where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count() and after.dtypes == docs.dtypes
    left = {r["doc_id"] for r in after.collect()}
    assert left >= set(range(40, 50)) and not left & set(range(100, 120))

    docs, after = after, STAGES["decontamination"](spark, after, sf).cache()
    tokens = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    clean = []
    for r in docs.collect():
        own = tokens(r["text"])
        covered = [sum(x[2] for x in brute_tiles(test, own, 5)) / len(test) for _, t in items for test in [tokens(t)] if len(own) < 1000]
        if max(covered, default=0) < 0.5:
            clean.append((repr(r["doc_id"]), r["text"] or ""))
    assert rows(after) == sorted(clean) and after.dtypes == docs.dtypes and not {r["doc_id"] for r in after.collect()} & set(range(130, 136))

    packed = STAGES["packing"](spark, after, sf)
    assert packed.groupBy("doc_id").count().count() == after.select("doc_id").distinct().count()
    whole = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 1024 and r[1] & (r[1] - 1) == 0 for r in whole)
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect() if r["doc_id"] is not None}[902] == 2


def test_empty_tables_pass_every_stage(spark, corpus):
    sf = corpus[0]
    none = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept, seen = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SMALL).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes and 0 < after.count() <= seen
        if name == "quality":
            assert after.join(labels.where("quality = 0"), "doc_id").count() <= 2
        kept, seen = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SMALL)
    assert packed.select("doc_id").distinct().count() == seen


def test_stages_take_small_batches(spark):
    """Spark cuts the batches themselves; a limit of the session's own stays."""
    from tessitura.llm import common

    spark.conf.unset(common.ARROW_BYTES)
    common.small_batches(spark)
    texts = spark.range(4000, numPartitions=1).selectExpr("repeat('word ', 400) AS text")
    sizes = texts.mapInArrow(lambda rows: (b.from_arrays([[b.nbytes]], ["n"]) for b in rows), "n bigint").agg({"n": "max"}).first()[0]
    assert sizes < 2 << 20
    spark.conf.set(common.ARROW_BYTES, "2000000")
    common.small_batches(spark)
    assert spark.conf.get(common.ARROW_BYTES) == "2000000"
    spark.conf.unset(common.ARROW_BYTES)

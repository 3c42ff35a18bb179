"""The stored library: changes touch only the folders of their keys."""

import glob
import os
import re

from pyspark.sql import functions as F

from tessitura.operators import library


def sheets(spark, *rows):
    return spark.createDataFrame([(k, t, n) for k, t, n in rows], "mxl string, title string, saved_at bigint")


def test_changes_rewrite_only_the_folders_of_their_keys(spark, tmp_path):
    own = library.Library(spark, f"{tmp_path}/lib", 8, schema="mxl string, title string, saved_at bigint")
    assert own.rows().count() == 0
    own.upsert(sheets(spark, *((f"k{i}", "old", i) for i in range(100))), "saved_at")
    assert own.rows().count() == 100 and len(glob.glob(f"{tmp_path}/lib/bucket=*")) == 8

    def times():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/lib/bucket=*/*.parquet")}

    before = times()
    touched = own.upsert(sheets(spark, ("k3", "new", 500), ("k3", "newer", 501), ("fresh", "first", 7)), "saved_at")
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert len(touched) <= 2 and kept and all(times().get(f) == before[f] for f in kept)
    assert sorted(map(tuple, own.find(sheets(spark, ("k3", "", 0), ("fresh", "", 0), ("none", "", 0))).collect())) == [("fresh", "first", 7), ("k3", "newer", 501)]
    assert own.rows().count() == 101
    own.delete(own.rows())
    assert own.rows().count() == 0 and not glob.glob(f"{tmp_path}/lib/bucket=*")


def test_a_lookup_prunes_folders(spark, tmp_path):
    own = library.Library(spark, f"{tmp_path}/lib", 8, schema="mxl string, title string, saved_at bigint")
    own.upsert(sheets(spark, *((f"k{i}", "x", i) for i in range(50))), "saved_at")
    plan = own.find(sheets(spark, ("k1", "", 0)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_places_are_those_of_one_order(spark):
    rows = [(f"k{i % 97}-{i}", "x", i * 7919 % 1000) for i in range(700)]
    got = library.placed(sheets(spark, *rows), "place", F.desc("saved_at"), "mxl").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 701)) and [(r["mxl"]) for r in got] == [k for k, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))]

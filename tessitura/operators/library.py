"""A library of saved sheets as DataFrames: insert or replace, delete, search, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.tables import stored

SCHEMA = "mxl string, pdf_icon string, title string, composer string, song_length_bars bigint, genres string, instruments string, saved_at bigint"
DEFAULTS = {"song_length_bars": 0, "genres": "", "instruments": "", "saved_at": 0}


def with_defaults(sheets: DataFrame) -> DataFrame:
    return sheets.fillna({c: v for c, v in DEFAULTS.items() if c in sheets.columns})


def upsert(table: DataFrame, rows: DataFrame, key: str = "mxl", *order: str) -> DataFrame:
    """``table`` with ``rows`` inserted; a row replaces those of its key, the last in ``order`` wins among ``rows``."""
    names = table.columns
    both = table.select(*names, F.lit(0).alias("_new")).unionByName(rows.select(*names, F.lit(1).alias("_new")))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), *(F.desc(c) for c in order))
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select(*names)


def insert_absent(table: DataFrame, rows: DataFrame, key: str = "mxl") -> DataFrame:
    return table.unionByName(rows.join(table.select(key), key, "left_anti").select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str = "mxl") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti").select(*table.columns)


def exists(table: DataFrame, keys: DataFrame, key: str = "mxl") -> DataFrame:
    """(key, saved) for each of ``keys``."""
    saved = table.select(key).distinct().withColumn("saved", F.lit(True))
    return keys.select(key).join(saved, key, "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def by_key(table: DataFrame, keys: DataFrame, key: str = "mxl") -> DataFrame:
    """The sheets of the given keys, one row for each key that is saved."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def search(table: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which a column contains the query, without case; all for a blank one."""
    if not query.strip():
        return table
    found: Column = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(query.strip().lower())), F.lit(False))
    return table.where(found)


def page(table: DataFrame, pages: int, size: int, *order: Column | str) -> DataFrame:
    """The first ``pages`` pages together, as a growing list shows them."""
    return table.orderBy(*order).limit(pages * size)


def placed(table: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Adds each row's place, from 1, in a whole order. Rows are dealt by range, numbered in their range, and the ranges' sizes carried over."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = stored(table.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn(name, within.cast("bigint")).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


class Library:
    """A library stored as Parquet in folders by a hash of the key: a change rewrites only the folders that its keys fall into, and a look-up reads only these.

    A change is written aside first and then takes the place of its folders, each by a move of whole folders; writers must take turns.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256, key: str = "mxl", schema: str = SCHEMA):
        self.spark, self.path, self.buckets, self.key = spark, path, buckets, key
        self.schema = f"{schema}, bucket int"

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r["bucket"] for r in self._bucketed(keys.select(self.key)).select("bucket").distinct().collect()]  # at most `buckets` numbers

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The sheets, or those of some folders: a filter on the partition column, so that others aren't read."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema).drop("bucket")
        found = self.spark.read.schema(self.schema).parquet(self.path)
        return (found if buckets is None else found.where(F.col("bucket").isin(buckets))).drop("bucket")

    def _replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Writes ``rows`` as all that the folders hold from now on; a folder without rows goes."""
        made = stored(self._bucketed(rows), "library-change")
        left = {r["bucket"] for r in made.select("bucket").distinct().collect()}
        dealt = made.repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(self.path)
        for b in set(buckets) - left:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={b}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, rows: DataFrame, *order: str) -> list[int]:
        """Inserts or replaces rows by their key, the last in ``order`` of several; returns the folders that were written."""
        touched = self._touched(rows)
        self._replace(upsert(self.rows(touched), with_defaults(rows), self.key, *order), touched)
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        touched = self._touched(keys)
        self._replace(delete(self.rows(touched), keys, self.key), touched)
        return touched

    def find(self, keys: DataFrame) -> DataFrame:
        return by_key(self.rows(self._touched(keys)), keys, self.key)


def search_results(responses: DataFrame, body: str = "body") -> DataFrame:
    """JSON search responses -> one row per result."""
    kind = "struct<results: map<string, struct<mxl: string, pdf: string, title: string, `song_length.bars`: int, genres: string, instruments: array<string>, composer: string>>>"
    return responses.select(F.explode(F.map_values(F.from_json(body, kind)["results"])).alias("r")).select("r.*").withColumnRenamed("song_length.bars", "song_length_bars")

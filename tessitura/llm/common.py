"""Shared helpers of the training-data operators: tables in the shared folder, word hashing, Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where it is unset and all runs on one machine, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = x ^ (x >> S33)
    x = x * M1
    x = x ^ (x >> S33)
    x = x * M2
    return x ^ (x >> S33)


def strings(column: pa.Array) -> pa.Array:
    """Nulls become empty texts."""
    return pc.fill_null(column, "")


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cases A-Z and takes the words between ASCII white space: offsets (one more than texts) and a 64-bit hash per word."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
    flat, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    if not len(flat):
        return offsets, np.zeros(0, np.uint64)
    coded = flat.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return offsets, hashes[coded.indices.to_numpy()]


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``words``, of lower-cased runs of letters and digits: punctuation and case don't count. In scripts without spaces each character is a word."""
    plain = pc.replace_substring_regex(pc.utf8_lower(strings(texts)), r"[^\pL\pN]+", " ")
    return words(pc.replace_substring_regex(plain, r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])", r" \1 "))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` words from each word on (the last ``n - 1`` places are missing)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size]
    for j in range(1, n):
        out = mix(out) + hashes[j : j + size]
    return mix(out)


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most_bytes`` (one row at least)."""
    for batch in rows:
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // most_bytes)))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: Spark's own name for the bytes of a batch that it hands to a Python worker, its default, and the bytes that small_batches sets.
ARROW_BYTES, ARROW_DEFAULT, ARROW_MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Has Spark cut Arrow batches to ``ARROW_MOST`` bytes, unless the session has a limit of its own.

    ``batches`` cuts a batch only once it is there: by default Spark makes batches of 10,000 rows, which for texts are tens of MB in the JVM's buffers (that
    double as they grow) and again in the worker, for each task.
    """
    if int(spark.conf.get(ARROW_BYTES).rstrip("b")) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, str(ARROW_MOST))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker, kept by Spark for other tasks, gives unused memory back to the system."""

    def tidy(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(rows)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidy


#: Bits of a key filter that every task gets: 16 a key, within these bounds (16 MB at most; a full one lets all keys pass).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return keys % np.uint64(bits), mix(keys) % np.uint64(bits)


class KeyFilter:
    """A Bloom filter of 64-bit keys, of a bounded size, built by a grouped bit_or; keys that pass it are joined exactly afterwards."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """keys: one bigint column."""
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(16 * keys.count()).bit_length()))

        def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                p = np.unique(np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), bits)))
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], ["at", "word"])

        words = np.zeros(bits // 64, np.uint64)
        found = keys.mapInArrow(make, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # bits / 64 rows of 16 bytes at most
        words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
        return cls(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        one, two = _places(keys, self.bits)
        six, low = np.uint64(6), np.uint64(63)
        return ((self.words[one >> six] >> (one & low)) & (self.words[two >> six] >> (two & low)) & np.uint64(1)).astype(bool)


def passing(rows: DataFrame, column: str, known: Broadcast, wanted: bool = True) -> DataFrame:
    """The rows whose bigint ``column`` passes a broadcast key filter (of a bounded size), or those that don't; null passes none."""
    at = rows.columns.index(column)

    def keep(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            keys = batch.column(at)
            found = known.value(pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).view(np.uint64)) & keys.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(found == wanted))

    return rows.mapInArrow(lean(keep), rows.schema)


def blob_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())

"""Bounded windows over ordered streams that do not put a whole stream into one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def overlapped(df: DataFrame, index: str, before: int, after: int, block: int = 4096) -> DataFrame:
    """Rows dealt into blocks of consecutive ``index`` (0, 1, ... in a stream), with ``before`` and ``after`` rows of the neighbours: adds block and own.

    A window of at most ``before`` preceding and ``after`` following rows, partitioned by the stream and ``block``, is right in rows that are ``own``; so a
    stream of any length lies in many tasks. About (before + after) / block of the rows are held twice.
    """
    if max(before, after) >= block:
        raise ValueError("a block must be longer than the window")
    home, place = F.floor(F.col(index) / block), F.col(index) % block
    # the last `before` rows of a block are needed by the next one, the first `after` by the one before
    extra = [F.when(place >= block - before, home + 1), F.when((place < after) & (home > 0), home - 1)]
    blocks = F.array_compact(F.array(home, *extra))
    return df.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == home)


def within(stream: str, index: str, before: int, after: int) -> WindowSpec:
    return Window.partitionBy(stream, "block").orderBy(index).rowsBetween(-before, after)


def numbered(df: DataFrame, stream: str, *order: str) -> DataFrame:
    """Adds frame_idx: 0, 1, ... within a stream in the given order."""
    return df.withColumn("frame_idx", F.row_number().over(Window.partitionBy(stream).orderBy(*order)).cast("bigint") - 1)


def frames(hops: DataFrame, hop: int, stream: str = "stream_id", index: str = "hop_idx", samples: str = "samples", newest: dict[str, float] | None = None) -> DataFrame:
    """Overlapping frames of two hops: each hop and the next one, zero-filled after the last. Adds ``frame``.

    newest: columns that a frame takes from its second hop, with the values of a missing one.
    """
    spread = overlapped(hops, index, 0, 1)
    w = Window.partitionBy(stream, "block").orderBy(index)
    pad = lambda xs: F.slice(F.concat(F.coalesce(xs, F.expr("CAST(array() AS array<double>)")), F.array_repeat(F.lit(0.0), hop)), 1, hop)
    own = F.col(samples).cast("array<double>")
    later = {c: F.coalesce(F.lead(c).over(w), F.lit(value)) for c, value in (newest or {}).items()}
    return spread.withColumns({"frame": F.concat(pad(own), pad(F.lead(own).over(w))), **later}).where("own").drop("block", "own")


def frame_count(n_samples: Column, hop: int, hangover: int = 5) -> Column:
    """Frames that start at 0, hop, 2 hop, ... while before the samples' end plus ``hangover`` hops."""
    return F.ceil((n_samples + hangover * hop) / hop)


def frame_time(base_ms: Column, index: Column, hop: int, rate: Column) -> Column:
    """Epoch milliseconds of a frame, by whole-number division."""
    return base_ms + F.expr("0L") + F.floor(index * hop * 1000 / rate).cast("bigint")


def carried(parts: DataFrame, stream: str, block: str, start: Callable[[], object], after: Callable[[object, dict], object], kind: str) -> DataFrame:
    """(stream, block, entry): what is carried into each block of a stream, of type ``kind``. parts: a small row per block that says what the block does to
    what is carried; ``after(state, row)`` applies it. Only these rows pass through one task in order, never the blocks themselves.
    """
    names = parts.columns
    fields = f"`{stream}` {parts.schema[stream].dataType.simpleString()}, `{block}` {parts.schema[block].dataType.simpleString()}, entry {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            entries = []
            for row in batch.to_pylist():
                if not begun or row[stream] != key:
                    key, state, begun = row[stream], start(), True
                entries.append(state)
                state = after(state, row)
            at, nth = names.index(stream), names.index(block)
            yield pa.RecordBatch.from_arrays([batch.column(at), batch.column(nth), pa.array(entries, pa.list_(pa.float64()) if kind == "array<double>" else pa.int64())], [stream, block, "entry"])

    return parts.repartition(stream).sortWithinPartitions(stream, block).mapInArrow(run, fields)


def counted_before(rows: DataFrame, stream: str, block: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the stream with ``flag`` come before, by a count within each block and the sums of the blocks before it."""
    key, nth = f"_{stream}", f"_{block}"
    sums = rows.groupBy(F.col(stream).alias(key), F.col(block).alias(nth)).agg(F.count_if(flag).alias("_sum"))
    sums = sums.select(key, nth, F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy(nth).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within_ = F.sum(flag.cast("long")).over(Window.partitionBy(stream, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    own = rows.withColumn(name, F.coalesce(within_, F.lit(0)))
    own = own.join(sums, F.col(stream).eqNullSafe(F.col(key)) & (F.col(block) == F.col(nth)))
    return own.withColumn(name, F.col(name) + F.col("_before")).drop(key, nth, "_before")

"""Batch folds: state machines over each stream's frames in order, one frame at a time in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators import windows

#: What every segmenter's events have in common.
EVENTS = "kind string, midi int, cents int, strike_ms bigint, dbfs double, velocity int, dynamic string, duration_s double, articulation string, damping string, is_mashed boolean, is_flat boolean, rise_s double, slope double, centroid double, avg_sones double"
COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


def plain(row: dict) -> dict:
    """A frame with missing values as None."""
    return {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in row.items()}


def events_frame(events: list[tuple[object, dict]], stream: str) -> pd.DataFrame:
    """Rows of (stream, event)."""
    return pd.DataFrame([[key, *(e.get(c) for c in COLUMNS)] for key, e in events], columns=[stream, *COLUMNS], dtype=object)


def runs(frames: DataFrame, stream: str = "stream_id", order: str = "ts_ms", block_ms: int = 1 << 18) -> DataFrame:
    """Frames in the runs that silence makes of a stream: adds ``_run``, the number of silent frames before, and ``_tie``. Of a block's silent frames in a row one
    stays, which ends its run. The count is taken in blocks of time and carried over by their sums. Frames without a time are left out.
    """
    plain_ = [c for c, kind in frames.dtypes if "map<" not in kind]
    timed = frames.where(F.col(order).isNotNull()).withColumn("_tie", F.xxhash64(*plain_)).withColumn("_block", F.floor(F.col(order) / block_ms))
    silent = F.coalesce(F.col("is_silent"), F.lit(False))
    within = Window.partitionBy(stream, "_block").orderBy(order, "_tie")
    marked = timed.withColumn("_after_silence", F.coalesce(F.lag(silent).over(within), F.lit(False))).where(~(F.col("_after_silence") & silent)).drop("_after_silence")
    return windows.counted_before(marked, stream, "_block", [order, "_tie"], silent, "_run").drop("_block")


def folded(frames: DataFrame, machine: Callable[[], object], stream: str = "stream_id", order: str = "ts_ms", frame: Callable[[dict], dict] = plain) -> DataFrame:
    """Events of one machine per stream. A frame whose ``is_silent`` is true ends all its notes and is not given to the machine; so does the stream's end.

    A machine that ``resets`` is at its start again when its notes have ended, so each run of frames between silent ones is a group of its own, and a
    stream lies in many tasks; others take a stream as one task's work. Frames are sorted by Spark and pass through in batches, never gathered. Frames of
    one time come in the order of a hash of their values, the same in every run; frames without a time are left out.
    """
    kind = frames.schema[stream].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, own, last = None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if own is None or (row[stream], row["_run"]) != key:
                    if own is not None:
                        out += [(key[0], e) for e in own.finalize(last)]
                    key, own = (row[stream], row["_run"]), machine()
                last = int(row[order])
                out += [(key[0], e) for e in (own.finalize(last) if row.get("is_silent") is True else own.step(frame(row)))]
            yield events_frame(out, stream)
        if own is not None:
            yield events_frame([(key[0], e) for e in own.finalize(last)], stream)

    if getattr(machine(), "resets", False) and "is_silent" in frames.columns:
        dealt = runs(frames, stream, order)
    else:
        plain_ = [c for c, kind_ in frames.dtypes if "map<" not in kind_]
        dealt = frames.where(F.col(order).isNotNull()).withColumn("_tie", F.xxhash64(*plain_)).withColumn("_run", F.lit(0).cast("bigint"))
    timed = dealt.repartition(stream, "_run").sortWithinPartitions(stream, "_run", order, "_tie").drop("_tie")
    return timed.mapInPandas(run, f"{stream} {kind}, {EVENTS}")

"""Onset detection: an adaptive threshold over a short window, then a least distance between accepted onsets."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.operators.windows import carried, overlapped, within

#: Frames on either side of a candidate, and how many deviations above the median it must lie.
SIDE, DEVIATIONS = 3, 2.2


def candidates(frames: DataFrame, stream: str, index: str, novelty: str, loudness: Column | None = None, least_loudness: float = -45.0, side: int = SIDE, deviations: float = DEVIATIONS) -> DataFrame:
    """Frames whose novelty is positive, the largest of the window around them, and ``deviations`` population deviations above its median.

    Only frames with a whole window count. Where ``loudness`` is given, quieter frames are left out.
    """
    return marked(overlapped(frames, index, side, side), stream, index, novelty, loudness, least_loudness, side, deviations).where("own AND candidate").select(*frames.columns)


def marked(spread: DataFrame, stream: str, index: str, novelty: str, loudness: Column | None = None, least_loudness: float = -45.0, side: int = SIDE, deviations: float = DEVIATIONS) -> DataFrame:
    """``candidate`` beside overlapped frames."""
    w = within(stream, index, side, side)
    x = F.col(novelty)
    judged = spread.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_most", F.max(x).over(w)).withColumn("_middle", F.expr(f"percentile({novelty}, 0.5)").over(w)).withColumn("_spread", F.stddev_pop(x).over(w))
    keep = (F.col("_n") == 2 * side + 1) & (x > 0) & (x >= F.col("_most")) & (x >= F.col("_middle") + F.lit(deviations) * F.col("_spread"))
    if loudness is not None:
        keep = keep & (loudness >= least_loudness)
    return judged.withColumn("candidate", keep).drop("_n", "_most", "_middle", "_spread")


def debounced(found: DataFrame, stream: str, time_ms: str, distance_ms: int, start_ms: int = 0, block_ms: int = 1 << 18) -> DataFrame:
    """(stream, time): candidates more than ``distance_ms`` after the one accepted last; that is ``start_ms`` at first. Null times are left out.

    Each candidate leads to the next acceptable one, so what a block of time accepts depends only on its first accepted candidate, and that is one of the few
    within ``distance_ms`` of its beginning. A block therefore says, for each of these, which time it accepts last; a fold over these rows (a row a block)
    gives what each block begins with, and the blocks follow their candidates in parallel. A task holds the distinct times of one block.
    """
    times = found.select(stream, F.col(time_ms).cast("bigint").alias(time_ms)).where(F.col(time_ms) > start_ms + distance_ms).distinct().withColumn("_block", F.floor(F.col(time_ms) / block_ms))
    key = f"`{stream}` {times.schema[stream].dataType.simpleString()}"

    def exits(group: pa.Table) -> pa.Table:
        at = np.sort(group.column(time_ms).to_numpy())
        follow = np.searchsorted(at, at + distance_ms, side="right")
        last = at.copy()
        for i in range(len(at) - 1, -1, -1):
            if follow[i] < len(at):
                last[i] = last[follow[i]]
        few = min(int(follow[0]) + 1, len(at))
        return pa.table({stream: group.column(stream)[:1], "_block": group.column("_block")[:1], "first": pa.array([at[:few].tolist()], pa.list_(pa.int64())), "last": pa.array([last[:few].tolist()], pa.list_(pa.int64()))})

    def after(state: int | None, row: dict) -> int | None:
        i = 0 if state is None else bisect_right(row["first"], state + distance_ms)
        return row["last"][i] if i < len(row["first"]) else state

    def accepted(group: pa.Table, entries: pa.Table) -> pa.Table:
        at, state, kept = np.sort(group.column(time_ms).to_numpy()), entries.column("entry")[0].as_py(), []
        i = 0 if state is None else int(np.searchsorted(at, state + distance_ms, side="right"))
        while i < len(at):
            kept.append(int(at[i]))
            i = int(np.searchsorted(at, at[i] + distance_ms, side="right"))
        return pa.table({stream: pa.array([group.column(stream)[0].as_py()] * len(kept), group.schema.field(stream).type), time_ms: pa.array(kept, pa.int64())})

    parts = times.groupBy(stream, "_block").applyInArrow(exits, f"{key}, _block bigint, first array<bigint>, last array<bigint>")
    entries = carried(parts, stream, "_block", lambda: None, after, "bigint")
    return times.groupBy(stream, "_block").cogroup(entries.groupBy(stream, "_block")).applyInArrow(accepted, f"{key}, `{time_ms}` bigint")


class OnsetRing:
    """Candidates and their spacing for one stream, frame by frame, as ``candidates`` and ``debounced`` find them in whole tables: a ring of the frames around a
    candidate is all that is kept. ``step`` takes ts_ms, novelty and dbfs; an onset is reported SIDE frames after it."""

    def __init__(self, distance_ms: int = 60, start_ms: int = 0, least_loudness: float = -45.0):
        self.ring: deque[tuple[int, float, float]] = deque(maxlen=2 * SIDE + 1)
        self.distance_ms, self.last, self.least = distance_ms, start_ms, least_loudness

    def step(self, f: dict) -> list[dict]:
        self.ring.append((f["ts_ms"], f["novelty"], f["dbfs"]))
        if len(self.ring) <= 2 * SIDE:
            return []
        at, novelty, dbfs = self.ring[SIDE]
        around = np.array([n for _, n, _ in self.ring])
        loud = novelty > 0 and novelty >= around.max() and novelty >= np.median(around) + DEVIATIONS * around.std() and dbfs >= self.least
        if not loud or at <= self.last + self.distance_ms:
            return []
        self.last = at
        return [{"kind": "onset", "strike_ms": at, "dbfs": dbfs}]

    def finalize(self, ts: int) -> list[dict]:
        return []


def rising_edges(frames: DataFrame, stream: str, index: str, probability: str, threshold: float) -> DataFrame:
    """Adds ``edge``: at or above the threshold and not below the frame before (0 before the first)."""
    spread = overlapped(frames, index, 1, 0)
    before = F.coalesce(F.lag(probability).over(Window.partitionBy(stream, "block").orderBy(index)), F.lit(0.0))
    return spread.withColumn("edge", (F.col(probability) >= threshold) & (F.col(probability) >= before)).where("own").drop("block", "own")

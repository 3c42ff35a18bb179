"""Streaming transcription: the batch machines inside stateful processors, and file replays of frames."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessitura.operators.transcribe import EVENTS, events_frame, plain

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SegmenterProcessor(StatefulProcessor):
    """Keeps each stream's machine as state. Rows of a micro-batch are taken in the order of their time; a row whose ``is_last`` is true ends the stream."""

    def __init__(self, machine: Callable[[], object], stream: str, order: str, frame: Callable[[dict], dict]):
        self.machine, self.stream, self.order, self.frame = machine, stream, order, frame

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pickle.loads(self.state.get()[0]) if self.state.exists() else self.machine()  # noqa: S301  our own state
        out, ended = [], False
        for row in pd.concat(list(rows)).sort_values(self.order).to_dict("records"):
            at = int(row[self.order])
            out += own.finalize(at) if row.get("is_silent") is True else own.step(self.frame(row))
            if row.get("is_last") is True:
                out += own.finalize(at)
                ended = True
        if ended:
            self.state.clear()
        else:
            self.state.update((pickle.dumps(own),))
        yield events_frame([(key[0], e) for e in out], self.stream)

    def close(self) -> None:
        pass


def transcribed(frames: DataFrame, machine: Callable[[], object], stream: str = "stream_id", order: str = "ts_ms", frame: Callable[[dict], dict] = plain) -> DataFrame:
    """Events of a streaming DataFrame of frames. Notes that are open when the input stops stay in the state until a row with ``is_last`` comes."""
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = frames.schema[stream].dataType.simpleString()
    return frames.groupBy(stream).transformWithStateInPandas(SegmenterProcessor(machine, stream, order, frame), f"{stream} {kind}, {EVENTS}", "Append", "None")


class OrderedProcessor(StatefulProcessor):
    """Gives each stream's machine its frames in the order of time, also those that come late: frames wait in list state until the watermark has passed
    them. A timer at the next waiting frame takes them, and one ``idle_ms`` after a stream's last frame ends its notes and forgets the stream.
    """

    def __init__(self, machine: Callable[[], object], stream: str, order: str, frame: Callable[[dict], dict], idle_ms: int):
        self.machine, self.stream, self.order, self.frame, self.idle_ms = machine, stream, order, frame, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, tie bigint, data binary")
        self.state = handle.getValueState("machine", "last bigint, data binary")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _taken(self, key, rows: list[tuple[int, int, bytes]], watermark: int, ended: bool) -> Iterator[pd.DataFrame]:
        """Events of the waiting frames that the watermark has passed; of the stream's end too if nothing waits and it has been idle."""
        due = sorted(r for r in rows if r[0] < watermark)
        later = [r for r in rows if r[0] >= watermark]
        last, own = self.state.get() if self.state.exists() else (None, None)
        own = pickle.loads(own) if own is not None else self.machine()  # noqa: S301  our own state
        out = []
        for at, _, data in due:
            row, last = pickle.loads(data), at  # noqa: S301
            out += own.finalize(at) if row.get("is_silent") is True else own.step(self.frame(row))
        if ended and not later and last is not None and last + self.idle_ms < watermark:
            out += own.finalize(last)
            self.state.clear()
            self.waiting.clear()
        else:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            if last is not None:
                self.state.update((last, pickle.dumps(own)))
            self._timer((min(at for at, _, _ in later) if later else last + self.idle_ms) + 1)
        yield events_frame([(key[0], e) for e in out], self.stream)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(r[self.order]), int(r["tie_of_frame"]), pickle.dumps({k: v for k, v in r.items() if k not in ("tie_of_frame", "time_of_frame")})) for part in rows for r in part.to_dict("records")]
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._taken(key, held + new, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._taken(key, held, timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None:
        pass


def transcribed_in_order(frames: DataFrame, machine: Callable[[], object], lateness: str = "2 seconds", idle_ms: int = 5000, stream: str = "stream_id", order: str = "ts_ms", frame: Callable[[dict], dict] = plain) -> DataFrame:
    """Events of a streaming DataFrame of frames that may come in any order, ``lateness`` at most behind the latest: the same as those of the batch fold.

    Frames of one time come in the order of a hash of their values, as in the batch; frames later than ``lateness`` or without a time are dropped by the
    watermark. A stream that is idle for ``idle_ms`` of event time ends, as a batch does at its last frame; what comes after is a stream begun anew.
    """
    frames.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = frames.schema[stream].dataType.simpleString()
    plain_ = [c for c, kind_ in frames.dtypes if "map<" not in kind_]
    timed = frames.where(F.col(order).isNotNull()).withColumn("tie_of_frame", F.xxhash64(*plain_)).withColumn("time_of_frame", F.timestamp_millis(F.col(order).cast("bigint"))).withWatermark("time_of_frame", lateness)
    return timed.groupBy(stream).transformWithStateInPandas(OrderedProcessor(machine, stream, order, frame, idle_ms), f"{stream} {kind}, {EVENTS}", "Append", "EventTime")


def frame_files(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Frames that arrive as Parquet files, so many a micro-batch: nothing is dropped when the reader falls behind."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def live_metrics(frames: DataFrame, stream: str = "stream_id", time: str = "ts", lateness: str = "10 seconds", width: str = "1 second") -> DataFrame:
    """Count, last time and peak per stream and window of event time, with a watermark."""
    timed = frames.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return timed.groupBy(stream, F.window(time, width)).agg(F.count("*").alias("frames"), F.max(time).alias("last"), F.max("dbfs").alias("peak_dbfs"))

"""Queries of the state machines and the score reader: no SQL expresses them; tests hold them against scripts and loops."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.operators import playback, samples, segmenters
from tessitura.operators.tempo import TempoTracker
from tessitura.operators.transcribe import folded, plain
from tessitura.plans.events import frames
from tessitura.sources import scores, wav
from tessitura.tables import fresh_path, stored


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detector frames, one every 20 ms of a stream."""
    f = frames(spark, sf_dir)
    hz = F.lit(440.0) * F.pow(F.lit(2.0), F.floor(F.col("value") / 60.0) / 12.0)
    return f.select(
        F.col("user_id").alias("stream_id"), (F.col("frame_idx") * 20 + 1000).alias("ts_ms"), hz.alias("hz"), F.least(F.lit(1.0), F.col("value") / 40.0).alias("clarity"), (F.col("value") / 10.0 - 50.0).alias("dbfs"),
        F.when(F.col("event_type") == "click", F.col("frame_idx") * 20 + 1000).alias("onset_ms"), (F.col("value") / 20.0).alias("crest"), (F.col("value") / 10.0 - 40.0).alias("thump"), (F.col("event_type") == "error").alias("is_silent"),
    )


def mono_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(_detected(spark, sf_dir), segmenters.MonoSegmenter)


def _heads(row: dict) -> dict:
    p = min(1.0, row["clarity"])
    return {"ts_ms": row["ts_ms"], "energy": row["dbfs"], "pedal": (0.0, 0.0, p), "keys": {60 + int(row["hz"]) % 3: (p if row["onset_ms"] == row["onset_ms"] and row["onset_ms"] is not None else 0.0, p, 0.0, row["crest"] * 5)}}


def pedalled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(_detected(spark, sf_dir), segmenters.PedalSegmenter, frame=_heads)


def _hybrid(row: dict) -> dict:
    f = plain(row)
    return f | {"energy": f["dbfs"], "nsdf": (f["clarity"], 0.0 if f["crest"] > 2 else 0.9), "keys": {69: (0.0, f["clarity"])}}


def hybrid_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(_detected(spark, sf_dir), segmenters.HybridSegmenter, frame=_hybrid)


def _envelope(row: dict) -> dict:
    return {"note": segmenters.note_of(row["hz"]) if row["clarity"] >= 0.5 else None, "dbfs": row["dbfs"], "ts_ms": row["ts_ms"], "crest": row["crest"]}


@dataclass
class EnvelopeStream(segmenters.Envelope):
    resets = True

    def finalize(self, ts: int) -> list[dict]:
        note, self.note, self.state = self.note, None, "Idle"
        return [note.end(ts, self.p)] if note else []


def envelope_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(_detected(spark, sf_dir), EnvelopeStream, frame=_envelope)


@dataclass
class Beats:
    """Beats as events of the tempo tracker."""

    tracker: TempoTracker = field(default_factory=lambda: TempoTracker(fps=50.0))

    def step(self, f: dict) -> list[dict]:
        out = self.tracker.step(f["dbfs"] + 50.0)
        return [{"kind": "beat", "strike_ms": f["ts_ms"], "duration_s": 60.0 / out["bpm"]}] if out["beat"] else []

    def finalize(self, ts: int) -> list[dict]:
        return []


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(_detected(spark, sf_dir).drop("is_silent"), Beats).select("stream_id", F.col("strike_ms").alias("ts_ms"), (60.0 / F.col("duration_s")).alias("bpm"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scores: an order is a measure, some with repeats; its lines are notes."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # lines travel as numbers, and all to their order at once: nothing is collected before the shuffle, which no order's few lines would make smaller
    lines = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("quantity")).alias("line"))
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    step = lambda x: F.element_at(F.split(F.lit("C D E F G A B"), " "), (x["l_partkey"] % 7 + 1).cast("int"))
    note = lambda x: F.concat(F.lit("<note><pitch><step>"), step(x), F.lit("</step><octave>"), (x["l_suppkey"] % 5 + 2).cast("string"), F.lit("</octave></pitch><duration>"), x["quantity"].cast("string"), F.lit("</duration></note>"))
    notes = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line")), note), "").alias("notes"))
    bar = F.when(F.col("o_orderkey") % 7 == 0, "<barline><repeat direction='backward'/></barline>").otherwise("")
    measure = F.concat(F.lit("<measure number='"), F.col("o_orderkey").cast("string"), F.lit("'><part id='P1'>"), F.col("notes"), bar, F.lit("</part></measure>"))
    measures = spark.read.parquet(f"{sf_dir}/orders.parquet").join(notes, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", measure.alias("xml"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "xml"))), lambda x: x["xml"]), "")
    whole = F.concat(F.lit("<score-timewise><part-list><score-part id='P1'><part-name>Piano</part-name></score-part></part-list>"), body, F.lit("</score-timewise>"))
    return measures.groupBy(F.col("o_custkey").cast("string").alias("path")).agg(whole.cast("binary").alias("content"))


def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores.score_rows(documents(spark, sf_dir), fields=("score", "kind", "midi", "start", "duration"))
    return rows.groupBy("score").agg(F.count_if(F.col("kind") == "Note").alias("notes"), F.count_if(F.col("kind") == "Measure").alias("measures"), F.sum(F.when(F.col("kind") == "Note", F.col("midi"))).cast("bigint").alias("midi_sum"), F.max(F.when(F.col("kind") == "Note", F.col("start") + F.col("duration"))).alias("longest"))


STEP = "[0, 2, 4, 5, 7, 9, 11][l_partkey % 7 + 1]"
SQL_PARSE = f"""WITH n AS (SELECT o_custkey, o_orderkey, sum((l_suppkey % 5 + 3) * 12 + {STEP}) AS midi, count(*) AS n, sum(trunc(l_quantity)) AS len FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
    SELECT o_custkey::VARCHAR AS score, sum(n)::BIGINT AS notes, count(*) AS measures, sum(midi)::BIGINT AS midi_sum, max(len)::INT AS longest FROM n GROUP BY 1"""


def played_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores.score_rows(documents(spark, sf_dir), fields=("score", "measure", "ord", "kind", "value", "times", "start", "duration", "midi", "velocity", "dynamic", "articulation", "tie", "part"))
    return playback.unrolled_notes(stored(rows, "score-rows")).groupBy("score").agg(F.count(F.lit(1)).alias("notes"), F.countDistinct("pos").alias("measures"))


#: A backward repeat without a forward one goes back to the measure after the last repeat, so every measure up to the last repeat is played twice.
SQL_PLAYED = """WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), r AS (SELECT *, max(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS last FROM n)
    SELECT o_custkey::VARCHAR AS score, sum(n * CASE WHEN o_orderkey <= last THEN 2 ELSE 1 END)::BIGINT AS notes, sum(CASE WHEN o_orderkey <= last THEN 2 ELSE 1 END)::BIGINT AS measures FROM r GROUP BY 1"""

def volta_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scores of their orders; of every four measures the first opens a repeat, the next are its first and second ending."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    bars = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("score"), (F.row_number().over(w) - 1).alias("measure"))
    row = lambda kind, ord_, value=None: F.struct(F.lit(kind).alias("kind"), F.lit(value).cast("string").alias("value"), F.lit(ord_).alias("ord"))
    own = F.when(F.col("measure") % 4 == 0, F.array(row("Measure", 0), row("RepeatStart", 1))).when(F.col("measure") % 4 == 1, F.array(row("Measure", 0), row("EndingStart", 1, "1"), row("EndingStop", 2, "1"), row("RepeatEnd", 3)))
    own = own.when(F.col("measure") % 4 == 2, F.array(row("Measure", 0), row("EndingStart", 1, "2"), row("EndingStop", 2, "2"))).otherwise(F.array(row("Measure", 0)))
    rows = bars.select(F.col("score").cast("string").alias("score"), "measure", F.inline(own)).withColumn("times", F.lit(None).cast("int"))
    return playback.playback(rows)


SQL_VOLTAS_PLAYED = """WITH b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS measure, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    s AS (SELECT *, unnest(CASE measure % 4 WHEN 0 THEN CASE WHEN measure + 1 < n THEN [0, 2] ELSE [0] END WHEN 1 THEN [1] WHEN 2 THEN [3] ELSE [4] END) AS slot FROM b)
    SELECT o_custkey::VARCHAR AS score, (row_number() OVER (PARTITION BY o_custkey ORDER BY measure // 4, slot) - 1)::INT AS pos, measure::INT AS measure FROM s"""


def jump_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scores of their orders: measure 0 opens a repeat, a third of the way on it ends where the way to the coda leaves, at two thirds the score begins anew, and the last measure is the coda."""
    w = Window.partitionBy("o_custkey")
    bars = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("score"), (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("measure"), F.count(F.lit(1)).over(w).cast("int").alias("n"))
    at, third = F.col("measure"), F.floor(F.col("n") / 3)
    mark = lambda here, kind, ord_, value=None: F.when(here, F.struct(F.lit(kind).alias("kind"), F.lit(value).cast("string").alias("value"), F.lit(ord_).alias("ord")))
    everywhere, long = F.lit(True), F.col("n") >= 6
    own = F.array(mark(everywhere, "Measure", 0), mark(at == 0, "RepeatStart", 1), mark(long & (at == third), "Jump", 2, "ToCoda"), mark(long & (at == third), "RepeatEnd", 3), mark(long & (at == 2 * third), "Jump", 4, "DaCapo"), mark(at == F.col("n") - 1, "Jump", 5, "Coda"))
    rows = bars.select("score", "measure", F.inline(F.array_compact(own))).withColumn("times", F.lit(None).cast("int"))
    return playback.playback(rows)


#: Legs by the rules: the repeated start twice, on to the D.C., the repeated start twice again (the repeat comes after the way to the coda), then the coda.
SQL_JUMPS_PLAYED = """WITH b AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS measure, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), t AS (SELECT *, n // 3 AS third FROM b),
    l AS (SELECT *, unnest(CASE WHEN n < 6 THEN [0] WHEN measure <= third THEN [0, 1, 3, 4] || CASE WHEN measure = n - 1 THEN [5] ELSE [] END WHEN measure <= 2 * third THEN [2] || CASE WHEN measure = n - 1 THEN [5] ELSE [] END WHEN measure = n - 1 THEN [5] ELSE [] END) AS leg FROM t)
    SELECT o_custkey::VARCHAR AS score, (row_number() OVER (PARTITION BY o_custkey ORDER BY leg, measure) - 1)::INT AS pos, measure::INT AS measure FROM l"""


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as hops of a stream, each a tone of 18 hops with a rest of 6 after it: stream_id, hop_idx, samples."""
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    tones = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey", F.row_number().over(w).alias("nth"), (F.lit(440.0) * F.pow(F.lit(2.0), (F.col("s_suppkey") % 24 - 12) / 12.0)).alias("hz"))
    hops = tones.select(F.col("s_nationkey").alias("stream_id"), ((F.col("nth") - 1) * 24).alias("first"), "hz", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("k"))
    hops = hops.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "stream_id", "first")  # by number: suppliers are few bytes, which the adaptive planner puts into one task, but their samples are many
    tone = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.lit(0.5) * F.sin(F.lit(2 * math.pi) * F.col("hz") * (F.col("k") * 512 + i) / 44100.0))
    value = F.when(F.col("k") < 18, tone).otherwise(F.array_repeat(F.lit(0.0), 512))
    return hops.select("stream_id", (F.col("first") + F.col("k")).cast("bigint").alias("hop_idx"), value.alias("samples"))


def heard_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes that are heard in the suppliers' tones."""
    return samples.notes(_tones(spark, sf_dir).select("stream_id", "hop_idx", F.lit(44100).alias("sample_rate"), "samples"))


def wav_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' tones written as 16-bit WAV files and read back in ranges: the keys of the notes that begin, in order; strikes of one key in a row (rounding makes some) count once."""
    values = _tones(spark, sf_dir).select("stream_id", F.col("hop_idx").alias("idx"), F.transform("samples", lambda v: F.floor(v * 32767 + 0.5)).alias("value"))
    files = fresh_path(spark, "tones")
    wav.write_wavs(values, files, 44100).write.format("noop").mode("overwrite").save()
    heard = samples.notes(wav.read_wav(spark, files, 1 << 20).drop("error")).where("kind = 'start'")
    order = Window.partitionBy("stream_id").orderBy("strike_ms")
    changes = heard.withColumn("before", F.lag("midi").over(order)).where("before IS NULL OR before <> midi")
    return changes.select(F.regexp_extract("stream_id", r"([^/]+)\.wav$", 1).alias("nation"), F.row_number().over(order).alias("nth"), "midi")


SQL_HEARD = """WITH m AS (SELECT s_nationkey, s_suppkey, s_suppkey % 24 + 57 AS midi, lag(s_suppkey % 24 + 57) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS before FROM supplier)
    SELECT s_nationkey::VARCHAR AS nation, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey))::INT AS nth, midi::INT AS midi FROM m WHERE before IS NULL OR before <> midi"""


QUERIES = {
    "mono_notes": (mono_notes, None), "pedalled_notes": (pedalled_notes, None), "hybrid_notes": (hybrid_notes, None), "envelope_notes": (envelope_notes, None), "beats": (beats, None),
    "volta_playback": (volta_playback, SQL_VOLTAS_PLAYED), "jump_playback": (jump_playback, SQL_JUMPS_PLAYED), "heard_notes": (heard_notes, None), "wav_notes": (wav_notes, SQL_HEARD), "score_parse": (score_parse, SQL_PARSE), "played_notes": (played_notes, SQL_PLAYED),
}

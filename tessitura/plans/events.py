"""Queries that read ``events`` as frames: a user is a stream, the value a novelty or probability, the type a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import theory
from tessitura.functions.profiles import instrument_profiles
from tessitura.operators import notes, onsets
from tessitura.operators.windows import numbered, overlapped

HALF_DAY = 12 * 3600 * 1000
KEYS = ("click", "error", "purchase", "signup", "view")

MS = "CAST(floor(epoch_us(ts) / 1000) AS BIGINT)"
#: Novelty frames: index in the stream, milliseconds.
SQL_FRAMES = f"f AS (SELECT user_id, event_id, event_type, value, {MS} AS ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx FROM events)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts_ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint"))
    return numbered(events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value", "ts_ms", "frame_idx")


def onset_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onsets.candidates(frames(spark, sf_dir), "user_id", "frame_idx", "value").select("user_id", "frame_idx", "ts_ms", "value")


SQL_CANDIDATES = f"""{SQL_FRAMES}, w AS (SELECT *, count(*) OVER s AS n, max(value) OVER s AS most, median(value) OVER s AS middle, stddev_pop(value) OVER s AS spread FROM f
    WINDOW s AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    c AS (SELECT user_id, frame_idx, ts_ms, value FROM w WHERE n = 7 AND value > 0 AND value >= most AND value >= middle + 2.2::DOUBLE * spread)"""
SQL_ONSET_CANDIDATES = f"WITH {SQL_CANDIDATES} SELECT * FROM c"


def onset_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onsets.debounced(onset_candidates(spark, sf_dir), "user_id", "ts_ms", HALF_DAY)


SQL_ONSET_DETECTION = f"""WITH RECURSIVE {SQL_CANDIDATES}, o AS (
    SELECT user_id, min(ts_ms) AS ts_ms FROM c WHERE ts_ms > {HALF_DAY} GROUP BY user_id
    UNION ALL SELECT o.user_id, (SELECT min(c.ts_ms) FROM c WHERE c.user_id = o.user_id AND c.ts_ms > o.ts_ms + {HALF_DAY}) FROM o
    WHERE EXISTS (SELECT 1 FROM c WHERE c.user_id = o.user_id AND c.ts_ms > o.ts_ms + {HALF_DAY})) SELECT user_id, ts_ms FROM o"""


def spectral_flux_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises of the novelty against the frame before (0 before the first)."""
    w = Window.partitionBy("user_id", "block").orderBy("frame_idx")
    df = overlapped(frames(spark, sf_dir), "frame_idx", 1, 0).withColumn("flux", F.round(F.greatest(F.lit(0.0), F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))), 6))
    return df.where("own").select("user_id", "frame_idx", "flux")


SQL_FLUX = f"WITH {SQL_FRAMES} SELECT user_id, frame_idx, round(greatest(0, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY frame_idx), 0)), 6) AS flux FROM f"


def silence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the flag that gates them, and the number of the sounding run they belong to."""
    df = frames(spark, sf_dir).withColumn("dbfs", F.round(F.lit(20.0) * F.log10(F.col("value") / 600.0 + F.lit(1e-9)), 6)).withColumn("is_silent", F.col("dbfs") < -15.0)
    w = Window.partitionBy("user_id").orderBy("frame_idx")
    fresh = ~F.col("is_silent") & F.coalesce(F.lag("is_silent").over(w), F.lit(True))
    df = df.withColumn("fresh", fresh)
    run = F.sum(F.col("fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.select("user_id", "frame_idx", "dbfs", "is_silent", F.when(~F.col("is_silent"), run).alias("run"))


SQL_SILENCE = f"""WITH {SQL_FRAMES}, d AS (SELECT *, round(20 * log10(value / 600 + 1e-9), 6) AS dbfs FROM f), s AS (SELECT *, dbfs < -15 AS is_silent FROM d),
    e AS (SELECT *, NOT is_silent AND coalesce(lag(is_silent) OVER (PARTITION BY user_id ORDER BY frame_idx), true) AS fresh FROM s)
    SELECT user_id, frame_idx, dbfs, is_silent, CASE WHEN NOT is_silent THEN sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY frame_idx)::BIGINT END AS run FROM e"""


def rising_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir).withColumn("p", F.col("value") / 600.0)
    return onsets.rising_edges(df, "user_id", "frame_idx", "p", 0.1).select("user_id", "frame_idx", "edge")


SQL_EDGES = f"WITH {SQL_FRAMES}, g AS (SELECT *, value / 600 AS p FROM f) SELECT user_id, frame_idx, p >= 0.1 AND p >= coalesce(lag(p) OVER (PARTITION BY user_id ORDER BY frame_idx), 0) AS edge FROM g"


def pedal_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames(spark, sf_dir).withColumn("frame_p", F.col("value") / 200.0).withColumn("onset_p", F.when(F.col("event_type") == "click", F.col("value") / 200.0).otherwise(0.0))
    df = df.withColumn("offset_p", F.when(F.col("event_type") == "error", F.col("value") / 200.0).otherwise(0.0))
    return notes.pedal(df, "user_id", "frame_idx").select("user_id", "frame_idx", "pedal")


SQL_PEDAL = f"""WITH {SQL_FRAMES}, p AS (SELECT user_id, frame_idx, value / 200 AS fp, CASE WHEN event_type = 'click' THEN value / 200 ELSE 0 END AS op, CASE WHEN event_type = 'error' THEN value / 200 ELSE 0 END AS xp FROM f)
    SELECT user_id, frame_idx, coalesce(last_value(CASE WHEN fp >= 0.5 OR op >= 0.4 THEN true WHEN fp < 0.35 OR xp >= 0.35 THEN false END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS pedal FROM p"""


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as activations: the key from the type, probabilities and levels from the value."""
    df = frames(spark, sf_dir)
    key = F.lit(60) + (F.array_position(F.array(*[F.lit(k) for k in KEYS]), F.col("event_type")) % 2).cast("int")
    return df.select(
        "user_id", key.alias("midi"), "frame_idx", "ts_ms", (F.col("value") / 100.0).alias("frame_p"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 100.0).otherwise(0.0).alias("onset_p"),
        (F.col("value") / 10.0 - 60.0).alias("dbfs"), (F.col("event_id") % 21 - 10).cast("int").alias("cents"), (F.col("value") / 20.0).alias("crest"), (F.col("value") / 10.0 - 30.0).alias("thump"),
        (F.lit(500.0) + F.col("value")).alias("centroid"), F.when(F.col("event_id") % 2 == 0, F.col("value") / 50.0).alias("sones"),
    )


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notes.islands(activations(spark, sf_dir), ["user_id", "midi"], "frame_idx", "ts_ms", "frame_p", "onset_p", 0.3, 0.5)
    return notes.accumulated(rows, ["user_id", "midi"], "frame_idx", "ts_ms", "dbfs", "cents", "crest", "thump", "centroid", "sones")


SQL_ACTIVATIONS = f"""{SQL_FRAMES}, a AS (SELECT user_id, 60 + (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) % 2)::INT AS midi, frame_idx, ts_ms, value / 100 AS frame_p,
    CASE WHEN event_id % 3 = 0 THEN value / 100 ELSE 0 END AS onset_p, value / 10 - 60 AS dbfs, (event_id % 21 - 10)::INT AS cents, value / 20 AS crest, value / 10 - 30 AS thump, 500 + value AS centroid,
    CASE WHEN event_id % 2 = 0 THEN value / 50 END AS sones FROM f)"""
SQL_NOTES = f"""{SQL_ACTIVATIONS}, b AS (SELECT *, frame_p >= 0.3 AS active, coalesce(lag(frame_p >= 0.3) OVER k, false) AS was FROM a WINDOW k AS (PARTITION BY user_id, midi ORDER BY frame_idx)),
    c AS (SELECT *, active AND (NOT was OR onset_p >= 0.5) AS fresh FROM b), d AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id, midi ORDER BY frame_idx) AS no,
    (SELECT min(x.ts_ms) FROM c x WHERE x.user_id = c.user_id AND x.midi = c.midi AND x.frame_idx > c.frame_idx AND (x.fresh OR NOT x.active)) AS until FROM c),
    n AS (SELECT user_id, midi, no::BIGINT AS note, min(ts_ms) AS strike_ms, arg_max(until, frame_idx) FILTER (until IS NOT NULL) AS end_ms, count(*) AS n_frames, max(dbfs) AS peak_dbfs, arg_min(dbfs, frame_idx) AS onset_dbfs,
    round(sum(cents) / count(*))::INT AS avg_cents, max(cents) - min(cents) AS cents_range, arg_min(crest, frame_idx) AS crest, arg_min(thump, frame_idx) AS thump, avg(centroid) AS centroid, max(sones) AS peak_sones,
    sum(sones) / count(*) AS avg_sones, first(sones ORDER BY frame_idx) AS onset_sones FROM d WHERE active GROUP BY ALL)"""


def note_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _notes(spark, sf_dir).select("user_id", "midi", "note", "strike_ms", "end_ms", "n_frames", r("peak_dbfs"), r("onset_dbfs"), "avg_cents", "cents_range", r("centroid"), r("peak_sones"), r("avg_sones"), r("onset_sones"))


SQL_SEGMENTS = f"""WITH {SQL_NOTES} SELECT user_id, midi, note, strike_ms, end_ms, n_frames, round(peak_dbfs, 6) AS peak_dbfs, round(onset_dbfs, 6) AS onset_dbfs, avg_cents, cents_range, round(centroid, 6) AS centroid,
    round(peak_sones, 6) AS peak_sones, round(avg_sones, 6) AS avg_sones, round(onset_sones, 6) AS onset_sones FROM n"""


def case_sql(value: str, cuts: tuple, names: tuple = theory.LEVELS, op: str = "<") -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {c} THEN '{n}'" for c, n in zip(cuts, names, strict=False)) + f" ELSE '{names[len(cuts)]}' END"


def phons_sql(sones: str) -> str:
    return f"(CASE WHEN {sones} >= 1 THEN 40 + 33.21928::DOUBLE * log10(greatest({sones}, 1)) WHEN {sones} > 0 THEN 40 * pow({sones}, 0.35::DOUBLE) ELSE 0 END)"


def velocity_sql(dbfs: str) -> str:
    return f"least(greatest(round((least(greatest(({dbfs} + 55) / 50, 0), 1) * 0.85::DOUBLE + least(greatest((crest - 6) / 18, 0), 0.2::DOUBLE)) * 127), 1), 127)::INT"


def note_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.starts(_notes(spark, sf_dir)).select("user_id", "midi", "strike_ms", "dynamic", "velocity")


SQL_STARTS = f"""WITH {SQL_NOTES} SELECT user_id, midi, strike_ms, CASE WHEN onset_sones IS NOT NULL THEN {case_sql(phons_sql("onset_sones"), theory.PHON_CUTS)} ELSE {case_sql("onset_dbfs", theory.DBFS_CUTS)} END AS dynamic,
    {velocity_sql("onset_dbfs")} AS velocity FROM n"""


def note_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = notes.ends(_notes(spark, sf_dir), instrument_profiles(spark), "Piano")
    return out.select("user_id", "midi", "strike_ms", F.round("note_duration", 6).alias("note_duration"), F.round("slope", 4).alias("slope"), "velocity", "dynamic", "articulation", "is_mashed", "is_flat", "damping")


SQL_ENDS_CORE = f"""{SQL_NOTES}, e AS (SELECT *, (end_ms - strike_ms) / 1000 AS seconds, abs(peak_dbfs - onset_dbfs) / 0.005::DOUBLE AS slope, {velocity_sql("peak_dbfs")} AS velocity FROM n WHERE end_ms IS NOT NULL),
    ends AS (SELECT user_id, midi, strike_ms, end_ms, round(seconds, 6) AS note_duration, round(slope, 4) AS slope, velocity,
    CASE WHEN peak_sones IS NOT NULL THEN {case_sql(phons_sql("peak_sones"), theory.PHON_CUTS)} ELSE {case_sql("peak_dbfs", theory.DBFS_CUTS)} END AS dynamic,
    CASE WHEN (slope >= 150 AND 0.005 <= 0.015) OR (velocity >= 90 AND crest >= 15) THEN 'Marcato' WHEN seconds <= 0.22 THEN 'Staccato' WHEN seconds >= 0.7 THEN 'Tenuto' ELSE 'Normal' END AS articulation,
    crest >= 16 AND thump >= -22 AS is_mashed, avg_cents <= -8 AS is_flat, CASE WHEN seconds >= 0.7 THEN 'PedalSustained' WHEN seconds <= 0.22 THEN 'DryDamped' ELSE 'HalfPedal' END AS damping
    FROM e WHERE seconds >= 0.02)"""
SQL_ENDS = f"WITH {SQL_ENDS_CORE} SELECT user_id, midi, strike_ms, note_duration, slope, velocity, dynamic, articulation, is_mashed, is_flat, damping FROM ends"


def note_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start events with the end event of the same key and strike, if it has come."""
    start = note_starts(spark, sf_dir).withColumnsRenamed({"dynamic": "start_dynamic", "velocity": "start_velocity"})
    end = note_ends(spark, sf_dir).select("user_id", "midi", "strike_ms", "note_duration", F.col("dynamic").alias("end_dynamic"))
    return start.join(end, ["user_id", "midi", "strike_ms"], "left")


SQL_PAIRS = f"""WITH {SQL_ENDS_CORE}, s AS (SELECT user_id, midi, strike_ms, CASE WHEN onset_sones IS NOT NULL THEN {case_sql(phons_sql("onset_sones"), theory.PHON_CUTS)} ELSE {case_sql("onset_dbfs", theory.DBFS_CUTS)} END AS start_dynamic,
    {velocity_sql("onset_dbfs")} AS start_velocity FROM n) SELECT s.*, ends.note_duration, ends.dynamic AS end_dynamic FROM s LEFT JOIN ends USING (user_id, midi, strike_ms)"""


def note_event_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = note_starts(spark, sf_dir).select(F.lit("start").alias("kind"), "user_id", "midi", F.col("strike_ms").alias("ts_ms"), "velocity")
    end = note_ends(spark, sf_dir).select(F.lit("end").alias("kind"), "user_id", "midi", (F.col("strike_ms") + F.round(F.col("note_duration") * 1000).cast("bigint")).alias("ts_ms"), "velocity", "damping")
    return start.unionByName(end, allowMissingColumns=True)


SQL_UNION = f"""WITH {SQL_ENDS_CORE} SELECT 'start' AS kind, user_id, midi, strike_ms AS ts_ms, {velocity_sql("onset_dbfs")} AS velocity, NULL::VARCHAR AS damping FROM n
    UNION ALL SELECT 'end', user_id, midi, strike_ms + round(note_duration * 1000)::BIGINT, velocity, damping FROM ends"""


def strike_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the last purchase of its stream up to then, and whether a day has passed (a restrike)."""
    df = frames(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy("ts_ms").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("strike_ms", F.max(F.when(F.col("event_type") == "purchase", F.col("ts_ms"))).over(w))
    return df.where("event_type = 'click'").select("user_id", "event_id", "ts_ms", "strike_ms", (F.col("ts_ms") - F.col("strike_ms") >= 86_400_000).alias("restrike"))


SQL_ASOF = f"""WITH {SQL_FRAMES} SELECT c.user_id, c.event_id, c.ts_ms, p.ts_ms AS strike_ms, c.ts_ms - p.ts_ms >= 86400000 AS restrike
    FROM (FROM f WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT DISTINCT user_id, ts_ms FROM f WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts_ms >= p.ts_ms"""


def live_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).groupBy("user_id").agg(F.max_by("value", "frame_idx").alias("last_value"), F.max("ts_ms").alias("last_ms"), F.count(F.lit(1)).alias("processed_frames"), F.round(F.max("value"), 6).alias("peak"))


SQL_METRICS = f"WITH {SQL_FRAMES} SELECT user_id, arg_max(value, frame_idx) AS last_value, max(ts_ms) AS last_ms, count(*) AS processed_frames, round(max(value), 6) AS peak FROM f GROUP BY user_id"


def loudest_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.struct("midi", "note"), F.struct("peak_dbfs", F.col("strike_ms") * -1, F.col("midi") * -1)).alias("x")).select("user_id", "x.midi", "x.note")


SQL_LOUDEST = f"WITH {SQL_NOTES} SELECT user_id, midi, note FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY peak_dbfs DESC, strike_ms, midi) = 1"


def active_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activations that concern a key: strong enough, or met by an open note."""
    rows = notes.islands(activations(spark, sf_dir), ["user_id", "midi"], "frame_idx", "ts_ms", "frame_p", "onset_p", 0.3, 0.5)
    open_before = F.coalesce(F.lag(F.col("note").isNotNull()).over(Window.partitionBy("user_id", "midi").orderBy("frame_idx")), F.lit(False))
    rows = rows.withColumn("open_before", open_before)
    return rows.where((F.col("frame_p") >= 0.3) | (F.col("onset_p") >= 0.5) | F.col("open_before")).select("user_id", "midi", "frame_idx", "open_before")


SQL_ACTIVE = f"""WITH {SQL_ACTIVATIONS}, b AS (SELECT *, coalesce(lag(frame_p >= 0.3) OVER (PARTITION BY user_id, midi ORDER BY frame_idx), false) AS open_before FROM a)
    SELECT user_id, midi, frame_idx, open_before FROM b WHERE frame_p >= 0.3 OR onset_p >= 0.5 OR open_before"""

QUERIES = {
    "onset_candidates": (onset_candidates, SQL_ONSET_CANDIDATES), "onset_detection": (onset_detection, SQL_ONSET_DETECTION), "novelty_flux": (spectral_flux_stream, SQL_FLUX), "silence_gate": (silence_gate, SQL_SILENCE),
    "rising_edges": (rising_edges, SQL_EDGES), "pedal_switch": (pedal_switch, SQL_PEDAL), "note_segments": (note_segments, SQL_SEGMENTS), "note_starts": (note_starts, SQL_STARTS), "note_ends": (note_ends, SQL_ENDS),
    "note_pairs": (note_pairs, SQL_PAIRS), "note_event_union": (note_event_union, SQL_UNION), "strike_asof": (strike_asof, SQL_ASOF), "live_metrics": (live_metrics, SQL_METRICS), "loudest_note": (loudest_note, SQL_LOUDEST),
    "active_keys": (active_keys, SQL_ACTIVE),
}

"""Queries that read ``embeddings`` as frames or spectra of 64 values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import dsp, signal
from tessitura.operators import notes, samples, spectra
from tessitura.operators import windows as win
from tessitura.sources import wav
from tessitura.tables import fresh_path

X = "CAST(embedding AS DOUBLE[])"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.transform("x", F.abs)
    r = lambda c, n: F.round(c, 5).alias(n)
    return _vectors(spark, sf_dir).select("vec_id", r(signal.loudness(F.col("x")), "dbfs"), r(signal.crest_factor(F.col("x")), "crest"), r(signal.spectral_centroid(m, 344.53125), "centroid"), r(signal.spectral_flatness(m), "flatness"), r(signal.high_frequency_content(m), "hfc"))


SQL_FEATURES = f"""WITH v AS (SELECT vec_id, {X} AS x FROM embeddings), w AS (SELECT *, list_transform(x, lambda a: abs(a)) AS m, sqrt(list_sum(list_transform(x, lambda a: a * a)) / len(x)) AS rms FROM v),
    p AS (SELECT *, list_transform(m, lambda a: greatest(a * a, 1e-12)) AS pw FROM w)
    SELECT vec_id, round(20 * log10(rms + 1e-9), 5) AS dbfs, round(CASE WHEN list_max(m) >= 1e-6 AND rms >= 1e-6 THEN 20 * log10(list_max(m) / rms) ELSE 0 END, 5) AS crest,
    round(CASE WHEN list_sum(m) > 1e-6 THEN list_sum(list_transform(m, lambda a, i: a * (i - 1) * 344.53125::DOUBLE)) / list_sum(m) ELSE 0 END, 5) AS centroid,
    round(CASE WHEN list_avg(pw) > 1e-9 THEN least(greatest(exp(list_avg(list_transform(pw, lambda a: ln(a)))) / list_avg(pw), 0), 1) ELSE 0 END, 5) AS flatness,
    round(list_sum(list_transform(m, lambda a, i: i * a * a)), 5) AS hfc FROM p"""


def spectral_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir).withColumn("m", F.transform("x", F.abs))
    df = win.overlapped(win.numbered(df, "label", "vec_id"), "frame_idx", 1, 0)
    before = F.lag("m").over(Window.partitionBy("label", "block").orderBy("frame_idx"))
    return df.withColumn("before", before).where("own").select("vec_id", F.round(signal.spectral_flux(F.col("m"), F.col("before")), 5).alias("flux"))


SQL_FLUX = f"""WITH v AS (SELECT vec_id, label, list_transform({X}, lambda a: abs(a)) AS m FROM embeddings), b AS (SELECT *, lag(m) OVER (PARTITION BY label ORDER BY vec_id) AS l FROM v)
    SELECT vec_id, round(list_sum(list_transform(m, lambda a, i: greatest(0, a - coalesce(l[i], 0)))), 5) AS flux FROM b"""


def magnitude_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed magnitudes of each frame, bin by bin."""
    df = _vectors(spark, sf_dir).select("vec_id", F.posexplode(spectra.magnitude_spectrum(F.col("x"))).alias("bin", "magnitude"))
    return df.select("vec_id", "bin", F.round("magnitude", 5).alias("magnitude"))


SQL_SPECTRUM = f"""WITH v AS (SELECT vec_id, list_transform({X}, lambda a, i: a * 0.5 * (1 - cos(2 * pi() * (i - 1) / 64))) AS x FROM embeddings), b AS (SELECT vec_id, x, unnest(range(32)) AS bin FROM v)
    SELECT vec_id, bin::INT AS bin, round(sqrt(pow(list_sum(list_transform(x, lambda a, i: a * cos(2 * pi() * (i - 1) * bin / 64))), 2) + pow(list_sum(list_transform(x, lambda a, i: a * sin(2 * pi() * (i - 1) * bin / 64))), 2)), 5) AS magnitude FROM b"""


def overlapping_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the next of its label as one frame of 128: energy and length."""
    df = win.numbered(_vectors(spark, sf_dir), "label", "vec_id").withColumnsRenamed({"label": "stream_id", "frame_idx": "hop_idx", "x": "samples"})
    out = win.frames(df, 64)
    return out.select("vec_id", F.size("frame").alias("n"), F.round(signal.total(F.transform("frame", lambda x: x * x)), 5).alias("energy"))


SQL_FRAMES = f"""WITH v AS (SELECT vec_id, label, list_sum(list_transform({X}, lambda a: a * a)) AS e FROM embeddings)
    SELECT vec_id, 128 AS n, round(e + coalesce(lead(e) OVER (PARTITION BY label ORDER BY vec_id), 0), 5) AS energy FROM v"""


def mel_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 32 vectors of a label as one context, oldest first, padded with the log floor."""
    df = win.overlapped(win.numbered(_vectors(spark, sf_dir), "label", "vec_id"), "frame_idx", 31, 0)
    df = df.withColumn("seen", F.flatten(F.collect_list("x").over(win.within("label", "frame_idx", 31, 0)))).where("own")
    context = F.concat(F.array_repeat(F.lit(-11.5129), F.lit(2048) - F.size("seen")), F.col("seen"))
    return df.select("vec_id", F.size(context).alias("n"), F.round(signal.total(context), 5).alias("total"))


SQL_CONTEXT = f"""WITH v AS (SELECT vec_id, label, list_sum({X}) AS s FROM embeddings), w AS (SELECT vec_id, sum(s) OVER k AS s, count(*) OVER k AS n FROM v WINDOW k AS (PARTITION BY label ORDER BY vec_id ROWS 31 PRECEDING))
    SELECT vec_id, 2048 AS n, round(s + (32 - n) * 64 * -11.5129::DOUBLE, 5) AS total FROM w"""


def stereo_to_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as interleaved stereo: mixed down, scaled as 16-bit samples."""
    mixed = signal.mono(F.transform("x", lambda a: F.round(a * 1000.0)), 2)
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(signal.scaled_pcm(mixed, 16)).alias("place", "sample")).select("vec_id", "place", F.round("sample", 9).alias("sample"))


SQL_MONO = f"""WITH v AS (SELECT vec_id, list_transform({X}, lambda a: round(a * 1000)) AS x FROM embeddings), b AS (SELECT vec_id, x, unnest(range(32)) AS place FROM v)
    SELECT vec_id, place::INT AS place, round((x[2 * place + 1] + x[2 * place + 2]) / 2 / 32768, 9) AS sample FROM b"""


def wav_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lengths as sample counts: how many frames a file of so many samples gives, and the time of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = win.frame_count(F.col("n_chars"), 512)
    return docs.select("doc_id", n.cast("bigint").alias("n_frames"), win.frame_time(F.lit(1000).cast("bigint"), n - 1, 512, F.lit(44100)).alias("last_ms"))


SQL_COUNT = "WITH n AS (SELECT doc_id, ceil((n_chars + 2560) / 512)::BIGINT AS n FROM documents) SELECT doc_id, n AS n_frames, (1000 + ((n - 1) * 512 * 1000) // 44100)::BIGINT AS last_ms FROM n"


def harmonic_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    probabilities = F.transform("x", lambda a: F.least(F.abs(a) * 3.0, F.lit(1.0)))
    out = notes.harmonic_sieve(_vectors(spark, sf_dir).withColumn("p", probabilities), "p")
    return out.select("vec_id", F.posexplode("sieved").alias("bin", "p")).select("vec_id", "bin", F.round("p", 6).alias("p"))


SQL_SIEVE = f"""WITH v AS (SELECT vec_id, list_transform({X}, lambda a: least(abs(a) * 3, 1)) AS x FROM embeddings), b AS (SELECT vec_id, x, unnest(range(64)) AS bin FROM v), e AS (SELECT vec_id, bin, x[bin + 1] AS p FROM b),
    h AS (SELECT *, unnest(range(2, 7)) AS h FROM e WHERE p > 0.4), t AS (SELECT vec_id, round(69 + 12 * log2(440 * pow(2, (bin + 21 - 69) / 12) * h / 440))::INT - 21 AS bin, p / pow(h, 1.2::DOUBLE) * (1 - 0.0002::DOUBLE * h) AS leak FROM h),
    m AS (SELECT vec_id, bin, max(leak) AS leak FROM t WHERE bin BETWEEN 0 AND 87 GROUP BY ALL)
    SELECT vec_id, bin::INT AS bin, round(CASE WHEN leak > 0 AND p <= leak + 0.15::DOUBLE THEN 0 ELSE p END, 6) AS p FROM e LEFT JOIN m USING (vec_id, bin)"""


def pitch_and_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector outputs over the vectors as frames at 8 kHz: no SQL expresses them."""
    df = _vectors(spark, sf_dir).withColumn("p", spectra.pitch(F.col("x"), F.lit(8000.0), 0.3)).withColumn("two", spectra.polyphony(F.col("x"))).withColumn("m", spectra.magnitude_spectrum(F.col("x")))
    return df.select("vec_id", "p.hz", "p.clarity", F.col("two.ratio").alias("second"), spectra.bark_loudness(F.col("m"), 44100.0).alias("sones"), spectra.note_sones(F.col("m"), F.lit(69), 44100.0).alias("a4_sones"), F.size(spectra.log_mel(F.col("x"), 20, 16000)).alias("n_mel"))


def filtered_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as hops of a stream: band-passed with registers carried from hop to hop."""
    df = win.numbered(_vectors(spark, sf_dir), "label", "vec_id")
    hops = df.select(F.col("label").alias("stream_id"), F.col("frame_idx").alias("hop_idx"), F.lit(8000).alias("sample_rate"), F.col("x").alias("samples"))
    return spectra.filtered(hops, 200.0, 2000.0).select("stream_id", "hop_idx", signal.loudness(F.col("samples")).alias("dbfs"), "thump_dbfs")


def key_sones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as spectra at 44.1 kHz and as activations of 64 keys: sones of the keys that sound, or sounded in the label's vector before."""
    df = win.numbered(_vectors(spark, sf_dir), "label", "vec_id").withColumn("ts_ms", F.col("frame_idx") * 20)
    keys = F.map_from_arrays(F.sequence(F.lit(21), F.lit(84)), F.transform("x", lambda a: F.struct(F.lit(0.0).alias("onset"), (F.abs(a) * 3.0).alias("frame"))))
    activations = df.select(F.col("label").alias("stream_id"), "ts_ms", "vec_id", keys.alias("keys"))
    spectra_ = df.select(F.col("label").alias("stream_id"), "ts_ms", F.transform("x", F.abs).alias("magnitudes"))
    loud = samples.with_loudness(activations, spectra_, 44100.0, 0.7)
    return loud.select("vec_id", F.explode("sones").alias("midi", "sones")).select("vec_id", "midi", F.round("sones", 6).alias("sones"))


SQL_SONES = f"""WITH v AS (SELECT vec_id, list_transform({X}, lambda a: abs(a)) AS m, lag({X}) OVER (PARTITION BY label ORDER BY vec_id) AS l FROM embeddings), z AS (SELECT unnest({list(dsp.BARK_HZ)}::DOUBLE[]) AS hz, unnest(range(25)) AS z),
    e AS (SELECT z, greatest(1, least(64, round_even(hz * 128 / 44100, 0)::INT)) AS edge, hz FROM z), b AS (SELECT a.z, a.edge AS low, greatest(b.edge, a.edge + 1) AS high, greatest((a.hz + b.hz) / 2000, 0.02) AS k FROM e a JOIN e b ON b.z = a.z + 1),
    q AS (SELECT z, pow(10::DOUBLE, (3.64::DOUBLE * pow(k, -0.8::DOUBLE) - 6.5::DOUBLE * exp(-0.6::DOUBLE * pow(k - 3.3::DOUBLE, 2)) + 1e-3::DOUBLE * pow(k, 4) - 94) / 10) AS quiet FROM b),
    i AS (SELECT i, (SELECT min(z) FROM b WHERE low <= i AND i < high) AS z FROM range(64) r(i)), p AS (SELECT vec_id, i.i, i.z, m[i.i + 1] * m[i.i + 1] AS w FROM v, i WHERE z IS NOT NULL), t AS (SELECT vec_id, z, sum(w) AS w FROM p GROUP BY ALL),
    s AS (SELECT t.vec_id, b.z, sum(t.w / 16384 * CASE WHEN b.z >= t.z THEN pow(10::DOUBLE, -1.2::DOUBLE * (b.z - t.z)) ELSE pow(10::DOUBLE, -2.7::DOUBLE * (t.z - b.z)) END) / any_value(q.quiet) AS r FROM t, b JOIN q ON q.z = b.z GROUP BY ALL),
    n AS (SELECT s.vec_id, s.z, CASE WHEN r > 1 AND w > 0 THEN 0.08::DOUBLE * (pow(1 + r, 0.23::DOUBLE) - 1) / w ELSE 0 END AS per FROM s JOIN t ON t.vec_id = s.vec_id AND t.z = s.z),
    h AS (SELECT DISTINCT k + 21 AS midi, round_even(440 * pow(2::DOUBLE, (k + 21 - 69) / 12.0::DOUBLE) * h * 128 / 44100, 0)::INT + d AS i FROM range(64) a(k), range(1, 13) c(h), (VALUES (-1), (0), (1)) f(d)),
    a AS (SELECT vec_id, unnest(list_distinct(list_filter(range(21, 85), lambda k: m[k - 20] * 3 >= 0.7::DOUBLE) || list_filter(range(21, 85), lambda k: l IS NOT NULL AND abs(l[k - 20]) * 3 >= 0.7::DOUBLE))) AS midi FROM v)
    SELECT a.vec_id, a.midi::INT AS midi, round(coalesce(sum(w * per), 0), 6) AS sones FROM a LEFT JOIN h ON h.midi = a.midi LEFT JOIN p ON p.vec_id = a.vec_id AND p.i = h.i LEFT JOIN n ON n.vec_id = p.vec_id AND n.z = p.z GROUP BY a.vec_id, a.midi"""


def wav_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as a file of 16-bit samples, written and read back in ranges of 64 KB: the energy of each hop."""
    values = _vectors(spark, sf_dir).select(F.col("label").alias("stream_id"), F.col("vec_id").alias("idx"), F.transform("x", lambda v: F.floor(v * 1000)).alias("value"))
    files = fresh_path(spark, "wavs")
    wav.write_wavs(values, files, 44100).write.format("noop").mode("overwrite").save()
    energy = F.aggregate("samples", F.lit(0).cast("bigint"), lambda a, v: a + F.round(v * 32768 * v * 32768).cast("bigint"))
    return wav.read_wav(spark, files, 1 << 16).select(F.regexp_extract("stream_id", r"([^/]+)\.wav$", 1).alias("label"), "hop_idx", "sample_rate", energy.alias("energy"))


SQL_WAV = """WITH v AS (SELECT label::VARCHAR AS label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, count(*) OVER (PARTITION BY label) * 64 AS n, embedding, unnest(range(64)) AS i FROM embeddings),
    s AS (SELECT label, n, (rn * 64 + i) // 512 AS hop, floor(CAST(embedding[i + 1] AS DOUBLE) * 1000)::BIGINT AS q FROM v), e AS (SELECT label, hop, sum(q * q)::BIGINT AS energy FROM s GROUP BY ALL),
    h AS (SELECT label, unnest(range((n + 5 * 512 + 511) // 512)) AS hop_idx FROM (SELECT DISTINCT label, n FROM s)) SELECT h.label, hop_idx, 44100::INT AS sample_rate, coalesce(energy, 0) AS energy FROM h LEFT JOIN e ON h.label = e.label AND h.hop_idx = e.hop"""


QUERIES = {
    "frame_features": (frame_features, SQL_FEATURES), "spectral_flux": (spectral_flux, SQL_FLUX), "magnitude_spectrum": (magnitude_bins, SQL_SPECTRUM), "overlapping_frames": (overlapping_frames, SQL_FRAMES), "mel_context": (mel_context, SQL_CONTEXT),
    "stereo_to_mono": (stereo_to_mono, SQL_MONO), "wav_frame_count": (wav_frame_count, SQL_COUNT), "harmonic_sieve": (harmonic_sieve, SQL_SIEVE), "pitch_and_loudness": (pitch_and_loudness, None), "filtered_hops": (filtered_hops, None), "wav_energy": (wav_energy, SQL_WAV), "key_sones": (key_sones, SQL_SONES),
}

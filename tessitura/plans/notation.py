"""Queries of theory and score tables over ``part``, ``lineitem``, ``orders``, ``customer``, ``supplier``, ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.functions import theory
from tessitura.functions.profiles import instrument_profiles, profile
from tessitura.operators import library, measures
from tessitura.plans.events import case_sql, phons_sql
from tessitura.tables import fresh_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz = F.col("p_retailprice")
    midi = theory.hz_to_midi(hz)
    return _read(spark, sf_dir, "part").select(
        "p_partkey", midi.alias("midi"), theory.midi_index(hz * 20).alias("high_midi"), theory.pitch_class(midi).alias("pitch"), theory.octave(midi).alias("octave"), theory.cents_off(hz).alias("cents"),
        F.round(theory.midi_to_hz(midi, theory.cents_off(hz)), 4).alias("back_hz"), theory.pitch_label(hz).alias("label"), theory.midi_of(theory.pitch_class(midi), theory.octave(midi)).alias("midi_again"),
    )


PITCH_LIST = "[" + ", ".join(f"'{p}'" for p in theory.PITCHES) + "]"
SQL_NOTE_NAMES = f"""WITH n AS (SELECT p_partkey, p_retailprice AS hz, 69 + 12 * log2(p_retailprice / 440) AS n, 69 + 12 * log2(p_retailprice * 20 / 440) AS h FROM part),
    m AS (SELECT *, round(n)::INT AS midi, round((n - round(n)) * 100)::INT AS cents FROM n), o AS (SELECT *, {PITCH_LIST}[midi % 12 + 1] AS pitch, midi // 12 - 1 AS octave FROM m)
    SELECT p_partkey, midi, CASE WHEN round(h) BETWEEN 0 AND 127 THEN round(h)::INT END AS high_midi, pitch, octave::INT AS octave, cents, round(440 * pow(2, (midi - 69) / 12 + cents / 1200), 4) AS back_hz,
    CASE WHEN hz BETWEEN 20 AND 5000 THEN pitch || octave || CASE WHEN cents >= 0 THEN '+' ELSE '' END || cents ELSE '---' END AS label, midi AS midi_again FROM o"""


def scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz, sones = F.col("p_retailprice") * 5.0, F.col("p_size") / 10.0
    phons = theory.sones_to_phons(sones)
    return _read(spark, sf_dir, "part").select(
        "p_partkey", F.round(theory.slaney_mel(hz), 6).alias("mel"), F.round(theory.slaney_hz(theory.slaney_mel(hz)), 4).alias("hz"), theory.bark_band(hz).alias("bark"), F.round(phons, 6).alias("phons"), theory.level_from_phons(phons).alias("level")
    )


BARK = "CASE WHEN hz < 20 THEN 0 WHEN hz >= 15500 THEN 23 ELSE len(list_filter([" + ", ".join(map(str, theory.BARK_EDGES[1:-1])) + "], lambda e: hz >= e)) END"
SQL_SCALES = f"""WITH p AS (SELECT p_partkey, p_retailprice * 5 AS hz, p_size / 10 AS s FROM part), m AS (SELECT *, CASE WHEN hz < 1000 THEN 3 * hz / 200 ELSE 15 + 27 * ln(hz / 1000) / ln(6.4::DOUBLE) END AS mel FROM p)
    SELECT p_partkey, round(mel, 6) AS mel, round(hz, 4) AS hz, ({BARK})::INT AS bark, round({phons_sql("s")}, 6) AS phons, {case_sql(phons_sql("s"), theory.PHON_CUTS)} AS level FROM m"""


def loudness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, db, crest = (F.col("l_quantity") * 2 + 20).cast("int"), F.col("l_quantity") - 50.0, F.col("l_discount") * 200.0
    percent = F.col("l_quantity") * 2.5
    return _read(spark, sf_dir, "lineitem").groupBy(v.alias("v"), db.alias("db"), crest.alias("crest"), percent.alias("percent")).count().select(
        F.col("v").alias("velocity"), F.round("crest", 4).alias("crest"), "count", theory.level_from_dbfs(F.col("db")).alias("by_dbfs"), theory.level_from_velocity(F.col("v")).alias("by_velocity"), theory.level_from_percent(F.col("percent")).alias("by_percent"),
        theory.midi_velocity(F.col("db"), F.col("crest")).alias("midi_velocity"), theory.override_velocity(F.col("percent")).alias("override"), theory.velocity_from_level(theory.level_from_dbfs(F.col("db"))).alias("default_velocity"), theory.meter(F.col("db")).alias("meter"),
    )


DEFAULT_VELOCITY = "CASE by_dbfs " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in theory.LEVEL_VELOCITY.items()) + " END"
SQL_LEVELS = f"""WITH l AS (SELECT (l_quantity * 2 + 20)::INT AS velocity, l_quantity - 50 AS db, l_discount * 200 AS crest, l_quantity * 2.5::DOUBLE AS percent, count(*) AS count FROM lineitem GROUP BY ALL),
    n AS (SELECT *, {case_sql("db", theory.DBFS_CUTS)} AS by_dbfs, round((least(greatest(db, -60), 0) + 60) / 60 * 16)::INT AS bars FROM l)
    SELECT velocity, round(crest, 4) AS crest, count, by_dbfs, {case_sql("velocity", theory.VELOCITY_CUTS, op="<=")} AS by_velocity, {case_sql("percent", theory.PERCENT_CUTS)} AS by_percent,
    least(greatest(round((least(greatest((db + 55) / 50, 0), 1) * 0.85::DOUBLE + least(greatest((crest - 6) / 18, 0), 0.2::DOUBLE)) * 127), 1), 127)::INT AS midi_velocity, trunc(least(greatest(percent / 100 * 90, 1), 127))::INT AS override,
    {DEFAULT_VELOCITY} AS default_velocity, '[' || repeat('\u2588', bars) || repeat('\u2591', 16 - bars) || '] ' || lpad(format('{{:.1f}}', db), 5, ' ') || ' dBFS' AS meter FROM n"""


def articulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a note, classified by the profile of an instrument that its part's size picks: a broadcast of the small dimension."""
    names = [F.lit(x) for x in ("Piano", "Violin", "Flute", "Tuba", "Generic")]
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50.0).alias("seconds"), (F.col("l_tax") * 2000.0).alias("slope"), (F.col("l_discount") / 4).alias("rise"), (F.col("l_tax") * 250.0).alias("crest"), (F.col("l_quantity") * 2 + 20).cast("int").alias("velocity"), (F.col("l_returnflag") == "A").alias("legato"))
    lines = lines.withColumn("instrument", F.element_at(F.array(*names), (F.col("l_partkey") % 5 + 1).cast("int")))
    p = {c: F.col(c) for c in profile("Piano")}
    df = lines.join(F.broadcast(instrument_profiles(spark)), "instrument")
    kind = theory.articulation(F.col("seconds"), F.col("legato"), F.col("slope"), F.col("rise"), F.col("crest"), F.col("velocity"), p)
    df = df.select("instrument", kind.alias("articulation"), theory.mashed(F.col("crest"), F.lit(-18.0), p).alias("is_mashed"), theory.damping(F.col("seconds"), p).alias("damping"), theory.intonation((F.col("velocity") % 41 - 20), F.col("flat_cents"), F.col("sharp_cents")).alias("intonation"))
    return df.groupBy("instrument", "articulation", "is_mashed", "damping", "intonation").agg(F.count(F.lit(1)).alias("n"))


PROFILE_ROWS = ", ".join(str(tuple(p[c] for c in ("instrument", "stacc_max_s", "tenuto_min_s", "rise_max_s", "rise_min_slope", "mash_crest", "mash_thump", "flat_cents", "sharp_cents"))) for p in map(profile, ("Piano", "Violin", "Flute", "Tuba", "Generic")))
SQL_ARTICULATIONS = f"""WITH p(instrument, stacc, tenuto, rise_max, min_slope, m_crest, m_thump, flat, sharp) AS (VALUES {PROFILE_ROWS}), l AS (SELECT ['Piano', 'Violin', 'Flute', 'Tuba', 'Generic'][l_partkey % 5 + 1] AS instrument,
    l_quantity / 50 AS s, l_tax * 2000 AS slope, l_discount / 4 AS rise, l_tax * 250 AS crest, (l_quantity * 2 + 20)::INT AS v, l_returnflag = 'A' AS legato FROM lineitem)
    SELECT instrument, CASE WHEN legato THEN 'Legato' WHEN (slope >= min_slope::DOUBLE * 100 AND rise <= rise_max::DOUBLE) OR (v >= 90 AND crest >= 15) THEN 'Marcato' WHEN s <= stacc::DOUBLE THEN 'Staccato' WHEN s >= tenuto::DOUBLE THEN 'Tenuto' ELSE 'Normal' END AS articulation,
    crest >= m_crest::DOUBLE AND -18 >= m_thump::DOUBLE AS is_mashed, CASE WHEN s >= tenuto::DOUBLE THEN 'PedalSustained' WHEN s <= stacc::DOUBLE THEN 'DryDamped' ELSE 'HalfPedal' END AS damping,
    CASE WHEN v % 41 - 20 < flat THEN 'Flat' WHEN v % 41 - 20 > sharp THEN 'Sharp' ELSE 'InTune' END AS intonation, count(*) AS n FROM l JOIN p USING (instrument) GROUP BY ALL"""


def pitch_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies outside the instrument's range become 0."""
    df = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("hz")).crossJoin(F.broadcast(instrument_profiles(spark).where("instrument = 'Violin'")))  # one row
    return df.select("p_partkey", F.when(F.col("hz").between(F.col("f0_min_hz"), F.col("f0_max_hz")), F.col("hz")).otherwise(0.0).alias("hz"))


SQL_RANGE = "SELECT p_partkey, CASE WHEN p_retailprice BETWEEN 196 AND 3136 THEN p_retailprice ELSE 0 END AS hz FROM part"


def voicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hz, clarity, db = F.col("l_extendedprice") / 10.0, F.col("l_discount") * 10.0, F.col("l_quantity") - 90.0
    df = _read(spark, sf_dir, "lineitem").select(((clarity >= 0.4) & (hz > 20) & (hz < 4500) & (db >= -65.0)).alias("voiced"), ((clarity >= 0.7) & (F.col("l_tax") * 10 <= 0.55)).alias("mono"))
    return df.groupBy("voiced", "mono").agg(F.count(F.lit(1)).alias("n"))


SQL_VOICING = "SELECT l_discount * 10 >= 0.4::DOUBLE AND l_extendedprice / 10 > 20 AND l_extendedprice / 10 < 4500 AND l_quantity - 90 >= -65 AS voiced, l_discount * 10 >= 0.7::DOUBLE AND l_tax * 10 <= 0.55::DOUBLE AS mono, count(*) AS n FROM lineitem GROUP BY ALL"


def direction_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    df = _read(spark, sf_dir, "conversations").select(words).unionByName(spark.createDataFrame([(w,) for w in ("rit.", "poco rall.", "accel.", "a tempo", "cresc.", "crescendo molto", "dim.", "decresc.", "D.C.", "da capo al fine", "D.S.", "Fine", "To Coda", "mf", "sfz", "dolce")], "word string"))
    return df.groupBy(theory.direction_kind(F.col("word")).alias("kind"), F.coalesce(theory.level_from_word(F.col("word")), F.lit("-")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


WORD_LEVELS = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**{x: x for x in theory.LEVELS}, **theory.WORD_LEVEL}.items()) + " END"
SQL_DIRECTIONS = f"""WITH a AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM conversations UNION ALL SELECT lower(unnest(['rit.', 'poco rall.', 'accel.', 'a tempo', 'cresc.', 'crescendo molto', 'dim.', 'decresc.', 'D.C.', 'da capo al fine', 'D.S.', 'Fine', 'To Coda', 'mf', 'sfz', 'dolce'])))
    SELECT CASE WHEN contains(w, 'rit') OR contains(w, 'rall') THEN 'Ritardando' WHEN contains(w, 'accel') THEN 'Accelerando' WHEN contains(w, 'a tempo') OR contains(w, 'tempo i') OR contains(w, 'tempo primo') THEN 'ATempo' WHEN w = 'cresc.' OR contains(w, 'crescendo') THEN 'Crescendo'
    WHEN w = 'dim.' OR contains(w, 'diminuendo') OR contains(w, 'decresc') THEN 'Diminuendo' WHEN w = 'd.c.' OR contains(w, 'da capo') THEN 'DaCapo' WHEN w = 'd.s.' OR contains(w, 'dal segno') THEN 'DalSegno' WHEN w = 'fine' THEN 'Fine' WHEN contains(w, 'to coda') THEN 'ToCoda'
    WHEN ({WORD_LEVELS}) IS NOT NULL THEN 'Dynamic' ELSE 'Words' END AS kind, coalesce({WORD_LEVELS}, '-') AS level, count(*) AS n FROM a GROUP BY ALL"""


def volta_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volta texts made of order numbers, asked for the passes 1 to 4."""
    k = F.col("o_orderkey")
    text = F.concat((k % 4 + 1).cast("string"), F.when(k % 3 == 0, ".").otherwise(""), F.when(k % 2 == 0, F.concat(F.lit(", "), (k % 3 + 1).cast("string"), F.lit("-"), (k % 3 + 2).cast("string"))).otherwise(F.when(k % 5 == 0, " 3").otherwise("")))
    df = _read(spark, sf_dir, "orders").select("o_orderkey", text.alias("number"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("pass"))
    return df.select("o_orderkey", "pass", theory.ending_includes("number", "pass").alias("included"))


SQL_VOLTAS = """WITH t AS (SELECT o_orderkey, (o_orderkey % 4 + 1)::VARCHAR || CASE WHEN o_orderkey % 3 = 0 THEN '.' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN ', ' || (o_orderkey % 3 + 1) || '-' || (o_orderkey % 3 + 2) WHEN o_orderkey % 5 = 0 THEN ' 3' ELSE '' END AS number FROM orders),
    p AS (SELECT *, unnest([1, 2, 3, 4]) AS pass FROM t)
    SELECT o_orderkey, pass, list_bool_or(list_transform(list_transform(string_split(number, ','), lambda x: rtrim(trim(x), '.')), lambda x: coalesce(TRY_CAST(x AS INT) = pass, false) OR (contains(x, '-') AND coalesce(TRY_CAST(split_part(x, '-', 1) AS INT) <= pass AND pass <= TRY_CAST(split_part(x, '-', 2) AS INT), false)))) AS included FROM p"""


def tempo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").groupBy(theory.tempo_name(F.col("p_size") * 5).alias("tempo")).agg(F.count(F.lit(1)).alias("n"))


SQL_TEMPO = "SELECT " + case_sql("p_size * 5", tuple(t[0] for t in theory.TEMPO_NAMES), (*(t[1] for t in theory.TEMPO_NAMES), theory.FASTEST)) + " AS tempo, count(*) AS n FROM part GROUP BY ALL"


def sounding_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    step = F.element_at(F.array(*[F.lit(x) for x in "CDEFGAB"]), (k % 7 + 1).cast("int"))
    shift = theory.octave_shift(F.element_at(F.array(*[F.lit(x) for x in ("down", "up", "stop", "continue")]), (F.col("l_suppkey") % 4 + 1).cast("int")), F.when(k % 2 == 0, 15).otherwise(8), F.lit(12))
    midi = theory.sounding_midi(step, (k % 3 - 1).cast("int"), (F.col("l_linenumber")).cast("int"), theory.transpose((k % 5 - 2).cast("int"), F.lit(-1)), shift)
    return _read(spark, sf_dir, "lineitem").groupBy(midi.alias("midi")).agg(F.count(F.lit(1)).alias("n"))


SQL_SOUNDING = """SELECT least(greatest((l_linenumber + 1) * 12 + [0, 2, 4, 5, 7, 9, 11][l_partkey % 7 + 1] + l_partkey % 3 - 1 + l_partkey % 5 - 2 - 12 + CASE l_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN 0 ELSE 2 END *
    CASE WHEN l_suppkey % 4 = 3 THEN 6 WHEN l_partkey % 2 = 0 THEN 24 ELSE 12 END, 0), 127)::INT AS midi, count(*) AS n FROM lineitem GROUP BY ALL"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    return _read(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(w))


SQL_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS ord FROM lineitem)"


def cursor_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as elements of a measure: some go back, some are chord notes."""
    delta = F.when(F.col("l_returnflag") == "A", -F.col("l_quantity") * 2).otherwise(F.col("l_quantity")).cast("bigint")
    df = _lines(spark, sf_dir).select("l_orderkey", "ord", delta.alias("delta"), ((F.col("l_partkey") % 4 == 0) & (F.col("ord") > 1)).alias("chord"))
    return measures.positions(df, ["l_orderkey"], ["ord"], "delta", "chord").select("l_orderkey", "ord", "start")


SQL_CURSOR = f"""WITH RECURSIVE {SQL_LINES}, e AS (SELECT l_orderkey, ord, CASE WHEN l_returnflag = 'A' THEN -l_quantity * 2 ELSE l_quantity END::BIGINT AS delta, l_partkey % 4 = 0 AND ord > 1 AS chord FROM l),
    r AS (SELECT l_orderkey, ord, 0::BIGINT AS start, greatest(0, delta)::BIGINT AS cur FROM e WHERE ord = 1
    UNION ALL SELECT e.l_orderkey, e.ord, CASE WHEN e.chord THEN r.start ELSE r.cur END, CASE WHEN e.chord THEN r.cur ELSE greatest(0, r.cur + e.delta) END FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.ord = r.ord + 1)
    SELECT l_orderkey, ord::INT AS ord, start FROM r"""


def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).withColumn("dynamic", F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))).withColumn("tempo", F.when(F.col("l_linestatus") == "O", F.col("l_partkey")))
    part, order = ["l_suppkey"], ("l_orderkey", "ord")
    return df.select("l_orderkey", "ord", measures.carried(df, "dynamic", part, *order).alias("dynamic"), measures.carried(df, "tempo", part, *order).alias("tempo"))


SQL_CARRIED = f"""WITH {SQL_LINES} SELECT l_orderkey, ord::INT AS ord, last_value(CASE WHEN l_returnflag = 'A' THEN l_quantity END IGNORE NULLS) OVER w AS dynamic, last_value(CASE WHEN l_linestatus = 'O' THEN l_partkey END IGNORE NULLS) OVER w AS tempo
    FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def note_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).select("l_orderkey", "ord", F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("bigint").alias("end"), "l_partkey")
    out = measures.clusters(df, ["l_orderkey"], "start", "end", ["ord"], "l_partkey")
    return out.select("l_orderkey", "start", "size", "is_chord", "max_end", F.array_join(F.col("values").cast("array<string>"), ",").alias("parts"))


SQL_CLUSTERS = f"WITH {SQL_LINES} SELECT l_orderkey, l_linenumber AS start, count(*) AS size, count(*) > 1 AS is_chord, max(l_linenumber + l_quantity)::BIGINT AS max_end, string_agg(l_partkey::VARCHAR, ',' ORDER BY ord) AS parts FROM l GROUP BY l_orderkey, l_linenumber"


def distinct_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.distinct_in_order(_lines(spark, sf_dir), ["l_orderkey", "l_returnflag", "l_linestatus"], "ord")


SQL_DISTINCT = f"WITH {SQL_LINES} SELECT l_orderkey, l_returnflag, l_linestatus, min(ord)::INT AS ord FROM l GROUP BY ALL"


def content_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("RepeatStart", "Attribute", "Note", "Rest", "RepeatEnd", "Jump")]), (F.col("l_partkey") % 6 + 1).cast("int"))
    df = _lines(spark, sf_dir).withColumn("kind", kind)
    place, rank = measures.content_order(F.col("kind"), F.col("l_quantity").cast("bigint"))
    w = Window.partitionBy("l_orderkey").orderBy(place, rank, "ord")
    return df.select("l_orderkey", "ord", "kind", F.row_number().over(w).alias("place"))


SQL_CONTENT = f"""WITH {SQL_LINES}, k AS (SELECT l_orderkey, ord, l_quantity, ['RepeatStart', 'Attribute', 'Note', 'Rest', 'RepeatEnd', 'Jump'][l_partkey % 6 + 1] AS kind FROM l)
    SELECT l_orderkey, ord::INT AS ord, kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN kind = 'RepeatStart' THEN 0 WHEN kind IN ('RepeatEnd', 'Jump') THEN 4294967294 ELSE l_quantity END,
    CASE kind WHEN 'RepeatStart' THEN 0 WHEN 'Attribute' THEN 1 WHEN 'Note' THEN 2 WHEN 'Rest' THEN 3 ELSE 4 END, ord)::INT AS place FROM k"""


def struck_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that strike anew: neither tied on nor tied off."""
    tie = F.element_at(F.array(*[F.lit(x) for x in ("None", "Start", "Stop", "Continue")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "lineitem").withColumn("tie", tie).where(~F.col("tie").isin("Stop", "Continue")).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


SQL_STRUCK = "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 4 < 2 GROUP BY 1"


def chosen_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.parts_for(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), "c_nationkey", "c_mktsegment", "Build").select("c_custkey", "chosen")


SQL_PARTS = "SELECT c_custkey, contains(lower(c_mktsegment), 'build') OR NOT bool_or(contains(lower(c_mktsegment), 'build')) OVER w OR count(*) OVER w = 1 AS chosen FROM customer WINDOW w AS (PARTITION BY c_nationkey)"


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as part lists with groups."""
    kind = F.when(F.col("s_suppkey") % 5 == 0, "start").when(F.col("s_suppkey") % 5 == 4, "stop").otherwise("part")
    df = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", kind.alias("kind"), F.concat(F.lit(" Group "), (F.col("s_suppkey") % 3).cast("string")).alias("grp"), F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.col("s_name")).alias("name"))
    return measures.part_names(df, "s_nationkey", "s_suppkey", "kind", "grp", "name").select("s_suppkey", "full_name")


SQL_PART_NAMES = """WITH k AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 5 WHEN 0 THEN 'start' WHEN 4 THEN 'stop' ELSE 'part' END AS kind, 'Group ' || (s_suppkey % 3) AS grp, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS name FROM supplier),
    g AS (SELECT *, nullif(last_value(CASE kind WHEN 'start' THEN grp WHEN 'stop' THEN '-' END IGNORE NULLS) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '-') AS g FROM k)
    SELECT s_suppkey, CASE WHEN g IS NULL THEN name WHEN name = '' THEN g WHEN contains(lower(name), lower(g)) THEN name ELSE g || ' - ' || name END AS full_name FROM g WHERE kind = 'part'"""


def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as input configurations of their supplier as device."""
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    df = _read(spark, sf_dir, "lineitem").select("l_suppkey", pick((1, 2, 4, 6), F.col("l_partkey")).alias("channels"), pick((44100, 48000, 96000, 16000), F.col("l_orderkey")).alias("rate"), pick(("F32", "I32", "I16", "U16"), F.col("l_linenumber")).alias("format"))
    return measures.first_config(df.distinct(), "l_suppkey")


SQL_CONFIG = """WITH c AS (SELECT DISTINCT l_suppkey, [1, 2, 4, 6][l_partkey % 4 + 1] AS channels, [44100, 48000, 96000, 16000][l_orderkey % 4 + 1] AS rate, ['F32', 'I32', 'I16', 'U16'][l_linenumber % 4 + 1] AS format FROM lineitem),
    t AS (SELECT *, CASE WHEN channels <= 2 AND rate IN (44100, 48000) THEN 1 WHEN rate IN (44100, 48000) THEN 2 WHEN channels <= 2 THEN 3 ELSE 4 END::INT AS tier FROM c)
    SELECT l_suppkey, channels, rate, format, tier FROM t QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY tier, CASE WHEN tier >= 3 THEN -rate ELSE 0 END, list_position(['F32', 'I32', 'I16', 'U16'], format), rate, channels) = 1"""


def device_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.find_device(_read(spark, sf_dir, "supplier"), "s_name", "s_suppkey", "#000000012").select("s_suppkey", "s_name", "rank")


SQL_DEVICE = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey::VARCHAR = '#000000012' THEN 1 WHEN lower(s_name) = '#000000012' THEN 2 WHEN contains(lower(s_name), '#000000012') THEN 3 END::INT AS rank FROM supplier WHERE contains(lower(s_name), '#000000012') ORDER BY rank, s_suppkey LIMIT 1"


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as saved sheets."""
    return _read(spark, sf_dir, "part").select(
        theory.sheet_path(F.concat(F.lit("C:\\scores/"), F.col("p_name"), F.lit(".v1.mxl"))).alias("mxl"), F.lit("").alias("pdf_icon"), F.col("p_name").alias("title"), F.col("p_brand").alias("composer"), F.col("p_size").cast("bigint").alias("song_length_bars"),
        F.col("p_type").alias("genres"), theory.joined_names(F.array(F.lit("Piano"), F.col("p_type"), F.lit(""))).alias("instruments"), F.col("p_partkey").alias("saved_at"),
    )


SQL_SHEETS = """s AS (SELECT mxl, pdf_icon, title, composer, bars AS song_length_bars, genres, instruments, saved_at FROM (SELECT p_name || '.v1.xml' AS mxl, '' AS pdf_icon, p_name AS title, p_brand AS composer, p_size::BIGINT AS bars, p_type AS genres, 'Piano, ' || p_type || ', ' AS instruments, p_partkey AS saved_at FROM part))"""


def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets, then the ones of even key saved again later, of which every third is new."""
    table = library.upsert(sheets(spark, sf_dir).limit(0), sheets(spark, sf_dir), "mxl", "saved_at")
    again = sheets(spark, sf_dir).where("saved_at % 2 = 0").withColumn("mxl", F.when(F.col("saved_at") % 3 == 0, F.concat(F.lit("new-"), F.col("mxl"))).otherwise(F.col("mxl"))).withColumn("saved_at", F.col("saved_at") + 1_000_000)
    return library.upsert(table, again, "mxl", "saved_at").select("mxl", "title", "saved_at")


SQL_UPSERT = f"""WITH {SQL_SHEETS}, a AS (SELECT mxl, title, saved_at, 0 AS new FROM s UNION ALL SELECT CASE WHEN saved_at % 3 = 0 THEN 'new-' || mxl ELSE mxl END, title, saved_at + 1000000, 1 FROM s WHERE saved_at % 2 = 0)
    SELECT mxl, title, saved_at FROM a QUALIFY row_number() OVER (PARTITION BY mxl ORDER BY new DESC, saved_at DESC) = 1"""


def library_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sheets(spark, sf_dir)
    return library.delete(table, table.where("saved_at % 10 = 0")).select("mxl", "saved_at")


SQL_DELETE = f"WITH {SQL_SHEETS} SELECT mxl, saved_at FROM s WHERE mxl NOT IN (SELECT mxl FROM s WHERE saved_at % 10 = 0)"


def library_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have labels."""
    labels = _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "mxl")
    return library.exists(labels, _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("mxl"))).select(F.col("mxl").alias("doc_id"), "saved")


SQL_EXISTS = "SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS saved FROM documents d"


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = library.search(sheets(spark, sf_dir), " brand#1 ", "title", "composer")
    return library.page(found, 2, 10, F.desc("saved_at"), "mxl").select("mxl", "composer", "saved_at")


SQL_SEARCH = f"WITH {SQL_SHEETS} SELECT mxl, composer, saved_at FROM s WHERE contains(lower(title), 'brand#1') OR contains(lower(composer), 'brand#1') ORDER BY saved_at DESC, mxl LIMIT 20"


def library_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(theory.split_names(F.col("instruments")))).alias("names"))


SQL_LIBRARY_COUNT = f"WITH {SQL_SHEETS} SELECT count(*) AS n, sum(len(list_filter(string_split(instruments, ', '), lambda x: trim(x) <> '')))::BIGINT AS names FROM s"


def search_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON response built of parts, read back as rows."""
    body = F.to_json(F.struct(F.create_map(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("song_length.bars"), F.array(F.lit("Piano"), F.col("p_type")).alias("instruments"), F.col("p_brand").alias("composer"))).alias("results")))
    return library.search_results(_read(spark, sf_dir, "part").select(body.alias("body"))).select("title", "composer", "song_length_bars", F.array_join("instruments", ",").alias("instruments"))


SQL_RESPONSE = "SELECT p_name AS title, p_brand AS composer, p_size AS song_length_bars, 'Piano,' || p_type AS instruments FROM part"


def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole library, the sheet saved last first, with each sheet's place."""
    ranked = library.page(sheets(spark, sf_dir), 1 << 20, 1 << 10, F.desc("saved_at"), "mxl").select("mxl", "composer", "saved_at")
    return library.placed(ranked, "place", F.desc("saved_at"), "mxl")


SQL_LISTING = f"WITH {SQL_SHEETS} SELECT mxl, composer, saved_at, row_number() OVER (ORDER BY saved_at DESC, mxl) AS place FROM s"


def stored_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets in a stored library: saved, every fifth saved again with a new name, every seventh deleted."""
    own = library.Library(spark, fresh_path(spark, "library"), 16)
    table = sheets(spark, sf_dir).withColumn("mxl", F.concat((F.col("saved_at") % 1000).cast("string"), F.lit("-"), "mxl"))
    own.upsert(table, "saved_at")
    own.upsert(table.where("saved_at % 5 = 0").withColumn("title", F.concat(F.lit("new "), F.col("title"))).withColumn("saved_at", F.col("saved_at") + 1_000_000), "saved_at")
    own.delete(table.where("saved_at % 7 = 0"))
    return own.rows().select("mxl", "title", "saved_at")


SQL_STORED = f"""WITH {SQL_SHEETS.replace("s AS (", "s0 AS (", 1)}, s AS (SELECT * REPLACE ((saved_at % 1000)::VARCHAR || '-' || mxl AS mxl) FROM s0), l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mxl ORDER BY saved_at DESC) = 1), n AS (SELECT mxl, 'new ' || title AS title, saved_at + 1000000 AS saved_at FROM s WHERE saved_at % 5 = 0 QUALIFY row_number() OVER (PARTITION BY mxl ORDER BY saved_at DESC) = 1)
    SELECT l.mxl, coalesce(n.title, l.title) AS title, coalesce(n.saved_at, l.saved_at) AS saved_at FROM l LEFT JOIN n ON l.mxl = n.mxl WHERE l.mxl NOT IN (SELECT mxl FROM s WHERE saved_at % 7 = 0)"""


def attack_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attacks: quantity and discount as levels, the tax as the rise."""
    lines = _read(spark, sf_dir, "lineitem")
    peak, onset, rise = -F.col("l_quantity").cast("double") / 10, -F.col("l_quantity").cast("double") - F.col("l_discount").cast("double"), F.when(F.col("l_linenumber") < 7, F.col("l_tax").cast("double"))
    return lines.select("l_orderkey", "l_linenumber", F.round(theory.attack_slope(peak, onset, rise), 4).alias("slope"))


SQL_SLOPES = "SELECT l_orderkey, l_linenumber, round((l_quantity::DOUBLE + l_discount::DOUBLE - l_quantity::DOUBLE / 10) / CASE WHEN l_linenumber < 7 THEN greatest(l_tax::DOUBLE, 0.001) END, 4) AS slope FROM lineitem"


def score_to_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as marks: their level as a detector names it, articulations, and a name as a command line takes it."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("ppp", "sfz", "mf", "n", "FFF", "x", " p ")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Normal", "Accent", "Marcato", "Legato", "Tenuto")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    level = theory.level_from_mark(mark)
    return _read(spark, sf_dir, "part").select("p_partkey", level.alias("level"), theory.audio_level(level).alias("audio_level"), theory.audio_articulation(kind).alias("audio_articulation"), theory.alias_key(F.concat(F.lit("Alto-"), F.col("p_brand"), F.lit("_x y"))).alias("alias"))


SQL_AUDIO = f"""WITH m AS (SELECT p_partkey, p_brand, lower(trim(['ppp', 'sfz', 'mf', 'n', 'FFF', 'x', ' p '][p_partkey % 7 + 1])) AS mark, ['Normal', 'Accent', 'Marcato', 'Legato', 'Tenuto'][p_partkey % 5 + 1] AS kind FROM part),
    l AS (SELECT *, CASE WHEN mark IN ('ppp', 'pp', 'p', 'mp', 'mf', 'f', 'ff', 'fff') THEN mark {' '.join(f"WHEN mark = '{k}' THEN '{v}'" for k, v in theory.MARK_LEVEL.items())} ELSE 'Other' END AS level FROM m)
    SELECT p_partkey, level, CASE WHEN level = 'Other' THEN 'mf' ELSE level END AS audio_level, CASE WHEN kind = 'Accent' THEN 'Marcato' ELSE kind END AS audio_articulation,
    replace(replace(replace(lower('Alto-' || p_brand || '_x y'), '-', ''), '_', ''), ' ', '') AS alias FROM l"""


def library_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of some keys, with the defaults of a table for what is missing."""
    own = sheets(spark, sf_dir).withColumn("genres", F.lit(None).cast("string")).withColumn("song_length_bars", F.when(F.col("saved_at") % 2 == 0, F.col("song_length_bars")))
    keys = own.where("saved_at % 3 = 0").select("mxl")
    return library.with_defaults(library.by_key(own, keys)).select("mxl", "saved_at", "genres", "song_length_bars")


SQL_BY_KEY = f"WITH {SQL_SHEETS}, k AS (SELECT DISTINCT mxl FROM s WHERE saved_at % 3 = 0) SELECT mxl, coalesce(saved_at, 0) AS saved_at, '' AS genres, CASE WHEN saved_at % 2 = 0 THEN coalesce(song_length_bars, 0) ELSE 0 END AS song_length_bars FROM s WHERE mxl IN (SELECT mxl FROM k)"


def library_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets inserted only where their key is absent."""
    own = sheets(spark, sf_dir)
    return library.insert_absent(own.where("saved_at % 4 != 0"), own.withColumn("saved_at", F.col("saved_at") + 1)).groupBy("mxl").agg(F.count(F.lit(1)).alias("n"), F.max("saved_at").alias("saved_at"))


SQL_INSERTS = f"WITH {SQL_SHEETS}, t AS (SELECT * FROM s WHERE saved_at % 4 <> 0), u AS (SELECT mxl, saved_at FROM t UNION ALL SELECT mxl, saved_at + 1 FROM s WHERE mxl NOT IN (SELECT mxl FROM t)) SELECT mxl, count(*) AS n, max(saved_at) AS saved_at FROM u GROUP BY 1"

QUERIES = {
    "score_to_audio": (score_to_audio, SQL_AUDIO), "library_by_key": (library_by_key, SQL_BY_KEY), "library_inserts": (library_inserts, SQL_INSERTS),
    "note_names": (note_names, SQL_NOTE_NAMES), "pitch_scales": (scales, SQL_SCALES), "loudness_levels": (loudness_levels, SQL_LEVELS), "articulations": (articulations, SQL_ARTICULATIONS), "pitch_range": (pitch_range, SQL_RANGE),
    "voicing": (voicing, SQL_VOICING), "direction_words": (direction_words, SQL_DIRECTIONS), "volta_passes": (volta_passes, SQL_VOLTAS), "tempo_names": (tempo_names, SQL_TEMPO), "sounding_pitch": (sounding_pitch, SQL_SOUNDING),
    "cursor_positions": (cursor_positions, SQL_CURSOR), "carried_state": (carried_state, SQL_CARRIED), "note_clusters": (note_clusters, SQL_CLUSTERS), "distinct_attributes": (distinct_attributes, SQL_DISTINCT),
    "content_order": (content_order, SQL_CONTENT), "struck_notes": (struck_notes, SQL_STRUCK), "chosen_parts": (chosen_parts, SQL_PARTS), "part_names": (part_names, SQL_PART_NAMES), "best_config": (best_config, SQL_CONFIG),
    "device_lookup": (device_lookup, SQL_DEVICE), "library_upsert": (library_upsert, SQL_UPSERT), "library_delete": (library_delete, SQL_DELETE), "library_exists": (library_exists, SQL_EXISTS), "library_search": (library_search, SQL_SEARCH),
    "library_count": (library_count, SQL_LIBRARY_COUNT), "search_response": (search_response, SQL_RESPONSE), "library_listing": (library_listing, SQL_LISTING), "stored_library": (stored_library, SQL_STORED), "attack_slopes": (attack_slopes, SQL_SLOPES),
}

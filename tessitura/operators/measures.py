"""Measures as rows: cursor positions, carried state, clusters, order-preserving distinct rows, part filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(elements: DataFrame, measure: list[str], order: list[str], delta: str, chord: str) -> DataFrame:
    """Adds ``start``: the cursor before each element. Elements move it by ``delta`` (backups are negative), never below 0; a chord element shares the start of
    the one before and does not move it. The cursor is the running sum less its least value so far, where that is negative."""
    w = Window.partitionBy(*measure).orderBy(*order)
    running, chord_ = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), F.coalesce(F.col(chord), F.lit(False))
    df = elements.withColumn("_sum", F.sum(F.when(chord_, 0).otherwise(F.coalesce(F.col(delta).cast("bigint"), F.lit(0)))).over(running))
    df = df.withColumn("_after", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(running)))
    df = df.withColumn("_before", F.when(~chord_, F.coalesce(F.lag("_after").over(w), F.lit(0))))
    return df.withColumn("start", F.coalesce(F.last("_before", ignorenulls=True).over(running), F.lit(0)).cast("bigint")).drop("_sum", "_after", "_before")


def carried(df: DataFrame, column: str, part: list[str], *order: str) -> Column:
    """The last value of ``column`` up to each row that isn't null."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.last(column, ignorenulls=True).over(w)


def clusters(notes: DataFrame, measure: list[str], start: str, end: str, order: list[str], value: str) -> DataFrame:
    """Notes of one start: size, is_chord, max_end and their values in arrival order."""
    return notes.groupBy(*measure, start).agg(F.count(F.lit(1)).alias("size"), F.max(end).alias("max_end"), F.array_sort(F.collect_list(F.struct(*order, value))).alias("_v")).select(
        *measure, start, "size", (F.col("size") > 1).alias("is_chord"), F.coalesce("max_end", start).alias("max_end"), F.col(f"_v.{value}").alias("values")
    )


def distinct_in_order(df: DataFrame, payload: list[str], order: str) -> DataFrame:
    """Equal payloads once, where they first came."""
    return df.groupBy(*payload).agg(F.min(order).alias(order))


def content_order(kind: Column, division: Column) -> tuple[Column, Column]:
    """Sort keys of a measure's content: left repeats and ending starts first, then attributes, notes and rests by division, other repeats last."""
    first, last = kind.isin("RepeatStart", "EndingStart"), kind.isin("RepeatEnd", "EndingStop", "Jump")
    place = F.when(first, 0).when(last, 4294967294).otherwise(division).cast("bigint")
    return place, F.when(first, 0).when(kind == "Attribute", 1).when(kind == "Note", 2).when(kind == "Rest", 3).otherwise(4)


def parts_for(parts: DataFrame, score: str, name: str, target: str) -> DataFrame:
    """Adds ``chosen``: parts whose name contains the target without case; a lone part is always chosen, and all are if none matches."""
    w = Window.partitionBy(score)
    match = F.contains(F.lower(name), F.lit(target.lower()))
    df = parts.withColumn("_m", F.coalesce(match, F.lit(False)))
    return df.withColumn("chosen", F.col("_m") | ~F.max("_m").over(w) | (F.count(F.lit(1)).over(w) == 1)).drop("_m")


def part_names(parts: DataFrame, score: str, order: str, kind: str, group: str, name: str) -> DataFrame:
    """Names of parts with the group that is open: group start sets it, stop clears it; the part's own name if it holds the group's already."""
    w = Window.partitionBy(score).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col(kind) == "start", F.struct(F.nullif(F.trim(F.col(group)), F.lit("")).alias("g"))).when(F.col(kind) == "stop", F.struct(F.lit(None).cast("string").alias("g")))
    df = parts.withColumn("_g", F.last(mark, ignorenulls=True).over(w)["g"]).where(F.col(kind) == "part")
    g, n = F.col("_g"), F.col(name)
    full = F.when(g.isNull(), n).when(F.coalesce(F.trim(n), F.lit("")) == "", g).when(F.contains(F.lower(n), F.lower(g)), n).otherwise(F.concat(g, F.lit(" - "), n))
    return df.withColumn("full_name", full).drop("_g")


def first_config(configs: DataFrame, device: str) -> DataFrame:
    """The best input configuration per device: one or two channels at a preferred rate, any at a preferred rate, one or two at the highest rate; then by format."""
    few, preferred = F.col("channels") <= 2, F.col("rate").isin(44100, 48000)
    tier = F.when(few & preferred, 1).when(preferred, 2).when(few, 3).otherwise(4)
    form = F.array_position(F.array(*[F.lit(x) for x in ("F32", "I32", "I16", "U16")]), F.col("format"))
    w = Window.partitionBy(device).orderBy(tier, F.when(tier >= 3, -F.col("rate")).otherwise(0), form, "rate", "channels")
    return configs.withColumn("tier", tier).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def find_device(devices: DataFrame, name: str, index: str, wanted: str) -> DataFrame:
    """The device for a wanted name: by number, by the whole name without case, or by a part of it, in that order; the first by index."""
    low, n = F.lower(name), wanted.lower()
    rank = F.when(F.col(index).cast("string") == wanted, 1).when(low == n, 2).when(F.contains(low, F.lit(n)), 3)
    return devices.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", index).limit(1)

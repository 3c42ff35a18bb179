"""Repair of broken conversations: the cheapest edits that give a well-formed dialogue, found by a fold in Spark SQL.

A conversation is well formed if the initials of its roles give ``(s?(ua)+)?``. Each row may be kept, given the role user or assistant, or deleted, and
empty turns may be put in anywhere. The fold carries four (cost, audit) structs, one for each place in that form: nothing yet (b), after a system turn (s),
after a user turn (u), after an assistant turn (a). Costs tie often; the audit, a string of edits, decides, and says all that is done.

A conversation of any length lies in blocks: a block's fold starts from each of the four places, and a second fold goes over the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import batches, lean, partitions, stored

#: Costs of edits. An undeleted truncated row costs 1 more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space that makes no text.
SPACES = " \t\n\x0b\f\r"
#: More than any conversation costs: a place that can't be reached.
FAR = 1 << 50
#: Rows of a conversation that one fold takes.
BLOCK = 512
#: Letters inside the fold say which role an edit gives, and sort as the edits' initials D, I, K, R do: I, J insert a user, an assistant; R, S give these roles.
INNER, OUTER = "JS", "IR"
PLACES = ("b", "s", "u", "a")
#: What may stand before a kept or given user or assistant turn.
BEFORE_USER, BEFORE_ASSISTANT = ("b", "s", "a"), ("u",)
_STATE = "struct<cost:bigint,audit:string>"
_ADJACENT = ("su", "ua", "au")


def _least(*states: str) -> str:
    return f"least({', '.join(states)})" if len(states) > 1 else states[0]


def _put(state: str, cost: str | int, letter: str) -> str:
    return f"named_struct('cost', {state}.cost + {cost}, 'audit', concat({state}.audit, '{letter}'))"


def _closed(raw: str) -> str:
    """The four places with inserted turns: a user after b, s and a, then an assistant after that user."""
    user = f"transform(array({raw}), r -> named_struct('r', r, 'u', {_least('r.u', *(_put(f'r.{p}', INSERT, 'I') for p in BEFORE_USER))}))[0]"
    return f"transform(array({user}), c -> named_struct('b', c.r.b, 's', c.r.s, 'u', c.u, 'a', {_least('c.r.a', _put('c.u', INSERT, 'J'))}))[0]"


def _stepped(acc: str, row: str) -> str:
    """The four places after a row with fields role (initial), must (be deleted), extra (cost of staying)."""
    far = f"named_struct('cost', {FAR}L, 'audit', '')"

    def arrive(place: str, initial: str, before: tuple[str, ...], rerole: str | None) -> str:
        best = _least(*(f"{acc}.{p}" for p in before))
        ways = [_put(f"{acc}.{place}", DELETE, "D"), f"CASE WHEN NOT {row}.must AND {row}.role = '{initial}' THEN {_put(best, f'{row}.extra', 'K')} ELSE {far} END"]
        if rerole:
            ways.append(f"CASE WHEN NOT {row}.must THEN {_put(best, f'{REROLE} + {row}.extra', rerole)} ELSE {far} END")
        return _least(*ways)

    raw = f"named_struct('b', {_put(f'{acc}.b', DELETE, 'D')}, 's', {arrive('s', 's', ('b',), None)}, 'u', {arrive('u', 'u', BEFORE_USER, 'R')}, 'a', {arrive('a', 'a', BEFORE_ASSISTANT, 'S')})"
    return _closed(raw)


def block_fold(turns: str) -> Column:
    """An array of four: from each place on entry, the four places at the end of a block's sorted ``turns``."""
    starts = []
    for entry in PLACES:
        raw = ", ".join(f"'{p}', CAST(named_struct('cost', {0 if p == entry else FAR}L, 'audit', '') AS {_STATE})" for p in PLACES)
        starts.append(_closed(f"named_struct({raw})"))
    return F.expr(f"transform(array({', '.join(starts)}), start -> aggregate({turns}, start, (acc, x) -> {_stepped('acc', 'x')}))")


def chain_fold(blocks: str) -> Column:
    """(cost, audit, entries) of a conversation from its sorted ``blocks`` with a field ``ways`` of ``block_fold``; entries: each block's place on entry."""
    state = "struct<cost:bigint,audit:string,entries:array<int>>"

    def through(place: str) -> str:
        return _least(*(f"named_struct('cost', acc.{p}.cost + x.ways[{i}].{place}.cost, 'audit', concat(acc.{p}.audit, x.ways[{i}].{place}.audit), 'entries', array_append(acc.{p}.entries, {i}))" for i, p in enumerate(PLACES)))

    start = ", ".join(f"'{p}', CAST(named_struct('cost', {0 if p == 'b' else FAR}L, 'audit', '', 'entries', array()) AS {state})" for p in PLACES)
    return F.expr(f"aggregate({blocks}, named_struct({start}), (acc, x) -> named_struct({', '.join(f'{p!r}, {through(p)}' for p in PLACES)}), acc -> IF(acc.a < acc.b, named_struct('best', acc.a, 'end', 'a'), named_struct('best', acc.b, 'end', 'b')))")


def _flagged(turns: DataFrame) -> DataFrame:
    """Rows in order, with part (range of the order), nth (place in part, from 1), and faults that a part alone shows; stored."""
    text = F.col("text")
    ink = F.rtrim(text, F.lit(SPACES))
    rows = turns.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(turns.sparkSession), "conv", "turn", "role", "tie").withColumn("part", F.spark_partition_id())
    rows = rows.select(
        "conv", "turn", "role", "text", "part", "tie", F.substring("role", 1, 1).alias("initial"), (ink == "").alias("blank"), (~F.substring(ink, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("said"),
    )
    order = Window.partitionBy("conv", "part").orderBy("turn", "role", "tie", "text")
    again = Window.partitionBy("conv", "part", "said").orderBy("nth")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("pair", F.concat(F.lag("initial").over(order), "initial"))
    rows = rows.withColumn("bad", F.coalesce((~F.col("pair").isin(*_ADJACENT)).cast("long"), F.lit(0))).withColumn("again", F.row_number().over(again) > 1)
    return stored(rows.drop("tie", "pair"), "turns-flagged")


def _faults(flagged: DataFrame) -> DataFrame:
    """Rows without their text, with ``fault``: the first of blank, duplicate, truncated, or null. Only a part's first of equal rows looks at other parts."""
    rows = flagged.select("conv", "turn", "part", "nth", "initial", "bad", "blank", "cut", "said", "again")
    first = F.min("part").over(Window.partitionBy("conv", "said"))
    rows = rows.where("again").withColumn("seen", F.lit(True)).unionByName(rows.where("NOT again").withColumn("seen", F.col("part") > first))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated")
    return rows.select("conv", "turn", "part", "nth", "initial", "bad", fault.alias("fault"))


def _counts(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal."""
    kinds = ("blank", "duplicate", "truncated")
    by_turn = rows.groupBy("conv", "turn").agg(*(F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in kinds))
    span = F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("turn")
    per = by_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.sum(k).alias(k) for k in kinds))
    parts = rows.groupBy("conv", "part").agg(F.sum("bad").alias("bad"), F.min_by("initial", "nth").alias("head"), F.max_by("initial", "nth").alias("tail"))
    seam = F.concat(F.lag("tail").over(Window.partitionBy("conv").orderBy("part")), "head")
    parts = parts.withColumn("bad", F.col("bad") + F.coalesce((~seam.isin(*_ADJACENT)).cast("long"), F.lit(0)))
    illegal = parts.groupBy(F.col("conv").alias("i_conv")).agg(F.sum("bad").alias("illegal"))
    return per.join(illegal, F.col("conv").eqNullSafe(F.col("i_conv"))).drop("i_conv")


def plan(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns).

    audits, per conversation: conv, gaps (numbers missing between the least and greatest turn), blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours whose role initials aren't su, ua or au), cost, audit (the initials of Keep, Rerole, Delete, Insert in order; of the cheapest the ASCII-least).
    repaired turns: conv, part, nth, piece (order within the row's edits), role, text; in this order they are the conversation.

    A null role or text is one space; order is by turn (null first), then role, then a hash of the text and the text; repeated rows are turns of their own
    (duplicates); a null conv_id is a conversation of its own; other columns are ignored. Rows are dealt by range and folded in blocks, so a conversation
    may lie in many tasks; what a task holds of one is 16 audits of its blocks and the audit itself, a letter a row.
    """
    space = F.lit(" ")
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    flagged = _flagged(base)
    rows = stored(_faults(flagged), "turns-faults")
    struct = F.struct("nth", F.col("initial").alias("role"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must"), F.when(F.col("fault") == "truncated", TRUNCATED).otherwise(0).alias("extra"))
    block = F.floor((F.col("nth") - 1) / BLOCK).alias("block")
    blocks = rows.groupBy("conv", "part", block).agg(F.array_sort(F.collect_list(struct)).alias("turns")).select("conv", "part", "block", block_fold("turns").alias("ways"))
    blocks = stored(blocks, "turns-blocks")
    chained = blocks.repartition(partitions(turns.sparkSession), "conv").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "block", "ways"))).alias("blocks"))
    chained = chained.select("conv", chain_fold("blocks").alias("found"), F.expr("transform(blocks, x -> struct(x.part, x.block))").alias("places"))
    best = stored(chained.select("conv", F.col("found.best.cost").alias("cost"), F.col("found.best.audit").alias("inner"), F.col("found.best.entries").alias("entries"), F.col("found.end").alias("end"), "places"), "turns-best")
    audits = _counts(rows).join(best.select(F.col("conv").alias("b_conv"), "cost", F.translate("inner", INNER, OUTER).alias("audit")), F.col("conv").eqNullSafe(F.col("b_conv"))).drop("b_conv")
    # the way through each block: from its place on entry to the next block's
    exits = "transform(entries, (e, i) -> IF(i + 1 < size(entries), entries[i + 1], IF(end = 'a', 3, 0)))"
    ways = best.select(F.col("conv").alias("w_conv"), F.explode(F.arrays_zip("places", "entries", F.expr(exits).alias("exits"))).alias("w"))
    ways = ways.select("w_conv", F.col("w.places.part").alias("w_part"), F.col("w.places.block").alias("w_block"), F.col("w.entries").alias("entry"), F.col("w.exits").alias("exit"))
    same = F.col("conv").eqNullSafe(F.col("w_conv")) & (F.col("part") == F.col("w_part")) & (F.col("block") == F.col("w_block"))
    way = F.col("ways")[F.col("entry")]
    audit = F.when(F.col("exit") == 0, way["b"]["audit"]).when(F.col("exit") == 1, way["s"]["audit"]).when(F.col("exit") == 2, way["u"]["audit"]).otherwise(way["a"]["audit"])
    each = blocks.join(ways, same).select("conv", "part", "block", F.posexplode(F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS](?:[IJ]+$)?"), F.lit(0))).alias("at", "edits"))
    each = each.select(F.col("conv").alias("e_conv"), F.col("part").alias("e_part"), (F.col("block") * BLOCK + F.col("at") + 1).cast("int").alias("e_nth"), "edits")
    mine = F.col("conv").eqNullSafe(F.col("e_conv")) & (F.col("part") == F.col("e_part")) & (F.col("nth") == F.col("e_nth"))
    done = flagged.join(each.where("edits <> 'D'"), mine).select("conv", "part", "nth", "role", "text", F.posexplode(F.regexp_extract_all("edits", F.lit("."), F.lit(0))).alias("piece", "edit")).where("edit <> 'D'")
    role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("J", "S"), "assistant").otherwise(F.col("role"))
    text = F.when(F.col("edit").isin("I", "J"), "").otherwise(F.col("text"))
    return audits, done.select("conv", "part", "nth", "piece", role.alias("role"), text.alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """Per conversation with turns left: conv, repaired_sha256 of its ``role:text`` lines joined by newlines. The hash takes the sorted rows as they pass: no conversation is held whole."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, h = None, None
        for batch in batches(rows):
            convs, values = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h is not None and conv == current:
                    h.update(b"\n")
                else:
                    if h is not None:
                        convs.append(current)
                        values.append(h.hexdigest())
                    current, h = conv, hashlib.sha256()
                h.update(line.encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array(convs, batch.schema.field(0).type), pa.array(values, pa.string())], ["conv", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.schema.field(0).type), pa.array([h.hexdigest()], pa.string())], ["conv", "repaired_sha256"])

    lines = repaired.repartition(partitions(repaired.sparkSession), "conv").sortWithinPartitions("conv", "part", "nth", "piece").select("conv", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.mapInArrow(lean(run), f"conv {lines.schema['conv'].dataType.simpleString()}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32 of ``conv_id:turn``, modulo 20: 0 drops a row, 1 empties its text, 2 takes its [.!?] away, 3 repeats it, 4 gives the role user. Nulls in role, text and the key count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def repair_audit(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Per conversation of ``conversations``: its audit and the digest of its repaired turns, from ``turns``; zeros, an empty audit and the digest of nothing where ``turns`` has no row of it."""
    audits, repaired = plan(turns)
    whole = conversations.select("conv_id").distinct()
    found = whole.join(audits, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    found = found.join(digests(repaired), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

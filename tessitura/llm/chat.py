"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a dialogue, the dialogue is rendered with that speaker as assistant and all others as named users; what the speaker says is
what a model learns (the mask). Results are rows of messages with their place in the rendered dialogue, so no dialogue has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessitura.llm.common import partitions, stored

#: The marks of the rendered form.
START, SEP, END = "<|im_start|>", "\n", "<|im_end|>\n"
CONTEXT = ("system",)


def rendered(role: Column, name: Column, text: Column) -> tuple[Column, Column]:
    """(head, whole message). Marks inside a text are broken up by a space, so that they can't be taken for marks of the form."""
    safe = F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    head = F.concat(F.lit(START), role, F.when(name.isNotNull(), F.concat(F.lit(" name="), name)).otherwise(F.lit("")), F.lit(SEP))
    return head, F.concat(head, safe, F.lit(END))


def _speaker(role: Column) -> Column:
    """A name without white space, and without marks of the form."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(role.cast("string"), F.lit("unknown")), r"\s+", "_"), r"<\|(im_start|im_end)\|>", "<|_$1_|>")


def rotations(turns: DataFrame, context_roles: tuple[str, ...] = CONTEXT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation, perspective and message: conv_id, perspective, turn, position, role, name, rendered, start, mask_start, mask_end.

    ``start`` is the message's first character in the perspective's whole rendered dialogue; mask_start and mask_end (exclusive) bound the learned
    characters, the speaker's text with its end mark; both are null in other messages. Context roles are rendered as such, unmasked, in every
    perspective, and have none of their own; a conversation of context messages alone gives no rows.

    Order is by turn (null first), then by role and text, so ties have one order; repeated rows are messages of their own. A null role is the speaker
    "unknown"; white space in a speaker's name becomes "_" and marks in it are broken up; a null text is empty; a null conv_id is a conversation of its own. Other columns are ignored.
    Messages are dealt by range, so a conversation with very many messages lies in many tasks; running sums are carried over per range.
    """
    spark = turns.sparkSession
    base = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _speaker(F.col(role_col)).alias("speaker"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    base = base.withColumn("tie", F.xxhash64("text"))
    dealt = stored(base.repartitionByRange(partitions(spark), "conv", "turn", "speaker", "tie").withColumn("part", F.spark_partition_id()), "chat-dealt")
    own = dealt.where(~F.col("speaker").isin(*context_roles)).groupBy("conv", "speaker").agg(F.count(F.lit(1)).alias("said"))
    # `said` makes the grouping's key differ from the join's, so both sides are dealt anew and a long conversation can be split
    people = own.select(F.col("conv").alias("p_conv"), F.col("speaker").alias("perspective"))
    seen = dealt.join(people, F.col("conv").eqNullSafe(F.col("p_conv"))).drop("p_conv")
    role = F.when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).when(F.col("speaker").isin(*context_roles), F.col("speaker")).otherwise(F.lit("user"))
    name = F.when(role == "user", F.col("speaker"))
    seen = seen.withColumn("role", role).withColumn("name", name)
    head, whole = rendered(F.col("role"), F.col("name"), F.col("text"))
    seen = seen.withColumn("head_chars", F.length(head).cast("bigint")).withColumn("rendered", whole).withColumn("chars", F.length("rendered").cast("bigint"))
    seen = stored(seen.drop("text"), "chat-seen")
    group = ["conv", "perspective", "part"]
    within = Window.partitionBy(*group).orderBy("turn", "speaker", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = seen.withColumn("till", F.sum("chars").over(within)).withColumn("nth", F.count(F.lit(1)).over(within))
    sums = seen.groupBy(*group).agg(F.sum("chars").alias("all_chars"), F.count(F.lit(1)).alias("all_rows"))
    before = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(  # a row per range, conversation and perspective
        F.col("conv").alias("c_conv"), F.col("perspective").alias("c_perspective"), F.col("part").alias("c_part"),
        F.coalesce(F.sum("all_chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("all_rows").over(before), F.lit(0)).alias("rows_before"),
    )
    out = placed.join(carried, F.col("conv").eqNullSafe(F.col("c_conv")) & (F.col("perspective") == F.col("c_perspective")) & (F.col("part") == F.col("c_part")))
    start = F.col("chars_before") + F.col("till") - F.col("chars")
    mine = F.col("speaker") == F.col("perspective")
    return out.select(
        F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), (F.col("rows_before") + F.col("nth") - 1).alias("position"), "role", "name", "rendered", start.alias("start"),
        F.when(mine, start + F.col("head_chars")).alias("mask_start"), F.when(mine, start + F.col("chars")).alias("mask_end"),
    )


def dialogues(messages: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Whole rendered dialogues with their masks, for conversations that are known to be short: conv_id, perspective, rendered, masks."""
    rows = F.array_sort(F.collect_list(F.struct("position", "rendered", "mask_start", "mask_end")))
    grouped = messages.groupBy(conv_col, "perspective").agg(rows.alias("rows"))
    masks = F.expr("transform(filter(rows, x -> x.mask_start IS NOT NULL), x -> struct(x.mask_start AS start, x.mask_end AS end))")
    return grouped.select(conv_col, "perspective", F.expr("concat_ws('', rows.rendered)").alias("rendered"), masks.alias("masks"))

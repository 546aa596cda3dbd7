"""Message histories: token estimates, atomic blocks and trimming to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treeline import settings

CHUNK = 65_536


def estimated_tokens() -> Column:
    """Two characters per token over the newline-joined message fields, plus four per message."""
    text = F.concat_ws(
        "\n",
        *[F.coalesce(c, F.lit("")) for c in ("role", "content", "tool_calls", "tool_call_id", "name")],
    )
    return F.greatest(F.lit(1), F.floor((F.length(text) + 1) / 2).cast("int")) + 4


def trim_history(messages: DataFrame, budget: int = settings.MAX_HISTORY_TOKENS, chunk: int = CHUNK) -> DataFrame:
    """Mark what survives trimming: adds est_tokens, starts_block, kept.

    A block is an assistant message with tool calls and the tool replies right
    after it. The newest blocks that fit the budget stay, the last one always.

    A conversation of any length is cut into chunks of turns: a task sorts one
    chunk, and what a chunk needs from the ones before it (tokens so far, the
    latest message that was no tool reply) is carried over a table with one row
    per chunk.
    """
    talks = F.col("role") != "tool"
    opens = (F.col("role") == "assistant") & (F.coalesce("tool_calls", F.lit("")) != "")
    rows = messages.withColumns({
        "est_tokens": estimated_tokens(), "_chunk": F.floor(F.col("turn") / chunk).cast("long"),
    })
    earlier = W.partitionBy("conv_id", "_chunk").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.coalesce(F.sum("est_tokens").over(earlier), F.lit(0)))
    speaker = F.when(talks, F.struct(F.col("turn"), opens.alias("opens"), F.col("_sum").alias("before")))
    rows = rows.withColumn("_speaker", F.max(speaker).over(earlier))

    def shifted(value: Column, offset: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(
            value["turn"].alias("turn"), value["opens"].alias("opens"), (value["before"] + offset).alias("before")))

    per_chunk = rows.groupBy("conv_id", "_chunk").agg(
        F.sum("est_tokens").alias("tokens"), F.max("turn").alias("top"), F.max(speaker).alias("speaker")
    )
    whole = W.partitionBy("conv_id")
    before = whole.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        per_chunk.withColumn("_offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("_latest", shifted(F.col("speaker"), F.col("_offset")))
        .select(
            "conv_id", "_chunk", "_offset",
            F.max("_latest").over(before).alias("_carry"),
            F.max("_latest").over(whole).alias("_final"),
            F.sum("tokens").over(whole).alias("_total"),
            F.max("top").over(whole).alias("_top"),
        )
    )
    joined = rows.join(carried, ["conv_id", "_chunk"]).withColumn(
        "_owner", F.coalesce(shifted(F.col("_speaker"), F.col("_offset")), F.col("_carry"))
    ).withColumn("starts_block", talks | ~F.coalesce(F.col("_owner.opens"), F.lit(False)))
    starts = F.col("starts_block")
    block_before = F.when(starts, F.col("_offset") + F.col("_sum")).otherwise(F.col("_owner.before"))
    block_turn = F.when(starts, F.col("turn")).otherwise(F.col("_owner.turn"))
    last_turn = F.when(F.col("_final.opens"), F.col("_final.turn")).otherwise(F.col("_top"))
    kept = (F.col("_total") - block_before <= budget) | (block_turn >= last_turn)
    return joined.select(*messages.columns, "est_tokens", "starts_block", kept.alias("kept"))

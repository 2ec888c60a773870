"""Multi-party chat: one rendering for each participant, in which that participant is the assistant.  Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelane.llm.common import col

#: Chat markers; fixed values of the rendering.
START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a block.  A dialogue is one row for each perspective and block, so that a dialogue of any length is never gathered in one task.
BLOCK_TURNS = 64


def plain(text: Column) -> Column:
    """Text in which no chat marker is left: a space breaks each that someone wrote."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = ("system",), block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, perspective, block, n_turns, n_train_chars, text, train_spans) for every participant of every dialogue.

    A turn is START role END with a line break; the role is 'assistant' for the perspective's own turns, 'system' for context
    speakers, else 'user name=<speaker>'.  train_spans lists start-end (code points of this row's text, end exclusive) of what
    the perspective says with its END marker, in order, joined by ';' ('' if it does not speak in the block): the loss mask.

    Block b holds the turns b*block_turns .. (b+1)*block_turns-1 by turn number; reading blocks in order gives the dialogue.
    Markers inside of texts and names are broken by a space, so nobody can speak for another; a line break in a name becomes a space.
    Turns with equal numbers (repeated rows too) stand in order of speaker and text.  Null text is empty, a null speaker is named
    'unknown', a null turn comes in block -1 before the others, a null dialogue id is a dialogue.  Context speakers
    are no participants: a dialogue of these alone gives no row.  An empty table gives none; other columns are not carried.
    """
    rows = df.select(col(conv_col).alias("conv"), col(turn_col).cast("bigint").alias("turn"), F.coalesce(col(speaker_col), F.lit("unknown")).alias("speaker"), plain(F.coalesce(col(text_col), F.lit(""))).alias("body"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)))
    people = rows.filter(~F.col("speaker").isin(*context)).groupBy("conv").agg(F.collect_set("speaker").alias("people"))
    # a row for each dialogue, so a long dialogue's turns are split by Spark's skew handling while this side is copied
    turned = rows.alias("r").join(people.alias("p"), F.col("r.conv").eqNullSafe(F.col("p.conv"))).select("r.*", F.explode("people").alias("perspective"))
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*context), "system").otherwise(F.concat(F.lit("user name="), F.regexp_replace(plain(F.col("speaker")), "[\n\r]", " ")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    said = F.concat(F.col("body"), F.lit(END))
    pieces = turned.select("conv", "perspective", "block", F.struct("turn", "speaker", "body", own.alias("own"), head.alias("head"), said.alias("said")).alias("x"))
    blocks = pieces.groupBy("conv", "perspective", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))

    def step(state, x):
        start = state["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["said"])
        span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(x["own"], state["n"] + end - start).otherwise(state["n"]).alias("n"), F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("spans"))
    text = F.array_join(F.transform("xs", lambda x: F.concat(x["head"], x["said"], F.lit("\n"))), "")
    done = blocks.withColumn("mask", F.aggregate("xs", zero, step))
    return done.select(F.col("conv").alias(conv_col), "perspective", "block", F.size("xs").alias("n_turns"), F.col("mask.n").alias("n_train_chars"), text.alias("text"), F.array_join("mask.spans", ";").alias("train_spans"))


SQL = """
WITH r AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<| im_') AS body,
         coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS block
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
x AS (
  SELECT r.conv_id, p.perspective, r.block, r.turn, r.speaker, r.body, r.speaker = p.perspective AS own,
         '<|im_start|>' || CASE WHEN r.speaker = p.perspective THEN 'assistant' WHEN r.speaker = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(replace(r.speaker, '<|im_', '<| im_'), '[\n\r]', ' ', 'g') END || chr(10) AS head,
         r.body || '<|im_end|>' AS said
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
y AS (
  SELECT *, sum(length(head) + length(said) + 1) OVER (
    PARTITION BY conv_id, perspective, block ORDER BY turn NULLS FIRST, speaker, body
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(said) - 1 AS start_at
  FROM x)
SELECT conv_id, perspective, block, count(*) AS n_turns,
       CAST(coalesce(sum(length(said)) FILTER (WHERE own), 0) AS BIGINT) AS n_train_chars,
       string_agg(head || said || chr(10), '' ORDER BY turn NULLS FIRST, speaker, body) AS text,
       coalesce(string_agg(CAST(start_at AS BIGINT) || '-' || CAST(start_at + length(said) AS BIGINT), ';'
         ORDER BY turn NULLS FIRST, speaker, body) FILTER (WHERE own), '') AS train_spans
FROM y GROUP BY conv_id, perspective, block
"""

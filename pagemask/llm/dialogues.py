"""Multi-party perspective rotation of dialogues. Only DataFrame functions: no Python runs on the executors.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant, everybody else
as a named user, and system turns as they are. The rendering comes as segments, one row per turn, with character offsets in
the rendering, so that a conversation of any length never has to fit one task; the segments joined in order are the text.
The offsets to learn from (the assistant's words and their end mark) are mask_start and mask_stop, null on other segments.

Names and texts can't make marks: '<|' in them is rendered as '< |', and in names also '|>' as '| >' and a line break as a space.

The turns are sorted once over the whole table; the parts of that sort are the blocks in which turns are numbered and measured, so a
conversation with any share of all turns, or with one turn number only, is spread over as many tasks as it fills. Counting and measuring
work on lengths; the texts join the result once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemask.llm.common import materialize

END = "<|end|>"


def _unmarked(c: Column, name: bool = False) -> Column:
    c = F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.regexp_replace(F.replace(c, F.lit("|>"), F.lit("| >")), "[\\r\\n]", " ") if name else c


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, perspective, seq (0-based), speaker, chat_role, segment, start, stop, mask_start, mask_stop.

    Turns are ordered by turn, then speaker, then text; null turns come first; repeated rows are turns of their own. A null or
    blank role is the speaker 'unknown', 'system' in any case is the system, a null text is empty, null conversation ids form one
    conversation. A conversation with system turns only is rendered once, with a null perspective. Other columns are not read.
    """
    speaker = F.coalesce(F.nullif(F.trim(F.col(role_col).cast("string")), F.lit("")), F.lit("unknown"))
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("text")]
    # Equal rows are any of each other's, but they need not stay together: the last key lets the sort part them.
    t = t.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(*order, "n").sortWithinPartitions(*order)
    t = materialize(t.drop("n").withColumn("rid", F.monotonically_increasing_id()), "turns")

    light = t.select("conv_id", "rid", F.shiftright("rid", 33).alias("block"), "speaker", (F.lower("speaker") == "system").alias("system"), F.length(_unmarked(F.col("text"))).cast("long").alias("words"))
    who = light.filter("NOT system").select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    blocks = light.select("conv_id", "block").distinct()
    grid = blocks.join(who, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "perspective")
    x = light.join(grid, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")
    x = x.withColumn("chat_role", F.when(F.col("system"), "system").when(F.col("speaker").eqNullSafe(F.col("perspective")), "assistant").otherwise("user"))
    head = F.when(F.col("chat_role") == "user", F.concat(F.lit("<|user name="), _unmarked(F.col("speaker"), True), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), "chat_role", F.lit("|>\n")))
    x = x.withColumn("head", head).withColumn("len", F.length("head") + F.col("words") + len(END) + 1)
    # Two levels of running sums: over the blocks of a rendering, then over the turns of a block.
    sums = x.groupBy("conv_id", "perspective", "block").agg(F.count("*").alias("n"), F.sum("len").alias("chars"))
    before = W.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0"))
    inside = W.partitionBy("conv_id", "perspective", "block").orderBy("rid")
    x = x.withColumns({"k": F.row_number().over(inside) - 1, "upto": F.sum("len").over(inside.rowsBetween(W.unboundedPreceding, 0))})
    x = x.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("perspective").eqNullSafe(F.col("_p")) & (F.col("block") == F.col("_b")))
    x = x.select("rid", "perspective", "chat_role", "head", "len", (F.col("n0") + F.col("k")).alias("seq"), (F.col("c0") + F.col("upto")).alias("stop")).join(t, "rid")
    start = F.col("stop") - F.col("len")
    mine = F.col("chat_role") == "assistant"
    return x.select(
        "conv_id", "perspective", "seq", "speaker", "chat_role", F.concat("head", _unmarked(F.col("text")), F.lit(END + "\n")).alias("segment"), start.alias("start"), "stop",
        F.when(mine, start + F.length("head")).alias("mask_start"), F.when(mine, F.col("stop") - 1).alias("mask_stop"),
    )


def op5_dialogues(spark, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations),
who AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE lower(speaker) <> 'system'),
x AS (SELECT t.*, perspective, CASE WHEN lower(speaker) = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS chat_role
      FROM t LEFT JOIN who ON t.conv_id IS NOT DISTINCT FROM who.c),
h AS (SELECT *, CASE WHEN chat_role = 'user' THEN '<|user name=' || regexp_replace(replace(replace(speaker, '<|', '< |'), '|>', '| >'), '[\r\n]', ' ', 'g') || '|>' || chr(10) ELSE '<|' || chat_role || '|>' || chr(10) END AS head FROM x),
s AS (SELECT *, head || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS segment FROM h),
n AS (SELECT *, row_number() OVER w - 1 AS seq, (sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM s
      WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, seq, speaker, chat_role, segment, stop - length(segment) AS start, stop,
  CASE WHEN chat_role = 'assistant' THEN stop - length(segment) + length(head) END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN stop - 1 END AS mask_stop
FROM n
"""

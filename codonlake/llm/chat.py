"""Dialogues from the perspective of each speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Turns of a part of a rendered dialogue, and messages of one piece of a part.
PART_TURNS, PIECE_MESSAGES = 256, 4096
END = "<|end|>"


def _ranges(m: DataFrame, piece_messages: int) -> DataFrame:
    """c, p, cuts of each part of over piece_messages messages: the first messages of all its pieces but the first.

    Messages of a large part are dealt to cells by ranges of the whole order, so no task holds a large
    part; the number in a part is its place in its cell and the messages of the part in cells before.
    """
    large = m.groupBy("conv_id", "part").count().where(F.col("count") > piece_messages).select(F.col("conv_id").alias("c"), F.col("part").alias("p"))
    own = m.join(large, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left_semi")
    order = ["conv_id", "part", "turn", "role", "text"]
    dealt = written(own.repartitionByRange(*order).withColumn("cell", F.spark_partition_id()), "messages")  # read twice: cells must not change
    placed = dealt.withColumn("at", F.row_number().over(Window.partitionBy("cell", "conv_id", "part").orderBy("turn", "role", "text")))
    cells = dealt.groupBy("conv_id", "part", "cell").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("conv_id", "part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("cell").alias("of"), before.alias("before"))
    placed = placed.join(cells, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("cell") == F.col("of")))
    first = placed.where((F.col("before") + F.col("at") > 1) & ((F.col("before") + F.col("at") - 1) % piece_messages == 0))
    return first.groupBy("c", "p").agg(F.collect_list(F.struct("turn", "role", "text")).alias("cuts"))


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS, piece_messages: int = PIECE_MESSAGES) -> DataFrame:
    """conv_id, speaker, part, piece, n_messages, text and spans for each participant of each dialogue.

    Input: conv_id, turn, role, text; other columns are ignored. Each role but `system` is a participant.
    For each of them the dialogue is rendered with its messages as `<|assistant|>`, those of others as
    `<|user|> name` and system messages as `<|system|>`; spans are the [start, end) code points of the
    speaker's words and end marks, on which a model is trained.

    Messages go in the order of turn, role and text. A dialogue is rendered in parts of part_turns turns,
    so that one of any length is spread; most have the part 0 only. A part of over piece_messages distinct
    messages is cut into pieces, ranges of the order of turn, role and text. Rows that repeat conv_id, turn,
    role and text are one message.

    `<|` in texts and roles becomes `< |`, so that no message can forge a turn, a mark or a mask.

    A null text is empty, a null role is the participant `unknown`, a null turn is part -1, a null conv_id
    is a dialogue of its own. A text of any length is one message. A dialogue without participants, or an
    empty table, gives no rows.
    """
    m = conversations.select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"),
        "turn",
        F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    ).distinct()
    m = m.join(_ranges(m, piece_messages), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    after = F.filter("cuts", lambda x: x <= F.struct("turn", "role", "text"))
    m = m.withColumn("piece", F.coalesce(F.size(after), F.lit(0)).cast("int")).drop("c", "p", "cuts")
    parts = m.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("messages"))
    speakers = m.where("role <> 'system'").groupBy(F.col("conv_id").alias("c")).agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    rows = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.explode("speakers").alias("speaker"), "part", "piece", "messages")
    own = lambda x: x["role"] == F.col("speaker")
    head = lambda x: F.when(own(x), F.lit("<|assistant|>\n")).when(x["role"] == "system", F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user|> "), x["role"], F.lit("\n")))
    body = lambda x: F.concat(x["text"], F.lit(END))
    shown = F.transform("messages", lambda x: F.struct(head(x).alias("head"), body(x).alias("body"), own(x).alias("own")))
    rows = rows.withColumn("shown", shown)
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(acc, x):
        a = (acc["at"] + F.length(x["head"])).cast("int")
        b = (a + F.length(x["body"])).cast("int")
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + 1).cast("int").alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return rows.select(
        "conv_id",
        "speaker",
        "part",
        "piece",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("shown", start, step, lambda acc: acc["spans"]).alias("spans"),
    )


def spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ";")


SQL = """
WITH m AS (
  SELECT DISTINCT conv_id, coalesce(turn // 256, -1) AS part, turn,
    replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'
), shown AS (
  SELECT m.conv_id, speaker, part, turn, role, text, role = speaker AS own, text || '<|end|>' AS body,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user|> ' || role END || chr(10) AS head
  FROM m JOIN speakers s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part
    ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS pos
  FROM shown)
SELECT conv_id, speaker, part::BIGINT AS part, 0::INTEGER AS piece, count(*) AS n_messages,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(pos::VARCHAR || '-' || (pos + length(body))::VARCHAR, ';' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
"""

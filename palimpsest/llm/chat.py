"""Multi-party dialogues as training examples, one for each speaker's point of view.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and the
others as named users; the loss mask covers the assistant's words only. A dialogue is one row for each perspective, if
it is small enough for that. A conversation may hold any share of all rows, so larger ones are cut into blocks of
turns: the blocks of a perspective in a row are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Workspace, skew_join, sorted_positions

#: Turns and characters of a dialogue that is one row, at most.
WHOLE_TURNS = 1024
WHOLE_CHARS = 1 << 20
#: Turns in a block of a larger one, at most.
BLOCK_TURNS = 64
#: This speaker frames the dialogue and is no participant.
SYSTEM = "system"
#: What null and empty roles are called; no other role comes to these names.
NOBODY, EMPTY = "%nobody", "%empty"
#: White space and marks of the format, and the sign that they are written with, first.
_MARKS = '%\t\n\x0b\x0c\r "<>|'


def speaker(role: Column) -> Column:
    """A speaker's name. White space and marks of the format are written as % and two hexadecimal digits, so different
    roles have different names."""
    name = role
    for c in _MARKS:
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(role.isNull(), NOBODY).when(role == "", EMPTY).otherwise(name)


def _head(name: Column, perspective: Column) -> Column:
    return (F.when(name == SYSTEM, F.lit("<|system|>\n")).when(name == perspective, F.lit("<|assistant|>\n"))
            .otherwise(F.concat(F.lit('<|user name="'), name, F.lit('"|>\n'))))


def perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK_TURNS) -> DataFrame:
    """Per conversation, participant and block: conv_id, perspective, block, first_turn (its place in the dialogue),
    n_turns, n_chars, trained_chars, mask (spans "from-to," of the assistant's characters in the text) and text.

    Turns go by turn, role and text, nulls first. Null texts count as empty; marks of the format in a text are
    broken up, so no turn can speak for another; repeated rows are turns of their own; rows with a null conversation
    form one conversation; a conversation of the system's turns alone has no participant and gives no row; other
    columns are ignored; an empty table gives an empty one. Dialogues of WHOLE_TURNS turns and WHOLE_CHARS characters
    of text at most are block 0 alone, very long texts whole within it.
    """
    ws = Workspace(df.sparkSession, "chat")
    rows = df.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("raw"),
        speaker(F.col(role)).alias("name"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |").alias("said"))
    order = [F.col(x) for x in ("c", "t", "r", "raw")]
    placed = sorted_positions(ws, rows, order, "sorted", "at")
    placed = ws.table(placed.select("c", "name", "said", "at"), "placed")
    size = F.sum(F.length("said"))
    start = placed.groupBy("c").agg(F.min("at").alias("start"), ((F.count(F.lit(1)) <= WHOLE_TURNS) & (size <= WHOLE_CHARS)).alias("whole"))
    key = F.xxhash64("c")  # never null, so a null conversation is joined like any other
    turns = skew_join(placed.withColumn("k", key), start.select(key.alias("k"), F.col("c").alias("c2"), "start", "whole"), ["k"], "inner").filter(F.col("c").eqNullSafe(F.col("c2")))
    turns = turns.withColumn("place", F.col("at") - F.col("start")).withColumn("block", F.when(F.col("whole"), 0).otherwise(F.floor(F.col("place") / block)).cast("long"))
    blocks = turns.groupBy("c", "k", "block").agg(F.sort_array(F.collect_list(F.struct("place", "name", "said"))).alias("turns"))
    who = placed.filter(F.col("name") != SYSTEM).select("c", key.alias("k"), F.col("name").alias("perspective")).distinct()
    each = skew_join(blocks, who.select("k", F.col("c").alias("c2"), "perspective"), ["k"], "inner").filter(F.col("c").eqNullSafe(F.col("c2")))
    p = F.col("perspective")
    step = lambda a, x: F.struct(
        (a["at"] + F.length(_head(x["name"], p)) + F.length(x["said"]) + 1).cast("long").alias("at"),
        (a["own"] + F.when(x["name"] == p, F.length(x["said"])).otherwise(0)).cast("long").alias("own"),
        F.when(x["name"] == p, F.concat(a["mask"], (a["at"] + F.length(_head(x["name"], p))).cast("string"), F.lit("-"), (a["at"] + F.length(_head(x["name"], p)) + F.length(x["said"])).cast("string"), F.lit(","))).otherwise(a["mask"]).alias("mask"))
    zero = F.lit(0).cast("long")
    told = F.aggregate("turns", F.struct(zero.alias("at"), zero.alias("own"), F.lit("").alias("mask")), step)
    body = F.array_join(F.transform("turns", lambda x: F.concat(_head(x["name"], p), x["said"], F.lit("\n"))), "")
    each = each.withColumn("told", told)
    return each.select(
        F.col("c").alias(conv), "perspective", "block", F.element_at("turns", 1)["place"].alias("first_turn"), F.size("turns").cast("long").alias("n_turns"),
        F.col("told.at").alias("n_chars"), F.col("told.own").alias("trained_chars"), F.col("told.mask").alias("mask"), body.alias("text"))


_NAME = "role"
for _c in _MARKS:
    _NAME = f"replace({_NAME}, chr({ord(_c)}), '%{ord(_c):02X}')"

#: The same in DuckDB over `conversations`.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS raw, replace(coalesce(text, ''), '<|', '< |') AS said,
    CASE WHEN role IS NULL THEN '{NOBODY}' WHEN role = '' THEN '{EMPTY}' ELSE {_NAME} END AS name
  FROM conversations),
placed AS (
  SELECT conv_id, name, said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, raw) - 1 AS place,
    count(*) OVER (PARTITION BY conv_id) <= {WHOLE_TURNS} AND sum(length(said)) OVER (PARTITION BY conv_id) <= {WHOLE_CHARS} AS whole FROM rows),
who AS (SELECT DISTINCT conv_id, name AS perspective FROM placed WHERE name <> 'system'),
heads AS (
  SELECT p.conv_id, perspective, place, CASE WHEN whole THEN 0 ELSE place // {BLOCK_TURNS} END AS block, said, name = perspective AS own,
    CASE WHEN name = 'system' THEN '<|system|>' || chr(10) WHEN name = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name="' || name || '"|>' || chr(10) END AS head
  FROM placed p JOIN who w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
spans AS (
  SELECT *, sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, perspective, block ORDER BY place) - length(said) - 1 AS low FROM heads)
SELECT conv_id, perspective, CAST(block AS BIGINT) AS block, CAST(min(place) AS BIGINT) AS first_turn, count(*) AS n_turns,
  CAST(sum(length(head) + length(said) + 1) AS BIGINT) AS n_chars, CAST(sum(CASE WHEN own THEN length(said) ELSE 0 END) AS BIGINT) AS trained_chars,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(low AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(low + length(said) AS BIGINT) AS VARCHAR) || ',' END, '' ORDER BY place), '') AS mask,
  string_agg(head || said || chr(10), '' ORDER BY place) AS text
FROM spans GROUP BY conv_id, perspective, block
"""

"""Chat formatting with every participant in turn as the assistant, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.llm.storage import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
NOBODY = "unknown"  # the name of a turn without a role


def _turns(talk: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    order = ["conv_id", "turn", "role", "text", "row"]
    turns = talk.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),  # tells repeated turns apart
    )
    cut = turns.repartitionByRange(*order)
    return written(cut.withColumn("range", F.spark_partition_id()), "turns")


def rotate(
    talk: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Every dialogue once for each participant, a row for each turn.

    (conv_id, speaker, position, turn, role, name, segment, start, mask_start,
    mask_end): seen from ``speaker``, that participant's turns have role
    assistant and all others' role user with the participant's name; system
    turns are nobody's and stay. The segments of a dialogue in order of
    position make its text; start counts the characters before. The characters
    from mask_start up to mask_end are those to learn: text and end mark of
    the assistant's turns; elsewhere the two are equal.

    Turns are ordered by turn, then by role and text; a null turn comes first
    and rows that repeat each other in all four columns are turns of their own,
    one behind the other. A null
    text is empty; a turn without a role is a user's named 'unknown', who has
    no view of his own; null conv_ids make one conversation; a conversation of
    system turns alone has no views; other columns are ignored; an empty table
    gives no rows.

    A conversation may hold any share of the rows: turns are cut into ranges of
    (conversation, turn), lengths are summed inside a range, and the ranges'
    totals, few for each conversation, along it.
    """
    turns = _turns(talk, conv_col, turn_col, role_col, text_col)
    people = turns.filter(F.col("role").isNotNull() & (F.col("role") != SYSTEM))
    people = written(people.select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct(), "people")
    views = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    mine = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    system = F.coalesce(F.col("role") == SYSTEM, F.lit(False))
    name = F.coalesce("role", F.lit(NOBODY))
    head = F.when(mine, "assistant\n").when(system, SYSTEM + "\n").otherwise(F.concat(F.lit("user name="), name, F.lit("\n")))
    views = views.select(
        "conv_id", "speaker", "range", "turn", "text", "row", F.col("role").alias("said_by"),
        F.when(mine, "assistant").when(system, SYSTEM).otherwise("user").alias("role"),
        F.when(~mine & ~system, name).alias("name"),
        F.concat(F.lit(OPEN), head).alias("head"),
    )
    views = views.withColumn("segment", F.concat("head", "text", F.lit(CLOSE)))
    view = ["conv_id", "speaker", "range"]
    inside = Window.partitionBy(*view).orderBy("turn", "said_by", "text", "row")
    views = views.withColumn("place", F.row_number().over(inside))
    views = views.withColumn("inside", _before(F.length("segment"), inside))
    totals = views.groupBy(*view).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("segment")).alias("chars"))
    along = Window.partitionBy("conv_id", "speaker").orderBy("range")
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("range").alias("r"),
        _before(F.col("n"), along).alias("n_before"), _before(F.col("chars"), along).alias("chars_before"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("range") == F.col("r"))
    start = F.col("chars_before") + F.col("inside")
    end = start + F.length("segment")
    learnt = F.col("role") == "assistant"
    return views.join(written(totals, "totals"), same).select(
        "conv_id", "speaker", (F.col("n_before") + F.col("place") - 1).alias("position"), "turn", "role", "name",
        "segment", start.alias("start"),
        F.when(learnt, start + F.length("head")).otherwise(end).alias("mask_start"),
        F.when(learnt, end - 1).otherwise(end).alias("mask_end"),
    )


def _before(value: Column, window: Window) -> Column:
    """The sum of ``value`` over the rows before."""
    return F.coalesce(F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


SQL = """
WITH turns AS (
    SELECT row_number() OVER () AS row, conv_id, turn, role AS said_by, coalesce(text, '') AS text FROM conversations
), people AS (
    SELECT DISTINCT conv_id, said_by AS speaker FROM turns WHERE said_by <> 'system'
), views AS (
    SELECT t.row, t.conv_id, p.speaker, t.turn, t.said_by, t.text,
           CASE WHEN t.said_by = p.speaker THEN 'assistant' WHEN t.said_by = 'system' THEN 'system' ELSE 'user' END AS role
    FROM turns t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
    SELECT *, CASE WHEN role = 'user' THEN coalesce(said_by, 'unknown') END AS name,
           '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || coalesce(said_by, 'unknown') ELSE '' END
               || chr(10) AS head
    FROM views
), whole AS (
    SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM headed
), placed AS (
    SELECT *,
           row_number() OVER w - 1 AS position,
           coalesce(sum(length(segment)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM whole
    WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, said_by NULLS FIRST, text, row)
)
SELECT conv_id, speaker, CAST(position AS BIGINT) AS position, turn, role, name, segment, CAST(start AS BIGINT) AS start,
       CAST(start + length(CASE WHEN role = 'assistant' THEN head ELSE segment END) AS BIGINT) AS mask_start,
       CAST(start + length(segment) - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS mask_end
FROM placed
"""

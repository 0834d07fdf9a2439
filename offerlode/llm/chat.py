"""Chat formatting from every speaker's point of view.

For each participant of a conversation the whole dialogue is rendered once: that speaker's turns
become the assistant's, those of others become user turns that name the speaker, and system
turns stay. A turn is one row, so no dialogue is gathered into a cell or task, however long;
offsets give its place in the rendered text, and the mask marks what the model learns to say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerlode.llm.common import same

SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Start of every marker; in texts and names it is set apart, so that no turn can forge one.
MARK, APART = "<|", "< |"
#: Turns whose lengths one task adds up; offsets of blocks are added in a second step.
BLOCK_TURNS = 1024


def perspectives(turns: DataFrame) -> DataFrame:
    """One row for each turn and participant of (conv_id, turn, role, text).

    Columns: conv_id, perspective, turn, role (system, user or assistant), name (of another
    speaker, else null), segment, in_loss, start and stop (characters of the rendered dialogue)
    and loss_start, where the text behind the header of an own turn begins, else null. Markers in
    texts and names are set apart by a blank, and line breaks in names become blanks.
    A speaker is a role other than system; a null role speaks as "unknown", a null text is
    empty. Turns are ordered by turn, then role and text; repeated rows are turns of their own.
    A conversation of system turns only has no participants, and no rows. Null conv_ids are
    one conversation. Other columns are ignored.
    """
    text = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(MARK), F.lit(APART))
    base = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"),
        text.alias("text"),
    )
    people = base.where(F.col("speaker") != SYSTEM).select(
        F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")
    ).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(own, "assistant").otherwise("user")
    plain = F.replace(F.translate("speaker", "\r\n", "  "), F.lit(MARK), F.lit(APART))
    name = F.when(~own & (F.col("speaker") != SYSTEM), plain)
    seen = base.join(people, same(F.col("conv_id"), F.col("conv"))).select(
        "conv_id", "perspective", "turn", "speaker", role.alias("role"), name.alias("name"), own.alias("in_loss"), "text",
        F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS).alias("block"),
    )
    label = F.coalesce(F.concat(F.lit(" name="), "name"), F.lit(""))
    seen = seen.withColumn("segment", F.concat(F.lit(OPEN), "role", label, F.lit("\n"), "text", F.lit(CLOSE)))
    keys = ["conv_id", "perspective"]
    inside = Window.partitionBy(*keys, "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    blocks = seen.groupBy(*keys, "block").agg(F.sum(F.length("segment")).alias("chars"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        F.col("conv_id").alias("conv"), F.col("perspective").alias("view"), F.col("block").alias("part"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before"),
    )
    placed = seen.withColumn("stop", F.sum(F.length("segment")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(
        starts,
        same(F.col("conv_id"), F.col("conv")) & (F.col("perspective") == F.col("view")) & (F.col("block") == F.col("part")),
    )
    stop = (F.col("before") + F.col("stop")).cast("long")
    start = stop - F.length("segment")
    own_text = stop - F.length("text") - len(CLOSE)
    return joined.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", "in_loss", start.alias("start"), stop.alias("stop"),
        F.when(F.col("in_loss"), own_text).alias("loss_start"),
    )


#: The same rows for DuckDB.
PERSPECTIVES_SQL = f"""
with base as (
  select conv_id, cast(turn as bigint) as turn, coalesce(role, 'unknown') as speaker,
    replace(coalesce(text, ''), '{MARK}', '{APART}') as text from conversations
), people as (
  select distinct conv_id as conv, speaker as perspective from base where speaker <> '{SYSTEM}'
), seen as (
  select conv_id, perspective, turn, speaker, text,
    case when speaker = '{SYSTEM}' then '{SYSTEM}' when speaker = perspective then 'assistant' else 'user' end as role,
    case when speaker not in (perspective, '{SYSTEM}')
      then replace(replace(replace(speaker, chr(13), ' '), chr(10), ' '), '{MARK}', '{APART}') end as name, speaker = perspective as in_loss
  from base join people on conv_id is not distinct from conv
), rendered as (
  select *, '{OPEN}' || role || coalesce(' name=' || name, '') || chr(10) || text || '<|im_end|>' || chr(10) as segment from seen
), placed as (
  select *, sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text
    rows between unbounded preceding and current row) as total from rendered
)
select conv_id, perspective, turn, role, name, segment, in_loss,
  cast(total - length(segment) as bigint) as start, cast(total as bigint) as stop,
  case when in_loss then cast(total - length(text) - {len(CLOSE)} as bigint) end as loss_start from placed
"""

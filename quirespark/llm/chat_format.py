"""Chat rendering with rotated perspectives: each participant of a dialogue in turn is the assistant, the others are named users.

Only built-in DataFrame functions. ``rotated`` gives one row for each dialogue and participant, with the whole dialogue however many turns it has; such a row is as
long as the dialogue. ``parts`` gives the same renderings cut after every so many messages, for dialogues that are too long for a row: messages are numbered
without one task seeing all of a dialogue, each part tells where in the whole it begins, and the parts put together in order are the row of ``rotated``.
The mask holds the spans of characters to train on: the assistant's words and the end mark after them.

Defined results: a null role is the speaker 'unknown', a null text is empty, a null turn comes first, a null conv_id is a
conversation of its own. Every row is a message, repeated ones too; rows that share a turn are ordered by role and text. The system
role is shown to everyone and takes no perspective; a dialogue of system messages alone has no row. Marks of the format inside a role or text are written with a
blank after '<', and a line end inside a role is a blank. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of
from .sharding import numbered

BEGIN, END = "<|begin|>", "<|end|>"
#: Messages of a part, and of the stretches in which a long dialogue's spans are added up.
PART = 512


def turns(conversations: DataFrame) -> DataFrame:
    """All messages: conv_id, turn, role and text without nulls or marks."""
    rows = columns_of(conversations, ["conv_id", "turn", "role", "text"])
    bare = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.coalesce(F.nullif(F.trim(F.translate("role", "\r\n", "  ")), F.lit("")), F.lit("unknown"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), bare(role).alias("role"), bare(F.coalesce("text", F.lit(""))).alias("text"))


def speakers(said: DataFrame) -> DataFrame:
    return said.filter("role <> 'system'").select(F.col("conv_id").alias("__conv"), F.col("role").alias("perspective")).distinct()


def rendered(rows: DataFrame) -> DataFrame:
    """Rows with an array ``said`` of messages in order and a ``perspective``, with n_messages, rendered, spans (start and end in this rendering) and n_trained added."""
    head = f"concat('{BEGIN}', case when m.role = 'system' then 'system' when m.role = perspective then 'assistant' else concat('user name=', m.role) end, '\\n')"
    shown = rows.withColumn("__shown", F.expr(f"transform(said, m -> struct({head} as head, concat(m.text, '{END}') as body, m.role = perspective as own))"))
    # stretch by stretch, so that no list is copied more than PART times: how long it is, and the spans in it
    step = "struct(a.at + s.h + s.b + 1L as at, case when s.own then concat(a.spans, array(struct(a.at + s.h as start, a.at + s.h + s.b as end))) else a.spans end as spans)"
    none = "struct(0L as at, cast(array() as array<struct<start:bigint,end:bigint>>) as spans)"
    sizes = "transform(__shown, s -> struct(cast(length(s.head) as bigint) as h, cast(length(s.body) as bigint) as b, s.own as own))"
    cut = shown.withColumn("__sizes", F.expr(sizes)).withColumn("__walked", F.expr(f"transform(sequence(0, (size(__sizes) - 1) div {PART}), k -> aggregate(slice(__sizes, cast(k * {PART} + 1 as int), {PART}), {none}, (a, s) -> {step}))"))
    begun = cut.withColumn("__begin", F.expr("aggregate(__walked, array(0L), (a, w) -> concat(a, array(element_at(a, -1) + w.at)))"))
    spans = F.expr("flatten(transform(__walked, (w, k) -> transform(w.spans, s -> struct(s.start + __begin[k] as start, s.end + __begin[k] as end))))")
    told = begun.withColumn("n_messages", F.size("said").cast("long")).withColumn("rendered", F.expr("array_join(transform(__shown, s -> concat(s.head, s.body, '\\n')), '')")).withColumn("spans", spans)
    return told.withColumn("n_trained", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")).drop("said", "__shown", "__sizes", "__walked", "__begin")


def mask() -> F.Column:
    return F.expr("array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')").alias("mask")


def gathered(said: DataFrame, *keys: str) -> DataFrame:
    return said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull(), "turn", "role", "text"))).alias("said"))


def rotated(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_messages, rendered, mask (spans 'start-end' joined by ','), n_trained (characters of the spans) of every dialogue and participant."""
    said = turns(conversations)
    rows = gathered(said, "conv_id").join(speakers(said), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    return rendered(rows).select("conv_id", "perspective", "n_messages", "rendered", mask(), "n_trained")


def parts(conversations: DataFrame, size: int = PART) -> DataFrame:
    """conv_id, perspective, part, begin (characters of the dialogue before it), n_messages, rendered, mask (spans in the whole dialogue) and n_trained of every part of ``size`` messages."""
    said = turns(conversations)
    placed = numbered(said, "conv_id", ["turn", "role", "text"], "number").withColumn("part", F.floor(F.col("number") / size).cast("long"))
    rows = gathered(placed, "conv_id", "part").join(speakers(said), F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")
    before = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    made = rendered(rows).withColumn("begin", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long")))
    whole = made.withColumn("spans", F.expr("transform(spans, s -> struct(s.start + begin as start, s.end + begin as end))"))
    return whole.select("conv_id", "perspective", "part", "begin", "n_messages", "rendered", mask(), "n_trained")


#: The same in DuckDB.
ROTATED_SQL = f"""
with said as (
  select row_number() over () as id, conv_id, coalesce(turn, -9223372036854775808) as turn,
    replace(coalesce(nullif(trim(translate(role, chr(13) || chr(10), '  ')), ''), 'unknown'), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text
  from conversations),
speakers as (select distinct conv_id, role as perspective from said where role <> 'system'),
shown as (
  select s.*, p.perspective, s.role = p.perspective as own,
    '{BEGIN}' || case when s.role = 'system' then 'system' when s.role = p.perspective then 'assistant' else 'user name=' || s.role end || chr(10) as head,
    s.text || '{END}' as body
  from said s join speakers p on s.conv_id is not distinct from p.conv_id),
placed as (
  select *, row_number() over (partition by conv_id, perspective order by turn, role, text, id) - 1 as number,
    coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective order by turn, role, text, id rows between unbounded preceding and 1 preceding), 0)::bigint as pos
  from shown)
select conv_id, perspective, count(*)::bigint as n_messages,
  string_agg(head || body || chr(10), '' order by turn, role, text, id) as rendered,
  coalesce(string_agg(case when own then (pos + length(head))::varchar || '-' || (pos + length(head) + length(body))::varchar end, ',' order by turn, role, text, id), '') as mask,
  coalesce(sum(case when own then length(body) end), 0)::bigint as n_trained
from placed group by conv_id, perspective
"""


def parts_sql(size: int = PART) -> str:
    """``parts`` in DuckDB."""
    head, _, _ = ROTATED_SQL.partition("select conv_id, perspective, count(*)::bigint as n_messages")
    return f"""{head}
select conv_id, perspective, (number // {size})::bigint as part, min(pos)::bigint as begin, count(*)::bigint as n_messages,
  string_agg(head || body || chr(10), '' order by number) as rendered,
  coalesce(string_agg(case when own then (pos + length(head))::varchar || '-' || (pos + length(head) + length(body))::varchar end, ',' order by number), '') as mask,
  coalesce(sum(case when own then length(body) end), 0)::bigint as n_trained
from placed group by conv_id, perspective, number // {size}"""

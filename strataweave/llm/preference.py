"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation, rendered once.

Turns are compared position by position. A position agrees when both conversations hold the same (role, text) turns
there; the prompt is every position before the first that disagrees, and what follows on either side is its
completion. ``format_preferences`` gives one row for each rendered turn, keyed by (pair_id, part, turn), with the template
applied and a loss mask: prompts are masked, and in completions only what an assistant says counts, its end marker
included. ``paired_records`` gives the training records: the prompt once, the chosen and the rejected completion beside it,
and in each completion the stretches that count (code points, end exclusive). A record holds ``segment_turns`` turn
positions; a longer pair goes on in further records of the same id, in order, so no conversation is gathered whole.

Defined results: a null role is ``user``, a null text is empty, a null turn comes first (position -1); a turn repeated
with the same role and text counts once; different turns at one position are ordered by role, then text; a pair with
one side only has an empty prompt, all its turns being completion, and an empty other side; of two identical
conversations all is prompt and both completions are empty; a very long text is a value like others and is never cut; rows without conv_id are left out; an empty table gives no
records; columns beside those named are not carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BEGIN, END = "<|im_start|>", "<|im_end|>"


def _parts(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text -> pair_id, part, turn, role, text; rows may repeat."""
    t = turns.filter("pair_id is not null and side in ('chosen', 'rejected')").select(
        F.col("pair_id").cast("long").alias("pair_id"), "side", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # 1. Where do the sides part? Two 64-bit hashes stand for a turn's content, so texts stay out of this shuffle.
    content = [F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "text", "role")]
    held = t.groupBy("pair_id", "turn", content[0].alias("h"), content[1].alias("g")).agg(
        F.max(F.col("side") == "chosen").alias("chosen"), F.max(F.col("side") == "rejected").alias("rejected")
    )
    parts = held.groupBy("pair_id").agg(F.min(F.when(~(F.col("chosen") & F.col("rejected")), F.col("turn"))).alias("fork"))
    # 2. Prompt turns are taken from the chosen side only.
    common = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    return (
        t.join(parts, "pair_id").filter(~common | (F.col("side") == "chosen"))
        .withColumn("part", F.when(common, "prompt").otherwise(F.col("side")))
        .select("pair_id", "part", "turn", "role", "text")
    )


def _head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(_head(role), text, F.lit(END + "\n"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text -> rendered turns with masks."""
    role, text = F.col("role"), F.col("text")
    counts = (F.col("part") != "prompt") & (role == "assistant")
    return _parts(turns).distinct().select(
        "pair_id", "part", "turn", "role", _rendered(role, text).alias("rendered"), counts.alias("in_loss"),
        F.when(counts, F.length(_head(role))).otherwise(0).cast("long").alias("loss_start"),
        F.when(counts, F.length(_rendered(role, text)) - 1).otherwise(0).cast("long").alias("loss_end"),
    )


SPANS = "array<struct<start: bigint, end: bigint>>"


def _said(turns: Column) -> Column:
    """Sorted turns of a completion -> the stretches of their joined rendering that count."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = (acc["at"] + F.length(_rendered(x["role"], x["text"]))).cast("long")
        span = F.struct((acc["at"] + F.length(_head(x["role"]))).cast("long").alias("start"), (end - 1).alias("end"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def paired_records(turns: DataFrame, segment_turns: int = 256) -> DataFrame:
    """turns as above -> pair_id, segment, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    turn = F.struct("turn", "role", "text")
    of = lambda part: F.array_sort(F.collect_set(F.when(F.col("part") == part, turn))).alias(part)
    segment = F.floor(F.greatest(F.col("turn"), F.lit(0)) / segment_turns).cast("long").alias("segment")
    held = _parts(turns).groupBy("pair_id", segment).agg(of("prompt"), of("chosen"), of("rejected"))
    text = lambda part: F.array_join(F.transform(part, lambda x: _rendered(x["role"], x["text"])), "").alias(part)
    return held.select("pair_id", "segment", text("prompt"), text("chosen"), text("rejected"), _said(F.col("chosen")).alias("chosen_spans"), _said(F.col("rejected")).alias("rejected_spans"))


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k."""
    key = F.col("conv_id").cast("long")
    return conversations.filter("conv_id is not null").select(
        F.expr("cast(floor(conv_id / 2) as long)").alias("pair_id"), F.when(key % 2 == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text"
    )


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    records = paired_records(adjacent_pairs(table(spark, sf_dir, "conversations")))
    return records.withColumns({c: listed(c) for c in ("chosen_spans", "rejected_spans")})


OP3_SQL = f"""
with t as (
  select cast(conv_id // 2 as bigint) pair_id, case when conv_id % 2 = 0 then 'chosen' else 'rejected' end side,
         coalesce(cast(turn as bigint), -1) turn, coalesce(role, 'user') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
held as (
  select pair_id, turn, role, text, bool_or(side = 'chosen') c, bool_or(side = 'rejected') r from t group by all),
forks as (select pair_id, min(case when not (c and r) then turn end) fork from held group by 1),
placed as (
  select distinct t.pair_id, greatest(turn, 0) // 256 as segment, case when fork is null or turn < fork then 'prompt' else side end part, turn, role, text
  from t join forks using (pair_id)
  where not (fork is null or turn < fork) or side = 'chosen'),
said as (
  select *, '{BEGIN}' || role || chr(10) as head, '{BEGIN}' || role || chr(10) || text || '{END}' || chr(10) as line from placed),
laid as (
  select *, coalesce(sum(length(line)) over (partition by pair_id, segment, part order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as off from said)
select pair_id, cast(segment as bigint) as segment,
  coalesce(string_agg(line, '' order by turn, role, text) filter (part = 'prompt'), '') as prompt,
  coalesce(string_agg(line, '' order by turn, role, text) filter (part = 'chosen'), '') as chosen,
  coalesce(string_agg(line, '' order by turn, role, text) filter (part = 'rejected'), '') as rejected,
  coalesce(string_agg(cast(off + length(head) as bigint) || ':' || cast(off + length(line) - 1 as bigint), ',' order by turn, role, text) filter (part = 'chosen' and role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg(cast(off + length(head) as bigint) || ':' || cast(off + length(line) - 1 as bigint), ',' order by turn, role, text) filter (part = 'rejected' and role = 'assistant'), '') as rejected_spans
from laid group by 1, 2
"""

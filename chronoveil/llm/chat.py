"""Multi-party perspective rotation of dialogues.

For every participant the whole dialogue is rendered with that speaker as the assistant and all others as named users;
the mask marks what the assistant says. A dialogue is rendered in parts of a bounded number of turns with offsets that
run through the whole dialogue, so a dialogue of any length never has to fit into one row or task. DataFrame functions only.

Defined results: turns are ordered by (turn, speaker, text), nulls first, and repeated rows are kept; a null text is
empty; a null speaker speaks as ``unknown`` and takes no perspective of its own; narrators (system) keep their role in
every perspective and take none; a null conversation id is one conversation; control marks inside a text are broken up
with a space; a dialogue without participants gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoveil.llm import base

START, END = "<|im_start|>", "<|im_end|>"
TURNS_PER_PART = 256


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           narrators: tuple[str, ...] = ("system",), turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Columns conv_id, participant, part, start, text, mask: ``mask`` lists start:end of the assistant's words.

    Offsets are code points from the beginning of the dialogue in this perspective.
    """
    base.set_up(turns.sparkSession)
    rows = base.pick(turns, conv_id=(conv, "bigint"), turn=(turn, "bigint"), speaker=(speaker, "string"), text=(text, "string"))
    rows = rows.select(
        "conv_id", "turn", "speaker", F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / turns_per_part), F.lit(-(2 ** 62))).cast("bigint").alias("block"))
    place = F.expr("row_number() over (partition by conv_id, block order by turn nulls first, speaker nulls first, text)")
    rows = rows.withColumn("place", place).withColumn("sub", F.floor((F.col("place") - 1) / turns_per_part))
    parts = rows.groupBy("conv_id", "block", "sub").agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns"))
    people = (rows.filter(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*narrators))
              .select(F.col("conv_id").alias("whose"), F.col("speaker").alias("participant")).distinct())
    # The parts of a very long dialogue are split by the skew join; a part meets each participant once.
    pairs = parts.join(people, F.col("conv_id").eqNullSafe(F.col("whose")))
    name = lambda t: F.coalesce(t.speaker, F.lit("unknown"))
    own = lambda t: t.speaker.eqNullSafe(F.col("participant"))
    head = lambda t: F.when(own(t), F.lit(f"{START}assistant\n")).when(
        name(t).isin(*narrators), F.concat(F.lit(START), name(t), F.lit("\n"))).otherwise(
        F.concat(F.lit(f"{START}user name="), name(t), F.lit("\n")))
    pieces = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t.text, F.lit(END)).alias("body"), own(t).alias("own")))
    shown = pairs.select("conv_id", "participant", "block", "sub", pieces.alias("pieces"))
    shown = shown.select("conv_id", "participant", "block", "sub", F.array_join(F.transform(
        "pieces", lambda p: F.concat(p.head, p.body, F.lit("\n"))), "").alias("text"), F.aggregate(
        "pieces", F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<a:bigint,b:bigint>>))"),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p.head) + F.length(p.body) + 1).alias("at"),
            F.when(p.own, F.array_append(acc["spans"], F.struct(
                (acc["at"] + F.length(p.head)).alias("a"), (acc["at"] + F.length(p.head) + F.length(p.body)).alias("b"))))
            .otherwise(acc["spans"]).alias("spans"))).alias("r"))
    shown = base.written(shown.select("conv_id", "participant", "block", "sub", "text", F.col("r.at").alias("size"),
                                      F.col("r.spans").alias("spans")), "perspectives")
    whole = "(partition by conv_id, participant order by block, sub"
    starts = shown.select("conv_id", "participant", "block", "sub", F.expr(
        f"sum(size) over {whole} rows unbounded preceding) - size").alias("start"), F.expr(
        f"row_number() over {whole}) - 1").cast("bigint").alias("part"))
    out = shown.alias("s").join(starts.alias("t"), F.expr(
        "s.conv_id <=> t.conv_id and s.participant = t.participant and s.block = t.block and s.sub = t.sub"))
    mask = F.array_join(F.transform("s.spans", lambda x: F.concat_ws(
        ":", (x.a + F.col("t.start")).cast("string"), (x.b + F.col("t.start")).cast("string"))), ",")
    return out.select("s.conv_id", "s.participant", "t.part", "t.start", "s.text", mask.alias("mask"))

"""Perspective rotation: every dialogue once per participant, with that participant as the assistant.

For each participant the dialogue is rendered with their turns as `assistant`, the other participants' turns as `user` with
their name, system turns unchanged. `mask` lists the code point spans that the participant says, end-of-turn mark included,
and that a model would be trained on.

A dialogue is rendered in parts of `turns_per_part` consecutive turns, one row each; parts in order give the whole dialogue,
so no row or task has to hold a dialogue of any length. The turns are numbered without their texts, by ranges of dialogue
and order, so that turns at one number, or without one, are cut into parts like all others. Texts are shuffled
twice: to fold copies and take their number, and to meet the other turns of their part. Only built-in functions.

Defined cases: rows that are equal in dialogue, turn, speaker and text are one turn; different rows at one turn number come
in order of speaker, then of the SHA-256 of the text; a null text is an empty turn; a null speaker is a participant named
`unknown`; a null turn number sorts before all others; null dialogue ids form one dialogue; a dialogue of system turns alone
has no participant and no row; an empty table gives an empty result; other columns are not read. Control marks inside
names and texts lose their bar, so a text cannot open or close a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursegrid.llm.shared import numbered, settled

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def harmless(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<|im_"), F.lit("<im_")), F.lit("|>"), F.lit(">"))


def rotate(
    turns: DataFrame,
    dialogue_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
    system: str = "system",
    turns_per_part: int = 256,
) -> DataFrame:
    """`conv_id, perspective, part, n_turns, n_own_turns, text, mask`, one row per dialogue, participant and part."""
    rows = turns.select(
        F.col(dialogue_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    order = ["turn", "speaker", "digest"]
    # Structs of columns that may be null are no null themselves, so plain equality joins them without a further shuffle.
    same_turn = F.struct("conv_id", *order).alias("key")
    at = numbered(rows.select("conv_id", *order).distinct(), ["conv_id"], order, "at")
    at = settled(at.withColumn("part", F.floor(F.col("at") / turns_per_part).cast("long")))
    texts = rows.groupBy(same_turn).agg(F.first("text").alias("text"))
    said = F.struct("at", F.col("key.speaker").alias("speaker"), "text")
    unit = F.struct("conv_id", "part").alias("unit")
    parts = (
        texts.join(at.select(same_turn, "at", unit), "key")
        .groupBy("unit")
        .agg(F.array_sort(F.collect_list(said)).alias("said"))
    )
    people = at.filter(F.col("speaker") != system).select("conv_id", "speaker").distinct().alias("q")
    views = (
        at.select("conv_id", "part").distinct().alias("p")
        .join(people, F.col("p.conv_id").eqNullSafe(F.col("q.conv_id")))
        .select(F.struct("p.conv_id", "part").alias("unit"), F.col("speaker").alias("perspective"))
    )
    seen = parts.join(views, "unit").select("unit.conv_id", "unit.part", "said", "perspective")
    return seen.select(
        "conv_id",
        "perspective",
        "part",
        _render(F.col("said"), F.col("perspective"), system).alias("r"),
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda s: s["speaker"] == F.col("perspective"))).cast("long").alias("n_own_turns"),
    ).select(
        "conv_id",
        "perspective",
        "part",
        "n_turns",
        "n_own_turns",
        F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        _mask(F.col("r")).alias("mask"),
    )


def _render(said: Column, me: Column, system: str) -> Column:
    """Head and body of each turn, and whether the body is trained on."""

    def turn(s: Column) -> Column:
        name = F.when(s["speaker"] == me, F.lit("assistant")).when(s["speaker"] == system, F.lit("system"))
        other = F.concat(F.lit("user name="), F.regexp_replace(harmless(s["speaker"]), "[\\r\\n]+", " "))
        return F.struct(
            F.concat(F.lit(OPEN), F.coalesce(name, other), F.lit("\n")).alias("head"),
            F.concat(harmless(s["text"]), F.lit(CLOSE)).alias("body"),
            (s["speaker"] == me).alias("own"),
        )

    return F.transform(said, turn)


def _mask(turns: Column) -> Column:
    none = F.array().cast("array<struct<start:long,end:long>>")
    state = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + 1).cast("long").alias("at"), F.when(x["own"], F.concat(s["out"], span)).otherwise(s["out"]).alias("out")
        )

    return F.aggregate(turns, state, step, lambda s: s["out"])

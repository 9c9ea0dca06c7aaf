"""Chat formatting by perspective rotation.

Every participant of a conversation (each role but ``system``) gets a rendering of the dialogue in which that speaker is the assistant
and all others are named users; the loss mask covers exactly the assistant's own words.  A conversation of up to ``SEGMENT`` turns is
one dialogue.  A longer one is rendered in stretches of that many turns, counted in their order, and every later stretch begins with the system
turns that open the conversation; so no row or group is unbounded, and no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.merkle import ranked

SEGMENT = 1_024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def safe(c: Column) -> Column:
    """Text that cannot pass for one of the markers: ``<|`` becomes ``< |``."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation, perspective and segment: ``text``, ``mask`` (spans [begin, end) in code points of the assistant's words), ``n_turns``, ``carried``.

    Turns are ordered by turn, role and text, nulls first.  A null role is the participant ``unknown``, a null text is empty, all rows without a
    conv_id form one conversation.  ``n_turns`` counts the segment's own turns, ``carried`` the opening system turns put before them.  A conversation of
    system turns alone has no participant and no row; repeated rows stay repeated turns.  Places in a conversation come from sorted ranges that are
    counted and added up, so a conversation may hold a third of all turns; only segments are gathered.  Other columns are not read.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_part")
    rows = ranked(turns.select("conv_id", named, "turn", F.coalesce("role", F.lit("unknown")).alias("_who"), safe(F.col("text")).alias("_text")), ["turn", "_who", "_text"])
    people = rows.where("_who <> 'system'").groupBy("_part", "_who").agg(F.count(F.lit(1)).alias("_spoken")).select("_part", F.col("_who").alias("perspective"))
    grouped = rows.groupBy("_part", "conv_id", "_n", F.floor(F.col("_rank") / segment).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("_rank", "_who", "_text"))).alias("_turns"))
    opening = F.filter("_turns", lambda t: (t["_who"] == "system") & (t["_rank"] < F.coalesce(
        F.array_min(F.transform(F.filter("_turns", lambda u: u["_who"] != "system"), lambda u: u["_rank"])), F.lit(segment))))
    opened = grouped.where((F.col("segment") == 0) & (F.col("_n") > segment)).select("_part", opening.alias("_opening"))
    led = grouped.join(opened, "_part", "left").withColumn("_opening", F.when(F.col("segment") > 0, F.col("_opening")))
    led = led.withColumns({"carried": F.coalesce(F.size("_opening"), F.lit(0)).cast("bigint"), "n_turns": F.size("_turns").cast("bigint"),
                           "_turns": F.when(F.col("_opening").isNull(), F.col("_turns")).otherwise(F.concat("_opening", "_turns"))})
    paired = led.join(people, "_part")

    def head(t: Column) -> Column:
        me = t["_who"] == F.col("perspective")
        return F.concat(F.lit(OPEN), F.when(me, F.lit("assistant")).when(t["_who"] == "system", F.lit("system")).otherwise(
            F.concat(F.lit("user name="), safe(t["_who"]))), F.lit("\n"))

    pieces = F.transform("_turns", lambda t: F.struct(head(t).alias("head"), t["_text"].alias("body"), (t["_who"] == F.col("perspective")).alias("own")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.cast("bigint").alias("begin"), end.cast("bigint").alias("end")))
        return F.struct((end + len(CLOSE)).cast("bigint").alias("at"), F.when(p["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return paired.withColumn("_pieces", pieces).select(
        "conv_id", "perspective", "segment",
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        F.aggregate("_pieces", start, step)["spans"].alias("mask"), "n_turns", "carried")

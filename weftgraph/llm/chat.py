"""Multi-party perspective rotation of dialogues, in DataFrame operations only.

Every participant of a conversation gets the dialogue once with that speaker as the assistant, the
other speakers as named users, and a mask over what the assistant says. Long conversations are
rendered in segments of ``SEGMENT`` turn numbers, so no row and no task holds an unbounded one; a
conversation's list of speakers reaches its segments by a join that broadcasts only hot ones. The texts of a
conversation's segments, put together in their order, are the whole rendering; a segment tells its first turn.

Defined results: rows without conv_id belong to no conversation and are left out; a null text is empty; a
null role is the speaker ``unknown``; null turns come last, in a segment of their own; turns with
the same number follow by role, then text; repeated rows are repeated turns; control marks inside a text
are broken up; system turns open no perspective; a conversation of system turns alone gives no
row; very long texts are rendered whole; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.storage import join_groups

OPEN, CLOSE, SEGMENT, FIXED = "<|im_start|>", "<|im_end|>", 64, ("system",)


def rotate(turns: DataFrame, segment: int = SEGMENT, fixed: tuple[str, ...] = FIXED) -> DataFrame:
    """conv_id, perspective, segment, first_turn, n_turns, n_own, text, mask: spans of characters the assistant says, with its end mark."""
    clean = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text")
    ).withColumn("segment", F.floor(F.col("turn") / segment))
    part = clean.groupBy("conv_id", "segment").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.min("turn").alias("first_turn")
    )
    speakers = clean.groupBy("conv_id").agg(F.collect_set("role").alias("speakers"), F.count_distinct("segment").alias("n_segments"))
    # There are no more segments than turns, so the count of turns bounds how many conversations are hot.
    rows = join_groups(part, speakers, "conv_id", "n_segments", turns.count())
    each = rows.select("conv_id", "segment", "first_turn", "turns", F.explode(F.array_except("speakers", F.array(*map(F.lit, fixed)))).alias("perspective"))
    own = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.concat(F.lit(OPEN), F.when(own(t), "assistant").when(t["role"].isin(*fixed), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"])), F.lit("\n"))
    parts = each.withColumn("parts", F.transform("turns", lambda t: F.struct(own(t).alias("own"), F.char_length(head(t)).cast("long").alias("head"), (F.char_length(t["text"]) + len(CLOSE)).cast("long").alias("body"), F.concat(head(t), t["text"], F.lit(CLOSE + "\n")).alias("shown"))))
    span = F.lit(None).cast("struct<begin:bigint,end:bigint>")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array(span).alias("mask"))
    walked = F.aggregate("parts", start, lambda a, p: F.struct(
        (a["at"] + p["head"] + p["body"] + 1).alias("at"),
        F.when(p["own"], F.concat(a["mask"], F.array(F.struct((a["at"] + p["head"]).alias("begin"), (a["at"] + p["head"] + p["body"]).alias("end"))))).otherwise(a["mask"]).alias("mask")))
    return parts.select("conv_id", "perspective", F.col("segment").cast("long").alias("segment"), "first_turn", F.size("parts").cast("long").alias("n_turns"), F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"), F.array_join(F.transform("parts", lambda p: p["shown"]), "").alias("text"), F.filter(walked["mask"], lambda m: m.isNotNull()).alias("mask"))

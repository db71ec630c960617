"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the
assistant and all others as named users, and the spans to train on are those
of the assistant. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 64
SYSTEM = "system"
# The template's markers.
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    """A text that can't open or close a turn: a blank splits the markers' first two characters."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _name(speaker: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(F.col(speaker), F.lit("unknown")), r"[\s<>|]+", " "))


def _turns(dialogues: DataFrame, speaker: str) -> DataFrame:
    """One row for each distinct turn, with the part it belongs to.

    Part = turn number // ``PART_TURNS``. Where one turn number has more than
    ``PART_TURNS`` different rows, they are split by their hash, so no part
    grows without bound.
    """
    rows = dialogues.select("conv_id", F.col("turn").cast("long").alias("turn"), _name(speaker).alias("speaker"),
                            _safe(F.col("text")).alias("body")).distinct()
    rows = rows.withColumn("rank", F.xxhash64("speaker", "body"))
    crowded = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter(F.col("n") > PART_TURNS)
    same = F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & F.col("r.turn").eqNullSafe(F.col("c.turn"))
    split = F.floor(F.shiftrightunsigned("rank", 1) / F.lit(float(1 << 63)) * F.ceil(F.col("n") / (PART_TURNS // 2)))
    return (rows.alias("r").join(crowded.alias("c"), same, "left")
            .select("r.*", F.floor(F.col("r.turn") / PART_TURNS).alias("part"),
                    F.coalesce(split, F.lit(0)).cast("long").alias("piece"),
                    F.when(F.col("n").isNotNull(), F.col("r.turn")).alias("crowded_turn")))


def rotate(dialogues: DataFrame, speaker: str = "role") -> DataFrame:
    """(conv_id, part, piece, perspective, n_turns, n_trained, text, spans).

    One row for each part of a dialogue and each participant of the whole
    dialogue, so a participant's parts make up the dialogue, also where it is
    silent: ``text`` is the rendered part with the participant as assistant, ``spans`` the code point
    ranges [start, end) of its turns' bodies and end markers. Turns follow in
    turn order (null first; equal numbers by a hash of speaker and text);
    ``part`` numbers stretches of ``PART_TURNS`` turn numbers; a turn is in one
    part only, ``system`` turns too. ``system`` turns stay system turns
    and are nobody's perspective, so a dialogue of only those gives no row.
    A null text is empty, a null speaker ``unknown``, rows with a null conv_id
    are one dialogue, a repeated row is one turn. Markers inside texts and
    names are broken up.
    """
    parts = _turns(dialogues, speaker).groupBy("conv_id", "part", "crowded_turn", "piece").agg(
        F.sort_array(F.collect_list(F.struct("turn", "rank", "speaker", "body"))).alias("turns"))
    speakers = dialogues.select("conv_id", _name(speaker).alias("perspective")).filter(F.col("perspective") != SYSTEM).distinct()
    each = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select(
        "p.conv_id", "part", "piece", "turns", "perspective")

    def head(t: Column) -> Column:
        who = (F.when(t["speaker"] == SYSTEM, F.lit(SYSTEM)).when(t["speaker"] == F.col("perspective"), F.lit("assistant"))
               .otherwise(F.concat(F.lit("user name="), t["speaker"])))
        return F.concat(F.lit(START), who, F.lit("\n"))

    each = each.withColumn("messages", F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["body"], F.lit(END)).alias("body"),
        (t["speaker"] == F.col("perspective")).alias("trained"))))
    each = each.withColumn("sizes", F.transform("messages", lambda m: F.char_length(m["head"]) + F.char_length(m["body"]) + 1))

    def span(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, x: a + x) + F.char_length(m["head"])
        return F.struct(before.alias("start"), (before + F.char_length(m["body"])).alias("end"), m["trained"].alias("trained"))

    spans = F.transform(F.filter(F.transform("messages", span), lambda s: s["trained"]),
                        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "")
    return each.select("conv_id", "part", "piece", "perspective", F.size("turns").alias("n_turns"),
                       F.size(spans).alias("n_trained"), text.alias("text"), spans.alias("spans"))

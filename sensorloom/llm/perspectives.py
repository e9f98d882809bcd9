"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant. Every other speaker is a user with a name; a system
message stays a system message and is nobody's perspective. The mask marks what
a model should learn in that rendering: the assistant's own content with its end marker.

A rendering of a long conversation is not one string in one task: it is cut into
*parts* of ``PART_TURNS`` neighbouring messages. Where a part begins in the whole is
found from the lengths of the parts before it, so positions are global although no task
ever holds more than one part. Ordinary conversations have one part.

Defined results: a message without a conversation or without a role is left out (it
has no place or no speaker); a null text is an empty message; messages are ordered
by turn, then role and text (nulls first), so ties and repeated rows have a fixed place
and are all rendered; role names are trimmed and lower-cased, line ends inside names become
blanks, markers inside names and texts are escaped; conversations of system messages alone give no row; an empty table gives
an empty one; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.ranking import binned_rank

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Messages of one part.
PART_TURNS = 512
SYSTEM_ROLES = ("system",)


def _clean(text: Column) -> Column:
    """Text in which no marker can be mistaken for one of ours."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _name(speaker: Column) -> Column:
    """A speaker as part of a header, which ends at the line end."""
    return _clean(F.translate(speaker, "\n\r", "  "))


def messages(conversations: DataFrame) -> DataFrame:
    """``conv_id, speaker, is_system, content, turn`` of the messages that take part."""
    role = F.lower(F.trim(F.col("role").cast("string")))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"),
    ).where(F.col("conv_id").isNotNull() & F.col("speaker").isNotNull() & (F.col("speaker") != ""))


def placed(spoken: DataFrame, part_turns: int) -> DataFrame:
    """Adds ``place`` (0, 1, ... within the conversation) and ``part``.

    Turns are binned by value, so that a conversation of any length is ranked in
    pieces; only messages of neighbouring turn numbers are sorted together.
    """
    binned = spoken.withColumn("bin", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(2**62))))
    order = [F.col("turn").asc_nulls_first(), "speaker", "content"]
    ranked = binned_rank(binned, ["conv_id"], "bin", order)
    place = (F.col("position") - 1).cast("bigint")
    return ranked.withColumn("place", place).withColumn(
        "part", F.floor(F.col("place") / part_turns)
    ).drop("bin", "position")


def participants(spoken: DataFrame) -> DataFrame:
    """``conv_id, perspective``: everyone who speaks, but for system messages."""
    speakers = spoken.where(~F.col("speaker").isin(*SYSTEM_ROLES))
    return speakers.groupBy("conv_id", "speaker").agg(F.lit(1).alias("one")).select(
        "conv_id", F.col("speaker").alias("perspective")
    )


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, perspective, part, start, n_messages, rendered, mask``.

    ``rendered`` is one part; ``start`` its first character in the whole rendering;
    ``mask`` the array of (begin, end) within ``rendered`` to be learnt, end excluded.
    """
    spoken = messages(conversations)
    seats = placed(spoken, part_turns)
    # One row per message and participant: what is rendered, no pairs of messages.
    views = seats.join(participants(spoken), "conv_id")
    own = F.col("speaker") == F.col("perspective")
    is_system = F.col("speaker").isin(*SYSTEM_ROLES)
    header = (
        F.when(own, F.lit("assistant"))
        .when(is_system, F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), _name(F.col("speaker"))))
    )
    lines = views.select(
        "conv_id",
        "perspective",
        "part",
        "place",
        own.alias("own"),
        F.concat(F.lit(OPEN), header, F.lit("\n")).alias("head"),
        F.concat(_clean(F.col("content")), F.lit(CLOSE)).alias("body"),
    )
    message = F.struct("place", "own", "head", "body")
    parts = lines.groupBy("conv_id", "perspective", "part").agg(
        # At most ``part_turns`` messages.
        F.array_sort(F.collect_list(message)).alias("said")
    )
    whole = F.array_join(
        F.transform("said", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), ""
    )
    begin = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("spans"),
    )

    def step(acc: Column, m: Column) -> Column:
        text_from = acc["at"] + F.length(m["head"])
        text_to = text_from + F.length(m["body"])
        span = F.struct(text_from.alias("begin"), text_to.alias("end"))
        spans = F.when(m["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((text_to + 1).alias("at"), spans.alias("spans"))

    rendered = parts.select(
        "conv_id",
        "perspective",
        "part",
        F.size("said").cast("bigint").alias("n_messages"),
        whole.alias("rendered"),
        F.aggregate("said", begin, step)["spans"].alias("mask"),
    ).withColumn("width", F.length("rendered").cast("bigint"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Over parts, which are a ``part_turns``-th of the messages, and without their texts.
    starts = rendered.select("conv_id", "perspective", "part", "width").withColumn(
        "start", F.coalesce(F.sum("width").over(before), F.lit(0))
    )
    keys = ["conv_id", "perspective", "part"]
    return rendered.join(starts.drop("width"), keys).select(
        *keys, "start", "n_messages", "rendered", "mask"
    )

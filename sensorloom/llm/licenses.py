"""License scans as an exact set-similarity join of text blocks and templates.

Every text is cut into overlapping blocks of words. A block and a template belong
together if the block holds at least ``threshold`` of the template's distinct
words. The join is exact and runs on DataFrame functions alone:

* *order*: the words of all templates are ordered by how many words of the whole
  corpus they are, rarest first;
* *prefix*: of a template with n words of which m must be met, a block that
  holds m has one of the n - m + 1 rarest, so only those are joined on;
* *length*: a block with fewer distinct words than m is out before it is joined;
* *position*: if the rarest shared word is the p-th of the template, at most
  n - p + 1 words can be shared, and pairs for which that is below m are out;
* what is left is verified by counting the shared words.

Labels that name a license by a phrase are templates as well, with threshold 1;
after the join an exact check finds the places where the words stand one behind the other.

Blocks start every ``STRIDE`` words and reach ``OVERLAP`` words into the next, so a
phrase lies in the block in which it starts and a passage of up to ``OVERLAP`` words lies in some block as a whole.

Defined results: a null, empty or word-less text has 0 words, no places, no labels
and score 0; a null ``doc_id`` is carried along; repeated rows give repeated rows with the same
result; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.sources.scratch import materialize

STRIDE = 64
OVERLAP = 48
THRESHOLD = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What stands between words: everything ASCII but digits and lower-case letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words that stand for a license; a phrase must also stand in order."""

    name: str
    label: str
    words: str
    phrase: bool = False
    # What decides for the label besides the threshold: words that must be met, or one of
    # these sequences as it stands.
    must: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()


PHRASES = (
    Template("gpl-name", "gpl", "gnu general public license", True),
    Template("apache-name", "apache", "apache license", True),
    Template("cc-by-name", "cc-by", "cc by", True),
    Template("mit-name", "mit", "mit license", True),
)

# Opening sentences of well-known license texts (fixed values).
PASSAGES = (
    Template(
        "mit-grant",
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files the software to deal in the software "
        "without restriction",
    ),
    Template(
        "bsd-grant",
        "bsd",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
    ),
    Template(
        "gpl-notice",
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms "
        "of the gnu general public license as published by the free software foundation",
        must=("gnu",),
    ),
    Template(
        "gpl-use",
        "gpl",
        "licensed under the gnu general public license version",
        forms=("licensed under the gnu general public license version",),
    ),
    Template(
        "apache-notice",
        "apache",
        "licensed under the apache license version 2 0 you may not use this file except in "
        "compliance with the license",
        must=("apache",),
    ),
    Template(
        "apache-use",
        "apache",
        "licensed under the apache license version 2 0",
        forms=("licensed under the apache license version 2 0",),
    ),
    Template(
        "cc-by-nc-use",
        "cc-by-nc",
        "licensed under cc by nc 4 0",
        forms=(
            "licensed under cc by nc 4 0",
            "licensed under cc by nc sa 4 0",
            "licensed under cc by nc nd 4 0",
        ),
    ),
    Template(
        "cc-by-sa-use",
        "cc-by-sa",
        "licensed under cc by sa 4 0",
        forms=("licensed under cc by sa 4 0", "licensed under cc by nc sa 4 0"),
    ),
    Template(
        "mit-use",
        "mit",
        "released under the mit license",
        forms=("released under the mit license",),
    ),
    Template(
        "mpl-notice",
        "mpl",
        "this source code form is subject to the terms of the mozilla public license",
        must=("mozilla",),
    ),
    Template(
        "reserved", "all-rights-reserved", "all rights reserved", forms=("all rights reserved",)
    ),
)


def words_of(text: Column) -> Column:
    """Lower-cased words of a text; ASCII letters only are folded."""
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(folded, NO_WORD), lambda w: w != "")


def needed(n: int, threshold: float, phrase: bool) -> int:
    """How many of n distinct words must be met."""
    if phrase:
        return n
    # Whole numbers: 0.8 * 5 is 4, not a little more.
    share = round(threshold * 1000)
    return max(1, -(-n * share // 1000))


def word_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template word occurs in the corpus: one row per word at most."""
    found = (
        words.select(F.explode("ws").alias("w"))
        .where(F.col("w").isin(vocabulary))
        .groupBy("w")
        .count()
    )
    return {row["w"]: row["count"] for row in found.collect()}


@dataclass(frozen=True)
class Ordered:
    """A template with its distinct words in global order, rarest first."""

    template: Template
    words: list[str]
    need: int

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.need + 1]


def in_global_order(
    templates: tuple[Template, ...], counts: dict[str, int], threshold: float
) -> list[Ordered]:
    ordered = []
    for t in templates:
        distinct = sorted(set(t.words.split()), key=lambda w: (counts.get(w, 0), w))
        ordered.append(Ordered(t, distinct, needed(len(distinct), threshold, t.phrase)))
    return ordered


def template_prefixes(spark: SparkSession, ordered: list[Ordered]) -> DataFrame:
    """One row per template and prefix word: a table of the size of the templates."""
    rows = [
        (word, o.template.name, o.template.label, o.template.phrase, o.words, len(o.words), o.need, p)
        for o in ordered
        for p, word in enumerate(o.prefix, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "word string, name string, label string, phrase boolean, t_words array<string>, "
        "n int, need int, p int",
    )


def candidate_blocks(words: DataFrame, ordered: list[Ordered], stride: int, overlap: int) -> DataFrame:
    """``row, block, ws`` of the blocks that hold any prefix word and enough words."""
    probe = F.lit(sorted({w for o in ordered for w in o.prefix}))
    fewest = min(o.need for o in ordered)
    # First the texts, then the blocks: most texts hold no such word at all.
    hopeful = words.where(F.arrays_overlap("ws", probe))
    blocks = hopeful.select(
        "row",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("ws"), F.lit(stride)),
                lambda at: F.slice("ws", at, stride + overlap),
            )
        ).alias("block", "ws"),
    )
    return blocks.where(F.arrays_overlap("ws", probe)).where(
        F.size(F.array_distinct("ws")) >= fewest
    )


def similarity_join(blocks: DataFrame, ordered: list[Ordered]) -> DataFrame:
    """``row, block, ws, name, label, phrase, t_words, containment`` of all true pairs."""
    spark = blocks.sparkSession
    probe = F.lit(sorted({w for o in ordered for w in o.prefix}))
    tokens = blocks.select("row", "block", "ws", F.array_distinct("ws").alias("distinct_ws")).select(
        "row",
        "block",
        "ws",
        F.size("distinct_ws").alias("n_block"),
        "distinct_ws",
        F.explode(F.array_intersect("distinct_ws", probe)).alias("word"),
    )
    # The template table is bounded by the templates, not by the data.
    met = tokens.join(F.broadcast(template_prefixes(spark, ordered)), "word")
    # Length and position filters.
    close = met.where(F.col("n_block") >= F.col("need")).where(
        F.col("n") - F.col("p") + 1 >= F.col("need")
    )
    # A pair met by several prefix words is verified where it meets first.
    earlier = F.slice(F.col("t_words"), F.lit(1), F.col("p") - 1)
    first_met = close.where((F.col("p") == 1) | ~F.arrays_overlap("distinct_ws", earlier))
    shared = F.size(F.array_intersect("t_words", "distinct_ws"))
    return (
        first_met.withColumn("shared", shared)
        .where(F.col("shared") >= F.col("need"))
        .select(
            "row", "block", "ws", "name", "label", "phrase", "t_words",
            (F.col("shared") / F.col("n")).alias("containment"),
        )
    )


def phrase_places(ws: Column, phrase: str, stride: int) -> Column:
    """0-based starts of a phrase in a block, of those that are the block's own."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.least(F.lit(stride), F.size(ws)) - 1)

    def here(at: Column) -> Column:
        # get() is null past the end, which is no match.
        tests = [F.get(ws, at + i) == part for i, part in enumerate(parts)]
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    return F.filter(starts, here)


def _sure(t: Template, ws: Column, stride: int) -> Column:
    """Whether a block that meets the threshold also holds what decides for the template."""
    sure = F.lit(True)
    for word in t.must:
        sure = sure & F.array_contains(ws, word)
    if t.forms:
        places = [F.size(phrase_places(ws, form, stride)) > 0 for form in t.forms]
        sure = sure & reduce(lambda a, b: a | b, places)
    return sure


def scan_licenses(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    stride: int = STRIDE,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Per row of ``docs``: words, phrase places, labels and the best containment.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` and
    ``templates``, the names of all templates met. ``near_labels`` are those of all templates
    within the threshold, among them licenses that differ in one word from the text's; ``labels`` are
    those whose deciding words stand there too.
    """
    templates = PHRASES + PASSAGES
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    texts = docs.select("doc_id", words_of(F.col("text")).alias("ws"))
    ordered = in_global_order(templates, word_counts(texts, vocabulary), threshold)

    # Rows, not ids: an id may be missing or come twice. Rows of one id and one
    # word sequence have one result, so (id, digest of the words) names them.
    digest = F.md5(F.array_join("ws", " "))
    keyed = texts.select(
        "doc_id",
        F.size("ws").cast("bigint").alias("n_words"),
        F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("row"),
        "ws",
    )
    probe = F.lit(sorted({w for o in ordered for w in o.prefix}))
    pairs = similarity_join(candidate_blocks(keyed, ordered, stride, overlap), ordered)
    places = F.lit(None).cast("array<int>")
    for t in PHRASES:
        places = F.when(F.col("name") == t.name, phrase_places(F.col("ws"), t.words, stride)).otherwise(places)
    checked = pairs.withColumn("places", F.transform(places, lambda p: p + F.col("block") * stride))
    met = checked.where(~F.col("phrase") | (F.size("places") > 0))
    sure = F.lit(True)
    for t in PASSAGES:
        if t.must or t.forms:
            sure = F.when(F.col("name") == t.name, _sure(t, F.col("ws"), stride)).otherwise(sure)
    per_block = met.select(
        "row", "block", "name", "label", "phrase", "containment",
        F.when(F.col("phrase"), F.size("places")).otherwise(0).alias("n_places"),
        F.array_min("places").alias("first"),
        F.array_max("places").alias("last"),
        sure.alias("sure"),
    ).dropDuplicates(["row", "block", "name"])
    found = materialize(
        per_block.groupBy("row").agg(
            F.sum("n_places").cast("bigint").alias("n_base"),
            F.min("first").cast("bigint").alias("first_word"),
            F.max("last").cast("bigint").alias("last_word"),
            # Bounded by the number of templates.
            F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base_set"),
            F.collect_set("label").alias("label_set"),
            F.collect_set(F.when(F.col("sure"), F.col("label"))).alias("sure_set"),
            F.array_sort(F.collect_set("name")).alias("templates"),
            F.max("containment").alias("score"),
        ),
        "license_hits",
    )
    rows = keyed.select(
        "doc_id", "n_words", F.when(F.arrays_overlap("ws", probe), F.col("row")).alias("row")
    )
    joined = rows.join(found, "row", "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce(F.array_join(F.array_sort("base_set"), ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort("sure_set"), ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce(F.array_join("templates", ","), F.lit("")).alias("templates"),
        F.coalesce(F.array_join(F.array_sort("label_set"), ","), F.lit("")).alias("near_labels"),
    )

"""Removal of multi-line chunks that repeat across the corpus.

A text's lines are grouped into chunks by their content: a rolling hash over the
hashes of a line and the line before it decides whether a chunk ends there. The
same lines give the same borders wherever they stand, so an insertion moves the
chunks around it and no others. Chunks that occur again, in another document or in
the same one, are candidates; they are compared byte by byte with the first
occurrence and removed if equal. The first occurrence in (doc_id, chunk) order stays.

A line of ``LONG_WORDS`` words or more is a chunk of its own: a passage that was pasted as a
single line. Else a chunk is worth removing if it has several lines with a word; a short
line that comes back everywhere (a heading, a greeting) stays.

What is shuffled is one digest per chunk; chunk texts travel only for repeated
chunks, and whole texts on their way to the candidates and to the removals.
A chunk that a third of the corpus repeats is counted before the shuffle, and the
join that finds its copies meets one row per chunk, so run-time skew handling can
split the copies.

Defined results: a null text stays null; lines end at ``\\n`` only; lines without a word
belong to the chunk they stand in; repeated rows (same id, same text) are one
document and treated alike; rows that share an id but not the text, or have no id
(they come last), are ordered by a hash of the text; an empty table gives an empty
one; all other columns stay as they are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Store, free_name, map_slices, texts_of, type_of
from sensorloom.sources.scratch import ScratchTables, materialize

# On average a chunk ends at every third line.
BORDER = 3
LONG_WORDS = 50
BLANKS = " \t\n\x0b\x0c\r"


def line_hash(line: str) -> int:
    """60 bits of the digest of a line."""
    return int(hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)


def chunk_spans(text: str, border: int = BORDER) -> list[tuple[int, int, int, int]]:
    """(begin, end, lines with a word, words) of the chunks; ends include the line end."""
    spans = []
    begin = at = filled = words = before = 0
    for line in text.split("\n"):
        start, at = at, at + len(line) + 1
        if not line.strip(BLANKS):
            continue
        n_words = len(line.encode("utf-8", "surrogatepass").split())
        if n_words >= LONG_WORDS and begin < start:
            spans.append((begin, start, filled, words))
            begin, filled, words = start, 0, 0
        filled += 1
        words += n_words
        now = line_hash(line)
        # The rolling hash of two neighbouring lines.
        if n_words >= LONG_WORDS or (31 * before + now) % border == 0:
            spans.append((begin, min(at, len(text)), filled, words))
            begin, filled, words = at, 0, 0
        before = now
    if begin < len(text):
        spans.append((begin, len(text), filled, words))
    return spans


def worth_removing(filled: int, words: int) -> bool:
    return filled > 1 or words >= LONG_WORDS


def _row_key() -> Column:
    """Names a row: equal rows are one document, equal ids alone are not."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))


def chunk_occurrences(docs: DataFrame) -> DataFrame:
    """``row, chunk, digest`` of the chunks worth removing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, numbers, digests = [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            for number, (begin, end, filled, words) in enumerate(chunk_spans(text)):
                if worth_removing(filled, words):
                    chunk = text[begin:end].rstrip("\n").encode("utf-8", "surrogatepass")
                    rows.append(row)
                    numbers.append(number)
                    digests.append(hashlib.blake2b(chunk, digest_size=16).digest())
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("text_hash").take(take),
                pa.array(numbers, pa.int32()),
                pa.array(digests, pa.binary()),
            ],
            names=["doc_id", "text_hash", "chunk", "digest"],
        )

    hashed = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_hash bigint, chunk int, digest binary"
    found = map_slices(hashed, "text", run, schema)
    row = F.struct(F.col("doc_id").alias("id"), "text_hash")
    return found.select(row.alias("row"), "chunk", "digest")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row, chunk, digest, is_first, begin, end, body`` of wanted chunks.

    ``wanted``: one row per document, with an array ``chunks`` of (chunk, digest, is_first).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = [], []
        chunks = batch.column("chunks").to_pylist()
        for row, text in enumerate(batch.column("text").to_pylist()):
            spans = chunk_spans(text)
            for one in chunks[row]:
                begin, end, _, _ = spans[one["chunk"]]
                rows.append(row)
                body = text[begin:end].rstrip("\n")
                out.append((one["chunk"], one["digest"], one["is_first"], begin, end, body))
        take = pa.array(rows, pa.int64())
        columns = list(zip(*out)) or [()] * 6
        types = [pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("text_hash").take(take),
                *[pa.array(c, t) for c, t in zip(columns, types)],
            ],
            names=[
                "doc_id", "text_hash", "chunk", "digest", "is_first", "begin", "end", "body",
            ],
        )

    texts = texts_of(docs).withColumn("row", _row_key())
    touched = texts.join(wanted.hint("shuffle_hash"), "row").select(
        "doc_id", F.col("row.text_hash").alias("text_hash"), "text", "chunks"
    )
    schema = (
        f"doc_id {type_of(docs, 'doc_id')}, text_hash bigint, chunk int, digest binary, "
        "is_first boolean, begin int, end int, body string"
    )
    found = map_slices(touched, "text", run, schema)
    row = F.struct(F.col("doc_id").alias("id"), "text_hash")
    return found.select(row.alias("row"), "chunk", "digest", "is_first", "begin", "end", "body")


def repeated_spans(docs: DataFrame, store: Store = materialize) -> DataFrame:
    """``row, spans``: per document the (begin, end) characters to be removed."""
    occurrences = store(chunk_occurrences(docs), "chunks")
    place = F.struct(F.col("row.id").isNull().alias("last"), "row", "chunk")
    repeated = store(
        occurrences.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("digest", "first"),
        "repeated_chunks",
    )
    hits = occurrences.join(repeated, "digest").select(
        "row", "chunk", "digest", (place == F.col("first")).alias("is_first")
    )
    # At most the chunks of one document; equal rows say the same.
    wanted = hits.groupBy("row").agg(
        F.collect_set(F.struct("chunk", "digest", "is_first")).alias("chunks")
    )
    copies = store(_cut_out(docs, wanted), "repeated_chunk_texts")
    # The bytes are compared by grouping: copies of one chunk meet map-side. A body
    # without a first occurrence only shares the digest and stays.
    bodies = copies.groupBy("digest", "body").agg(F.max("is_first").alias("has_first"))
    # Written, as it is nearly always empty: known small, it does not make the copies move.
    strangers = store(bodies.where("not has_first").select("digest", "body"), "strangers")
    removed = copies.where("not is_first").join(strangers, ["digest", "body"], "left_anti")
    return removed.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans")
    )


def _without(text: Column, spans: Column) -> Column:
    """``text`` without the given ascending character spans."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def skip(acc: Column, span: Column) -> Column:
        kept = F.concat(acc["kept"], F.substring(text, acc["at"] + 1, span["begin"] - acc["at"]))
        return F.struct(span["end"].alias("at"), kept.alias("kept"))

    left = F.aggregate(spans, start, skip)
    rest = F.concat(left["kept"], F.substring(text, left["at"] + 1, F.length(text)))
    return F.regexp_replace(rest, r"\n+\z", "")


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks cut out, and ``chunks_removed`` (long) per row.

    A column of ``docs`` that has this name, in upper or lower case, stays as it is; the new one is
    then called as :func:`free_name` says.
    """
    with ScratchTables(docs.sparkSession) as scratch:
        removals = materialize(repeated_spans(docs, scratch.materialize), "removals")
    drops = removals.select(
        F.col("row").alias("__dedup_row"), F.col("spans").alias("__dedup_spans")
    )
    text = F.col("text").cast("string")
    key = F.struct(
        F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")
    )
    # One row per document on the small side; texts are not sorted.
    joined = docs.withColumn("__dedup_row", key).join(
        drops.hint("shuffle_hash"), "__dedup_row", "left"
    )
    spans = F.col("__dedup_spans")
    return joined.select(
        *[
            (F.when(spans.isNull(), text).otherwise(_without(text, spans)) if c == "text" else F.col(f"`{c}`")).alias(c)
            for c in docs.columns
        ],
        F.coalesce(F.size(spans), F.lit(0)).cast("bigint").alias(free_name(docs, "chunks_removed")),
    )

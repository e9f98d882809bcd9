"""Removal of passages of ``RUN`` words or more that stand earlier in the corpus.

A word goes if it lies in a run of ``RUN`` words that occurs before, in another document or,
without overlap, in the same one. Passages may begin and end anywhere in a line; what
stands between the words is not compared. The first occurrence in (doc_id, word) order stays.

* *Fingerprints*: of every run the least hash of its grams of ``GRAM`` words (winnowing). Equal
  runs have equal fingerprints wherever they stand, so no repeated run is missed.
* *Runs*: only where the fingerprint occurs again, runs are named by a 128-bit digest of
  their words, and the first place of each digest is looked up.

Every word starts at most one run, and runs meet one row per digest, never each other:
the work grows with the input, and run-time skew handling can split the copies of one passage.

Defined results: a null text stays null; a text with fewer than ``RUN`` words stays;
words end at ASCII blanks; repeated rows (same id, same text) are one document and treated
alike; rows without an id come last; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Store, free_name, map_slices, texts_of, type_of
from sensorloom.llm.line_dedup import _row_key, _without
from sensorloom.sources.scratch import ScratchTables, materialize

RUN = 50
GRAM = 25
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams, and per run of ``RUN`` words the least of its grams."""
    if len(words) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))
    codes = _mixed(codes + np.uint64(0x9E3779B97F4A7C15))
    n = len(words) - GRAM + 1
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(6364136223846793005) + codes[i : i + n]
    grams = _mixed(grams).view(np.int64)
    least, width, wanted = grams, 1, RUN - GRAM + 1
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < wanted:
        rest = wanted - width
        least = np.minimum(least[:-rest], least[rest:])
    return grams, least


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _fingerprint_table(docs: DataFrame) -> DataFrame:
    """``row, mark, n``: fingerprints of a document and at how many places it has them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, marks, counts = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row, text in enumerate(batch.column("text").to_pylist()):
            grams, least = fingerprints(_words(text))
            mark, n = np.unique(grams[np.isin(grams, np.unique(least))], return_counts=True)
            rows.append(np.full(len(mark), row, np.int64))
            marks.append(mark)
            counts.append(n)
        take = pa.array(np.concatenate([np.empty(0, np.int64), *rows]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("text_hash").take(take),
                pa.array(np.concatenate(marks)),
                pa.array(np.concatenate(counts), pa.int64()),
            ],
            names=["doc_id", "text_hash", "mark", "n"],
        )

    hashed = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    schema = f"doc_id {type_of(docs, 'doc_id')}, text_hash bigint, mark bigint, n bigint"
    found = map_slices(hashed, "text", run, schema)
    return found.select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias("row"), "mark", "n")


def _run_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``row, at, digest`` and the places in the text of the runs with a wanted fingerprint.

    ``wanted``: one row per document, with an array ``marks``. A run at the start of a line
    is cut to the next word (``until``), any other from the word before (``since``).
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, out = [], []
        marks = batch.column("marks").to_pylist()
        for row, text in enumerate(batch.column("text").to_pylist()):
            words = _words(text)
            _, least = fingerprints(words)
            spans = [m.span() for m in _WORD.finditer(text)]
            for at in np.flatnonzero(np.isin(least, np.array(marks[row], np.int64))).tolist():
                last = at + RUN - 1
                before = spans[at - 1][1] if at else 0
                leads = at == 0 or "\n" in text[before : spans[at][0]]
                until = spans[last + 1][0] if last + 1 < len(spans) else len(text)
                digest = hashlib.blake2b(b" ".join(words[at : last + 1]), digest_size=16).digest()
                rows.append(row)
                out.append((at, digest, leads, spans[at][0] if leads else before, spans[last][1], until))
        take = pa.array(rows, pa.int64())
        columns = list(zip(*out)) or [()] * 6
        types = [pa.int32(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("text_hash").take(take),
                *[pa.array(c, t) for c, t in zip(columns, types)],
            ],
            names=["doc_id", "text_hash", "at", "digest", "leads", "since", "end", "until"],
        )

    texts = texts_of(docs).withColumn("row", _row_key())
    touched = texts.join(wanted.hint("shuffle_hash"), "row").select(
        "doc_id", F.col("row.text_hash").alias("text_hash"), "text", "marks"
    )
    schema = (
        f"doc_id {type_of(docs, 'doc_id')}, text_hash bigint, at int, digest binary, "
        "leads boolean, since int, end int, until int"
    )
    found = map_slices(touched, "text", run, schema)
    row = F.struct(F.col("doc_id").alias("id"), "text_hash")
    return found.select(row.alias("row"), "at", "digest", "leads", "since", "end", "until")


def _merged(runs):
    """Ascending spans apart from each other; runs that touch or overlap are one."""
    out, first, last = [], None, None
    for one in [*runs, None]:
        if first is not None and (one is None or one["at"] > last["at"] + RUN):
            out.append((first["since"], last["until"] if first["leads"] else last["end"]))
            first = None
        if one is not None:
            first, last = first or one, one
    return out


def repeated_passages(docs: DataFrame, store: Store = materialize) -> DataFrame:
    """``row, spans``: per document the (begin, end) characters to be removed."""
    prints = store(_fingerprint_table(docs), "fingerprints")
    again = store(
        prints.groupBy("mark").agg(F.sum("n").alias("places")).where("places > 1").select("mark"),
        "repeated_fingerprints",
    )
    # At most the fingerprints of one document; equal rows say the same.
    wanted = prints.join(again, "mark").groupBy("row").agg(F.collect_set("mark").alias("marks"))
    runs = store(_run_table(docs, wanted), "runs")
    place = F.struct(F.col("row.id").isNull().alias("last"), "row", "at")
    firsts = store(
        runs.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(place).alias("first"))
        .where("n > 1")
        .select("digest", "first"),
        "first_runs",
    )
    # A run that overlaps its own first occurrence (aaaa) is no second one.
    same = F.col("row").eqNullSafe(F.col("first.row"))
    gone = runs.join(firsts, "digest").where(~same | (F.col("at") >= F.col("first.at") + RUN))
    per_row = gone.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("at", "leads", "since", "end", "until"))).alias("runs")
    )
    merged = F.udf(_merged, "array<struct<begin: int, end: int>>")
    return per_row.select("row", merged("runs").alias("spans"))


def remove_repeated_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out, and ``passages_removed`` (long) per row.

    A column of ``docs`` that has this name, in upper or lower case, stays as it is; the new one is
    then called as :func:`free_name` says.
    """
    with ScratchTables(docs.sparkSession) as scratch:
        removals = materialize(repeated_passages(docs, scratch.materialize), "passage_removals")
    drops = removals.select(
        F.col("row").alias("__passage_row"), F.col("spans").alias("__passage_spans")
    )
    text = F.col("text").cast("string")
    key = F.struct(
        F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash")
    )
    joined = docs.withColumn("__passage_row", key).join(
        drops.hint("shuffle_hash"), "__passage_row", "left"
    )
    spans = F.col("__passage_spans")
    return joined.select(
        *[
            (F.when(spans.isNull(), text).otherwise(_without(text, spans)) if c == "text" else F.col(f"`{c}`")).alias(c)
            for c in docs.columns
        ],
        F.coalesce(F.size(spans), F.lit(0)).cast("bigint").alias(free_name(docs, "passages_removed")),
    )

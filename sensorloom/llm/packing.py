"""Best-fit packing planned on a histogram of lengths.

A document is its ids and an end id; longer ones are cut into pieces of exactly
the capacity, of which only the first may be shorter. What is planned is not
documents but *counts*: best-fit decreasing runs over the at most ``capacity``
distinct lengths and places all pieces of a length at once, so planning costs the
same for a thousand documents and for 10^11. The plan says, for the r-th piece of
a length, which sequence and which offset it takes; pieces get their rank within
their length (in bins of bounded size, so a very common length is no large task)
and meet their slots in a join on (length, rank).

Defined results: a null or empty text is a document of the end id alone; repeated
rows are packed as often as they occur; a null ``doc_id`` is carried along; an
empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import map_slices, texts_of, type_of
from sensorloom.llm.token_counts import load_tokenizer
from sensorloom.operators.ranking import binned_rank
from sensorloom.sources.scratch import materialize

TOKENIZER = "byte_bpe_50k"
CAPACITY = 1024
END_ID = 2
# Chunks of text whose ids a worker keeps.
KEPT_CHUNKS = 400_000
# Pieces of one length that are sorted together.
ROWS_PER_BIN = 50_000
# Slots that one row of the plan is unfolded into at a time.
SLOTS_PER_ROW = 10_000

# Printable ASCII and Latin letters: both libraries agree on what is a letter.
_SIMPLE = re.compile("[!-~À-ɏ]*")


class ChunkEncoder:
    """Byte-level BPE of whole texts by distinct chunks.

    A blank before a word starts a new pre-token and a line end between two words
    is one, so both are places where a text falls apart without changing its ids. Each
    distinct chunk is encoded once; a table of bounded size keeps them.
    """

    def __init__(self, path_json: str, path_ranks: str, kept: int = KEPT_CHUNKS):
        import tiktoken

        self.library = load_tokenizer(path_json)
        with open(path_ranks, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        # The same vocabulary; its library is faster on single words.
        self.fast = tiktoken.Encoding(
            "chunks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={},
        )
        # Bytes of each token.
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.kept = kept
        self.line_end = self._whole("\n")
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: Iterable[str], table: dict[str, bytes]) -> None:
        """Ids of new words, the simple ones of them by one call on all."""
        words = list(words)
        if len(table) + len(words) > self.kept:
            table.clear()
        blank = "" if table is self.heads else " "
        simple = []
        for word in words:
            if not _SIMPLE.fullmatch(word):
                table[word] = self._whole(blank + word)
            elif blank:
                simple.append(word)
            else:
                table[word] = np.array(self.fast.encode_ordinary(word), "<u4").tobytes()
        if not simple:
            return
        # A blank starts a new pre-token, so the tokens of each word fill its bytes.
        sizes = [len(word) + 1 if word.isascii() else len(word.encode()) + 1 for word in simple]
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(simple)), "<u4")
        reached, wanted = self.sizes[ids].cumsum(), np.cumsum(sizes)
        last = reached.searchsorted(wanted)
        if not np.array_equal(reached[last], wanted):
            raise ValueError("words and tokens do not end together")
        packed, at = ids.tobytes(), 0
        for word, end in zip(simple, (4 * (last + 1)).tolist()):
            table[word] = packed[at:end]
            at = end

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed little-endian unsigned 32-bit integers."""
        words = text.replace("\n", " ").split(" ")
        # Anything but single blanks and line ends between words goes to the library whole.
        if words != text.split() or "<|" in text:
            return self._whole(text)
        heads = [line.partition(" ")[0] for line in text.split("\n")]
        tails, first = self.tails, self.heads
        missing = {word for word in words if word not in tails}
        if missing:
            if len(tails) + len(missing) > self.kept:
                missing = set(words)
            self._learn(missing, tails)
        missing = {word for word in heads if word not in first}
        if missing:
            if len(first) + len(missing) > self.kept:
                missing = set(heads)
            self._learn(missing, first)
        found = list(map(tails.__getitem__, words))
        at = 0
        for i, line in enumerate(text.split("\n")):
            ids = first[heads[i]]
            found[at] = self.line_end + ids if i else ids
            at += line.count(" ") + 1
        return b"".join(found)


@lru_cache(maxsize=2)
def _chunk_encoder(path_json: str, path_ranks: str) -> ChunkEncoder:
    return ChunkEncoder(path_json, path_ranks)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    path_json: str | None = None,
    path_ranks: str | None = None,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and on request ``ids`` (array of int)."""
    path_json = path_json or public_tokenizers.path(f"{TOKENIZER}.json")
    path_ranks = path_ranks or public_tokenizers.path(f"{TOKENIZER}.tiktoken")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _chunk_encoder(path_json, path_ranks)
        rows, parts, starts, lengths, sums, ids = [], [], [], [], [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            packed = encoder.encode(text) + end
            for part, (start, length) in enumerate(cut_points(len(packed) // 4, capacity)):
                piece = packed[4 * start : 4 * (start + length)]
                rows.append(row)
                parts.append(part)
                starts.append(start)
                lengths.append(length)
                sums.append(zlib.crc32(piece))
                if with_ids:
                    ids.append(np.frombuffer(piece, dtype=np.int32))
        columns = {
            "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
            "piece": pa.array(parts, pa.int32()),
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(lengths, pa.int64()),
            "ids_crc32": pa.array(sums, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = (
        f"doc_id {type_of(docs, 'doc_id')}, piece int, start bigint, length bigint, "
        "ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    )
    return map_slices(texts_of(docs), "text", run, schema)


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows ``(length, first_rank, n, first_sequence, per_sequence, offset)``: ranks
    first_rank .. first_rank + n - 1 (from 1) of that length go to the sequences
    from first_sequence on, ``per_sequence`` to each, the first of them at
    ``offset`` and the next right behind. Every sequence is filled without gaps.
    """
    plan = []
    # Groups of equally filled sequences by the space left: [first sequence, count].
    open_groups: dict[int, list[list[int]]] = {}
    spaces: list[int] = []
    n_sequences = 0

    def add(space: int, first: int, count: int) -> None:
        if space and count:
            if space not in open_groups:
                open_groups[space] = []
                bisect.insort(spaces, space)
            open_groups[space].append([first, count])

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit")
        left, rank = counts[length], 1
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):
                # No open sequence has room: new ones, each as full as this length gets.
                per = min(capacity // length, left)
                group = left // per
                plan.append((length, rank, group * per, n_sequences, per, 0))
                add(capacity - per * length, n_sequences, group)
                n_sequences += group
                rank += group * per
                left -= group * per
                continue
            space = spaces[at]
            groups = open_groups[space]
            first, count = groups.pop()
            if not groups:
                del open_groups[space]
                spaces.pop(at)
            # As long as these stay the tightest, the next piece of this length
            # goes there as well.
            per = min(space // length, left)
            used = min(count, left // per)
            plan.append((length, rank, used * per, first, per, capacity - space))
            add(space - per * length, first, used)
            add(space, first + used, count - used)
            rank += used * per
            left -= used * per
    return plan


def slots(spark: SparkSession, plan: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """One row ``(length, rank, sequence_id, offset)`` per planned place."""
    rows = spark.createDataFrame(
        plan or [(0, 1, 0, 0, 1, 0)],
        "length bigint, first_rank bigint, n bigint, first_sequence bigint, "
        "per_sequence bigint, base bigint",
    ).where("n > 0")
    step = SLOTS_PER_ROW
    blocks = rows.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {step})")))
    places = blocks.repartition("length", "first_rank", "block").withColumn(
        "i", F.explode(F.expr(f"sequence(block * {step}, least(n, (block + 1) * {step}) - 1)"))
    )
    return places.selectExpr(
        "length",
        "first_rank + i AS rank",
        "first_sequence + i div per_sequence AS sequence_id",
        "base + (i % per_sequence) * length AS offset",
    )


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces."""
    spark = pieces.sparkSession
    # At most ``capacity`` rows, whatever the number of pieces.
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_slots(counts, capacity)
    bins = {length: -(-n // ROWS_PER_BIN) for length, n in counts.items() if n > ROWS_PER_BIN}
    n_bins = F.lit(1)
    if bins:
        lookup = F.create_map(*[F.lit(x).cast("bigint") for item in bins.items() for x in item])
        n_bins = F.coalesce(lookup[F.col("length")], F.lit(1))
    binned = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece"), n_bins))
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = binned_rank(binned, ["length"], "bin", order, one_bin=not bins)
    ranked = ranked.withColumnRenamed("position", "rank").withColumn(
        "rank", F.col("rank").cast("bigint")
    )
    # There are as many slots as pieces; their estimated size must not make Spark broadcast them.
    return ranked.join(slots(spark, plan).hint("merge"), ["length", "rank"]).drop("bin", "rank")


def best_fit_pack(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``)."""
    pieces = materialize(token_pieces(docs, capacity, end_id, with_ids), "pieces")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return place(pieces, capacity).select(*columns, *(["ids"] if with_ids else []))

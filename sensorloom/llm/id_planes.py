"""Token ids in binary files of transposed, compressed planes.

A *plane file* holds the ids of many documents one behind the other. The ids are cut
into blocks of a fixed size; a block is transposed into planes (all lowest bytes,
all second bytes, ...; or one plane per bit) and each plane is compressed with
zstandard. Planes of high bytes or bits hold few different values, so they nearly vanish.

::

    magic | planes of block 0 | planes of block 1 | ... | documents | chunk index | trailer

The chunk index has offset, number of ids and compressed size of every plane of each
block, so a span of ids is read without the blocks around it. The table of documents (id
and number of tokens) is an Arrow stream. All numbers are little-endian.

Writing: texts are range-partitioned by ``doc_id``, sorted and encoded, and each task
writes files of bounded size under names of its own. What a task returns is the list
of its files; that list goes through Spark's own commit, so the files of a task that was
lost or ran twice are in no manifest and nobody reads them. Reading: one row per file,
first positions from the manifest, and each file is decoded block by block.

Texts are encoded by distinct pieces: a vocabulary with word ends joins nothing across
white space, so each distinct piece between blanks goes through the library once, and
the ids of a slice of texts are one gather from the table of pieces.

Files are opened with pyarrow's file systems (local paths, ``file``, ``hdfs``, ``s3``,
``gs``, ``abfs``): Spark has no writer for plain binary files.

Defined results: a null or empty text is a document of the end id alone; rows are in
ascending ``doc_id`` order, nulls first; rows with the same ``doc_id`` are all kept, in the order
they are read; an empty table gives no file and an empty result; a very long text spans
as many blocks as it needs; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import byte_slices, texts_of, type_of
from sensorloom.llm.token_counts import load_tokenizer, require_word_ends

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# Ids of one block.
BLOCK_IDS = 1 << 16
# A file is closed behind the slice of texts with which it reaches so many ids or documents.
FILE_IDS = 1 << 26
FILE_DOCS = 1 << 20
# Pieces and words whose ids a worker keeps (some 100 MB each), and ids of all pieces.
KEPT_PIECES = 600_000
KEPT_IDS = 8_000_000
# Words that go through the tokenizer in one text.
CALL_WORDS = 1000
# Latin letters, digits and signs that belong to no contraction or special string: their own
# normal form, lower case without regard to neighbours.
_SIMPLE = re.compile(r"""[A-Za-z0-9À-ÖØ-öø-ÿ!"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*""")
# The words of such a piece: letters, one digit, or signs.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")

MAGIC = b"IDPLANE1"
BYTES, BITS = 0, 1
# Offsets and sizes of documents and index, ids, documents, ids of a block, kind, magic.
_TRAILER = struct.Struct("<QQQQQQII8s")


class PieceTable:
    """Ids of pieces between blanks, each distinct piece looked at once.

    Pieces of Latin letters, digits and plain signs fall apart into words by the split
    pattern of the vocabulary; many distinct words go through the library in one text
    and are told apart by the word ends of their tokens. Any other piece goes through it whole.
    """

    def __init__(self, path: str, end_id: int = END_ID, kept: int = KEPT_PIECES):
        self.tokenizer = load_tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.end_id = end_id
        self.kept = kept
        # Packed ids by word.
        self.words: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        # Slot 0 is the end of a document, slot 1 the empty piece.
        self.slots: dict[str, int] = {"": 1}
        self.lengths = np.array([1, 0], np.int64)
        self.pool = np.array([self.end_id], "<u4")
        self.starts = np.array([0, 1], np.int64)

    def _learn_words(self, words: list[str]) -> None:
        if len(self.words) + len(words) > self.kept:
            self.words.clear()
        for start in range(0, len(words), CALL_WORDS):
            call = words[start : start + CALL_WORDS]
            encoded = self.tokenizer.encode_batch_fast([" ".join(call)], add_special_tokens=False)
            ids = np.array(encoded[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
            if len(ends) != len(call):
                raise ValueError("words and word ends of the tokenizer do not agree")
            packed, at = ids.tobytes(), 0
            for word, end in zip(call, ends.tolist()):
                self.words[word] = packed[at:end]
                at = end

    def _learn(self, pieces: list[str]) -> None:
        # Most pieces are one word of plain letters.
        cut = [
            [p.lower()]
            if p.isalpha() and p.isascii()
            else _WORD.findall(p.lower())
            if _SIMPLE.fullmatch(p)
            else None
            for p in pieces
        ]
        words = set()
        for found in cut:
            if found:
                words.update(found)
        missing = words.difference(self.words)
        if len(self.words) + len(missing) > self.kept:
            missing = words
        self._learn_words(list(missing))
        others = [p for p, found in zip(pieces, cut) if found is None]
        encoded = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        whole = (np.array(e.ids, "<u4").tobytes() for e in encoded)
        known = self.words
        packed = [
            next(whole)
            if found is None
            else known[found[0]]
            if len(found) == 1
            else b"".join([known[word] for word in found])
            for found in cut
        ]
        first = len(self.lengths)
        self.slots.update(zip(pieces, range(first, first + len(pieces))))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        self.lengths = np.concatenate([self.lengths, sizes])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(packed), "<u4")])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _slots_of(self, pieces: list[str]) -> np.ndarray:
        missing = [piece for piece in pieces if piece not in self.slots]
        if missing:
            if len(self.slots) + len(missing) > self.kept or len(self.pool) > KEPT_IDS:
                self._clear()
                missing = [piece for piece in pieces if piece]
            self._learn(missing)
        return np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its end id, and the number of ids per text."""
        blanks = pa.compute.replace_substring(texts, "\n", " ")
        cut = pa.compute.split_pattern(blanks, " ")
        per_text = pa.compute.list_value_length(cut).to_numpy(zero_copy_only=False)
        words = cut.flatten().dictionary_encode()
        known = self._slots_of(words.dictionary.to_pylist())
        # Behind the pieces of each text stands slot 0, the end id.
        ends = np.cumsum(per_text + 1) - 1
        slots = np.zeros(len(words) + len(per_text), np.int64)
        inner = np.ones(len(slots), bool)
        inner[ends] = False
        slots[inner] = known[words.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[slots]
        behind = np.cumsum(lengths)
        n_ids = np.diff(behind[ends], prepend=0)
        # Of a slice of texts and a bounded pool, so places fit 32 bits but for one huge text.
        kind = np.int32 if max(len(self.pool), int(behind[-1])) < 1 << 31 else np.int64
        at = np.repeat((self.starts[slots] - (behind - lengths)).astype(kind), lengths)
        at += np.arange(len(at), dtype=kind)
        return self.pool.take(at), n_ids


@lru_cache(maxsize=2)
def _pieces(path: str, end_id: int) -> PieceTable:
    return PieceTable(path, end_id)


# --- blocks ---


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """The planes of a block, lowest first; planes above the largest id are left out."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == BYTES:
        table = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [table[:, p].tobytes() for p in range(-(-top // 8))]
    return [
        np.packbits((ids >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).tobytes()
        for b in range(top)
    ]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    """The ids of a block of ``n`` from its planes."""
    if kind == BYTES:
        table = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(planes):
            table[:, p] = np.frombuffer(plane, np.uint8)
        return table.reshape(-1).view("<u4")
    ids = np.zeros(n, "<u4")
    for b, plane in enumerate(planes):
        bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        ids |= bits.astype(np.uint32) << np.uint32(b)
    return ids


# --- files ---


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder or file that all machines see."""
    return pa.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class PlaneWriter:
    """Writes one plane file; holds one block of ids and the table of documents."""

    def __init__(self, uri: str, kind: int = BYTES, block_ids: int = BLOCK_IDS):
        store, path = open_store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.file = store.open_output_stream(path)
        self.file.write(MAGIC)
        self.at = len(MAGIC)
        self.kind, self.block_ids = kind, block_ids
        self.packer = zstandard.ZstdCompressor(level=3)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = self.n_docs = 0
        self.documents: list[pa.RecordBatch] = []
        self.index: list[list[int]] = []

    def add(self, keys: pa.Array, n_ids: np.ndarray, ids: np.ndarray) -> None:
        """The next documents: their keys, numbers of ids, and ids one behind the other."""
        table = [keys, pa.array(n_ids, pa.int64())]
        self.documents.append(pa.RecordBatch.from_arrays(table, names=["doc_id", "n_tokens"]))
        self.n_docs += len(keys)
        self.n_ids += len(ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block_ids:
            self._write_blocks(whole=True)

    def _write_blocks(self, whole: bool) -> None:
        ids = np.concatenate(self.pending)
        last = len(ids) - len(ids) % self.block_ids if whole else len(ids)
        for start in range(0, last, self.block_ids):
            block = ids[start : min(start + self.block_ids, last)]
            planes = [self.packer.compress(p) for p in to_planes(block, self.kind)]
            self.index.append([self.at, len(block), len(planes), *map(len, planes)])
            for plane in planes:
                self._write(plane)
        self.pending, self.n_pending = [ids[last:]], len(ids) - last

    def _write(self, data: bytes) -> None:
        self.file.write(data)
        self.at += len(data)

    def close(self) -> int:
        """Writes what is left and the tables; the size of the file."""
        if self.n_pending:
            self._write_blocks(whole=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.documents[0].schema) as stream:
            for batch in self.documents:
                stream.write_batch(batch)
        documents = self.packer.compress(sink.getvalue().to_pybytes())
        flat = np.array(list(itertools.chain.from_iterable(self.index)), "<i8")
        index = self.packer.compress(flat.tobytes())
        documents_at = self.at
        self._write(documents)
        self._write(index)
        self._write(
            _TRAILER.pack(
                documents_at, len(documents), documents_at + len(documents), len(index),
                self.n_ids, self.n_docs, self.block_ids, self.kind, MAGIC,
            )
        )
        self.file.close()
        return self.at


class PlaneFile:
    """Reads a plane file by its chunk index."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        trailer = self._at(size - _TRAILER.size, _TRAILER.size)
        (at, n, index_at, n_index, self.n_ids, self.n_docs, self.block_ids, self.kind, magic) = (
            _TRAILER.unpack(trailer)
        )
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a whole plane file")
        self.unpacker = zstandard.ZstdDecompressor()
        self._documents = (at, n)
        flat = np.frombuffer(self.unpacker.decompress(self._at(index_at, n_index)), "<i8").tolist()
        self.index: list[tuple[int, int, list[int]]] = []
        i = 0
        while i < len(flat):
            offset, n_block, n_planes = flat[i : i + 3]
            self.index.append((offset, n_block, flat[i + 3 : i + 3 + n_planes]))
            i += 3 + n_planes

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def documents(self) -> Iterator[pa.RecordBatch]:
        """Batches of ``doc_id, n_tokens`` in the order of the file."""
        yield from pa.ipc.open_stream(self.unpacker.decompress(self._at(*self._documents)))

    def block(self, number: int) -> np.ndarray:
        """The ids of one block."""
        offset, n, sizes = self.index[number]
        data = self._at(offset, sum(sizes))
        planes, at = [], 0
        for size in sizes:
            planes.append(self.unpacker.decompress(data[at : at + size]))
            at += size
        return from_planes(planes, n, self.kind)

    def span(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file; reads the blocks they lie in."""
        stop = min(start + count, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        ids = np.concatenate([self.block(b) for b in range(first, last + 1)])
        return ids[start - first * self.block_ids : stop - first * self.block_ids]

    def close(self) -> None:
        self.file.close()


# --- Spark jobs ---


def write_ids(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    end_id: int = END_ID,
    kind: int = BYTES,
    block_ids: int = BLOCK_IDS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encodes ``docs`` and writes plane files under ``folder``; returns the manifest.

    The manifest, ``part, number, file, n_docs, n_ids, n_bytes``, is stored as
    ``folder/manifest``; ascending (part, number) is the order of the files.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    require_word_ends(path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        writer, name = None, ""
        pieces = _pieces(path, end_id)

        def close() -> None:
            size = writer.close()
            rows.append((part, len(rows), name, writer.n_docs, writer.n_ids, size))

        for batch in batches:
            for piece in byte_slices(batch, "text"):
                if writer is None:
                    # A name of this attempt alone.
                    name = f"files/{part:06d}-{uuid.uuid4().hex}-{len(rows):04d}.idp"
                    writer = PlaneWriter(f"{folder}/{name}", kind, block_ids)
                ids, n_ids = pieces.encode(piece.column("text"))
                writer.add(piece.column("doc_id"), n_ids, ids)
                if writer.n_ids >= file_ids or writer.n_docs >= FILE_DOCS:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = list(zip(*rows)) if rows else [[]] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = ["part", "number", "file", "n_docs", "n_ids", "n_bytes"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=names
        )

    # The row number splits rows that share an id over partitions and fixes their order.
    numbered = texts_of(docs).withColumn("tie", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = ordered.select("doc_id", "text").mapInArrow(
        run, "part int, number int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"
    )
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str, key_type: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) per document of the plane files.

    ``start`` is the number of ids before the document in all files; ``key_type`` the
    type of ``doc_id``. Without ``ids`` a task holds one block, whatever the document.
    """
    # One row per file, so as many as the folder has entries.
    listed = spark.read.parquet(f"{folder}/manifest").orderBy("part", "number")
    files, start = [], 0
    for row in listed.select("file", "n_ids").collect():
        files.append((len(files), row["file"], start))
        start += row["n_ids"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])

    def rows_of(file: PlaneFile, first: int) -> Iterator[pa.RecordBatch]:
        number, block, at = -1, np.zeros(0, "<u4"), 0
        for table in file.documents():
            sums, ids = [], []
            n_tokens = table.column("n_tokens").to_numpy()
            for n in n_tokens.tolist():
                crc, held = 0, []
                while n:
                    if at == len(block):
                        number, at = number + 1, 0
                        block = file.block(number)
                    take = min(n, len(block) - at)
                    part = block[at : at + take]
                    crc = zlib.crc32(part, crc)
                    if with_ids:
                        held.append(part.astype(np.int64))
                    at += take
                    n -= take
                sums.append(crc)
                if with_ids:
                    ids.append(np.concatenate(held) if held else np.zeros(0, np.int64))
            behind = first + np.cumsum(n_tokens)
            columns = [
                table.column("doc_id"),
                pa.array(behind - n_tokens, pa.int64()),
                table.column("n_tokens"),
                pa.array(sums, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=names)
            first = int(behind[-1]) if len(behind) else first

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch["file"].to_pylist(), batch["first"].to_pylist()):
                file = PlaneFile(f"{folder}/{name}")
                yield from rows_of(file, first)
                file.close()

    listing = spark.createDataFrame(files, "no bigint, file string, first bigint")
    # Neighbouring files, about as many in each task.
    spread = listing.repartitionByRange(max(1, len(files)), "no")
    schema = f"doc_id {key_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + (
        ", ids array<bigint>" if with_ids else ""
    )
    return spread.mapInArrow(run, schema)


def write_and_read(docs: DataFrame, folder: str) -> DataFrame:
    """What stands in the plane files of ``docs``, read back from them."""
    write_ids(docs, folder)
    return read_ids(docs.sparkSession, folder, type_of(docs, "doc_id"))

"""Token counts by batch encoding: lengths leave the Arrow function, ids never do.

A vocabulary with word ends never joins anything across white space, so a blank
or a line end is a place where a text may be cut without changing its tokens.
Here every text is cut at all of them. Of a batch, which is balanced by bytes and
not by rows, each distinct piece goes through the tokenizer once, and a text's
count is the sum over its pieces; a long text is thus never encoded as one. Counts of
frequent pieces are kept from batch to batch in a table of bounded size.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of
special tokens inside a text count as the library counts them by default; a null
``doc_id`` is carried along; an empty table gives an empty table; other columns
are not looked at.
"""

from __future__ import annotations

import os
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import map_slices, texts_of, type_of

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
# Pieces whose counts a worker keeps (some 60 MB).
KEPT_PIECES = 400_000
# Bytes of pieces that go through the tokenizer in one call.
CALL_BYTES = 1 << 20


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The library's tokenizer; Spark has the cores, so it gets no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def require_word_ends(path: str) -> None:
    """Refuses vocabularies for which white space is not a safe place to cut."""
    import json

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    if model["model"].get("end_of_word_suffix") is None or model.get("post_processor"):
        raise ValueError(f"{path}: cutting at white space needs a vocabulary with word ends")


class PieceCounter:
    """Counts tokens of pieces without white space, each distinct one once."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.tokenizer = load_tokenizer(path)
        self.kept = kept
        self.counts: dict[str, int] = {"": 0}

    def learn(self, pieces: set[str]) -> None:
        missing = [piece for piece in pieces if piece not in self.counts]
        if not missing:
            return
        if len(self.counts) + len(missing) > self.kept:
            self.counts = {"": 0}
            missing = list(pieces)
        batch, held = [], 0
        for piece in missing:
            batch.append(piece)
            held += len(piece)
            if held > CALL_BYTES:
                self._encode(batch)
                batch, held = [], 0
        self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        self.counts.update(zip(batch, map(len, encoded)))

    def lengths(self, texts: list[str]) -> list[int]:
        cut = [text.replace("\n", " ").split(" ") for text in texts]
        pieces: set[str] = set()
        for words in cut:
            pieces.update(words)
        self.learn(pieces)
        return [sum(map(self.counts.__getitem__, words)) for words in cut]


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``."""
    path = path or public_tokenizers.path(TOKENIZER)
    require_word_ends(path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = _counter(path).lengths(batch.column("text").to_pylist())
        sizes = pa.compute.binary_length(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), sizes.cast(pa.int64()), pa.array(lengths, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"],
        )

    schema = f"doc_id {type_of(docs, 'doc_id')}, n_bytes bigint, n_tokens bigint"
    counted = map_slices(texts_of(docs), "text", run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

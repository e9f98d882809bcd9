"""BPE by backtracking, and decoding by an offset table.

Encoding: an Aho-Corasick automaton over all tokens gives, for each position of
a word, the longest token that starts there. The encoder takes that token if it
may stand after the token before it, else the next shorter one; where none fits
it gives up the last token. A pair may stand side by side exactly if merging by
rank would never have joined anything across their border, which is
answered from the merge table by taking the two tokens apart step by step, and
remembered. The first full cover found is the result of the merges, and every position
is given up at most once, so the work is linear in the word.

Decoding: the strings of all ids lie in one byte array; an offset table says
where each begins, and a whole batch of ids is one gather.

Defined results: a null or empty text has no ids and decodes to an empty text; a
null ``doc_id`` is carried along; strings of special tokens in a text become the
special ids, as the library does by default; repeated rows give repeated rows;
an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from sensorloom.llm.common import byte_slices, map_slices, texts_of, type_of
from sensorloom.llm.token_counts import load_tokenizer

TOKENIZER = "word_bpe_49k.json"
# Pieces and words whose ids, and pairs whose verdicts, a worker keeps.
KEPT_PIECES = 200_000
KEPT_WORDS = 200_000
KEPT_PAIRS = 400_000
# Ids that are decoded together.
SLICE_IDS = 1 << 20
# Words of these characters are their own NFC form and hold no white space.
_SIMPLE = re.compile("[!-~À-ɏ]*")
# Stands for "this symbol ends its word"; byte symbols stay below U+0200.
_END = 0x1000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves; the rest take the next free
    characters from U+0100 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class BacktrackingEncoder:
    """Exact merges of one word at a time, from a vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Tokens are numbered by the merge that makes them, symbols come first.
        made = {left + right for left, right in merges}
        symbols = sorted((t for t in ids if t not in made), key=ids.get)
        order = symbols + [left + right for left, right in merges]
        number = {token: i for i, token in enumerate(order)}
        self.n_symbols = len(symbols)
        self.ids = [ids[token] for token in order]
        self.left = list(range(len(symbols)))
        self.right = list(range(len(symbols)))
        self.joined: dict[tuple[int, int], int] = {}
        for i, (left, right) in enumerate(merges, start=len(symbols)):
            self.left.append(number[left])
            self.right.append(number[right])
            self.joined[number[left], number[right]] = i
        spelt = [self._spelling(token) for token in order]
        self.length = [len(s) for s in spelt]
        by_spelling = {s: i for i, s in enumerate(spelt)}
        # The next shorter token with the same beginning, or -1.
        self.shorter = []
        for s in spelt:
            cut = len(s) - 1
            while cut and s[:cut] not in by_spelling:
                cut -= 1
            self.shorter.append(by_spelling[s[:cut]] if cut else -1)
        self.tokens = ahocorasick.Automaton()
        for i, s in enumerate(spelt):
            self.tokens.add_word(s, i)
        self.tokens.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _spelling(self, token: str) -> str:
        """A token as one character per symbol, with the word end marked on its last."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _END)
        return token

    def _compare(self, pair: int) -> bool:
        """Fills the table of pairs, whose keys are ``first << 32 | second``."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[pair] = self.compatible(pair >> 32, pair & 0xFFFFFFFF)
        return known

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging by rank leaves ``first`` and ``second`` side by side."""
        a, b = first, second
        # Undo merges from the last to the first. Whatever meets at the border must
        # not join before the merge that was just undone did happen; of equal
        # ranks, the one further left goes first.
        before = len(self.ids)
        while True:
            join = self.joined.get((a, b))
            if join is not None and join < before:
                return False
            split_a, split_b = a >= self.n_symbols, b >= self.n_symbols
            if split_a and (a > b or not split_b):
                before, a = a, self.right[a]
            elif split_b:
                before, b = b + 1, self.left[b]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Ids of a word of byte symbols (one word, no pre-tokenisation)."""
        if not word:
            return []
        if self.suffix:
            word = word[:-1] + chr(ord(word[-1]) + _END)
        size = len(word)
        longest = [-1] * size
        length, shorter = self.length, self.shorter
        for end, token in self.tokens.iter(word):
            # Matches come by their end, so a later one from the same start is longer.
            longest[end + 1 - length[token]] = token
        token = longest[0]
        if length[token] == size:
            return [self.ids[token]]
        given_up = bytearray(size + 1)
        cover: list[int] = []
        known = self.pairs.get
        at = 0
        while at < size:
            last = cover[-1] << 32 if cover else -1
            while token >= 0:
                if not given_up[at + length[token]]:
                    if last < 0:
                        break
                    fits = known(last | token)
                    if fits or (fits is None and self._compare(last | token)):
                        break
                token = shorter[token]
            if token >= 0:
                cover.append(token)
                at += length[token]
                token = longest[at] if at < size else -1
            elif cover:
                given_up[at] = 1
                token = cover.pop()
                at -= length[token]
            else:
                raise ValueError(f"no cover for {word!r}: the vocabulary lacks a symbol")
        return [self.ids[t] for t in cover]


class TextEncoder:
    """Whole texts: special strings, normal form, words, then the encoder above."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.encoder = BacktrackingEncoder(path)
        self.library = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        parts = spec["pre_tokenizer"]["pretokenizers"]
        if not self.encoder.suffix or parts[0]["type"] != "Split":
            raise ValueError(f"{path}: not a word-end vocabulary with a split pattern")
        self.words = regex.compile(parts[0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any("<|" not in string for string in self.special):
            raise ValueError(f"{path}: special strings are expected to hold <|")
        strings = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(f"({strings})") if strings else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.kept = kept
        self.known: dict[str, bytes] = {"": b""}
        self.known_words: dict[str, bytes] = {}

    def _pieces(self, piece: str) -> list[str]:
        """The words of a piece, each as byte symbols."""
        if _SIMPLE.fullmatch(piece):
            # No final sigma among these, so lower() is free of context as the library is.
            words = self.words.findall(piece.lower())
            return [
                # Printable ASCII stands for itself.
                w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(self.symbols)
                for w in words
            ]
        # Any other script: the library's own normal form and split.
        normal = self.library.normalizer.normalize_str(piece)
        return [word for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _word(self, word: str) -> bytes:
        ids = self.known_words.get(word)
        if ids is None:
            if len(self.known_words) >= KEPT_WORDS:
                self.known_words.clear()
            ids = self.known_words[word] = array("i", self.encoder.encode(word)).tobytes()
        return ids

    def _learn(self, piece: str) -> bytes:
        if self.cut is None or "<|" not in piece:
            return b"".join(map(self._word, self._pieces(piece)))
        ids = b""
        for part in self.cut.split(piece):
            if part in self.special:
                ids += array("i", [self.special[part]]).tobytes()
            elif part:
                ids += b"".join(map(self._word, self._pieces(part)))
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers."""
        known = self.known
        if len(known) >= self.kept:
            known.clear()
            known[""] = b""
        found = []
        # No token reaches across a blank or a line end.
        for piece in text.replace("\n", " ").split(" "):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = self._learn(piece)
            found.append(ids)
        return b"".join(found)


class OffsetTable:
    """Strings of ids 0, 1, ...; turns many ids into their strings by one gather."""

    def __init__(self, strings: list[str]):
        encoded = [s.encode("utf-8") for s in strings]
        self.offsets = np.zeros(len(encoded) + 1, dtype=np.int64)
        np.cumsum([len(e) for e in encoded], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(encoded), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The concatenated strings; an id outside the table is an error."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.offsets) - 1:
            raise ValueError("id outside the vocabulary")
        begins = self.offsets[ids]
        sizes = self.offsets[ids + 1] - begins
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(begins - ends + sizes, sizes)
        return self.bytes[places].tobytes()


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


@lru_cache(maxsize=2)
def offset_table(path: str) -> OffsetTable:
    """Token strings, each with the blank that joins it to the next."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["decoder"] is not None:
        raise ValueError(f"{path}: has a decoder of its own")
    ids = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        strings[i] = token + " "
    return OffsetTable(strings)


def _encoded(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    """``doc_id`` and ``ids`` of a batch of ``doc_id, text``."""
    encoder = text_encoder(path)
    packed = [encoder.encode(text) for text in batch.column("text").to_pylist()]
    ends = np.zeros(len(packed) + 1, dtype=np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
    values = np.frombuffer(b"".join(packed), dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])


def _id_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no piece holds much more than ``SLICE_IDS`` ids."""
    sizes = pa.compute.list_value_length(batch.column("ids")).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + (size or 0) > SLICE_IDS:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _decoded(whole: pa.RecordBatch, path: str) -> Iterator[pa.RecordBatch]:
    """``doc_id``, ``ids`` and ``text`` of a batch of ``doc_id, ids``, in pieces."""
    table = offset_table(path)
    for batch in _id_slices(whole):
        ids = batch.column("ids")
        texts = []
        for row in range(len(ids)):
            one = ids[row].values
            found = table.join(one.to_numpy(zero_copy_only=False)) if one is not None else b""
            texts.append(found[:-1].decode("utf-8"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), ids, pa.array(texts, pa.string())],
            names=["doc_id", "ids", "text"],
        )


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) per row of ``docs``."""
    path = path or public_tokenizers.path(TOKENIZER)
    schema = f"doc_id {type_of(docs, 'doc_id')}, ids array<int>"
    return map_slices(texts_of(docs), "text", lambda batch: _encoded(batch, path), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``text`` for rows of ``doc_id, ids``; null ids are none."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _decoded(batch, path)

    schema = f"doc_id {type_of(encoded, 'doc_id')}, ids array<int>, text string"
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``decode(encode(docs))`` in one Python function.

    Two functions in a row are two Python processes per core, and as processes are used again
    for either, both come to hold the encoder's tables.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in byte_slices(batch, "text"):
                yield from _decoded(_encoded(piece, path), path)

    schema = f"doc_id {type_of(docs, 'doc_id')}, ids array<int>, text string"
    return texts_of(docs).mapInArrow(run, schema)

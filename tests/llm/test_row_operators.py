"""Operators that look at one text at a time: quality rules, token counts, BPE, packing."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import bpe, packing, quality_rules, surrogates, token_counts


def library(name: str):
    return token_counts.load_tokenizer(public_tokenizers.path(name))


# --- quality rules ---


def plain_measures(text: str):
    words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {
        i + k
        for i in range(len(words) - 7)
        if windows[tuple(words[i : i + 8])] > 1
        for k in range(8)
    }
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_measures_against_plain_version():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(
            rng.choice(["a", "b", "é", " ", " ", "\n", "#", "\x0b", "a b c d ", "中 "])
            for _ in range(rng.randint(0, 120))
        )
        assert quality_rules.measure(text) == plain_measures(text)


def test_ledger_of_odd_rows(with_clashes, odd_rows):
    rows = quality_rules.rule_ledger(with_clashes).collect()
    assert len(rows) == len(odd_rows)
    empty = [r for r in rows if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_words"] == 0 and r["failures"] == 1 for r in empty)
    assert quality_rules.rule_ledger(with_clashes.limit(0)).count() == 0
    kept = quality_rules.kept_documents(with_clashes)
    assert kept.columns == with_clashes.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "2", "7", "8", "None"]


def test_policies_and_ablations(documents, sentence):
    junk = " ".join(w + "###" for w in sentence(3, 40).split())
    looped = " ".join([sentence(4, 9)] * 20)
    table = documents([(1, sentence(5, 50)), (2, junk), (3, looped), (4, "few words")])
    ledger = quality_rules.rule_ledger(table)
    kept = quality_rules.apply_policies(
        ledger, {"base": quality_rules.BASE, "all": quality_rules.DEFAULT, "two": ("symbols",)}
    )
    found = {r["doc_id"]: (r["base"], r["all"], r["two"]) for r in kept.collect()}
    assert found == {
        1: (True, True, True),
        2: (True, False, False),
        3: (False, False, True),
        4: (False, False, True),
    }
    rows = {r["rule"]: r for r in quality_rules.ablations(ledger).collect()}
    for name, row in rows.items():
        others = tuple(r for r in quality_rules.POLICIES[quality_rules.DEFAULT] if r != name)
        assert row["n_failed"] == ledger.where(~quality_rules.passes((name,))).count()
        assert row["n_kept_without"] == ledger.where(quality_rules.passes(others)).count()
        alone = ledger.where(quality_rules.passes(others) & ~quality_rules.passes((name,)))
        assert row["n_only"] == alone.count()
    with pytest.raises(KeyError):
        quality_rules.policy_mask(("unheard_of",))


# --- token counts and BPE ---

ODD_TEXTS = [
    "", " ", "a", "Hello, World! it's 42\n\nend", "x" * 3000, "é" * 700,
    "<|endoftext|>", "a<|startoftext|>b <|EndOfText|>", "ΣΑΣ σας İstanbul ß ﬁ",
    "한국어 中文 字 y z\x1c\x85q", "é ́x", "🙂🙂 1/2 ½ ²",
]


def random_texts(n: int):
    rng = random.Random(11)
    parts = [*"abcdefgéñßΣ中한1½.,!?'#<|>🙂 \n\t́ ", "<|endoftext|>", "ing", "'s", "  "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_token_counts_equal_the_library():
    texts = ODD_TEXTS + random_texts(500)
    counter = token_counts.PieceCounter(public_tokenizers.path(token_counts.TOKENIZER), kept=300)
    expected = [
        len(library(token_counts.TOKENIZER).encode(t, add_special_tokens=False).ids) for t in texts
    ]
    # In small groups, so that the bounded table is emptied in between.
    found = [n for i in range(0, len(texts), 7) for n in counter.lengths(texts[i : i + 7])]
    assert found == expected


def test_token_counts_of_odd_rows(with_clashes, odd_rows):
    rows = token_counts.token_counts(with_clashes, limit=100).collect()
    tokenizer = library(token_counts.TOKENIZER)
    expected = Counter()
    for doc_id, text in odd_rows:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected[doc_id, len((text or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, rows)) == expected
    assert token_counts.token_counts(with_clashes.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts.require_word_ends(public_tokenizers.path("byte_bpe_50k.json"))


def test_backtracking_equals_the_library():
    encoder = bpe.TextEncoder(public_tokenizers.path(bpe.TOKENIZER), kept=100)
    tokenizer = library(bpe.TOKENIZER)
    for text in ODD_TEXTS + random_texts(800):
        found = np.frombuffer(encoder.encode(text), dtype=np.int32).tolist()
        assert found == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_every_token_is_its_own_encoding():
    """What the pair table relies on."""
    encoder = bpe.BacktrackingEncoder(public_tokenizers.path(bpe.TOKENIZER))
    rng = random.Random(2)
    numbers = [i for i in range(len(encoder.ids)) if i >= encoder.n_symbols]
    for i in rng.sample(numbers, 3000):
        assert encoder.compatible(encoder.left[i], encoder.right[i]) is False


def test_round_trip_of_odd_rows(with_clashes, odd_rows):
    tokenizer = library(bpe.TOKENIZER)
    rows = bpe.decode(bpe.encode(with_clashes)).collect()
    expected = Counter()
    for doc_id, text in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected[doc_id, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in rows) == expected
    assert bpe.encode(with_clashes.limit(0)).count() == 0
    both = bpe.round_trip(with_clashes)
    assert sorted(map(str, both.collect())) == sorted(map(str, rows))
    assert bpe.round_trip(with_clashes.limit(0)).count() == 0


def test_one_python_process_a_core_for_the_round_trip(spark, sf_dir):
    """Processes are used again for any function, so a second one would hold the tables too."""
    from sensorloom.llm.registry import op7_bpe_round_trip

    plan = op7_bpe_round_trip(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_decoding_null_and_unknown_ids(spark):
    table = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r["text"] for r in bpe.decode(table).collect()} == {""}
    with pytest.raises(ValueError):
        bpe.OffsetTable(["a ", "b "]).join(np.array([2]))


# --- packing ---


def test_chunk_encoder_equals_the_library():
    encoder = packing.ChunkEncoder(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        kept=100,
    )
    tokenizer = library("byte_bpe_50k.json")
    for text in ODD_TEXTS + random_texts(800):
        found = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert found == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_new_words_of_a_text_are_encoded_in_one_call():
    encoder = packing.ChunkEncoder(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    )
    calls, fast = [], encoder.fast

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return fast.encode_ordinary(text)

    encoder.fast = Counting()
    text = "Zürich's (first) words\nand don't\nstop " + " ".join(f"w{i}x-{i}," for i in range(500))
    found = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
    assert found == library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    # One for the words and one for each first word of a line.
    assert len(calls) == 4


def test_cut_points():
    assert packing.cut_points(0, 4) == [(0, 0)]
    assert packing.cut_points(4, 4) == [(0, 4)]
    assert packing.cut_points(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert packing.cut_points(8, 4) == [(0, 4), (4, 4)]


def best_fit_one_by_one(lengths, capacity):
    spaces = []
    for length in sorted(lengths, reverse=True):
        fitting = [s for s in spaces if s >= length]
        if fitting:
            best = min(fitting)
            spaces.remove(best)
            spaces.append(best - length)
        else:
            spaces.append(capacity - length)
    return len(spaces)


@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(rng.randint(1, 400))]
    plan = packing.plan_slots(dict(Counter(lengths)), 64)
    used = {}
    for length, first, n, sequence, per, base in plan:
        for i in range(n):
            at = base + (i % per) * length
            used.setdefault(sequence + i // per, []).append((at, length))
    placed = Counter(length for places in used.values() for _, length in places)
    assert placed == Counter(lengths)
    for places in used.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 64
    assert len(used) == best_fit_one_by_one(lengths, 64)


def test_plan_does_not_grow_with_the_counts():
    few = {n: 3 * n % 7 + 1 for n in range(1, 1025)}
    many = {n: c * 10**9 for n, c in few.items()}
    assert len(packing.plan_slots(many, 1024)) < 3 * 1024


def test_packing_of_odd_rows(with_clashes, odd_rows):
    tokenizer = library("byte_bpe_50k.json")
    rows = packing.best_fit_pack(with_clashes, capacity=64, with_ids=True).collect()
    wanted = Counter()
    for doc_id, text in odd_rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        for part, (start, length) in enumerate(packing.cut_points(len(ids), 64)):
            piece = ids[start : start + length]
            crc = zlib.crc32(np.array(piece, dtype="<u4").tobytes())
            wanted[doc_id, part, start, length, crc, tuple(piece)] += 1
    found = Counter(
        (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"]))
        for r in rows
    )
    assert found == wanted
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 64
    assert packing.best_fit_pack(with_clashes.limit(0)).count() == 0


def test_ranks_in_bins_give_the_same_plan(documents, sentence, monkeypatch):
    table = documents([(i, sentence(i % 5, 12)) for i in range(60)])
    pieces = packing.materialize(packing.token_pieces(table), "pieces")
    monkeypatch.setattr(packing, "ROWS_PER_BIN", 4)
    binned = packing.place(pieces)
    places = binned.groupBy("sequence_id", "offset").count()
    assert binned.count() == 60 and places.count() == 60
    used = binned.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert used <= 1024


# --- texts that may hold an entity ---

PLAIN_HINT = (
    r"[0-9@]|AKIA|ASIA|sk-|gh[pousr]_|(?i)(password|passwd|pwd|token|secret|api[_-]?key)"
    r"|(Mr|Mrs|Ms|Miss|Herr|Frau|Señora?|Monsieur|Madame|Mme)\b"
)


def test_texts_of_words_are_passed_by_quickly(spark):
    parts = [
        "AKIA", "akia", "ASIA", "sk-", "SK-", "sK", "ghp_", "GHP_", "gho", "Password", "pASSWD", "PwD", "ToKen",
        "K", "SECRET", "API-KEY", "apikey", "api_key", "mR", "MRS", "items", "MISS", "hErr", "FRAU", "SEÑOR",
        "Señora", "señ", "MONSIEUR", "Madame", "mme", "M", "a", "s", "x", " ", "\n", "4", "@", "é",
    ]
    rng = random.Random(6)
    texts = parts + ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(3000)]
    regex = spark._jvm.java.util.regex.Pattern
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    found = table.select(
        table.text.rlike(surrogates._HINT).alias("new"), table.text.rlike(PLAIN_HINT).alias("plain")
    )
    rows = found.collect()
    assert all(r["new"] == r["plain"] for r in rows) and {r["new"] for r in rows} == {True, False}

    text = "several plain words stand here, the same again; nothing hides among them " * 20_000

    def seconds(pattern):
        matcher = regex.compile(pattern).matcher(text)
        best = 1e9
        for _ in range(5):
            start = time.perf_counter()
            assert not matcher.reset().find()
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(surrogates._HINT) < 0.75 * seconds(PLAIN_HINT)

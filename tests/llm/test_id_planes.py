"""Plane files: exact round trips, the library's ids, and what stands in the manifest."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import id_planes, registry
from sensorloom.llm.token_counts import load_tokenizer

ODD = [
    "", " ", "a", "Hello, World! it's 42\n\nend...", "x" * 3000, "é" * 700, "\t\x0b a\x0cb\r",
    "<|endoftext|>", "a<|startoftext|>b <|EndOfText|>", "ΣΑΣ σας. a.Σ İstanbul ß ﬁ", "≮ ≮ ≠",
    "한국어 中文 字 y z\x1c\x85q", "é ́x", "🙂🙂 1/2 ½ ²", "we'll don't 'S o'clock x,'s",
]


def tokenizer():
    return load_tokenizer(public_tokenizers.path(id_planes.TOKENIZER))


def expected_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [id_planes.END_ID]


def random_texts(n):
    rng = random.Random(3)
    parts = [*"abcXYZéñßΣς中한1½.,!?'#<|>_-🙂 \n\t̸́", "<|endoftext|>", "ing", "'s", "   "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_piece_table_equals_the_library():
    texts = ODD + random_texts(3000)
    pieces = id_planes.PieceTable(public_tokenizers.path(id_planes.TOKENIZER), kept=500)
    for start in range(0, len(texts), 40):
        some = texts[start : start + 40]
        ids, n_ids = pieces.encode(pa.array(some, pa.string()))
        assert n_ids.tolist() == [len(expected_ids(t)) for t in some]
        assert ids.tolist() == [i for t in some for i in expected_ids(t)]


def test_plain_words_are_taken_as_they_are(monkeypatch):
    pieces = id_planes.PieceTable(public_tokenizers.path(id_planes.TOKENIZER))
    looked_at, simple = [], id_planes._SIMPLE

    class Noting:
        def fullmatch(self, piece):
            looked_at.append(piece)
            return simple.fullmatch(piece)

    monkeypatch.setattr(id_planes, "_SIMPLE", Noting())
    texts = ["Plain WORDS of letters\nand lines", "one (more) é word2", "İx K", ""]
    ids, n_ids = pieces.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in expected_ids(t)]
    assert sorted(looked_at) == sorted(["(more)", "é", "word2", "İx"])


@pytest.mark.parametrize("kind", [id_planes.BYTES, id_planes.BITS])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 50_000, 1 << 20, 2**32):
        for n in (1, 7, 8, 1000):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            planes = id_planes.to_planes(ids, kind)
            assert (id_planes.from_planes(planes, n, kind) == ids).all()
    # Nothing above the largest id is stored.
    assert len(id_planes.to_planes(np.array([300], "<u4"), id_planes.BYTES)) == 2
    assert len(id_planes.to_planes(np.array([300], "<u4"), id_planes.BITS)) == 9


@pytest.mark.parametrize("kind", [id_planes.BYTES, id_planes.BITS])
def test_one_file_by_its_index(tmp_path, kind):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 90, 60)
    ids = rng.integers(0, 49_408, sizes.sum()).astype("<u4")
    uri = f"{tmp_path}/deep/er/one.idp"
    writer = id_planes.PlaneWriter(uri, kind, block_ids=100)
    for half in (slice(0, 30), slice(30, 60)):
        begin, end = sizes[: half.start].sum(), sizes[: half.stop].sum()
        keys = pa.array(range(half.start, half.stop), pa.int64())
        writer.add(keys, sizes[half], ids[begin:end])
    size = writer.close()
    file = id_planes.PlaneFile(uri)
    assert (file.n_ids, file.n_docs, file.kind) == (len(ids), 60, kind)
    assert [n for _, n, _ in file.index] == [100] * (len(ids) // 100) + [len(ids) % 100]
    for start, count in [(0, 1), (99, 2), (100, 100), (len(ids) - 3, 50), (5, 1000), (len(ids), 4)]:
        assert (file.span(start, count) == ids[start : start + count]).all()
    tables = pa.Table.from_batches(list(file.documents())).to_pydict()
    assert tables == {"doc_id": list(range(60)), "n_tokens": sizes.tolist()}
    file.close()
    cut = tmp_path / "cut.idp"
    cut.write_bytes((tmp_path / "deep/er/one.idp").read_bytes()[: size - 9])
    with pytest.raises(ValueError, match="not a whole plane file"):
        id_planes.PlaneFile(str(cut))


def brute_force(rows):
    """Per row (doc_id, n_tokens, crc) in ascending order, and all ids before it."""
    found, before = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = expected_ids(text)
        found.append((doc_id, before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        before += len(ids)
    return found


def test_odd_rows(spark, with_clashes, odd_rows, tmp_path):
    got = id_planes.write_and_read(with_clashes, f"{tmp_path}/odd").collect()
    expected = brute_force(odd_rows)
    # Rows that share an id may stand in either order.
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted(
        (str(r[0]), r[2], r[3]) for r in expected
    )
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at
        at += row["n_tokens"]
    keys = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert keys == [r[0] for r in expected]


def test_empty_table(documents, tmp_path):
    empty = id_planes.write_and_read(documents([]), f"{tmp_path}/empty")
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.isEmpty()


def test_small_files_and_blocks_with_ids(spark, documents, sentence, tmp_path):
    rows = [(i * 3, sentence(i, 1 + i % 17)) for i in range(200)] + [(7, sentence(999, 5000))]
    folder = f"{tmp_path}/small"
    slices = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(slices)
    spark.conf.set(slices, "10")
    try:
        manifest = id_planes.write_ids(
            documents(rows).repartition(5), folder, kind=id_planes.BITS, block_ids=64, file_ids=500
        )
    finally:
        spark.conf.set(slices, before)
    files = manifest.collect()
    assert len(files) > 5 and sum(r["n_docs"] for r in files) == len(rows)
    got = id_planes.read_ids(spark, folder, "bigint", with_ids=True).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == brute_force(rows)
    texts = dict(rows)
    assert all(r["ids"] == expected_ids(texts[r["doc_id"]]) for r in got)


def test_files_of_lost_attempts_are_not_read(spark, documents, sentence, tmp_path):
    rows = [(i, sentence(i, 20)) for i in range(30)]
    folder = f"{tmp_path}/lost"
    id_planes.write_ids(documents(rows), folder)
    stray = id_planes.PlaneWriter(f"{folder}/files/000000-stray-0000.idp")
    stray.add(pa.array([1], pa.int64()), np.array([2]), np.array([5, 6], "<u4"))
    stray.close()
    got = id_planes.read_ids(spark, folder, "bigint").orderBy("start").collect()
    assert [tuple(r) for r in got] == brute_force(rows)


def test_query_on_whole_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = registry.queries()["op11_bit_planes"](spark, sf_dir)
    assert [tuple(r) for r in got.orderBy(F.col("start")).collect()] == brute_force(rows)

"""Periodic runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from sensorloom.llm import periodic_runs, registry


def plain_runs(words):
    """(start, length, period) of every run, by looking at each period in turn."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - begin
            if length >= max(6, 4 * q):
                stretch = words[begin : begin + length]
                smaller = any(stretch[e:] == stretch[:-e] for e in range(1, q))
                if not smaller:
                    found.append((begin, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plain_row(doc_id, text):
    """What the contract of the query says about one document."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = (None,) * 4
    if runs:
        s, length, q = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (s, length, q, 1000 * length // q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = plain_collapsed(words, runs)
    shas = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed)]
    return (doc_id, len(runs), *best, *shas)


def looping_words(rng):
    """Words with loops, loops inside loops, broken loops and far repeats."""
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 5, 50]))]
    words = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.3:
            words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        elif kind < 0.8:
            block = [rng.choice(vocabulary) for _ in range(rng.randint(1, rng.choice([3, 8, 40])))]
            if rng.random() < 0.4:
                block = block[:1] * rng.randint(1, 30) + block
            looped = block * rng.randint(2, 9)
            words += looped[: len(looped) - rng.randint(0, len(block))]
        elif words:
            start = rng.randrange(len(words))
            words += words[start : start + 30] * rng.randint(1, 5)
    return words


def test_runs_against_every_period():
    rng = random.Random(4)
    n_runs = 0
    for _ in range(150):
        texts = [looping_words(rng) for _ in range(rng.randint(1, 12))]
        found = periodic_runs.runs_of_texts([" ".join(words) for words in texts])
        for words, (runs, collapsed) in zip(texts, found):
            assert runs == plain_runs(words)
            assert collapsed == plain_collapsed(words, runs)
            n_runs += len(runs)
    assert n_runs > 1000


@pytest.mark.parametrize("period", [1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 22, 23, 46, 47, 95, 300, 1001])
def test_every_period_up_to_its_shortest_run(period):
    rng = random.Random(period)
    block = [f"x{rng.randint(0, 9)}" for _ in range(period - 1)] + ["end"]
    least = max(6, 4 * period)
    for length in (least - 1, least, least + 1, 9 * period):
        loop = (block * 10)[:length]
        words = [f"before{i}" for i in range(7)] + loop + [f"after{i}" for i in range(40)]
        [(runs, _)] = periodic_runs.runs_of_texts([" ".join(words)])
        expected = [(7, length, period)] if length >= least else []
        assert [r for r in runs if r[2] == period] == expected


def test_colliding_hashes_lose_nothing(monkeypatch):
    import numpy as np

    # One hash for everything: all positions are chosen, all contexts seem equal.
    monkeypatch.setattr(
        periodic_runs, "_joined", lambda left, right: np.zeros(min(len(left), len(right)), np.uint64)
    )
    rng = random.Random(9)
    for _ in range(10):
        words = looping_words(rng)[:150]
        [(runs, _)] = periodic_runs.runs_of_texts([" ".join(words)])
        assert runs == plain_runs(words)


def test_a_long_text_and_short_ones():
    rng = random.Random(2)
    block = [f"v{rng.randint(0, 5000)}" for _ in range(20_000)]
    long = [f"u{i}" for i in range(100)] + block * 5 + ["tail"]
    results = periodic_runs.runs_of_texts(["a b", " ".join(long), "", "z " * 8])
    assert [r for r, _ in results] == [[], [(100, 100_000, 20_000)], [], [(0, 8, 1)]]
    assert results[3][1] == "z"


def test_odd_rows(with_clashes, odd_rows):
    got = periodic_runs.find_runs(with_clashes)
    assert got.columns == ["doc_id", "runs", "collapsed"]
    rows = got.collect()
    expected = []
    for doc_id, text in odd_rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        runs = plain_runs(words)
        expected.append(str((doc_id, runs, plain_collapsed(words, runs))))
    found = [str((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in rows]
    assert sorted(found) == sorted(expected)
    assert periodic_runs.find_runs(with_clashes.limit(0)).isEmpty()


def test_planted_loops_of_odd_rows(with_clashes, odd_rows):
    planted = periodic_runs.plant_loops(with_clashes).collect()
    assert len(planted) == len(odd_rows)
    assert periodic_runs.plant_loops(with_clashes.limit(0)).isEmpty()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_documents(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = registry.queries()["op12_periodic_runs"](spark, sf_dir)
    assert got.columns == [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        "runs_sha256", "collapsed_sha256",
    ]
    # Every period of a long text takes its time: texts of up to 1500 words.
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"].split()) <= 1500}
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(found) == len(rows)
    for doc_id, text in short.items():
        assert found[doc_id] == plain_row(doc_id, text)
    assert any(r[1] for r in found.values())

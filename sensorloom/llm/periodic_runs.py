"""Periodic runs of words by string synchronising sets.

A *run* is a stretch of words with smallest period q and at least ``max(6, 4 q)`` words that
no neighbouring word extends with that period: a loop of a model, a stuck crawler, a table
of equal rows. All runs of a text are found, whatever their period, in near-linear time.

Periods 1 to 4 are looked for directly; these are the *highly periodic regions* of all larger
scales. At scale t = 4, 8, 16, ... a position i is *synchronising* if the smallest
hash among the windows ``T[j : j + t]``, i <= j <= i + t, stands at i or at i + t, where
windows inside a run of a period of at most t / 4 do not count. Whether i is chosen depends only
on ``T[i : i + 2 t]``, the context of i, so the copies of a stretch choose the same positions;
where the context does not lie in a highly periodic region, there is a choice in any t
neighbouring positions, and equal contexts are more than t / 4 apart.

A run of period q with 1.5 t - 1 <= q <= 3 t - 2 therefore holds two chosen positions with equal
contexts exactly q apart. Equal-context pairs at these distances propose the period, and
word by word comparison extends every proposal to its maximal stretch. Runs of smaller periods
were found at the scales before. Hashes only choose and propose: a collision costs a
comparison and never a run.

The texts of a slice lie one behind the other with a separator of its own behind each, longest
first, so that a scale looks at the texts that are long enough for its periods.

Defined results: a null or empty text has no words and no runs; repeated rows give repeated
rows; a null ``doc_id`` is carried along; an empty table gives an empty table; a text is
looked at whole, however long; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import map_slices, texts_of, type_of

# A run has at least so many periods and words.
MIN_PERIODS = 4
MIN_WORDS = 6
# Periods that are looked for directly; the first scale is as large.
SMALL_PERIODS = 4
# What separates words.
BLANKS = r"[\x20\x09-\x0D]+"

_NONE = np.uint64(2**64 - 1)
# Odd multipliers of the window hashes.
_LEFT, _RIGHT, _MIX = (
    np.uint64(0x9E3779B97F4A7C15),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0xD6E8FEB86659FD93),
)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows from the hashes of their halves."""
    h = left * _LEFT
    h += right * _RIGHT
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of true."""
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    if len(equal) and equal[0]:
        edges = np.concatenate([[0], edges])
    if len(equal) and equal[-1]:
        edges = np.concatenate([edges, [len(equal)]])
    return edges[::2], edges[1::2]


def _window_minima(ids: np.ndarray, t: int) -> np.ndarray:
    """Minimum of each ``t + 1`` neighbours; ``t`` is a power of two."""
    least, width = ids, 1
    while width < t:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:-1], least[1:]) if t == 1 else np.minimum(least[:-1], ids[t:])


class _Runs:
    """The runs found so far, by their stretch; the first period found is the smallest."""

    def __init__(self) -> None:
        self.periods: dict[tuple[int, int], int] = {}

    def add(self, begin: int, end: int, period: int) -> None:
        if end - begin >= MIN_PERIODS * period:
            # The same stretch with a smaller period has been found before.
            self.periods.setdefault((begin, end), period)

    def highly_periodic(self, n: int, t: int) -> np.ndarray | None:
        """Which of ``n`` windows of size ``t`` lie in a run of a period of t / 4 at most."""
        inside = [
            (begin, end - t + 1)
            for (begin, end), period in self.periods.items()
            if period * MIN_PERIODS <= t <= end - begin and begin < n
        ]
        if not inside:
            return None
        change = np.zeros(n + 1, np.int64)
        begins, ends = np.array(inside).T
        np.add.at(change, begins, 1)
        np.add.at(change, np.minimum(ends, n), -1)
        return np.cumsum(change[:-1]) > 0


def _extended(text: np.ndarray, d: int, begin: int, end: int) -> tuple[int, int]:
    """The maximal stretch around [begin, end) in which ``text[x] == text[x + d]``."""
    step = 16
    while begin:
        k = min(step, begin)
        wrong = np.flatnonzero(text[begin - k : begin] != text[begin - k + d : begin + d])
        if len(wrong):
            begin -= k - 1 - int(wrong[-1])
            break
        begin, step = begin - k, 2 * step
    step, last = 16, len(text) - d
    while end < last:
        k = min(step, last - end)
        wrong = np.flatnonzero(text[end : end + k] != text[end + d : end + d + k])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = end + k, 2 * step
    return begin, end


def _proposals(chosen: np.ndarray, contexts: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of chosen positions with equal contexts at these distances."""
    places, distances = [], []
    back = 1
    while back < len(chosen):
        d = chosen[back:] - chosen[:-back]
        if d.min() > high:
            break
        pair = np.flatnonzero((contexts[back:] == contexts[:-back]) & (d >= low) & (d <= high))
        places.append(chosen[pair])
        distances.append(d[pair])
        back += 1
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(distances)


def _check(text: np.ndarray, runs: _Runs, places: np.ndarray, distances: np.ndarray, span: int) -> None:
    """Extends proposals, each of which says that ``span`` words recur ``distance`` later."""
    order = np.lexsort((places, distances))
    places, distances = places[order], distances[order]
    # Proposals of one distance whose spans touch belong to one stretch.
    apart = (np.diff(distances) != 0) | (np.diff(places) > span)
    firsts = np.concatenate([[0], np.flatnonzero(apart) + 1])
    lasts = np.concatenate([firsts[1:], [len(places)]]) - 1
    known = (0, 0)
    for begin, end, d in zip(
        places[firsts].tolist(), (places[lasts] + span).tolist(), distances[firsts].tolist()
    ):
        if known[0] == d and end <= known[1]:
            continue
        equal = text[begin:end] == text[begin + d : end + d]
        for a, b in zip(*_stretches(equal)):
            a, b = _extended(text, d, begin + int(a), begin + int(b))
            runs.add(a, b + d, d)
            known = (d, b)


def runs_of(text: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin, end, period) of all stretches with ``MIN_PERIODS`` periods, unordered.

    ``text`` holds sequences of ``sizes`` symbols (numbers from 0), longest first, each followed by a
    symbol that occurs nowhere else.
    """
    runs = _Runs()
    for period in range(1, SMALL_PERIODS + 1):
        if len(text) > MIN_PERIODS * period:
            begins, ends = _stretches(text[period:] == text[:-period])
            long = ends - begins >= (MIN_PERIODS - 1) * period
            for begin, end in zip(begins[long].tolist(), ends[long].tolist()):
                runs.add(begin, end + period, period)

    behind = np.cumsum(sizes + 1)
    t = 1
    hashes = _joined(text.astype(np.uint64), np.zeros(len(text), np.uint64))
    while t < SMALL_PERIODS:
        hashes, t = _joined(hashes[:-t], hashes[t:]), 2 * t
    while True:
        low, high = 3 * t // 2 - 1, 3 * t - 2
        # Sequences with room for a run of the smallest period.
        n_long = int(np.searchsorted(-sizes, -MIN_PERIODS * low, "right"))
        if not n_long:
            break
        n = int(behind[n_long - 1])
        hashes = hashes[: n - t + 1]
        wider = _joined(hashes[:-t], hashes[t:])
        periodic = runs.highly_periodic(len(hashes), t)
        ids = hashes if periodic is None else np.where(periodic, _NONE, hashes)
        least = _window_minima(ids, t)
        here = (ids[: len(least)] == least) | (ids[t : t + len(least)] == least)
        if periodic is not None:
            here &= least != _NONE
        chosen = np.flatnonzero(here)
        places, distances = _proposals(chosen, wider[chosen], low, high)
        if len(places):
            _check(text, runs, places, distances, 2 * t)
        hashes, t = wider, 2 * t
    return [(begin, end, period) for (begin, end), period in runs.periods.items()]


# --- texts ---


def _symbols(joined: list[bytes]) -> np.ndarray:
    """Numbers of the words of texts with single blanks, one text behind the other."""
    data = b" ".join(joined) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def runs_of_texts(texts: list[str]) -> list[tuple[list[tuple[int, int, int]], str]]:
    """Per text its runs (start, length, period), by start and period, and the text without
    the words that repeat the first period of a run (words joined by single blanks)."""
    # bytes.split() splits at exactly the six blanks.
    joined = [b" ".join(text.encode("utf-8").split()) for text in texts]
    sizes = np.array([j.count(b" ") + 1 if j else 0 for j in joined], np.int64)
    order = [i for i in np.argsort(-sizes, kind="stable").tolist() if sizes[i]]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if order:
        lengths = sizes[order]
        behind = np.cumsum(lengths + 1)
        begins = behind - lengths - 1
        words = _symbols([joined[i] for i in order])
        text = np.empty(int(behind[-1]), np.int64)
        inner = np.ones(len(text), bool)
        inner[behind - 1] = False
        text[inner] = words
        text[behind - 1] = -1 - np.arange(len(order))
        for begin, end, period in runs_of(text, lengths):
            at = int(np.searchsorted(begins, begin, "right")) - 1
            if end - begin >= MIN_WORDS:
                found[order[at]].append((begin - int(begins[at]), end - begin, period))
    results = []
    for runs, words in zip(found, joined):
        if runs:
            runs.sort(key=lambda run: (run[0], run[2]))
            kept = np.ones(words.count(b" ") + 1, bool)
            for start, length, period in runs:
                kept[start + period : start + length] = False
            split = words.split(b" ")
            words = b" ".join([split[i] for i in np.flatnonzero(kept).tolist()])
        results.append((runs, words.decode("utf-8")))
    return results


RUN = "struct<start: bigint, length: bigint, period: bigint>"
_ARROW_RUN = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period in words) and ``collapsed`` text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        results = runs_of_texts(batch.column("text").to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(runs) for runs, _ in results])])
        flat = np.array([r for runs, _ in results for r in runs], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays(
            [pa.array(flat[:, k]) for k in range(3)], fields=list(_ARROW_RUN.value_type)
        )
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs, type=_ARROW_RUN)
        collapsed = pa.array([text for _, text in results], pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), runs, collapsed], names=["doc_id", "runs", "collapsed"]
        )

    schema = f"doc_id {type_of(docs, 'doc_id')}, runs array<{RUN}>, collapsed string"
    return map_slices(texts_of(docs), "text", run, schema)


def best_run(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null without runs."""
    return F.reduce(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, r: F.when(
            r["length"] * best["period"] > best["length"] * r["period"], r
        ).otherwise(best),
    )


def plant_loops(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth text, by the crc32 of its id, ends in a loop.

    With h the crc32 of the decimal id and g = h div 10, the texts with h % 10 = 0 keep the words
    before a = g % n and go on with the p words from a on, over and over, where
    p = 1 + (n - a) div (3 + g % 8). Texts without an id or without words stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = texts_of(docs).withColumn(
        "words",
        F.when(h % 10 == 0, F.filter(F.split("text", BLANKS), lambda w: w != "")),
    )
    n = F.size("words").cast("bigint")
    g = F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    looped = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n - 1),
        lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")),
    )
    text = F.when(F.col("words").isNotNull() & (n > 0), F.array_join(looped, " "))
    return planted.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))

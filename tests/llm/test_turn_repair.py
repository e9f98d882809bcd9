"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from sensorloom.llm import registry, turn_repair
from sensorloom.sources.scratch import materialize

BLANKS = " \t\n\x0b\x0c\r"
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def cheapest(messages):
    """(cost, audit, repaired) of (role, text, fault) by looking at the edits in order of cost."""
    queue = [(0, "", 0, "", ())]
    seen = set()
    while queue:
        cost, audit, i, shape, kept = heapq.heappop(queue)
        # What comes first at a place of the search is the cheapest and ASCII-least way there.
        here = (i, shape[-1:])
        if here in seen:
            continue
        seen.add(here)
        if i == len(messages) and shape[-1:] in ("", "a"):
            return cost, audit, kept
        forced = "assistant" if shape[-1:] == "u" else "user"
        grown = shape[-1:] + forced[0]
        heapq.heappush(queue, (cost + 3, audit + "I", i, grown, (*kept, (forced, ""))))
        if i == len(messages):
            continue
        role, text, fault = messages[i]
        heapq.heappush(queue, (cost + 4, audit + "D", i + 1, shape, kept))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault == "truncated" else 0
        heapq.heappush(
            queue, (cost + 3 + more, audit + "R", i + 1, grown, (*kept, (forced, text)))
        )
        first = role[:1]
        if (first == "s" and not shape) or (first in ("u", "a") and first == forced[0]):
            heapq.heappush(
                queue, (cost + more, audit + "K", i + 1, shape[-1:] + first, (*kept, (role, text)))
            )
    raise AssertionError("no repair")


def plain_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows, every):
    """Per conversation what the contract of the query says."""

    def key(r):
        return (r[0] is not None, r[0] or 0)

    rows = [(c, t, *(" " if x is None else x for x in m)) for c, t, *m in rows]
    found = {conv_id: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv_id in every}
    for conv_id, group in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        ordered = sorted(
            group,
            key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()),
        )
        seen, messages = set(), []
        for _, _, role, text in ordered:
            left = text.rstrip(BLANKS)
            fault = "truncated" if left[-1:] not in (".", "!", "?") else None
            fault = "duplicate" if (role, text) in seen else fault
            fault = "blank" if not left else fault
            seen.add((role, text))
            messages.append((role, text, fault))
        faults = [sum(m[2] == f for m in messages) for f in ("blank", "duplicate", "truncated")]
        pairs = zip(messages, messages[1:])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
        turns = {r[1] for r in ordered if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, kept = cheapest(messages)
        said = "\n".join(f"{role}:{text}" for role, text in kept)
        sha = hashlib.sha256(said.encode()).hexdigest()
        found[conv_id] = (gaps, *faults, illegal, cost, audit, sha)
    return found


def as_found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def repaired(conversations, every=None):
    rated = turn_repair.structure(conversations, materialize, every)
    return turn_repair.with_digests(conversations, rated)


def test_automaton_against_search():
    rng = random.Random(5)
    letters = {
        "x": ("user", "t", "blank"),
        **{i: (r, "t", None) for i, r in zip("suao", ("sys", "user", "assistant", "tool"))},
        **{i: (r, "t", "truncated") for i, r in zip("SUAO", ("sys", "user", "assistant", "tool"))},
    }
    signatures = {"".join(rng.choices("suaoSUAOxuaua", k=rng.randint(0, 9))) for _ in range(2000)}
    ordered = sorted(signatures, key=lambda s: s[::-1])
    for signature, got in zip(ordered, turn_repair.audits_of(ordered)):
        assert got == cheapest([letters[c] for c in signature])[:2]
    # Any order gives the same; ends are then shared less.
    mixed = sorted(signatures)
    assert dict(zip(ordered, turn_repair.audits_of(ordered))) == dict(
        zip(mixed, turn_repair.audits_of(mixed))
    )


def test_few_nodes_for_many_signatures():
    rng = random.Random(6)
    turn_repair.step_before.cache_clear()
    signatures = sorted(
        ("".join(rng.choices("suaoSUAOx", k=200)) for _ in range(300)), key=lambda s: s[::-1]
    )
    assert len(list(turn_repair.audits_of(signatures))) == 300
    assert turn_repair.step_before.cache_info().currsize < 500


def random_rows(rng, conversations):
    texts = ["Hi.", "Yes!", "Why?", "cut", "", "  ", " \n\t", "a. ", "Ünï. \n", "ok.", "x" * 50 + "."]
    roles = ["user", "assistant", "system", "tool", "User", "", None]
    rows = []
    for conv_id in conversations:
        for turn in range(rng.randint(1, 14)):
            if rng.random() < 0.9:
                role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
                at = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1])
                rows.append((conv_id, at, role, rng.choice([*texts, None, f"t{turn}."])))
    return rows


def test_random_conversations(spark):
    rows = random_rows(random.Random(7), [None, *range(150)])
    table = spark.createDataFrame(rows, CONVERSATIONS)
    expected = plain_repair(rows, {r[0] for r in rows})
    assert as_found(repaired(table.repartition(7))) == expected


def test_conversations_over_several_tasks(spark):
    # 3000 messages, many of them the same, in one conversation and 40 others.
    rng = random.Random(8)
    rows = [
        (1, i // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", "b.", f"{i}.", f"{i}"]))
        for i in range(3000)
    ] + random_rows(rng, range(2, 42))
    rows += [(9, 3, "user", "again and again.")] * 500
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(8)
    expected = plain_repair(rows, {r[0] for r in rows})
    adaptive = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        assert as_found(repaired(table)) == expected
    finally:
        spark.conf.set(adaptive, before)


def test_repaired_messages_are_legal(spark):
    rows = random_rows(random.Random(9), range(60))
    table = spark.createDataFrame(rows, CONVERSATIONS)
    rated = turn_repair.structure(table, materialize)
    said = turn_repair.repaired_messages(table, rated)
    assert said.columns == ["conv_id", "place", "edit", "turn", "role", "text"]
    expected = plain_repair(rows, {r[0] for r in rows})
    by_conv = {}
    for r in said.orderBy("conv_id", "place").collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    for conv_id, (*_, audit, sha) in expected.items():
        messages = by_conv.get(conv_id, [])
        assert "".join(m["edit"] for m in messages) == audit.replace("D", "")
        shape = "".join(m["role"][0] for m in messages).removeprefix("s")
        assert shape == "ua" * (len(shape) // 2)
        text = "\n".join(f"{m['role']}:{m['text']}" for m in messages)
        assert hashlib.sha256(text.encode()).hexdigest() == sha


def test_empty_table_clashes_and_lost_conversations(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert repaired(empty).isEmpty()
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho!")]
    clashing = ["kind", "copies", "part", "signature", "audit", "summary", "digest", "first", "id"]
    table = spark.createDataFrame(rows, CONVERSATIONS).withColumns({c: F.lit(c) for c in clashing})
    every = spark.createDataFrame([(1,), (2,), (None,), (2,)], "conv_id bigint")
    got = as_found(repaired(table, every))
    assert got == plain_repair(rows, {1, 2, None})
    assert got[1][5:7] == (0, "KK") and got[2][5:7] == (0, "")
    assert turn_repair.damaged(empty).isEmpty()
    assert turn_repair.repaired_messages(table, turn_repair.structure(table, materialize)).count() == 2


def test_damage_of_odd_rows(spark):
    rows = random_rows(random.Random(10), [None, *range(40)])
    got = turn_repair.damaged(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_damage(rows)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_whole_conversations(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = registry.queries()["op13_turn_repair"](spark, sf_dir)
    assert got.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]
    assert as_found(got) == plain_repair(plain_damage(rows), {r[0] for r in rows})

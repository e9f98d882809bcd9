"""Repair of the role order of conversations by a suffix-shared automaton.

A message has at most one *fault*: it is blank, a duplicate of an earlier message of the
conversation (same role and text) or truncated (does not end in a full stop, exclamation or
question mark). A repaired conversation is empty or has the role initials ``s?(ua)+``. The
edits, one letter each: K keeps a message, R (cost 3) gives it the role user or assistant,
D (4) deletes it, as blanks and duplicates must be, and I (3) inserts an empty message of
user or assistant; a truncated message that stays costs 3 more. Wanted are the cheapest
edits, of several the ones whose letters come first.

What is best from some message on depends on the messages from there to the end alone, and on
how far the grammar has come (4 states). So the role and fault letters of whole conversations,
their *signatures*, go through an automaton that shares ends: each distinct signature once,
sorted by its reverse, so that common ends are neighbours and only the nodes of the current
signature are held. Nodes at which the four states cost the same up to a constant are merged:
their cost-to-go and best next letters are computed once for all conversations. From a
given state each letter leads to one successor, so the first letter of the cheapest is the
best, and a node needs no more than that letter to know its best audit suffix.

Messages are put in order by a range partitioning over (conversation, turn, ...), so a
conversation of any length is read by several tasks and only its signature, a letter per message
like the audit itself, comes together. Repeated messages are counted before any shuffle by
conversation. Replaying the edits streams over sorted messages and holds one batch and one audit.

Defined results: messages are ordered by turn (nulls first), then role, then the SHA-256 of
the text; a null role or text is one space; messages without a conversation form one of their
own; repeated rows are duplicates; an empty table gives an empty one; a very long text is
looked at whole; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Store, type_of

# What the edits cost.
DELETE, INSERT, REROLE, STAY_TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL_PAIRS = ("su", "ua", "au")
# Grammar states: nothing yet, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
# Where a role initial leads; None where it may not stand.
NEXT = {
    "s": (AFTER_S, None, None, None),
    "u": (AFTER_U, AFTER_U, None, AFTER_U),
    "a": (None, None, AFTER_A, None),
}
# The role that an insertion or a new role must have, and where it leads.
FORCED = ("user", "user", "assistant", "user")
FORCED_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
# Signature letter of a message that has to go; others are the role initial (o: any other role),
# in upper case if the message is truncated.
GONE = "x"


# --- the automaton ---


class Node(NamedTuple):
    """Nodes with the same costs up to a constant: ``costs`` by state, the least of them 0."""

    costs: tuple[int, int, int, int]


class Step(NamedTuple):
    """What to do with the first message of a node, by state."""

    node: Node
    extra: int
    letters: tuple[str, str, str, str]
    states: tuple[int, int, int, int]


# Behind the last message: insertions up to the next legal end.
END = Node((0, 2 * INSERT, INSERT, 0))
END_LETTERS = ("", "II", "I", "")


@lru_cache(maxsize=None)
def step_before(symbol: str, behind: Node) -> Step:
    """The node of one more message in front; there are few, as costs differ by little."""
    initial, truncated = symbol.lower(), symbol.isupper()
    stays = STAY_TRUNCATED if truncated else 0
    ways: list[list[tuple[int, str, int]]] = []
    for state in range(4):
        found = [(DELETE + behind.costs[state], "D", state)]
        if symbol != GONE:
            kept = NEXT.get(initial, (None,) * 4)[state]
            if kept is not None:
                found.append((stays + behind.costs[kept], "K", kept))
            forced = FORCED_NEXT[state]
            found.append((REROLE + stays + behind.costs[forced], "R", forced))
        ways.append(found)
    # Two insertions in a row lead from one of the last two states back to it, so one is enough
    # there, and at most two from the others.
    costs = [min(ways[state])[0] for state in range(4)]
    for _ in range(2):
        costs = [min(costs[q], INSERT + costs[FORCED_NEXT[q]]) for q in range(4)]

    def best(state: int) -> tuple[str, int]:
        options = [(letter, to) for cost, letter, to in ways[state] if cost == costs[state]]
        if costs[state] == INSERT + costs[FORCED_NEXT[state]]:
            options.append(("I", FORCED_NEXT[state]))
        letter, to = min(options)
        if letter != "I":
            return letter, to
        letters, end = best(to)
        return letter + letters, end

    letters, states = zip(*map(best, range(4)))
    least = min(costs)
    return Step(Node(tuple(c - least for c in costs)), least, letters, states)


def audits_of(signatures: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit per signature; signatures sorted by their reverse share their ends."""
    path: list[Step] = []
    bases: list[int] = [0]
    before = ""
    for signature in signatures:
        shared = 0
        for a, b in zip(reversed(signature), reversed(before)):
            if a != b:
                break
            shared += 1
        del path[shared:], bases[shared + 1 :]
        for symbol in reversed(signature[: len(signature) - shared]):
            step = step_before(symbol, path[-1].node if path else END)
            path.append(step)
            bases.append(bases[-1] + step.extra)
        before = signature
        node = path[-1].node if path else END
        state, letters = START, []
        for step in reversed(path):
            letters.append(step.letters[state])
            state = step.states[state]
        letters.append(END_LETTERS[state])
        yield bases[-1] + node.costs[START], "".join(letters)


# --- Spark jobs ---


def _messages(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest`` without nulls in role and text."""

    def clean(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)

    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), clean("role"), clean("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _counted(messages: DataFrame) -> DataFrame:
    """One row per distinct message of a turn: its role initial, how often it stands there, whether
    it is blank or truncated, and whether it stood in an earlier turn (``later``)."""
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(trimmed == "", "blank").when(
        ~F.right(trimmed, F.lit(1)).isin(*ENDS), "truncated"
    )
    key = ["conv_id", "turn", "role", "digest"]
    return messages.select(*key, fault.alias("fault")).groupBy(*key).agg(
        F.min("fault").alias("fault"), F.count("*").alias("copies")
    )


def _marked(counted: DataFrame) -> DataFrame:
    """Adds ``later``: the message stood in an earlier turn of its conversation."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (
        counted.groupBy("conv_id", "role", "digest")
        .agg(F.min(place).alias("first"), F.count("*").alias("turns"))
        # Few messages come back in another turn.
        .where("turns > 1")
        .select(
            F.col("conv_id").alias("f_conv"),
            F.col("role").alias("f_role"),
            F.col("digest").alias("f_digest"),
            "first",
        )
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("f_conv"))
        & (F.col("role") == F.col("f_role"))
        & (F.col("digest") == F.col("f_digest"))
    )
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return counted.join(firsts, same, "left").select(*counted.columns, later.alias("later"))


PIECE = [
    ("part", pa.int32(), "int"),
    ("signature", pa.string(), "string"),
    ("first_role", pa.string(), "string"),
    ("last_role", pa.string(), "string"),
    ("first_turn", pa.int64(), "bigint"),
    ("last_turn", pa.int64(), "bigint"),
    ("turns", pa.int64(), "bigint"),
    ("blank", pa.int64(), "bigint"),
    ("duplicate", pa.int64(), "bigint"),
    ("truncated", pa.int64(), "bigint"),
    ("illegal", pa.int64(), "bigint"),
]
# Rows that a Python function hands over at a time.
BATCH = 2000


class _Piece:
    """The part of a conversation that one task sees."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.letters: list[str] = []
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: str | None, copies: int, later: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_role is None:
            self.first_role = initial
        else:
            self.illegal += self.last_role + initial not in LEGAL_PAIRS
        # No role may follow itself.
        self.illegal += copies - 1
        self.last_role = initial
        if fault == "blank":
            self.blank += copies
        else:
            self.duplicate += copies if later else copies - 1
        if fault == "blank" or later:
            self.letters.append(GONE * copies)
            return
        letter = initial if initial in NEXT else "o"
        if fault == "truncated":
            self.truncated += 1
            letter = letter.upper()
        self.letters.append(letter + GONE * (copies - 1))

    def row(self, part: int) -> tuple:
        return (
            self.conv_id, part, "".join(self.letters), self.first_role, self.last_role,
            self.first_turn, self.last_turn, self.turns,
            self.blank, self.duplicate, self.truncated, self.illegal,
        )


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held) if held else [[]] * len(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held = []
    yield batch()


def _rows(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH):
            part = batch.slice(start, BATCH)
            yield from zip(*[part.column(name).to_pylist() for name in names])


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def signatures(conversations: DataFrame, store: Store) -> DataFrame:
    """One row per conversation that has messages: ``conv_id, signature, gaps, blank, duplicate,
    truncated, illegal``."""
    counted = store(_counted(_messages(conversations)), "messages")
    marked = _marked(counted).select(
        "conv_id", "turn", "role", "digest", "fault", "copies", "later"
    )
    order = ["conv_id", "turn", "role", "digest"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    key = _arrow_type(conversations, "conv_id")
    schema = pa.schema([("conv_id", key), *[(name, kind) for name, kind, _ in PIECE]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def pieces() -> Iterator[tuple]:
            piece = None
            names = ["conv_id", "turn", "initial", "fault", "copies", "later"]
            for conv_id, turn, initial, fault, copies, later in _rows(batches, names):
                if piece is None or piece.conv_id != conv_id:
                    if piece is not None:
                        yield piece.row(part)
                    piece = _Piece(conv_id)
                piece.add(turn, initial, fault, copies, later)
            if piece is not None:
                yield piece.row(part)

        yield from _batches(pieces(), schema)

    ddl = ", ".join(f"{name} {kind}" for name, _, kind in PIECE)
    slim = ordered.select(
        "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "copies", "later"
    )
    pieces = slim.mapInArrow(run, f"conv_id {type_of(conversations, 'conv_id')}, {ddl}")
    # As many pieces as tasks saw the conversation, nearly always one.
    seam = F.struct("part", "signature", "first_role", "last_role", "first_turn", "last_turn")
    whole = pieces.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(seam)).alias("pieces"),
        F.min("first_turn").alias("low"),
        F.max("last_turn").alias("high"),
        *[F.sum(c).alias(c) for c in ("turns", "blank", "duplicate", "truncated", "illegal")],
    )
    count = F.size("pieces")
    seams = F.zip_with(
        F.slice("pieces", F.lit(1), count - 1),
        F.slice("pieces", F.lit(2), count - 1),
        lambda a, b: F.struct(
            F.concat(a["last_role"], b["first_role"]).alias("pair"),
            (a["last_turn"] == b["first_turn"]).alias("same_turn"),
        ),
    )
    illegal = F.size(F.filter(seams, lambda s: ~s["pair"].isin(*LEGAL_PAIRS)))
    shared = F.size(F.filter(seams, lambda s: s["same_turn"]))
    gaps = F.col("high") - F.col("low") + 1 - (F.col("turns") - shared)
    return whole.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["signature"]), "").alias("signature"),
        F.coalesce(gaps, F.lit(0)).alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        (F.col("illegal") + illegal).alias("illegal"),
    )


def audits(signed: DataFrame) -> DataFrame:
    """``signature, cost, audit`` per distinct signature."""
    distinct = signed.groupBy("signature").agg(F.count("*").alias("conversations"))
    backwards = distinct.select("signature", F.reverse("signature").alias("backwards"))
    ordered = backwards.repartitionByRange("backwards").sortWithinPartitions("backwards")
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[str] = []

        def each() -> Iterator[str]:
            for (signature,) in _rows(batches, ["signature"]):
                seen[:] = [signature]
                yield signature

        rows = ((seen[0], cost, audit) for cost, audit in audits_of(each()))
        yield from _batches(rows, schema)

    return ordered.select("signature").mapInArrow(
        run, "signature string, cost bigint, audit string"
    )


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def structure(
    conversations: DataFrame, store: Store, every: DataFrame | None = None
) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` per conversation.

    ``every`` names the conversations to return (default: those with messages); one without
    messages has zeros and an empty audit.
    """
    signed = store(signatures(conversations, store), "signatures")
    rated = signed.join(audits(signed), "signature")
    ids = (conversations if every is None else every).groupBy("conv_id").agg(F.lit(1).alias("one"))
    ids = ids.select(F.col("conv_id").alias("id"))
    joined = ids.join(rated, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(
        F.col("id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SUMMARY[:-1]],
        F.coalesce("audit", F.lit("")).alias("audit"),
    )


def _replayed(conversations: DataFrame, rated: DataFrame) -> DataFrame:
    """Every conversation's row of ``rated``, followed by its messages in order."""
    head = rated.select(
        "conv_id", F.struct(*SUMMARY).alias("summary"), F.lit(0).alias("kind")
    )
    body = _messages(conversations).withColumn("kind", F.lit(1))
    both = head.unionByName(body, allowMissingColumns=True)
    order = ["conv_id", "kind", "turn", "role", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "summary", "kind", "turn", "role", "text"
    )


REPLAYED = ["conv_id", "summary", "kind", "turn", "role", "text"]


def _edited(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Replays the audits: ``(summary row or None, edit, turn, role, text)``.

    Each conversation begins with its summary; what follows are its repaired messages.
    """
    audit, at, state = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            yield None, "I", None, FORCED[state], ""
            at, state = at + 1, FORCED_NEXT[state]

    for conv_id, summary, kind, turn, role, text in rows:
        if kind == 0:
            yield from inserted()
            yield (conv_id, summary), None, None, None, None
            audit, at, state = summary["audit"], 0, START
            continue
        yield from inserted()
        letter = audit[at]
        at += 1
        if letter == "R":
            yield None, "R", turn, FORCED[state], text
            state = FORCED_NEXT[state]
        elif letter == "K":
            yield None, "K", turn, role, text
            state = NEXT[role[0]][state]
    yield from inserted()


def repaired_messages(conversations: DataFrame, rated: DataFrame) -> DataFrame:
    """``conv_id, place, edit, turn, role, text``: the repaired conversations.

    ``edit`` is K, R or I; inserted messages have no turn.
    """
    key = _arrow_type(conversations, "conv_id")
    schema = pa.schema(
        [("conv_id", key), ("place", pa.int64()), ("edit", pa.string()),
         ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv_id, place = None, 0
            for begins, edit, turn, role, text in _edited(_rows(batches, REPLAYED)):
                if begins:
                    conv_id, place = begins[0], 0
                else:
                    yield conv_id, place, edit, turn, role, text
                    place += 1

        yield from _batches(rows(), schema)

    kind = type_of(conversations, "conv_id")
    return _replayed(conversations, rated).mapInArrow(
        run, f"conv_id {kind}, place bigint, edit string, turn bigint, role string, text string"
    )


def with_digests(conversations: DataFrame, rated: DataFrame) -> DataFrame:
    """Adds ``repaired_sha256`` to ``rated``: of the repaired ``role:text``, joined by line ends."""
    key = _arrow_type(conversations, "conv_id")
    schema = pa.schema(
        [("conv_id", key), *[(c, pa.int64()) for c in SUMMARY[:-1]],
         ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            current, digest, any_yet = None, hashlib.sha256(), False

            def row() -> tuple:
                conv_id, summary = current
                return (conv_id, *[summary[c] for c in SUMMARY], digest.hexdigest())

            for begins, _, _, role, text in _edited(_rows(batches, REPLAYED)):
                if begins:
                    if current:
                        yield row()
                    current, digest, any_yet = begins, hashlib.sha256(), False
                else:
                    digest.update(f"{chr(10) if any_yet else ''}{role}:{text}".encode())
                    any_yet = True
            if current:
                yield row()

        yield from _batches(rows(), schema)

    counts = ", ".join(f"{c} bigint" for c in SUMMARY[:-1])
    return _replayed(conversations, rated).mapInArrow(
        run,
        f"conv_id {type_of(conversations, 'conv_id')}, {counts}, audit string, repaired_sha256 string",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Damages messages by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a message, 1 empties its text, 2 takes the sentence ends out, 3 repeats it, 4 makes
    it the user's. Nulls count as one space.
    """

    def clean(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(clean("conv_id"), F.lit(":"), clean("turn"))) % 20
    rows = conversations.select(
        "conv_id", "turn", clean("role").alias("role"), clean("text").alias("text"), kind.alias("kind")
    ).where("kind <> 0")
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate("text", ENDS, ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(times).alias("copy"),
    ).drop("copy")

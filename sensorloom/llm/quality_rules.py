"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. What is kept is a *ledger*: the
measurements and one integer whose bit i says that rule i failed. A policy is a
named, versioned set of rules, that is a mask; applying one is a bitwise AND, so
trying a policy never looks at a text again. Ablations come from the counts per
masked pattern, at most 2^rules rows whatever the number of documents.

Defined results: a null or empty text has zero words, fails ``few_words`` and
nothing that is a share of words; a null ``doc_id`` is carried along; repeated
rows give repeated rows; an empty table gives an empty ledger; other columns of
the input are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import map_slices, texts_of, type_of

MEASUREMENTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
)
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_LEDGER = "__quality_ledger"


@dataclass(frozen=True)
class Rule:
    """A named test on the measurements; ``failed`` is a SQL condition."""

    name: str
    failed: str


# The position of a rule is its bit; rules are only ever appended.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)

BASE = "base-1"
DEFAULT = "web-1"

# A published version never changes; a new set of rules gets a new name.
POLICIES: dict[str, tuple[str, ...]] = {
    BASE: ("few_words", "repeated_windows"),
    DEFAULT: (
        "few_words",
        "repeated_windows",
        "symbols",
        "duplicate_lines",
        "short_words",
        "long_words",
    ),
}


def _repeated_words(words: list[bytes]) -> int:
    """Words covered by a window of eight words that occurs at two places or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.fromiter(
        (numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n
    )
    if len(numbers) == n:
        return 0
    # Names for windows of two, four, eight words: equal names, equal windows.
    width = 1
    while width < WINDOW:
        pairs = codes[:-width] * np.int64(n + 1) + codes[width:]
        names, codes = np.unique(pairs, return_inverse=True)
        if len(names) == len(pairs):
            return 0
        width *= 2
    again = np.bincount(codes)[codes] > 1
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASUREMENTS``."""
    raw = text.encode("utf-8", "surrogatepass")
    # bytes.split() knows exactly the six ASCII white-space characters.
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated_words(words),
    )


def _failures(prefix: str = "") -> Column:
    """The failure bits, from measurements whose names carry a prefix."""
    names = re.compile(rf"\b({'|'.join(MEASUREMENTS)})\b")
    bits = [
        F.when(F.expr(names.sub(rf"{prefix}\1", rule.failed)), F.lit(1 << bit)).otherwise(F.lit(0))
        for bit, rule in enumerate(RULES)
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total.cast("bigint")


def rule_ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failures``: one row per row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(text) for text in batch.column("text").to_pylist()]
        found = np.array(rows, dtype=np.int64).reshape(len(rows), len(MEASUREMENTS))
        columns = [pa.array(found[:, i]) for i in range(len(MEASUREMENTS))]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *columns], names=["doc_id", *MEASUREMENTS]
        )

    schema = f"doc_id {type_of(docs, 'doc_id')}, " + ", ".join(f"{m} bigint" for m in MEASUREMENTS)
    return map_slices(texts_of(docs), "text", run, schema).withColumn("failures", _failures())


def kept_documents(docs: DataFrame, policy: str | tuple[str, ...] = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns.

    The measurements ride along in one column and are dropped again, so nothing is
    shuffled or joined by id. A null text is measured as an empty one.
    """
    measured = pa.struct([(m, pa.int64()) for m in MEASUREMENTS])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        rows = [dict(zip(MEASUREMENTS, measure(text or ""))) for text in texts]
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(rows, measured)], names=[*batch.schema.names, _LEDGER]
        )

    fields = ", ".join(f"{m}: bigint" for m in MEASUREMENTS)
    texts = docs.withColumn("text", F.col("text").cast("string"))
    empty = F.lit(None).cast(f"struct<{fields}>")
    with_ledger = map_slices(texts, "text", run, texts.withColumn(_LEDGER, empty).schema)
    kept = _failures(f"{_LEDGER}.").bitwiseAND(F.lit(policy_mask(policy))) == 0
    return with_ledger.where(kept).drop(_LEDGER)


def policy_mask(policy: str | tuple[str, ...]) -> int:
    """The mask of a policy name or of rule names; unknown names are errors."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {rule.name: 1 << bit for bit, rule in enumerate(RULES)}
    return sum({bits[name] for name in names})


def passes(policy: str | tuple[str, ...]) -> Column:
    """Whether a ledger row is kept by a policy."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy))) == 0


def apply_policies(ledger: DataFrame, policies: dict[str, str | tuple[str, ...]]) -> DataFrame:
    """Adds one boolean column per policy; no text is read again."""
    return ledger.withColumns({column: passes(policy) for column, policy in policies.items()})


def ablations(ledger: DataFrame, policy: str | tuple[str, ...] = DEFAULT) -> DataFrame:
    """Per rule of a policy: documents failing it, and those that only it rejects.

    ``(rule, n_failed, n_only, n_kept_without)``. The documents meet in one count
    per pattern of failure bits first.
    """
    mask = policy_mask(policy)
    patterns = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("pattern")).agg(
        F.count("*").alias("n")
    )
    rules = [(r.name, 1 << b) for b, r in enumerate(RULES) if mask >> b & 1]
    if not rules:
        raise ValueError("a policy needs at least one rule")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    pattern = F.col("pattern")
    row = patterns.agg(
        *[
            F.struct(
                F.lit(name).alias("rule"),
                total(pattern.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                total(pattern == bit).alias("n_only"),
                total(pattern.bitwiseAND(F.lit(mask & ~bit)) == 0).alias("n_kept_without"),
            ).alias(name)
            for name, bit in rules
        ]
    )
    return row.select(F.inline(F.array(*[name for name, _ in rules])))

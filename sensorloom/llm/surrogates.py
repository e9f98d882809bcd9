"""Personal data replaced by keyed surrogates.

Entities are found by pattern, in whole texts: e-mail addresses, phone numbers, IPv4
addresses, payment card numbers (with a valid check digit), IBANs, US social security numbers, access keys and secrets,
and names after a form of address, with any later or earlier mention of such a name or of its
last word in the same text. Each distinct entity of the corpus gets one
surrogate, which a secret key decides:

* the *type* and the *format* stay: lengths, separators, case, the card's issuer digit and
  its check digit, a phone number's country code and grouping, an address's domain
  ending, the script of letters, the gender of a name's form of address;
* the same entity gets the same surrogate everywhere (coreference), also where it is
  written with other separators or in other case; a name that is mentioned by its last word
  gets the last word of its surrogate (:func:`linked_entities` has the rule);
* different entities get different ones, and none gets a value that is itself an
  entity of the corpus. That is checked over all distinct entities: whoever
  collides draws again with the next round number until nobody does.

Texts without any entity never leave their partition. Distinct entities are
counted map-side first, so one that a third of the corpus repeats is a small row, and
its occurrences are joined with skew handling against one row per entity.

Defined results: a null text stays null; a null ``doc_id`` and repeated rows are
carried along; overlapping finds go to the earlier, then the longer one; an empty table gives an
empty one; all other columns stay as they are, also one called ``entities``.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import Store, free_name, map_slices
from sensorloom.sources.scratch import ScratchTables, materialize

# A word of a name: letters, also after a hyphen or an apostrophe (but for 's).
_NAME_WORD = r"[^\W\d_a-z](?:[^\W\d_]|-(?=[^\W\d_])|['’](?=[^\W\d_])(?!s\b))+"
# Patterns of the entity types, in order of precedence.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("secret", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("secret", r"\bsk-[A-Za-z0-9_\-]{20,}"),
    (
        "secret",
        r"(?i:\b(?:password|passwd|pwd|token|secret|api[_\-]?key)\b\"?\s*[=:]\s*\"?)"
        r"(?P<value>[A-Za-z0-9_\-+/.]{6,})",
    ),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    ("card", r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])"),
    (
        "phone",
        r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?![\w\-])",
    ),
    ("phone", r"(?<![\w+])\+\d(?:[ .\-]?\d){7,13}(?![\w\-])"),
    (
        "name",
        r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme)\b\.? "
        rf"(?P<value>{_NAME_WORD}(?: {_NAME_WORD})*)",
    ),
)

FEMALE_TITLES = ("mrs", "ms", "miss", "frau", "señora", "madame", "mme")
# Given names by gender and script, and family names by script.
GIVEN = {
    ("f", "latin"): "Anna Clara Elena Emma Julia Laura Maria Nora Paula Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Bruno Daniel Emil Felix Hugo Leon Lukas Oscar Paul Simon Victor".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Нина Ольга София".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Иван Максим Олег Павел Роман".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Μαρία Νίκη Σοφία".split(),
    ("m", "greek"): "Αλέξης Γιώργος Κώστας Νίκος Πέτρος Σπύρος".split(),
}
# Syllables that endings of family names are drawn from, by script.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}

_FOUND = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS]
# A text without a digit, an @, a prefix of a key or a form of address holds no entity. Few places
# of a text begin like one by their first two letters; only there the words are tried.
_HINT = (
    r"[0-9@]|(?=[AaFfgHhMmPpSsTt][AaEehIiKkMmOoPpRrSsWw])"
    r"(?:AKIA|ASIA|sk-|gh[pousr]_|(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)"
    r"|(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señora?|Monsieur|Madame|Mme)\b)"
)


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` + it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _name_end(text: str, begin: int, end: int) -> int:
    """Where a name ends: before its first further word in lower case."""
    words = text[begin:end].split(" ")
    kept = 1
    while kept < len(words) and not words[kept][0].islower():
        kept += 1
    return begin + len(" ".join(words[:kept]))


def _mentions(text: str, names: dict[str, str]) -> list[tuple[int, int, str]]:
    """(begin, end, type) of names found in a text and their last words, with or without a title."""
    known = {}
    for name, kind in names.items():
        last = name.split(" ")[-1]
        for one in (name, last) if len(last) > 2 else (name,):
            known.setdefault(one, kind)
            known.setdefault(one.upper(), kind)
    listed = "|".join(re.escape(n) for n in sorted(known, key=lambda n: (-len(n), n)))
    return [(*m.span(), known[m.group()]) for m in re.finditer(rf"(?<!\w)(?:{listed})(?!\w)", text)]


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, type) of the entities of a text, ascending and apart."""
    return [(begin, end, kind) for begin, end, kind, _ in _spans(text)]


def linked_entities(text: str) -> list[tuple[int, int, str, str, bool]]:
    """(begin, end, type, normal form, whether it is a last word) of the entities of a text.

    A name of one word that is the last word of a longer name of the text is a mention of it: of the
    nearest one before, else of the first one behind; with a title, of those of the same gender.
    So in "Mrs Anna Smith and Mr Paul Smith met. Smith spoke." it was Paul Smith who spoke.
    """
    spans = _spans(text)
    whole = [
        (begin, kind, text[begin:end].lower())
        for begin, end, kind, _ in spans
        if kind.startswith("name_") and " " in text[begin:end]
    ]
    linked = []
    for begin, end, kind, titled in spans:
        value = text[begin:end]
        normal, part = normal_form(kind, value), False
        if whole and kind.startswith("name_") and " " not in value:
            meant = [
                (at, other, name)
                for at, other, name in whole
                if name.split(" ")[-1] == normal and (other == kind or not titled)
            ]
            before = [one for one in meant if one[0] < begin]
            if meant:
                _, kind, normal = before[-1] if before else meant[0]
                part = True
        linked.append((begin, end, kind, normal, part))
    return linked


def _spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(begin, end, type, whether found by a pattern of its own) of the entities of a text."""
    found, names = [], {}
    for rank, (kind, pattern) in enumerate(_FOUND):
        for m in pattern.finditer(text):
            begin, end = m.span("value") if "value" in pattern.groupindex else m.span()
            if kind == "phone" and sum(c.isdigit() for c in m.group()) < 8:
                continue
            if kind == "card":
                digits = re.sub(r"\D", "", m.group())
                if luhn_digit(digits[:-1]) != digits[-1]:
                    continue
            if kind == "name":
                female = m.group().split(" ")[0].rstrip(".").lower() in FEMALE_TITLES
                end = _name_end(text, begin, end)
                found.append((begin, -end, rank, "name_f" if female else "name_m"))
                names.setdefault(text[begin:end], found[-1][-1])
            else:
                found.append((begin, -end, rank, kind))
    if names:
        found += [(b, -e, len(_FOUND), kind) for b, e, kind in _mentions(text, names)]
    out, free = [], 0
    for begin, end, rank, kind in sorted(found):
        if begin >= free:
            out.append((begin, -end, kind, rank < len(_FOUND)))
            free = -end
    return out


def normal_form(kind: str, value: str) -> str:
    """What makes two ways of writing one entity the same."""
    if kind in ("card", "phone", "ssn", "iban"):
        return re.sub(r"[^0-9A-Za-z]", "", value).upper()
    if kind in ("email", "name_f", "name_m"):
        return value.lower()
    return value


class Draw:
    """A stream of keyed choices for one entity and round."""

    def __init__(self, key: bytes, kind: str, normal: str, round_: int):
        self.seed = hmac.new(key, f"{kind}\0{normal}\0{round_}".encode(), hashlib.sha256).digest()
        self.bytes = self._stream()

    def _stream(self) -> Iterator[int]:
        block = 0
        while True:
            yield from hashlib.sha256(self.seed + block.to_bytes(4, "big")).digest()
            block += 1

    def below(self, n: int) -> int:
        value = 0
        for _ in range(4):
            value = value << 8 | next(self.bytes)
        return value % n

    def like(self, pattern: str) -> str:
        """Characters of the same class: digits, upper- or lower-case letters of the script."""
        return "".join(self._character(c) for c in pattern)

    def _character(self, c: str) -> str:
        if c.isdigit():
            return str(self.below(10))
        for first, last in (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ρ"), ("Α", "Ρ")):
            if first <= c <= last:
                return chr(ord(first) + self.below(ord(last) - ord(first) + 1))
        return c


def script_of(text: str) -> str:
    for c in text:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿":
            return "greek"
    return "latin"


def surrogate(key: bytes, kind: str, normal: str, round_: int) -> str:
    """The surrogate of a normal form, in normal form."""
    draw = Draw(key, kind, normal, round_)
    if kind == "email":
        local, domain = normal.split("@", 1)
        host, dot, ending = domain.partition(".")
        # The ending stays, the rest is drawn; where short ones run out, they grow.
        longer = draw.like("x" * (round_ // 8))
        return f"{draw.like(local)}{longer}@{draw.like(host)}{dot}{ending}"
    if kind == "ip":
        parts = normal.split(".")
        # Same number of digits per part, and no part above 255.
        spans = {1: (1, 9), 2: (10, 99), 3: (100, 254)}
        drawn = []
        for part in parts:
            # Where addresses of this shape run out, any shape will do.
            low, high = spans[len(part)] if round_ < 8 else (1, 254)
            drawn.append(str(low + draw.below(high - low + 1)))
        return ".".join(drawn)
    if kind == "card":
        body = normal[0] + draw.like(normal[1:-1])
        valid = luhn_digit(normal[:-1]) == normal[-1]
        return body + (luhn_digit(body) if valid else draw.like(normal[-1]))
    if kind == "iban":
        body = draw.like(normal[4:])
        number = "".join(str(int(c, 36)) for c in body + normal[:2] + "00")
        return f"{normal[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "phone":
        # Of longer numbers the leading digits are the country code.
        lead = max(0, len(normal) - 10)
        return normal[:lead] + draw.like(normal[lead:])
    if kind in ("name_f", "name_m"):
        script, gender = script_of(normal), kind[-1]
        words = normal.split(" ")
        syllables = SYLLABLES[script]
        given = GIVEN[gender, script]
        # As many words and hyphens as the name has.
        family = "-".join(
            "".join(syllables[draw.below(len(syllables))] for _ in range(3 + round_ // 4))
            for _ in words[-1].split("-")
        )
        first = [
            "-".join(given[draw.below(len(given))].lower() for _ in w.split("-")) for w in words[:-1]
        ]
        return " ".join([*first, family])
    if kind == "secret":
        for prefix in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"):
            if normal.startswith(prefix):
                return prefix + draw.like(normal[len(prefix) :])
        hexadecimal = re.fullmatch("[0-9a-f]+", normal)
        if hexadecimal:
            return "".join("0123456789abcdef"[draw.below(16)] for _ in normal)
    return draw.like(normal)


def written_like(kind: str, original: str, drawn: str, part: bool = False) -> str:
    """A surrogate in normal form with the separators and the case of the original; of a name that
    is mentioned by its last word the last word."""
    if part:
        drawn = drawn.split(" ")[-1]
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(drawn)
        return "".join(next(rest, "") if c.isalnum() else c for c in original)
    if kind in ("name_f", "name_m"):
        if original.isupper():
            return drawn.upper()
        return re.sub(r"(?<![^ \-])\w", lambda m: m.group().upper(), drawn)
    if kind == "email":
        if original.isupper():
            return drawn.upper()
        local, domain = drawn.split("@", 1)
        case = [c.isupper() for c in original]
        return "".join(c.upper() if up else c for c, up in zip(f"{local}@{domain}", case))
    return drawn


def occurrences(docs: DataFrame) -> DataFrame:
    """``text_key, found``: of the texts with entities, an array of (begin, end, kind, normal, part)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, found = [], []
        for row, text in enumerate(batch.column("text").to_pylist()):
            entities = [
                {"begin": b, "end": e, "kind": k, "normal": n, "part": p}
                for b, e, k, n, p in linked_entities(text)
            ]
            if entities:
                rows.append(row)
                found.append(entities)
        kind = pa.struct(
            [
                ("begin", pa.int32()),
                ("end", pa.int32()),
                ("kind", pa.string()),
                ("normal", pa.string()),
                ("part", pa.bool_()),
            ]
        )
        return pa.RecordBatch.from_arrays(
            [batch.column("text_key").take(pa.array(rows, pa.int64())), pa.array(found, pa.list_(kind))],
            names=["text_key", "found"],
        )

    hopeful = docs.where(F.col("text").rlike(_HINT)).select(
        F.col("text").cast("string").alias("text"), F.sha2("text", 256).alias("text_key")
    )
    # One text is one piece of work, however often it is repeated; the key is
    # of the whole text, so rows without or with repeated ids need no care.
    return map_slices(
        hopeful,
        "text",
        run,
        "text_key string, "
        "found array<struct<begin: int, end: int, kind: string, normal: string, part: boolean>>",
    )


def assign(
    entities: DataFrame, key: str, max_rounds: int = 64, store: Store = materialize
) -> DataFrame:
    """``kind, normal, drawn``: a surrogate for each distinct entity, all different.

    Gender does not make names different, so the kinds are checked in families. Each
    round is one shuffle of what is still open; the first round settles nearly all.
    """
    raw_key = key.encode()
    family = F.regexp_replace("kind", "_[fm]$", "")

    def drawing(round_: int):
        def run(batches):
            for batch in batches:
                drawn = [
                    surrogate(raw_key, k, n, round_)
                    for k, n in zip(batch.column("kind").to_pylist(), batch.column("normal").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), batch.column("normal"), pa.array(drawn, pa.string())],
                    names=["kind", "normal", "drawn"],
                )

        return run

    schema = "kind string, normal string, drawn string"
    real = entities.select(family.alias("family"), F.col("normal").alias("drawn")).distinct()
    settled: DataFrame | None = None
    open_ = entities.select("kind", "normal")
    for round_ in range(max_rounds):
        drawn = open_.mapInArrow(drawing(round_), schema).withColumn("family", family)
        # Taken: by an entity of the corpus, or by a surrogate of an earlier round.
        taken = real
        if settled is not None:
            taken = real.unionByName(settled.select("family", "drawn"))
        free = drawn.join(taken, ["family", "drawn"], "left_anti")
        # Of those who drew the same, the least keeps it.
        winner = free.groupBy("family", "drawn").agg(F.min(F.struct("kind", "normal")).alias("w"))
        won = winner.select("w.kind", "w.normal", "drawn", "family")
        won = store(won, f"surrogates_{round_}")
        settled = won if settled is None else settled.unionByName(won)
        open_ = store(
            open_.join(won, ["kind", "normal"], "left_anti").select("kind", "normal"),
            f"open_{round_}",
        )
        if open_.isEmpty():
            return settled.select("kind", "normal", "drawn")
    raise ValueError(f"surrogates still collide after {max_rounds} rounds")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``entities``: (begin, end, kind) in the new text.

    A column of ``docs`` that has this name, in upper or lower case, stays as it is; the new one is
    then called as :func:`free_name` says.
    """
    with ScratchTables(docs.sparkSession) as scratch:
        store = scratch.materialize
        found = store(occurrences(docs).dropDuplicates(["text_key"]), "entities")
        single = found.select("text_key", F.inline("found"))
        distinct = store(single.select("kind", "normal").distinct(), "distinct_entities")
        drawn = assign(distinct, key, store=store)
        plan = F.array_sort(F.collect_list(F.struct("begin", "end", "kind", "drawn", "part")))
        # Bounded by the entities of one text. Written, so that the texts of a hot key
        # can be split in the join below.
        per_text = materialize(
            single.join(drawn, ["kind", "normal"])
            .groupBy("text_key")
            .agg(plan.alias("__pii_plan"))
            .withColumnRenamed("text_key", "__pii_text_key"),
            "replacements",
        )

    def run(batches):
        for batch in batches:
            texts, spans = [], []
            for text, plan in zip(batch.column("text").to_pylist(), batch.column("__pii_plan").to_pylist()):
                new, places, at, grown = [], [], 0, 0
                for one in plan or []:
                    original = text[one["begin"] : one["end"]]
                    fresh = written_like(one["kind"], original, one["drawn"], one["part"])
                    new += [text[at : one["begin"]], fresh]
                    begin = one["begin"] + grown
                    places.append({"begin": begin, "end": begin + len(fresh), "kind": one["kind"]})
                    grown += len(fresh) - len(original)
                    at = one["end"]
                texts.append("".join([*new, text[at:]]))
                spans.append(places)
            kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "__pii_plan")}
            columns |= {"text": pa.array(texts, pa.string()), marks: pa.array(spans, pa.list_(kind))}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    marks_type = "array<struct<begin: int, end: int, kind: string>>"
    marks = free_name(docs, "entities")
    names = [*docs.columns, marks]
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns]).withColumn(
        "text", F.col("text").cast("string")
    )
    no_marks = F.expr(f"cast(array() as {marks_type})")
    schema = base.withColumn(marks, no_marks).schema
    hint = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    # Only texts that may hold an entity are shuffled.
    touched = base.where(hint).withColumn("__pii_key", F.sha2("text", 256))
    planned = touched.join(
        per_text.hint("shuffle_hash"), F.col("__pii_key") == F.col("__pii_text_key"), "left"
    ).select(*[F.col(f"`{c}`") for c in docs.columns], "__pii_plan")
    replaced = planned.mapInArrow(run, schema)
    rest = base.where(~hint).withColumn(marks, no_marks)
    return rest.unionByName(replaced)

"""Secrets in text: three fixed patterns, and assignments read as source or configuration syntax.

The lexer stands at every `=`, `:`, `:=` or `=>`, reads the name to its left (quotes and brackets
allowed) and the expression to its right: quoted literals, bare words, names, joined by `+` or `.`.
Names are kept with their value, so a literal that reaches a sensitive name over constants and
concatenations is found where it is written. A value is kept as its parts and the shape of its text, never
as joined text, so values that are joined again and again take no more memory than what is written. A
finding is scored by the parts of the target's name and by the literal itself; placeholders count against it.

Defined results: a null text is the empty text, without spans; equal texts give equal rows, repeated
rows one each; an empty table gives an empty result; spans count code points and end before `end`; only the
id and the text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")

OPERATOR = re.compile(r"=>|:=|[:=]+")
NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.-")
BLANK = re.compile(r"[ \t]*")
#: One term of an expression: a quoted literal with escapes, or a bare word.
TERM = re.compile(r"""(?P<q>["'`])(?P<text>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<bare>[A-Za-z0-9_$/.+=~!@%^*-]+)""")
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

NAME_POINTS = {"password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "secret": 4, "token": 4, "apikey": 4, "credential": 4,
               "credentials": 4, "auth": 2, "bearer": 3, "private": 2, "access": 1, "api": 1, "key": 2, "signing": 2, "session": 1,
               "id": -2, "name": -2, "path": -3, "file": -3, "url": -3, "uri": -3, "public": -4, "length": -4, "count": -4, "type": -3,
               "hint": -4, "policy": -4, "label": -3, "expires": -4, "expiry": -4, "field": -3}
NAME_LEAST, SCORE_LEAST = 3, 6
#: Placeholders: words anywhere in a value, and whole values.
WITHIN = re.compile(r"change_?me|example|placeholder|your[_-]|dummy|redacted", re.I)
WHOLE = re.compile(r"(?:null|none|true|false|undefined|test)\Z", re.I)


def name_points(name: str) -> int:
    return sum(NAME_POINTS.get(p.lower(), 0) for p in PART.findall(name))


#: Characters of the longest word that PLACEHOLDER seeks anywhere, less one; a shorter value is kept whole.
EDGE = 10
#: As many different characters count; more are not told apart.
ENOUGH = 6


@dataclass(frozen=True)
class Shape:
    """What is known of a value: its length, ends, kinds of character and some of its characters. Never its whole text."""

    length: int = 0
    head: str = ""
    tail: str = ""
    kinds: int = 0
    chars: frozenset = frozenset()
    placeholder: bool = False

    @staticmethod
    def of(text: str) -> Shape:
        kinds = sum(any(test(c) for c in text) << k for k, test in enumerate((str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())))
        return Shape(len(text), text[:EDGE], text[-EDGE:], kinds, frozenset(sorted(set(text))[:ENOUGH]), bool(WITHIN.search(text)))

    def __add__(self, other: Shape) -> Shape:
        """The shape of both texts joined."""
        if not self.length or not other.length:
            return self if self.length else other
        head = self.head if self.length >= EDGE else (self.head + other.head)[:EDGE]
        tail = other.tail if other.length >= EDGE else (self.tail + other.tail)[-EDGE:]
        return Shape(self.length + other.length, head, tail, self.kinds | other.kinds, frozenset(sorted(self.chars | other.chars)[:ENOUGH]),
                     self.placeholder or other.placeholder or bool(WITHIN.search(self.tail + other.head)))

    def stands_in(self) -> bool:
        """Is the value a placeholder?"""
        whole = self.length <= EDGE and WHOLE.match(self.head)
        repeated = self.chars <= {"x", "X"} or self.chars <= {"*"} or self.chars <= {"."}
        return self.placeholder or bool(whole) or repeated or self.head[:1] in tuple("$<%{")

    def points(self) -> int:
        if self.length < 6 or self.stands_in():
            return -9
        kinds = self.kinds.bit_count()
        return (self.length >= 8) + (self.length >= 16) + (kinds >= 2) + (kinds >= 3) + (len(self.chars) >= ENOUGH)


@dataclass(eq=False)
class Value:
    """What a name stands for: the shape of its text, and its parts, which are places of literals and values of other names."""

    shape: Shape = Shape()
    parts: list[tuple[int, int] | Value] = field(default_factory=list)


def name_before(text: str, at: int) -> str:
    """The name that ends at `at`, through blanks, one closing bracket and one quote."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    for closing in ("]", "\"'`"):
        if i and text[i - 1] in closing:
            i -= 1
    j = i
    while j and text[j - 1] in NAME:
        j -= 1
    return text[j:i].strip(".-")


def expression(text: str, at: int, known: dict[str, Value]) -> tuple[Value | None, int]:
    """The value of the terms from `at` on and where they end; names stand for what is known of them."""
    value, i, terms = Value(), at, 0
    while m := TERM.match(text, i):
        terms += 1
        if m["q"]:
            value.shape += Shape.of(m["text"])
            value.parts.append(m.span("text"))
        elif m["bare"] in known and IDENTIFIER.match(m["bare"]):
            value.shape += known[m["bare"]].shape
            value.parts.append(known[m["bare"]])
        else:
            value.shape += Shape.of(m["bare"])
            value.parts.append(m.span("bare"))
        i = m.end()
        j = BLANK.match(text, i).end()
        if j < len(text) and text[j] in "+." and (j == i or text[j] == "+"):
            i = BLANK.match(text, j + 1).end()
        else:
            break
    return (value if terms else None), i


def named_spans(text: str) -> set[tuple[int, int]]:
    """Where literals are written that reach a sensitive name."""
    found: set[tuple[int, int]] = set()
    known: dict[str, Value] = {}
    seen: set[Value] = set()
    done = 0
    for m in OPERATOR.finditer(text):
        if m.group() in ("==", "===", "::") or m.start() < done:
            continue
        name = name_before(text, m.start())
        if not name:
            continue
        value, end = expression(text, BLANK.match(text, m.end()).end(), known)
        if value is None:
            continue
        done = end
        known[name] = value
        points = name_points(name)
        if points >= NAME_LEAST and points + value.shape.points() >= SCORE_LEAST:
            mark(value, seen, found)
    return found


def mark(value: Value, seen: set[Value], found: set[tuple[int, int]]) -> None:
    """Add the places of all literals that a value is made of; a value that was marked before is not entered again."""
    left = [value]
    while left:
        at = left.pop()
        if at in seen:
            continue
        seen.add(at)
        for part in at.parts:
            if isinstance(part, Value):
                left.append(part)
            elif part[1] > part[0]:
                found.add(part)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and named literals outside the assign spans."""
    base = base_spans(text)
    extra = named_spans(text) if ":" in text or "=" in text else set()
    inside = [(s, e) for s, k, e in base if k == 0]  # in order, none within another
    starts = [s for s, _ in inside]
    extra = {x for x in extra if not ((i := bisect_right(starts, x[0])) and x[1] <= inside[i - 1][1])}
    return base, sorted(base + [(s, 3, e) for s, e in extra])


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            base, every = scan(text or "")
            counts = [sum(k == n for _, k, _ in base) for n in range(3)]
            rows.append((*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
        found = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
        found.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield found


def secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256 and all spans."""
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        rows_of, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

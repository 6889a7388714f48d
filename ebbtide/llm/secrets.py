"""Secret scan through trigram inverted indexes.

From every rule's regular expression a Boolean trigram query (an OR of ANDs) is derived. Each task cuts its
stream of texts into segments of bounded bytes and builds, per segment, an inverted index: for every trigram
that some rule asks for, the sorted postings of the texts that hold it. Clauses intersect their postings from
the shortest list on, clauses of a rule are united, and only those candidates meet the regular expression. A
rule without mandatory trigrams has the query "everything" and is scanned in full. Nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows get equal answers; offsets are code points,
the end is exclusive, spans are ordered by start and then by the order of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as op
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbtide.llm.common import windows_of

SEGMENT_BYTES = 4 << 20
BLOCK = 1 << 20
STRINGS = 48
SPANS = "array<struct<kind: string, start: int, end: int>>"

Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """A pattern whose ``group`` must have at least ``least`` characters; ``flags`` as in ``re``."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern, self.flags)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.regex.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
        re.IGNORECASE | re.ASCII,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# ---- from regular expression to Boolean query ---------------------------------------------------------------


def _all(a: Query, b: Query) -> Query:
    return _without_supersets(x | y for x in a for y in b)


def _any(a: Query, b: Query) -> Query:
    return _without_supersets(a | b)


def _without_supersets(clauses) -> Query:
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _of_strings(strings: set[str]) -> Query:
    """One clause per string: all its trigrams. A string under three characters asks for nothing."""
    return _without_supersets(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _class(items) -> set[str] | None:
    """The characters of a class, or None when they are too many to spell out."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _analyse(nodes) -> tuple[set[str] | None, Query]:
    """(All strings the nodes can match, if few; a query that every match fulfils), both in lower case.

    Strings are strung together while they are few; where that ends, their trigrams join the query.
    """
    run: set[str] = {""}
    query, whole = EVERYTHING, True
    for kind, value in nodes:
        exact, needs = None, EVERYTHING
        if kind is op.LITERAL:
            exact = {chr(value).lower()}
        elif kind is op.IN:
            exact = _class(value)
        elif kind is op.SUBPATTERN:
            exact, needs = _analyse(value[3])
        elif kind is op.BRANCH:
            parts = [_analyse(part) for part in value[1]]
            exact = set().union(*(p for p, _ in parts)) if all(p is not None for p, _ in parts) else None
            needs = parts[0][1]
            for _, n in parts[1:]:
                needs = _any(needs, n)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            inner, needs_inner = _analyse(body)
            if inner is not None and most == 1:
                exact = inner | ({""} if least == 0 else set())
            needs = needs_inner if least else EVERYTHING
        elif kind is op.AT:
            exact = {""}
        joined = {a + b for a in run for b in exact} if exact is not None and len(run) * len(exact) <= STRINGS else None
        if joined is not None:
            run = joined
        else:
            query, whole = _all(_all(query, _of_strings(run)), needs if exact is None else _of_strings(exact)), False
            run = exact if exact is not None else {""}
    return (run, query) if whole else (None, _all(query, _of_strings(run)))


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """Lower-case trigrams as an OR of ANDs that every match fulfils; ``EVERYTHING`` if nothing is mandatory.

    Trigrams beyond ASCII are left out: the index holds bytes, lower-cased for A-Z only.
    """
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return EVERYTHING  # k and s then also match letters beyond ASCII
    exact, query = _analyse(_parser.parse(pattern, flags))
    if exact is not None:
        query = _of_strings(exact)
    return _without_supersets(frozenset(t for t in clause if t.isascii()) for clause in query)


# ---- index ---------------------------------------------------------------------------------------------------


class SegmentIndex:
    """Postings of a segment: for each wanted trigram, the ascending numbers of the texts that hold it."""

    def __init__(self, data: list[bytes], wanted: dict[int, int], lookup: np.ndarray):
        ends, found, at = np.cumsum([len(d) + 1 for d in data]), [np.zeros(0, np.int64)], 0
        for piece in windows_of(b"\n".join([*data, b""]), BLOCK, 2):
            a = np.frombuffer(piece, np.uint8).astype(np.uint32)
            hit = lookup[a[:-2] << 16 | a[1:-1] << 8 | a[2:]] if len(a) > 2 else np.zeros(0, lookup.dtype)
            where = np.flatnonzero(hit)
            found.append(np.unique(hit[where].astype(np.int64) << 32 | np.searchsorted(ends, where + at, side="right")))
            at += len(piece) - 2
        pairs = np.unique(np.concatenate(found))
        numbers, texts = pairs >> 32, pairs & 0xFFFFFFFF
        self.postings = {t: texts[slice(*np.searchsorted(numbers, (n, n + 1)))] for t, n in wanted.items()}

    def candidates(self, query: Query) -> np.ndarray:
        found = []
        for clause in query:
            lists = sorted((self.postings[_code(t)] for t in clause), key=len)
            out = lists[0]
            for other in lists[1:]:
                if not len(out):
                    break
                out = np.intersect1d(out, other, assume_unique=True)
            found.append(out)
        return np.unique(np.concatenate(found))


def _code(trigram: str) -> int:
    return int.from_bytes(trigram.encode(), "big")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...], segment_bytes: int = SEGMENT_BYTES):
        self.rules, self.segment_bytes = rules, segment_bytes
        codes = sorted({_code(t) for rule in rules for clause in rule.query for t in clause})
        self.wanted = {c: i + 1 for i, c in enumerate(codes)}
        self.lookup = np.zeros(1 << 24, np.uint16)
        for code, number in self.wanted.items():
            self.lookup[code] = number

    def segments(self, texts) -> Iterator[list[str]]:
        part, size = [], 0
        for text in texts:
            text = text or ""
            if part and size + len(text) > self.segment_bytes:
                yield part
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            yield part

    def scan(self, texts) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = []
        for part in self.segments(texts):
            index = SegmentIndex([t.encode("utf-8", "replace").lower() for t in part], self.wanted, self.lookup)
            spans: list[list[tuple[int, int, str, int]]] = [[] for _ in part]
            for order, rule in enumerate(self.rules):
                for i in range(len(part)) if frozenset() in rule.query else index.candidates(rule.query):
                    spans[i] += [(start, order, rule.kind, end) for start, end in rule.spans(part[i])]
            out += [[(kind, start, end) for start, _, kind, end in sorted(s)] for s in spans]
        return out


def find_secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of ``kind, start, end`` of a text column, for rules of any kind."""

    @F.pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(rules)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in scanner.scan(texts)], dtype=object)

    return find(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

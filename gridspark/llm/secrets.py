r"""Secrets by assignment-aware lexing.

The lexer stops at every ``:`` and ``=`` and reads the assignment around it: a
name to the left (bare, quoted or the last part of a dotted path), and to the
right a literal (bare, quoted, in triple quotes, or an indented block below
``|`` or ``>``) or names and literals joined by ``+``. It also stops at every
``(`` between a name and a quote, where an argument is given to the name. Names that were
assigned a literal before are constants; a constant that reaches a sensitive
name makes its literal a finding where it stands. Literals are scored by the
words of their target name and by their own shape.

Literals, names and ``+`` chains may have any length: each is lexed once, and
operators that share one (``a=b=c``, ``a=b+c=d+e``) share what was read. The
names of a chain are looked up where the chain is first met. Work grows with
the text, and with the distinct characters of a value where constants are
joined to constants over and over.

Kinds, in order: assign, access, hex (the base kinds), then pair: a literal
that an assignment gives to a sensitive name. Spans are code points, end
exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections import Counter
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices, texts

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pair")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: The names of a base assignment.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = frozenset(string.ascii_letters + string.digits + "+/_.=-")
NAME = frozenset(string.ascii_letters + string.digits + "_-.$")
QUOTES = "\"'"

#: How much a word of a target name tells.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "key": 0.6, "auth": 0.6, "private": 0.5, "access": 0.4, "api": 0.4, "signing": 0.4, "encryption": 0.4}
HARMLESS = {"public": -0.6, "id": -0.3, "name": -0.4, "path": -0.5, "file": -0.5, "url": -0.4, "type": -0.5, "length": -0.6, "example": -0.5}
THRESHOLD = 1.2
MIN_LITERAL = 8

OPERATOR = re.compile("[:=(]")
BLOCK = re.compile(r"[ \t]*+[|>][-+]?[1-9]?[-+]?[ \t]*+\r?\n")
BLOCK_LINE = re.compile(r"([ \t]*+)[^\r\n]*+(?:\r?\n|\Z)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LEAD = re.compile(r"[ \t>]*+")
BARE = re.compile(r"[A-Za-z0-9/_.=$-]+")
QUOTED = {q: re.compile(rf"(?:[^{q}\\\r\n]|\\[\s\S])*+{q}") for q in QUOTES}
PLUS = re.compile(r"[ \t]*+\+")
#: Characters between the stored counts of a long bare literal.
STRIDE = 64


def name_score(name: str) -> float:
    words = [w.lower() for w in WORD.findall(name)]
    return sum(SENSITIVE.get(w, 0) + HARMLESS.get(w, 0) for w in words)


def literal_score(value: str) -> float:
    """0 to 1: length, entropy of the characters, and a mix of letters and digits; half of that with blanks inside."""
    return _shape_score(Counter(value))


def _shape_score(counts: Mapping[str, int]) -> float:
    n = sum(counts.values())
    if n < MIN_LITERAL:
        return 0.0
    entropy = -math.fsum(c / n * math.log2(c / n) for c in counts.values())
    mixed = any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)
    return min(1.0, entropy / 4.0) * (0.7 + 0.3 * mixed) * (0.5 if " " in counts else 1.0)


def _keyword_end(t: str, op: int) -> tuple[int, int] | None:
    """Start and end of the base keyword that the operator at ``op`` belongs to."""
    i = op
    while i > 0 and t[i - 1] == " ":
        i -= 1
    if i > 0 and t[i - 1] in QUOTES:
        i -= 1
    for word in KEYWORDS:
        own = t[max(0, i - len(word)) : i]
        if len(own) == len(word) and own.isascii() and own.lower() == word:
            return i - len(word), i
    return None


def _base_value(t: str, op: int) -> tuple[int, int]:
    n, j = len(t), op + 1
    while j < n and t[j] == " ":
        j += 1
    if j < n and t[j] in QUOTES:
        j += 1
    e = j
    while e < n and t[e] in VALUE:
        e += 1
    return j, e


class _Value:
    """One literal of the text (a span) or a term and what is joined to it; values share their parts."""

    __slots__ = ("span", "parts", "counts", "reported")

    def __init__(self, span: tuple[int, int] | None, parts: tuple[_Value, ...] = ()):
        self.span, self.parts, self.counts, self.reported = span, parts, None, False


class _Assignments:
    """Names and values of the assignments of one text, asked for from left to right."""

    def __init__(self, t: str):
        self.t = t
        self.constants: dict[str, _Value] = {}
        self.line = 0
        self.before, self.target = -1, ("", 0.0)
        self.bare = (0, 0)
        self.bare_starts: dict[int, int] = {}
        self.joins: dict[int, int | None] = {}
        self.chains: dict[int, _Value | None] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def name(self, op: int) -> tuple[str, float]:
        """The assigned name left of the operator, or an empty text, and its score."""
        t, i, last = self.t, op, self.before
        self.before = op
        while i > last + 1 and t[i - 1] in " \t":  # := and a space before the sign
            i -= 1
        if i == last + 1 and last >= 0 and t[last] == ":":
            return self.target
        if i > 0 and t[i - 1] == "]":
            i -= 1
        if i > 0 and t[i - 1] in QUOTES:
            i -= 1
        e = i
        while i > 0 and t[i - 1] in NAME:
            i -= 1
        self.target = t[i:e], name_score(t[i:e])
        return self.target

    def _term(self, j: int) -> tuple[_Value, int] | None:
        """The term at ``j`` after blanks, and where it ends."""
        t = self.t
        j = LEAD.match(t, j).end()
        if j >= len(t):
            return None
        if t[j] in QUOTES:
            if t.startswith(t[j] * 3, j):
                close = t.find(t[j] * 3, j + 3)
                return (_Value((j + 3, close)), close + 3) if close >= 0 else None
            m = QUOTED[t[j]].match(t, j + 1)
            return (_Value((j + 1, m.end() - 1)), m.end()) if m else None
        if not self.bare[0] <= j < self.bare[1]:
            m = BARE.match(t, j)
            if not m:
                return None
            self.bare = j, m.end()
        e = self.bare[1]
        self.bare_starts.setdefault(e, j)
        if t.find("=", j, e) < 0 and t.find("/", j, e) < 0:
            known = self.constants.get(t[j:e].lstrip("$"))
            if known:
                return known, e
        return _Value((j, e)), e

    def _join(self, e: int) -> int | None:
        """Behind the plus sign that follows a term ending at ``e``."""
        if e not in self.joins:
            m = PLUS.match(self.t, e)
            self.joins[e] = m.end() if m else None
        return self.joins[e]

    def value(self, op: int) -> _Value | None:
        """The terms right of the operator, joined by plus signs, or the block below it."""
        block = BLOCK.match(self.t, op + 1) if self.t[op] == ":" else None
        if block:
            return self._block(op, block.end())
        first = self._term(op + 1)
        if not first:
            return None
        # the bare literal at hand is for the operators inside it, which come next
        head, e, bare = *first, self.bare
        j, met = self._join(e), []
        while j is not None and j not in self.chains:
            term = self._term(j)
            met.append((j, term and term[0]))
            j = self._join(term[1]) if term else None
        self.bare = bare
        rest = self.chains[j] if j is not None else None
        for k, term in reversed(met):
            rest = self.chains[k] = term and (_Value(None, (term, rest)) if rest else term)
        return _Value(None, (head, rest)) if rest else head

    def _block(self, op: int, at: int) -> _Value | None:
        """The lines from ``at`` on that are blank or indented deeper than the operator's line, without their margins."""
        t = self.t
        line = max(t.rfind("\n", self.line, op) + 1, self.line)
        self.line = line
        margin = len(BLOCK_LINE.match(t, line)[1])
        start = end = None
        while at < len(t):
            m = BLOCK_LINE.match(t, at)
            if m[0].strip():
                if len(m[1]) <= margin:
                    break
                start = m.end(1) if start is None else start
                end = m.start() + len(m[0].rstrip())
            at = m.end()
        return _Value((start, end)) if start is not None else None

    def _span_counts(self, a: int, e: int) -> Mapping[str, int]:
        start = self.bare_starts.get(e)
        if start is None or e - a <= 4 * STRIDE:
            return Counter(self.t[a:e])
        if e not in self.tables:
            codes = np.frombuffer(self.t[start:e].encode("ascii"), dtype=np.uint8)
            blocks = -(-len(codes) // STRIDE)
            cells = np.bincount(codes + np.arange(len(codes)) // STRIDE * 128, minlength=blocks * 128).reshape(blocks, 128)
            self.tables[e] = codes, cells[::-1].cumsum(axis=0)[::-1]
        codes, behind = self.tables[e]
        k = (a - start) // STRIDE
        own = behind[k] - np.bincount(codes[k * STRIDE : a - start], minlength=128)
        return {chr(c): int(own[c]) for c in np.flatnonzero(own)}

    def score(self, value: _Value) -> float:
        todo = [value]
        while todo:
            v = todo[-1]
            missing = [p for p in v.parts if p.counts is None] if v.counts is None else []
            if missing:
                todo += missing
                continue
            todo.pop()
            if v.counts is None and v.span:
                v.counts = self._span_counts(*v.span)
            elif v.counts is None:
                v.counts = dict(v.parts[0].counts)
                for c, n in v.parts[1].counts.items():
                    v.counts[c] = v.counts.get(c, 0) + n
                if max(v.counts.values(), default=0) >> 256:  # shares stay the same in double precision
                    v.counts = {c: max(1, n >> 128) for c, n in v.counts.items()}
        return _shape_score(value.counts)

    def argument(self, op: int, pairs: set[tuple[int, int]]) -> None:
        """A quoted argument without blanks of a sensitive name's call is a finding; it names no constant."""
        i = op
        while i > self.before + 1 and self.t[i - 1] in NAME:
            i -= 1
        score = name_score(self.t[i:op])
        if score > 0 and score + 1 >= THRESHOLD:
            term = self._term(op + 1)
            if term and term[0].span and " " not in self.t[slice(*term[0].span)] and score + self.score(term[0]) >= THRESHOLD:
                self.report(term[0], pairs)

    def report(self, value: _Value, pairs: set[tuple[int, int]]) -> None:
        todo = [value]
        while todo:
            v = todo.pop()
            if v.reported:
                continue
            v.reported = True
            todo += v.parts
            if v.span and v.span[1] > v.span[0]:
                pairs.add(v.span)


def find(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span of the whole text, by start, then kind as listed."""
    t = text or ""
    out = [(m.start(), "access", m.end()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(t)]
    last, lexer, pairs = 0, _Assignments(t), set()
    for op in (m.start() for m in OPERATOR.finditer(t)):
        if t[op] == "(":
            if t[op + 1 : op + 2] in ("'", '"'):
                lexer.argument(op, pairs)
            continue
        key = _keyword_end(t, op)
        if key and key[0] >= last:
            a, e = _base_value(t, op)
            if e > a:
                last = e
                if e - a >= 6:
                    out.append((key[0], "assign", e))
        name, score = lexer.name(op)
        value = lexer.value(op) if name else None
        if value:
            lexer.constants[name] = value
            if score > 0 and score + 1 >= THRESHOLD and score + lexer.score(value) >= THRESHOLD:
                lexer.report(value, pairs)
    out += [(a, "pair", e) for a, e in pairs]
    out.sort(key=lambda x: (x[0], ORDER[x[1]], x[2]))
    return out


def spans_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: doc_id, counts of the base kinds, base_sha256, spans, n_pair.

    A null text is empty: no spans and the digest of no bytes. Repeated rows
    each give a row; an empty table gives none; other columns are ignored.
    """

    def make():
        def fn(keys, docs):
            out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_pair")}
            for key, t in zip(keys, docs):
                all_spans = find(t)
                base = [x for x in all_spans if x[1] != "pair"]
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[1] == k for x in base))
                out["doc_id"].append(key)
                out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                out["spans"].append(spans_text(all_spans))
                out["n_pair"].append(len(all_spans) - len(base))
            return out

        return fn

    return map_slices(texts(df, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_pair long")

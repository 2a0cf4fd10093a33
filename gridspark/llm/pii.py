r"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, schemes, plus-digit,
dot-digit, neighbouring digits, and cue words of identifiers and addresses.
From each anchor a deterministic parser expands left and right over a fixed
character set and validates what it read. No text is searched in any other way.

Kinds, in order: email, ip, card, phone (the base kinds), then iban, ssn,
address, account (user information inside a URL). Spans are code points, end
exclusive; spans of one kind never overlap.
"""

from __future__ import annotations

import hashlib
import string
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import map_slices, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "address", "account")

DIGITS = frozenset(string.digits)
ALNUM = frozenset(string.ascii_letters + string.digits)
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
SCHEME = ALNUM | frozenset("+.-")
USERINFO = ALNUM | frozenset("-._~!$&'()*+,;=%:")

#: Cue words.
IBAN_CUES = ("IBAN", "Iban", "iban")
SSN_CUES = ("SSN", "ssn", "Social Security", "social security")
STREET_CUES = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", " Square", " Court", " St.", " Ave.", " Rd.", " Blvd.", " Ln.", " Dr.")
LINE_ENDS = frozenset("\n\r")
#: The lengths of an IBAN.
IBAN_LENGTHS = (15, 34)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


@lru_cache(1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    anchors: dict[str, set[str]] = {}
    for word, kind in [("@", "email"), ("://", "account"), *((f".{d}", "ip") for d in string.digits), *((f"+{d}", "phone") for d in string.digits)]:
        anchors.setdefault(word, set()).add(kind)
    for a, gap, b in product(string.digits, ("", " ", "-"), string.digits):
        anchors.setdefault(a + gap + b, set()).add("card")
    for words, kind in ((IBAN_CUES, "iban"), (SSN_CUES, "ssn"), (STREET_CUES, "address")):
        for w in words:
            anchors.setdefault(w, set()).add(kind)
    for word, kinds in anchors.items():
        out.add_word(word, (len(word), tuple(kinds)))
    out.make_automaton()
    return out


# Parsers: (text, anchor's start, anchor's end, end of the kind's last match, notes of the text) → (start, end, valid) or None.
# Notes hold how far a kind's walk got, so that no stretch of a text is walked twice.


def _email(t: str, a: int, b: int, floor: int, notes: dict):
    s = a
    while s > floor and t[s - 1] in LOCAL:
        s -= 1
    if s == a:
        return None
    n, e, labels = len(t), b, 0
    while True:
        k = e
        while k < n and t[k] in LABEL:
            k += 1
        if k == e:
            e -= 1  # the dot before an empty label isn't part
            break
        labels, e = labels + 1, k
        if e < n and t[e] == ".":
            e += 1
            continue
        break
    return (s, e, True) if labels > 1 else None


def _ip(t: str, a: int, b: int, floor: int, notes: dict):
    s = a
    while s > floor and t[s - 1] in DIGITS:
        s -= 1
    if s == a:
        return None
    n, e, parts = len(t), s, []
    for k in range(4):
        if k:
            if e >= n or t[e] != ".":
                return None
            e += 1
        at = e
        while e < n and t[e] in DIGITS:
            e += 1
        if e == at:
            return None
        parts.append(t[at:e].lstrip("0"))
    return s, e, all(len(p) < 4 and int(p or 0) <= 255 for p in parts)


def _card(t: str, a: int, b: int, floor: int, notes: dict):
    s, n = a, len(t)
    while s > floor:
        if t[s - 1] in DIGITS:
            s -= 1
        elif s - 1 > floor and t[s - 1] in " -" and t[s - 2] in DIGITS:
            s -= 2
        else:
            break
    e = s + 1
    while e < n:
        if t[e] in DIGITS:
            e += 1
        elif t[e] in " -" and e + 1 < n and t[e + 1] in DIGITS:
            e += 2
        else:
            break
    digits = t[s:e].replace(" ", "").replace("-", "")
    return s, e, 14 <= len(digits) <= 19 and luhn(digits)


def _phone(t: str, a: int, b: int, floor: int, notes: dict):
    n, e = len(t), b
    while e < n and t[e] in PHONE:
        e += 1
    while e > b and t[e - 1] not in DIGITS:
        e -= 1
    if e < b + 2:
        return None
    return a, e, 10 <= sum(c in DIGITS for c in t[a:e]) <= 15


def _along(t: str, b: int, notes: dict, kind: str, begins) -> int:
    """The first place from ``b`` on in the same line where ``begins`` holds, or the end of the line."""
    if kind in notes and notes[kind][0] <= b <= notes[kind][1]:
        return notes[kind][1]
    s, n = b, len(t)
    while s < n and t[s] not in LINE_ENDS and not begins(t, s):
        s += 1
    notes[kind] = b, s
    return s


def _iban_begins(t: str, s: int) -> bool:
    return t[s].isupper() and t[s : s + 2].isascii() and t[s : s + 2].isalpha() and t[s + 2 : s + 4].isdigit() and t[s - 1] not in ALNUM


def _iban(t: str, a: int, b: int, floor: int, notes: dict):
    """The first identifier that begins in the cue's line."""
    n = len(t)
    s = _along(t, max(b, floor), notes, "iban", _iban_begins)
    e, raw, held = s, "", s
    while e < n and len(raw) < IBAN_LENGTHS[1]:
        if t[e] in ALNUM:
            raw += t[e]
            e += 1
            if len(raw) >= IBAN_LENGTHS[0] and raw[:2].isalpha() and raw[2:4].isdigit():
                code = "".join(str(int(c, 36)) for c in (raw[4:] + raw[:4]))
                if int(code) % 97 == 1:
                    held = e
        elif t[e] == " " and e + 1 < n and t[e + 1] in ALNUM:
            e += 1
        else:
            break
    return (s, held, True) if held > s else None


def _digit_begins(t: str, s: int) -> bool:
    return t[s] in DIGITS


def _ssn(t: str, a: int, b: int, floor: int, notes: dict):
    """The number that the first digit behind the cue in its line begins."""
    n = len(t)
    s = _along(t, max(b, floor), notes, "ssn", _digit_begins)
    part = t[s : s + 11]
    if len(part) < 11 or part[3] not in " -" or part[6] != part[3] or (s + 11 < n and t[s + 11] in DIGITS):
        return None
    x, y, z = part[:3], part[4:6], part[7:]
    if not all(c in DIGITS for c in x + y + z) or x in ("000", "666") or x[0] == "9" or y == "00" or z == "0000":
        return None
    return s, s + 11, True


def _address(t: str, a: int, b: int, floor: int, notes: dict):
    """Capitalised words to the left, as many as there are, up to a house number."""
    if b < len(t) and t[b] in ALNUM:
        return None
    s = a
    while s != notes.get("address"):  # from there an earlier cue found no number
        w = s
        while w > floor and t[w - 1] in ALNUM:
            w -= 1
        word = t[w:s]
        if word and word[0] in DIGITS:
            house = word.rstrip(string.ascii_letters)
            if len(word) - len(house) < 2 and house.isdigit() and len(house) < 6 and s < a:
                return w, b, True
            break
        if not word or not word[0].isupper() or w - 1 <= floor or t[w - 1] != " ":
            break
        s = w - 1
    notes["address"] = a
    return None


def _account(t: str, a: int, b: int, floor: int, notes: dict):
    s = a
    while s > floor and t[s - 1] in SCHEME:
        s -= 1
    n, e = len(t), b
    while e < n and t[e] in USERINFO:
        e += 1
    if s == a or e == b or e >= n or t[e] != "@":
        return None
    return b, e, True


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban, "ssn": _ssn, "address": _address, "account": _account}
ORDER = {k: i for i, k in enumerate(KINDS)}


def find(text: str | None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span of the whole text, by start, then kind as listed."""
    t = text or ""
    ends, notes = dict.fromkeys(KINDS, 0), {}
    out = []
    for last, (size, kinds) in automaton().iter(t):
        a = last + 1 - size
        for kind in kinds:
            if a < ends[kind]:
                continue
            got = PARSERS[kind](t, a, last + 1, ends[kind], notes)
            if got:
                ends[kind] = got[1]
                if got[2]:
                    out.append((got[0], kind, got[1]))
    out.sort(key=lambda x: (x[0], ORDER[x[1]]))
    return out


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """Each span, overlapping ones as one, becomes ``<KIND>`` of the first."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def spans_text(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: doc_id, counts of the base kinds, base_sha256, spans, n_extra.

    A null text is empty: no spans and the digest of no bytes. Repeated rows
    each give a row; an empty table gives none; other columns are ignored.
    """

    def make():
        def fn(keys, docs):
            out = {k: [] for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_extra")}
            for key, t in zip(keys, docs):
                all_spans = find(t)
                base = [x for x in all_spans if x[1] in BASE]
                for k in BASE:
                    out[f"n_{k}"].append(sum(x[1] == k for x in base))
                out["doc_id"].append(key)
                out["base_sha256"].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                out["spans"].append(spans_text(all_spans))
                out["n_extra"].append(len(all_spans) - len(base))
            return out

        return fn

    return map_slices(texts(df, id_col, text_col), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long")


def redact(df: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with its texts redacted, and ``length_col``, if there is one, counted anew. Null texts stay null."""
    @pandas_udf("string")
    def clean(col: pd.Series) -> pd.Series:
        return col.map(lambda t: None if t is None else redacted(t, find(t)))

    out = df.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
    if length_col in df.columns:
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.char_length(text_col)).cast(df.schema[length_col].dataType))
    return out

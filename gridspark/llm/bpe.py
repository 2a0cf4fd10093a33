"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation works on code-point arrays. Every code point has a class;
every class is a transition function over five states of a small automaton that
follows apostrophes (where one may begin a contraction, and how far a
contraction has come). Function composition is associative, so a scan composes
the functions of blocks in parallel, then replays each block from its start
state. States and neighbouring classes give all piece boundaries at once.

Each piece is merged once and its ids are cached; pieces of a text are joined
as packed 32-bit ids. Piece offsets are kept, so ids map back to the text.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices, texts

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_PIECES = 400_000
BLOCK = 128

# Character classes.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, STMD, RV, E, L, END = range(11)

# States after a character: an apostrophe next would begin a piece (FREE) or not (BOUND);
# a piece began with an apostrophe (OPEN); then came r or v (TWO_E), or l (TWO_L); a contraction is complete (DONE).
FREE, BOUND, OPEN, TWO_E, TWO_L, DONE = range(6)

#: The White_Space property of Unicode.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out[kinds == "L"], out[kinds == "N"] = LETTER, NUMBER
    for a, b in WHITE_SPACE:
        out[a : b + 1] = BLANK
    out[0x20] = SPACE
    for chars, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("e", E), ("l", L)):
        out[[ord(c) for c in chars]] = kind
    return out


def _transitions() -> np.ndarray:
    """[class, state] → next state."""
    after = {LETTER: FREE, NUMBER: FREE, SPACE: BOUND, BLANK: FREE, OTHER: BOUND, QUOTE: OPEN, STMD: FREE, RV: FREE, E: FREE, L: FREE, END: FREE}
    table = np.array([[after[c]] * 6 for c in range(11)], np.uint8)
    table[QUOTE, [BOUND, OPEN]] = BOUND
    table[STMD, OPEN], table[RV, OPEN], table[L, OPEN] = DONE, TWO_E, TWO_L
    table[E, TWO_E], table[L, TWO_L] = DONE, DONE
    return table


STEPS = _transitions()


def states(kinds: np.ndarray) -> np.ndarray:
    """The automaton's state after each character, by a blocked scan of transition functions."""
    n = len(kinds)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = STEPS.reshape(-1)
    composed = np.tile(np.arange(6, dtype=np.uint8), (rows, 1))
    for column in grid:
        composed = flat[column[:, None].astype(np.int32) * 6 + composed]
    begin, state = np.empty(rows, np.uint8), FREE
    for k, f in enumerate(composed.tolist()):
        begin[k], state = state, f[state]
    out = np.empty((BLOCK, rows), np.uint8)
    now = begin
    for k, column in enumerate(grid):
        now = flat[column.astype(np.int32) * 6 + now]
        out[k] = now
    return out.T.reshape(-1)[:n]


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character; ``END`` characters part the texts and are pieces of their own."""
    n = len(kinds)
    state = states(kinds)
    letter = (kinds == LETTER) | (kinds >= STMD) & (kinds <= L)
    white = (kinds == SPACE) | (kinds == BLANK)
    group = np.select([letter, kinds == NUMBER, white, kinds == END], [0, 1, 2, 3], 4)
    first = np.ones(n, bool)
    if n > 1:
        before, own = group[:-1], group[1:]
        change = own != before
        change &= ~((kinds[:-1] == SPACE) & ((own == 0) | (own == 1) | (own == 4)))  # a blank joins what follows it
        last_white = np.zeros(n - 1, bool)
        last_white[:-1] = (own[:-1] == 2) & (before[:-1] == 2) & (own[1:] != 2) & (own[1:] != 3)
        first[1:] = change | last_white | (own == 3) | (before == 3)
        done = state == DONE
        first[1:] |= done[:-1]
        first[1:] &= ~(done[1:] & (state[:-1] == OPEN))  # 's 't 'm 'd
        two = np.flatnonzero(done & np.r_[False, (state[:-1] == TWO_E) | (state[:-1] == TWO_L)])
        first[two - 1] = False  # 're 've 'll
        first[two] = False
    return first


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: again and again the adjacent pair of lowest rank is merged, leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 400:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get = ranks.get
    order = [get(a + b) for a, b in zip(parts, parts[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(order):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del order[at]
        if at < len(order):
            order[at] = get(parts[at] + parts[at + 1])
        if at:
            order[at - 1] = get(parts[at - 1] + parts[at])


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As :func:`merge` with a heap over a linked list, for pieces of any length."""
    import heapq

    n = len(piece)
    ends, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    get = ranks.get

    def offer(i: int) -> None:
        j = ends[i]
        if j < n:
            r = get(piece[i : ends[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, ends[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        j = ends[i]
        alive[j], ends[i] = False, end
        if end < n:
            prev[end] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Coder:
    """Encodes and decodes; one a worker process, its cache bounded by ``CACHE_PIECES``."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        found = self.cache.get(piece)
        if found is None:
            found = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
            if len(piece) <= 64:
                if len(self.cache) >= CACHE_PIECES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def encode(self, docs: list[str]) -> list[tuple[bytes, list[int]]]:
        """For each text its packed ids and the code-point offsets at which its pieces begin."""
        out = []
        joined = "\0".join(docs) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = classes()[points]
        ends = np.cumsum([len(d) + 1 for d in docs]) - 1
        kinds[ends] = END
        starts = np.flatnonzero(boundaries(kinds))
        cuts = np.searchsorted(starts, np.r_[-1, ends])
        get, packed = self.cache.get, self.packed
        for k, end in enumerate(ends.tolist()):
            at = starts[cuts[k] + (1 if k else 0) : cuts[k + 1]].tolist()
            ids = [get(p) or packed(p) for p in [joined[a:b] for a, b in zip(at, [*at[1:], end])]]
            out.append((b"".join(ids), at))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, piece_starts (code points at which pieces begin).

    ``path`` names a rank file that every worker can open; without it the
    installed vocabulary is looked up on each worker. Null texts are empty and
    have no ids.
    """

    def make():
        own = coder(path or vocabulary_path())

        def fn(keys, docs):
            out = own.encode(docs)
            base = np.cumsum([0, *(len(d) + 1 for d in docs)]).tolist()
            return {"doc_id": keys, "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x, _ in out], "piece_starts": [[a - b for a in at] for (_, at), b in zip(out, base)]}

        return fn

    return map_slices(texts(df, id_col, text_col), make, "doc_id long, ids array<int>, piece_starts array<int>", rows=128)


def decoded(ids_df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids → doc_id, bytes."""

    def make():
        own = coder(path or vocabulary_path())
        return lambda keys, ids: {"doc_id": keys, "bytes": [own.decode(x or []) for x in ids]}

    return map_slices(ids_df.select("doc_id", "ids"), make, "doc_id long, bytes binary", rows=128)


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a text: doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces; with ``with_ids`` also the ids.

    Encodes whole texts, then decodes the stored ids. A null text is empty: no
    tokens and the digest of no bytes. Repeated rows each give a row; an empty
    table gives none; other columns are ignored.
    """

    def make():
        own = coder(path or vocabulary_path())
        sha = hashlib.sha256

        def fn(keys, docs):
            out = own.encode(docs)
            back = [own.decode(np.frombuffer(ids, "<u4").tolist()) for ids, _ in out]
            extra = {"ids": [np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in out]} if with_ids else {}
            return extra | {
                "doc_id": keys, "n_tokens": [len(ids) // 4 for ids, _ in out], "ids_sha256": [sha(ids).hexdigest() for ids, _ in out],
                "decoded_sha256": [sha(b).hexdigest() for b in back], "n_pieces": [len(at) for _, at in out],
            }

        return fn

    return map_slices(texts(df, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long" + ", ids array<int>" * with_ids, rows=128)

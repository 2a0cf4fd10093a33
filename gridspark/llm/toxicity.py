"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all documents. Every text is a
lattice: a sign may stand for a letter, for nothing or for itself, a repeated
letter may be stretched, signs between letters may be noise, and white space
beside a single character may be spacing inside a word. A Viterbi search under
the character model picks the likeliest reading, word breaks included. The
restored text, not the raw one, is scored: a logistic model over the presence
of words and word beginnings.

Context ends at a word break and two letters back, so the lattice falls apart
exactly wherever the channel leaves no choice for two letters. Array
operations over many texts find the stretches in between; each distinct one,
with two letters of context on each side, is searched once.

The classifier is fitted on at most ``SAMPLE`` labelled rows, those of the
smallest hash of their id; the character model is never sampled.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_sample, discard, fresh, map_slices, texts, written

#: Bound on the labelled rows that the classifier is fitted on.
SAMPLE = 20_000
FEATURES, BUCKETS, MIN_ROWS = 2048, 1 << 20, 5
BEGINNINGS = (4, 5, 6, 7)
THRESHOLD = 0.3
HELD_OUT = 2

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c"}

SIZE, FOREIGN, GAP, SKIPPED = 28, 26, 27, 28
SMOOTH = 0.5
MEMO = 200_000
#: Texts that are looked at together.
TEXTS = 64

# The channel: likelihoods of what an observed character came from.
SIGN_LETTER, SIGN_NOISE, SIGN_ITSELF = 0.6, 0.05, 0.35
REPEATED, STRETCHED = 0.1, 0.9  # that the second, or a later one, of equal letters is none
NOISE = 0.4  # that signs between letters are nothing
SPACING = {"singles": 0.48, "single": 0.05, "edge": 0.002}  # that white space is nothing: between single characters, around one, at the end of a row of them

WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"\s+|\S")
#: Stands for letters that can't matter; a text's own becomes a blank.
HIDDEN = "\0"
#: Stands between texts that are looked at together; a text's own becomes a blank.
BETWEEN = "\uffff"
LETTER, SIGN, SPACE, DIGIT = 1, 2, 4, 8


@lru_cache(1)
def character_kinds() -> np.ndarray:
    """Whether a code point is a letter, a sign that may be disguise, white space, or another digit."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        out[c] = LETTER * x.isalpha() | SIGN * (x in SIGNS) | SPACE * x.isspace() | DIGIT * (x.isalnum() and not x.isalpha())
    return out


@lru_cache(1)
def letter_classes() -> np.ndarray:
    """0-25 for a-z and A-Z, FOREIGN for other letters, GAP for all else."""
    out = np.array([FOREIGN if unicodedata.category(chr(c))[0] == "L" else GAP for c in range(0x110000)], np.int16)
    out[ord("a") : ord("z") + 1] = np.arange(26)
    out[ord("A") : ord("Z") + 1] = np.arange(26)
    return out


def character_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Trigram counts over every whole text, SIZE x SIZE x SIZE; each task adds its own up first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros(SIZE**3, np.int64), letter_classes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                joined = "\n\n".join(["", *batch.slice(at, 512).column(0).to_pylist(), ""])
                c = kinds[np.frombuffer(joined.encode("utf-32-le"), "<u4")]
                total += np.bincount((c[:-2].astype(np.int32) * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    rows = texts(df, id_col, text_col).select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n")).collect()  # SIZE ** 3 rows at most
    out = np.zeros(SIZE**3, np.int64)
    for code, n in rows:
        out[code] = n
    return out


class Channel:
    """Restores disguised words under a character model."""

    def __init__(self, counts: np.ndarray):
        cube = counts.reshape(SIZE, SIZE, SIZE) + SMOOTH
        cube[GAP, GAP, :GAP] = cube[:, GAP, :GAP].sum(axis=0)  # at a word's begin nothing else is known
        cube[:, GAP, GAP] = cube[GAP, GAP, GAP] = 0
        with np.errstate(divide="ignore"):
            logp = np.log(cube / cube.sum(axis=2, keepdims=True))
        wide = np.zeros((SIZE + 1, SIZE + 1, SIZE + 1))  # nothing is charged behind hidden letters
        wide[:SIZE, :SIZE, :SIZE] = logp
        self.logp = wide.tolist()
        self.memo: dict[str, str] = {}

    def arcs(self, piece: str) -> list[list[tuple[str, float]]]:
        """What each symbol of a piece may stand for: letters, nothing or itself, with log likelihoods."""
        symbols = SYMBOL.findall(piece)
        sizes = [len(x) for x in piece.split()]
        out, before, row, word = [], "", 0, 0
        for x in symbols:
            if x == before and x not in SIGNS and x.isalpha():
                row += 1
                gone = REPEATED if row == 1 else STRETCHED
                out.append([(x, math.log(1 - gone)), ("", math.log(gone))])
                continue
            row, before = 0, x
            if x in SIGNS:
                out.append([(c, math.log(SIGN_LETTER / len(SIGNS[x]))) for c in SIGNS[x]] + [("", math.log(SIGN_NOISE)), (x, math.log(SIGN_ITSELF))])
            elif x.isalpha() or x == HIDDEN:
                out.append([(x, 0.0)])
            elif x.isspace():
                word += 1
                left, right = sizes[word - 1], sizes[word] if word < len(sizes) else 2
                if left == 1 and right == 1:
                    kind = "singles"
                else:
                    beyond = (sizes[word - 2] if word > 1 else 2) if left == 1 else (sizes[word + 1] if word + 1 < len(sizes) else 2)
                    kind = "edge" if beyond == 1 else "single"
                joined = SPACING[kind] if 1 in (left, right) else 0.0
                out.append([(x, math.log(1 - joined)), *([("", math.log(joined))] if joined else [])])
            else:
                out.append([(x, math.log(1 - NOISE)), ("", math.log(NOISE))])
        return out

    def decode(self, piece: str) -> str:
        """Viterbi over the lattice of a piece: states are the classes of the last two letters since a break."""
        logp = self.logp
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(GAP, GAP): (0.0, None)}  # paths are linked backwards
        for arcs in self.arcs(piece):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for x, cost in arcs:
                    if not x:
                        state, value, link = (a, b), score + cost, path
                    elif x == HIDDEN:
                        state, value, link = (SKIPPED, SKIPPED), score, (path, x)
                    elif x.isalpha():
                        c = ord(x) - 97 if "a" <= x <= "z" else FOREIGN
                        state, value, link = (b, c), score + cost + logp[a][b][c], (path, x)
                    else:
                        state, value, link = (GAP, GAP), score + cost + (0.0 if b == GAP else logp[a][b][GAP]), (path, x)
                    if state not in after or value > after[state][0]:
                        after[state] = (value, link)
            best = after
        (_, _), (_, path) = max(best.items(), key=lambda x: (x[1][0] + (0.0 if x[0][1] == GAP else logp[x[0][0]][x[0][1]][GAP]), x[0]))
        out = []
        while path is not None:
            path, x = path
            out.append(x)
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """The text in lower case with its disguised words restored."""
        return self.restore_all([text])[0]

    def restore_all(self, texts: list[str]) -> list[str]:
        lowered = [t.lower().replace(HIDDEN, " ").replace(BETWEEN, " ") for t in texts]
        whole = f"\n{BETWEEN}\n".join(["", *lowered, ""])
        out, at = [], 0
        for start, end, left, right in zip(*stretches(whole)):
            key = (HIDDEN + whole[start - 2 : start] if left else "") + whole[start:end] + (whole[end : end + 2] + HIDDEN if right else "")
            found = self.memo.get(key)
            if found is None:
                found = self.decode(key)[3 if left else 0 : -3 if right else None]
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                if len(key) <= 64:
                    self.memo[key] = found
            out += [whole[at:start], found]
            at = end
        out.append(whole[at:])
        return "".join(out).split(f"\n{BETWEEN}\n")[1:-1]


def stretches(whole: str) -> tuple[list[int], list[int], list[bool], list[bool]]:
    """Begin and end of every stretch with a choice, and whether two letters without one stand before and behind it.

    Tokens are tied where white space between them may be nothing: beside a
    single letter or digit, or between two single characters. Of a group of
    tied tokens in which anything has a choice, the stretches are what lies
    between its runs of two or more letters of which each differs from the one
    before it.
    """
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = character_kinds()[c]
    letter, sign, solid = kind & LETTER > 0, kind & SIGN > 0, kind & SPACE == 0
    again = np.zeros(len(c), bool)
    again[1:] = letter[1:] & (c[1:] == c[:-1])
    choice = again.copy()
    choice[1:] |= sign[1:] & letter[:-1]
    choice[:-1] |= sign[:-1] & letter[1:]
    mark = solid & (kind & (LETTER | DIGIT) == 0)  # neither letter, digit nor white space
    begins, ends = _runs(mark)
    inner = (begins > 0) & (ends < len(c))
    begins, ends = begins[inner], ends[inner]
    choice[begins[letter[begins - 1] & (letter | sign)[ends]]] = True
    first, last = _runs(solid)
    if not len(first):
        return [], [], [], []
    single = last - first == 1
    named = single & (kind[first] & (LETTER | DIGIT) > 0)
    barrier = c[first] == ord(BETWEEN)
    tied = ((single[:-1] & single[1:]) | named[:-1] | named[1:]) & ~barrier[:-1] & ~barrier[1:]
    marked = named & ~barrier
    marked[np.searchsorted(first, np.flatnonzero(choice), side="right") - 1] = True
    opens, closes = np.r_[True, ~tied], np.r_[~tied, True]
    chosen = np.logical_or.reduceat(marked, np.flatnonzero(opens))
    low, high = first[opens][chosen], last[closes][chosen]
    run_low, run_high = _runs(letter & ~again)
    place = np.searchsorted(low, run_low, side="right") - 1
    kept = (run_high - run_low >= 2) & (place >= 0)
    kept &= run_low < high[np.maximum(place, 0)] if len(high) else False
    run_low, run_high = run_low[kept], run_high[kept]
    start, end = np.sort(np.r_[low, run_high]), np.sort(np.r_[run_low, high])
    wide = end > start
    return start[wide].tolist(), end[wide].tolist(), (~np.isin(start, low))[wide].tolist(), (~np.isin(end, high))[wide].tolist()


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
    return edges[::2], edges[1::2]


def features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    raw = [f"={word}", *(word[:k] for k in BEGINNINGS if len(word) >= k)]
    return [zlib.crc32(x.encode()) & (BUCKETS - 1) for x in raw]


def _fit(rows: list[tuple[list[int], int]], width: int, rounds: int = 400, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over sparse presence rows, by full-batch Adam."""
    y = np.array([t for _, t in rows], float)
    if not len(y):
        return np.zeros(width), math.log(0.1 / 0.9)
    r = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    c = np.array([x for f, _ in rows for x in f], np.int64)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    w, b = np.zeros(width), math.log(rate / (1 - rate))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(r, w[c], len(y)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.r_[np.bincount(c, err[r], width) + ridge * w / 10, err.sum()] / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Model:
    """What scoring needs: the character counts, the chosen buckets with their weights, the intercept."""

    def __init__(self, counts: np.ndarray, weights: dict[int, float], bias: float):
        self.counts, self.weights, self.bias = counts, weights, bias

    def scorer(self):
        """A function from texts to their scores."""
        channel, weights, bias = Channel(self.counts), self.weights, self.bias
        memo: dict[str, tuple[int, ...]] = {}

        def scores(texts: list[str]) -> list[float]:
            out = []
            for text in channel.restore_all(texts):
                seen: set[int] = set()
                for w in set(WORD.findall(text)):
                    own = memo.get(w)
                    if own is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        own = memo[w] = tuple(f for f in features(w) if f in weights)
                    if own:
                        seen.update(own)
                z = bias + sum(weights[f] for f in sorted(seen))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            return out

        return scores


def fold(id_column: F.Column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Character counts over all of ``docs``; weights from labelled rows outside the held-out fold.

    Labels whose doc_id or toxic is null are ignored; of several labels of an
    id the highest holds. Without any usable label the score is constant.
    """
    counts = character_counts(docs, id_col, text_col)
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).dropna().where(fold(F.col("_id")) != HELD_OUT)
    chosen = bounded_sample(own.groupBy("_id").agg(F.max("toxic").alias("toxic")), "_id", SAMPLE)
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # SAMPLE rows at most
    sample = written(rows.select("_id", "text", "toxic").repartition(docs.sparkSession.sparkContext.defaultParallelism, F.xxhash64("_id")).drop("_id"), "toxfit")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, got = Channel(counts), np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for text, toxic in zip(channel.restore_all(part.column(0).to_pylist()), part.column(1).to_pylist()):
                    words = set(WORD.findall(text))
                    got[int(toxic > 0), list({f for w in words for f in features(w)})] += 1
        at = np.flatnonzero(got.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(got[0, at], pa.int64()), pa.array(got[1, at], pa.int64())], names=["bucket", "n0", "n1"])

    by_class = {int(r[0]): r[1] for r in sample.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    if not n0 or not n1:
        rate = (n1 + 0.5) / (n0 + n1 + 1) if n0 + n1 else 0.1
        discard(sample)
        return Model(counts, {}, math.log(rate / (1 - rate)))
    share1 = n1 / (n0 + n1)
    lift = (F.col("n1") - (F.col("n0") + F.col("n1")) * F.lit(share1)) / F.sqrt((F.col("n0") + F.col("n1")) * F.lit(share1 * (1 - share1)))
    ranked = sample.mapInArrow(tally, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = ranked.where(f"n0 + n1 >= {MIN_ROWS}").orderBy(lift.desc(), "bucket").limit(FEATURES).select("bucket").collect()
    index = {r[0]: k for k, r in enumerate(best)}

    def make():
        channel = Channel(counts)

        def fn(body, toxic):
            found = [sorted({index[f] for w in set(WORD.findall(t)) for f in features(w) if f in index}) for t in channel.restore_all(body)]
            return {"f": found, "toxic": [int(x > 0) for x in toxic]}

        return fn

    fitted = [(r[0], r[1]) for r in map_slices(sample, make, "f array<int>, toxic int", rows=TEXTS).collect()]  # SAMPLE rows of at most FEATURES numbers
    discard(sample)
    w, bias = _fit(sorted(fitted), len(index))
    return Model(counts, {b: float(w[k]) for b, k in index.items()}, bias)


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: doc_id, held_out, score, predicted.

    A null or empty text has no features and gets the intercept's score.
    Equal texts get equal scores; a null doc_id counts as not held out; an
    empty table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = shared.value.scorer()
        return lambda keys, docs: {"doc_id": keys, "score": scores(docs)}

    out = map_slices(texts(df, id_col, text_col), make, "doc_id long, score double", rows=TEXTS)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is not predicted toxic, all columns as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = shared.value.scorer()
        for col in batches:
            docs = [t or "" for t in col]
            yield pd.Series([x for at in range(0, len(docs), TEXTS) for x in scores(docs[at : at + TEXTS])], dtype="float64")

    own = fresh(df, "_toxicity")
    return df.withColumn(own, score(F.col(f"`{text_col}`").cast("string"))).where(F.col(own) < THRESHOLD).drop(own)

"""How the values of a record are packed: plain words, row-wise packed integers, run lengths, land or sea points only."""

from __future__ import annotations

import numpy as np

from ..frame import GridError

# The flags of a packed row's control word.
BITS, MISSING, LOWEST, ZERO = 0x1F, 0x20, 0x40, 0x80


def ibm_float(word: int) -> float:
    """An IBM hexadecimal float of 32 bits."""
    sign, power, share = -1.0 if word >> 31 else 1.0, (word >> 24 & 0x7F) - 64, (word & 0xFFFFFF) / float(1 << 24)
    return sign * share * 16.0**power


def to_ibm_float(x: float) -> int:
    """The largest IBM float of 32 bits that isn't above ``x``."""
    if x == 0:
        return 0
    power = 0
    size = abs(x)
    while size >= 1:
        size, power = size / 16, power + 1
    while size < 1 / 16:
        size, power = size * 16, power - 1
    share = int(np.floor(size * (1 << 24))) if x > 0 else int(np.ceil(size * (1 << 24)))
    if share >> 24:
        share, power = share >> 4, power + 1
    return (0x80000000 if x < 0 else 0) | (power + 64) << 24 | share


def _fields(bits: np.ndarray, width: int) -> np.ndarray:
    """Consecutive unsigned numbers of ``width`` bits."""
    return bits.reshape(-1, width).astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64)) if width else np.zeros(0, np.int64)


def unpack_rows(raw: bytes, rows: int, cols: int, missing: float) -> np.ndarray:
    """Row-wise packed integers: every row has a base, a bit width and bitmaps of missing, lowest and zero points.

    The length that a row declares tells whether its zero bitmap marks the
    zeros or the others.
    """
    words = np.frombuffer(raw, ">u4", len(raw) // 4)
    if len(words) < 3 or (int(words[2]) >> 16, int(words[2]) & 0xFFFF) != (cols, rows):
        raise GridError("a packed record's own shape differs from its header's")
    step = 2.0 ** int(words[1].astype(np.int32))
    out, at = np.full((rows, cols), missing), 3
    for r in range(rows):
        base, control, size = ibm_float(int(words[at])), int(words[at + 1]) >> 16, int(words[at + 1]) & 0xFFFF
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size * 4, (at + 2) * 4))
        at += 2 + size
        used, marks = 0, {}
        for flag in (MISSING, LOWEST, ZERO):
            if control & flag:
                marks[flag] = bits[used : used + cols].astype(bool)
                used += cols
        used += -used % 32
        width = control & BITS
        gone, low = marks.get(MISSING, np.zeros(cols, bool)), marks.get(LOWEST, np.zeros(cols, bool))
        zero = np.zeros(cols, bool)
        if ZERO in marks:
            fits = lambda z: -(-int((~(gone | low | z)).sum()) * width // 32) == size - used // 32
            zero = ~marks[ZERO]
            zero = zero if fits(zero) or not fits(marks[ZERO]) else marks[ZERO]
        packed = ~(gone | low | zero)
        n = int(packed.sum())
        row = np.where(low, base, 0.0)
        row[packed] = base + (_fields(bits[used : used + n * width], width) if width else np.zeros(n)) * step
        out[r] = np.where(gone, missing, row)
    return out


def pack_rows(values: np.ndarray, accuracy: int, missing: float) -> bytes:
    """Row-wise packed integers to the nearest ``2 ** accuracy``."""
    rows, cols = values.shape
    step, body = 2.0**accuracy, []
    for line in values:
        gone = line == missing
        there = line[~gone]
        word = to_ibm_float(float(there.min())) if len(there) else 0
        base = ibm_float(word)
        steps = np.round((there - base) / step).astype(np.int64)
        width = int(steps.max()).bit_length() if len(there) else 0
        if width > 31:
            raise GridError("the accuracy is too fine for the range of a row")
        bits = [gone.astype(np.uint8)] if gone.any() else []
        bits = np.concatenate([*bits, np.zeros(-cols % 32, np.uint8)]) if bits else np.zeros(0, np.uint8)
        data = (steps[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8).ravel()
        bits = np.concatenate([bits, data, np.zeros(-len(data) % 32, np.uint8)])
        packed = np.packbits(bits).tobytes()
        body.append(np.array([word, (width | (MISSING if gone.any() else 0)) << 16 | len(packed) // 4], ">u4").tobytes() + packed)
    whole = b"".join(body)
    return np.array([3 + len(whole) // 4, accuracy & 0xFFFFFFFF, cols << 16 | rows], ">u4").tobytes() + whole


def unpack_runs(words: np.ndarray, size: int, missing: float) -> np.ndarray:
    """Run lengths: a missing value is followed by how often it stands."""
    out, at, k = np.full(size, missing), 0, 0
    while k < len(words) and at < size:
        if np.isclose(words[k], missing, rtol=1e-6, atol=0):
            at += int(words[k + 1])
            k += 2
        else:
            out[at] = words[k]
            at, k = at + 1, k + 1
    if at != size:
        raise GridError("a run-length record doesn't fill its shape")
    return out


def pack_runs(values: np.ndarray, missing: float) -> np.ndarray:
    out: list[float] = []
    flat = values.ravel()
    k = 0
    while k < len(flat):
        n = 1
        if flat[k] == missing:
            while k + n < len(flat) and flat[k + n] == missing:
                n += 1
            out += [missing, float(n)]
        else:
            out.append(float(flat[k]))
        k += n
    return np.array(out)


def unpacked(raw: bytes, code: int, order: str, word: int, rows: int, cols: int, integers: bool, missing: float, land: np.ndarray | None = None) -> np.ndarray:
    """The values of a record by its packing code: digits tell the words, then whether and which points are left out."""
    kind, points, which = code % 10, code // 10 % 10, code // 100 % 10
    size = rows * cols
    if kind == 1:
        return unpack_rows(raw, rows, cols, missing)
    width = 4 if kind == 2 else word
    words = np.frombuffer(raw, f"{order}{'i' if integers else 'f'}{width}", len(raw) // width).astype(float)
    if kind == 4:
        return unpack_runs(words, size, missing).reshape(rows, cols)
    if kind not in (0, 2):
        raise GridError(f"records of packing {code} aren't read")
    if points == 2:
        if land is None or land.shape != (rows, cols):
            raise GridError("a record of land or sea points needs the file's land mask")
        there = land > 0 if which == 1 else land <= 0
        out = np.full((rows, cols), missing)
        out[there] = words[: int(there.sum())]
        return out
    return words[:size].reshape(rows, cols)

"""Media columns: MPEG-1 Layer III streams that carry a byte payload, and their reader.

``mux`` writes an ID3v2.4 tag, a Xing frame (frame count, byte count, a table
of 100 seek points) and one frame after another at 48 kHz mono with checksums.
Each frame's side information declares no audio, so its main data is ancillary
data, which is where the payload lies; the last frame takes the smallest
bitrate that fits, so the stream has a variable bitrate.

``demux`` trusts nothing: it parses the tags (ID3v1, ID3v2.2 to 2.4), finds the
first header that a second valid header follows, resynchronises after junk,
verifies every frame's CRC-16, reads Xing, Info and VBRI tables, and returns
payload, exact duration and frame seek offsets. A frame in sync outranks
whatever its bytes look like, so a payload may hold tags and headers itself.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_slices, texts

UNIT = 192

#: Bitrates in kbit/s and sample rates of MPEG-1, MPEG-2 and MPEG-2.5 (as 25) Layer III by header index.
LOW_BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: LOW_BITRATES, 25: LOW_BITRATES}
RATES = {1: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 25: (11_025, 12_000, 8_000)}
CRC_POLYNOMIAL = 0x8005

HEAD = 4 + 2 + 17  # header, checksum, side information of a mono frame


def padded(text: bytes) -> bytes:
    """Blanks appended up to a positive multiple of ``UNIT``."""
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


@dataclass(frozen=True)
class Header:
    version: int
    rate: int
    length: int
    samples: int
    crc: bool
    mono: bool

    @property
    def side(self) -> int:
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The meaning of four header bytes, or None where they are no Layer III header."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1, 2: 2, 0: 25}.get(raw[1] >> 3 & 3)
    bitrate, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if version is None or raw[1] >> 1 & 3 != 1 or bitrate in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    samples = 1152 if version == 1 else 576
    hertz = RATES[version][rate]
    length = samples // 8 * BITRATES[version][bitrate] * 1000 // hertz + (raw[2] >> 1 & 1)
    return Header(version, hertz, length, samples, not raw[1] & 1, raw[3] >> 6 == 3)


@lru_cache(1)
def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, out << 1 ^ CRC_POLYNOMIAL, out << 1) & 0xFFFF
    return out


def crc16(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of bytes, most significant bit first, from 0xFFFF."""
    table, now = _crc_table(), np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        now = (now << 8 & 0xFFFF) ^ table[(now >> 8) ^ column]
    return now


@lru_cache(16)
def _frame_head(index: int) -> bytes:
    """Header, checksum and empty side information of our frames at a bitrate index."""
    raw = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    crc = int(crc16(np.frombuffer(raw[2:] + side, np.uint8)[None, :])[0])
    return raw + crc.to_bytes(2, "big") + side


CAPACITY = [0, *(3 * b - HEAD for b in BITRATES[1][1:])]


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3(tags: dict[str, str]) -> bytes:
    frames = b""
    for key, value in tags.items():
        body = b"\3" + key.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\4\0\0" + _synchsafe(len(frames)) + frames


def mux(payload: bytes, tags: dict[str, str] | None = None) -> bytes:
    """The payload as an MPEG stream."""
    top = len(CAPACITY) - 1
    whole, rest = divmod(len(payload), CAPACITY[top])
    indexes = [top] * whole
    if rest or not whole:
        indexes.append(next(i for i in range(1, top + 1) if CAPACITY[i] >= rest))
    frames, at = [], 0
    for i in indexes:
        body = payload[at : at + CAPACITY[i]]
        at += len(body)
        frames.append(_frame_head(i) + body + bytes(CAPACITY[i] - len(body)))
    sizes = np.cumsum([len(f) for f in frames])
    info_index = 5  # 192 bytes
    total = int(sizes[-1]) + UNIT
    starts = np.r_[0, sizes[:-1]] + UNIT
    toc = (starts[np.arange(100) * len(frames) // 100] * 256 // total).astype(np.uint8).tobytes()
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    info = _frame_head(info_index) + xing + bytes(CAPACITY[info_index] - len(xing))
    return b"".join([_id3({**(tags or {}), "payload": str(len(payload))}), info, *frames])


@dataclass
class Stream:
    """What a stream holds. ``offsets``: where each audio frame begins; ``skipped``: bytes of junk.

    ``toc``: the 100 shares of a Xing table; ``entries``: the seek offsets of a VBRI table.
    """

    payload: bytes = b""
    tags: dict[str, str] = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    checksums: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    xing_frames: int | None = None
    xing_bytes: int | None = None
    quality: int | None = None
    toc: bytes = b""
    entries: list[int] = field(default_factory=list)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // max(1, self.rate)

    def seek(self, sample: int) -> int:
        """Offset of the frame that holds a sample, exactly; 0 for a stream without frames."""
        if not self.offsets:
            return 0
        return self.offsets[min(len(self.offsets) - 1, max(0, sample) * len(self.offsets) // max(1, self.samples))]

    def seek_by_table(self, sample: int, length: int) -> int:
        """Where a player that knows only the Xing table of a stream of ``length`` bytes would start to look."""
        if len(self.toc) < 100:
            return self.seek(sample)
        share = self.toc[min(99, max(0, sample) * 100 // max(1, self.samples))]
        return share * (self.xing_bytes or length) // 256


ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")  # Fixed values: by the first byte of a text frame.


def _text(raw: bytes) -> list[str]:
    """The texts of a text frame, by its encoding byte."""
    if not raw or raw[0] > 3:
        return []
    out = raw[1:].decode(ENCODINGS[raw[0]], "replace").split("\0")
    return out if out[-1] else out[:-1]


def _synched(raw: bytes) -> int:
    return sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0)))


def _tags(data: bytes) -> tuple[dict[str, str], int]:
    """Text entries of a leading ID3v2 tag of version 2.2, 2.3 or 2.4, and where the tag ends.

    User texts (TXX, TXXX) go by their description, other text frames by their
    identifier; an entry that runs over the tag's end is left out.
    """
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127 or data[3] not in (2, 3, 4):
        return {}, 0
    major, flags = data[3], data[5]
    end = min(len(data), 10 + _synched(data[6:10]))
    body = data[10:end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and major > 2 and len(body) >= 4:
        at = _synched(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    wide, out = (3, 6) if major == 2 else (4, 10), {}
    while at + wide[1] <= len(body) and body[at : at + 1] != b"\0":
        kind = body[at : at + wide[0]]
        raw = body[at + wide[0] : at + 2 * wide[0]]
        n = _synched(raw) if major == 4 else int.from_bytes(raw, "big")
        own = body[at + wide[1] : at + wide[1] + n]
        coded = body[at + 9] if major > 2 else 0
        if major == 4 and (flags & 0x80 or coded & 2):
            own = own.replace(b"\xff\0", b"\xff")
        if major == 4 and coded & 1:
            own = own[4:]
        if kind[:1] == b"T" and len(own) and at + wide[1] + n <= len(body):
            texts = _text(own)
            if kind in (b"TXX", b"TXXX"):
                if texts:
                    out[texts[0]] = "\0".join(texts[1:])
            else:
                out[kind.decode("latin-1")] = "\0".join(texts)
        at += wide[1] + n
    return out, min(len(data), end + (10 if major == 4 and flags & 0x10 else 0))


#: The fields of an ID3v1 tag behind its mark, by width.
ID3V1 = (("title", 30), ("artist", 30), ("album", 30), ("year", 4), ("comment", 30))


def _last_tag(raw: bytes) -> dict[str, str]:
    out, at = {}, 3
    for key, width in ID3V1:
        value = raw[at : at + width].split(b"\0")[0].decode("latin-1").rstrip()
        at += width
        if value:
            out[key] = value
    return out


def demux(data: bytes) -> Stream:
    """Parse a stream of any origin; junk and broken frames never raise."""
    out = Stream()
    out.tags, at = _tags(data)
    n = len(data)
    tag = n - 128 if n >= 128 and data[n - 128 : n - 125] == b"TAG" else n  # a tag only where no frame covers it
    found: list[tuple[int, Header]] = []
    while at + 4 <= n and at != tag:
        h = header(data[at : at + 4])
        fits = h is not None and h.length >= 4 + 2 * h.crc + h.side and at + h.length <= n
        if fits:
            follow = at + h.length
            fits = follow in (n, tag) or header(data[follow : follow + 4]) is not None or _sound(data, at, h)
        if fits:
            found.append((at, h))
            at += h.length
            continue
        ahead = data.find(b"\xff", at + 1)
        ahead = n if ahead < 0 else ahead
        if at < tag < ahead:
            ahead = tag
        out.skipped += ahead - at
        at = ahead
    if at == tag < n:
        out.tags = _last_tag(data[tag:]) | out.tags
        at = n
    out.skipped += max(0, n - at)
    good = _checked(data, found, out)
    bodies, first = [], True
    for (start, h), ok in zip(found, good):
        body = start + 4 + 2 * h.crc + h.side
        if first and (data[body : body + 4] in (b"Xing", b"Info") or data[start + 36 : start + 40] == b"VBRI"):
            _table(data, start, body, start + h.length, out)
            first = False
            continue
        first = False
        out.offsets.append(start)
        out.samples += h.samples
        out.rate = out.rate or h.rate
        if ok:
            bodies.append(data[body : start + h.length])
    out.payload = b"".join(bodies)
    size = out.tags.get("payload", "")
    if size.isascii() and size.isdigit():
        out.payload = out.payload[: int(size)]
    return out


def _sound(data: bytes, at: int, h: Header) -> bool:
    """Whether a frame with junk behind it carries a checksum that holds."""
    raw = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
    return h.crc and int(crc16(np.frombuffer(raw, np.uint8)[None, :])[0]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _checked(data: bytes, found: list[tuple[int, Header]], out: Stream) -> list[bool]:
    """Whether each frame's checksum holds; frames without one count as good."""
    good = [True] * len(found)
    raw = np.frombuffer(data, np.uint8)
    for side in {h.side for _, h in found if h.crc}:
        at = np.array([k for k, (_, h) in enumerate(found) if h.crc and h.side == side])
        start = np.array([found[k][0] for k in at])
        columns = np.r_[2, 3, np.arange(6, 6 + side)]
        own = crc16(raw[start[:, None] + columns])
        stored = raw[start + 4].astype(np.uint32) << 8 | raw[start + 5]
        out.checksums += len(at)
        for k in at[own != stored].tolist():
            good[k] = False
            out.bad_checksums += 1
    return good


def _table(data: bytes, start: int, body: int, end: int, out: Stream) -> None:
    """The Xing or VBRI table of the frame at ``start``; a table that runs over the frame's end is read as far as it goes."""
    number = lambda at, width: int.from_bytes(data[at : min(end, at + width)], "big")
    if data[body : body + 4] in (b"Xing", b"Info"):
        flags, at = number(body + 4, 4), body + 8
        if flags & 1:
            out.xing_frames, at = number(at, 4), at + 4
        if flags & 2:
            out.xing_bytes, at = number(at, 4), at + 4
        if flags & 4:
            out.toc, at = data[at : min(end, at + 100)], at + 100
        if flags & 8:
            out.quality = number(at, 4)
        return
    at = start + 36
    out.quality, out.xing_bytes, out.xing_frames = number(at + 8, 2), number(at + 10, 4), number(at + 14, 4)
    count, scale, width = number(at + 18, 2), number(at + 20, 2), number(at + 22, 2)
    place = end
    for k in range(count):
        entry = at + 26 + k * width
        if not width or entry + width > end:
            break
        place += number(entry, width) * scale
        out.entries.append(place)


def feature(s: Stream) -> str:
    """Rate, frames, exact duration as samples and microseconds, checksum counts, digests of the seek table and offsets."""
    offsets = zlib.crc32(np.array(s.offsets, "<u8").tobytes())
    return f"mp3 rate={s.rate} frames={len(s.offsets)} samples={s.samples} us={s.duration_us} crc={s.checksums - s.bad_checksums}/{s.checksums} toc={zlib.crc32(s.toc):08x} seek={offsets:08x}"


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text's payload as a media column: media, n_samples, rate, seek_offsets.

    A null or empty text is a payload of 192 blanks; repeated rows each give
    a row; an empty table gives none; other columns are ignored.
    """

    def make():
        def fn(keys, docs):
            media = [mux(padded(t.encode())) for t in docs]
            read = [demux(m) for m in media]
            return {"doc_id": keys, "media": media, "n_samples": [s.samples for s in read], "rate": [s.rate for s in read], "seek_offsets": [s.offsets for s in read]}

        return fn

    return map_slices(texts(df, id_col, text_col), make, "doc_id long, media binary, n_samples long, rate int, seek_offsets array<long>", rows=64)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text, from the stored stream read back: sizes, digests, features and the frames' offsets, comma-joined.

    A null or empty text is a payload of 192 blanks. Equal texts give equal
    values; repeated rows each give a row; an empty table gives none; other
    columns are ignored.
    """

    def make():
        sha = hashlib.sha256

        def fn(keys, docs):
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_us", "seek_offsets")
            out = {"doc_id": keys, **{k: [] for k in names}}
            for t in docs:
                raw = t.encode()
                media = mux(padded(raw))
                s = demux(media)
                row = (len(raw), len(s.payload), sha(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), sha(media).hexdigest(), feature(s), len(s.offsets), s.duration_us, ",".join(map(str, s.offsets)))
                for k, v in zip(names, row):
                    out[k].append(v)
            return out

        return fn

    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, seek_offsets string"
    return map_slices(texts(df, id_col, text_col), make, ddl, rows=128)

"""Media columns in baseline JPEG: markers, Huffman-coded scans, DC-only luminance thumbnails.

A payload is stored as a grey baseline image in which each byte is the DC
coefficient of one 8 x 8 block: with a quantiser of 8 the block's mean is the
byte itself, so the DC-only thumbnail of the image is the payload and nothing is
lost. An image is 576 blocks wide, each row of blocks is one restart interval,
and payloads of more rows than one image can hold continue in further images.

The reader parses any baseline image (all markers, one or three components,
subsampling, restart intervals). Restart intervals do not depend on each other,
so the usual scans are decoded in numpy with one lane per interval, all lanes
going forward a block at a time; intervals that a 16-bit lookup cannot settle
are decoded bit by bit.

Defined cases: null and empty texts become one row of bytes 255; texts of any
length are stored whole (several images); equal texts give equal values; other
columns pass by, except those named like a result. Bytes that are no baseline JPEG raise ``ValueError``.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: Samples in a row of blocks, and what fills the last row (the contract's values).
WIDTH = 576
FILL = b"\xff"
#: Rows of blocks in one image: a side is at most 65,535 pixels.
ROWS = 8191
#: Restart intervals that are coded or decoded at a time.
LANES = 4096
QUANT = 8
#: Code lengths of DC categories 0 to 11 (fixed values of the standard's luminance table).
DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9)


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of the canonical Huffman code with these lengths."""
    out, code, last = {}, 0, 0
    for symbol, length in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
    return out


def _bits_table() -> tuple[np.ndarray, np.ndarray]:
    """Bits and length of a whole block (category, difference, end of block) for differences -255 to 255."""
    codes = canonical(dict(enumerate(DC_LENGTHS)))
    bits, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        cat = abs(diff).bit_length()
        code, length = codes[cat]
        value = diff if diff >= 0 else diff + (1 << cat) - 1
        bits[diff + 255], size[diff + 255] = (code << cat | value) << 1, length + cat + 1  # the end of block is the bit 0
    return bits, size


_BITS, _SIZE = _bits_table()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, ident: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: lengths[s])
    return _segment(0xC4, bytes([kind << 4 | ident, *(sum(lengths[s] == n for s in order) for n in range(1, 17)), *order]))


def _header(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, bytes([0, *[QUANT] * 64])),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0])),
        _huffman(0, 0, dict(enumerate(DC_LENGTHS))),
        _huffman(1, 0, {0: 1}),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def _coded(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes of each row of samples, stuffed, without markers."""
    level = samples.astype(np.int64) - 128
    diff = np.diff(level, axis=1, prepend=0) + 255
    bits, size = _BITS[diff], _SIZE[diff]
    end = np.cumsum(size, axis=1)
    n_bytes = (end[:, -1] + 7) >> 3
    first = np.concatenate(([0], np.cumsum(n_bytes)))
    start = end - size + first[:-1, None] * 8
    shifted = (bits << (24 - (start & 7) - size)).ravel()
    at, total = (start >> 3).ravel(), int(first[-1]) + 3
    out = sum(np.bincount(at + k, (shifted >> (16 - 8 * k)) & 255, total) for k in range(3)).astype(np.uint8)
    spare = (n_bytes * 8 - end[:, -1]).astype(np.int64)
    out[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    data = out.tobytes()
    return [data[a:b].replace(b"\xff", b"\xff\0") for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Images that hold the payloads; each a positive multiple of WIDTH bytes long."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)
    coded: list[bytes] = []
    for i in range(0, len(rows), LANES):
        coded += _coded(rows[i:i + LANES])
    out, at = [], 0
    for p in payloads:
        images = []
        n = len(p) // WIDTH
        for i in range(0, n, ROWS):
            m = min(ROWS, n - i)
            scan = [coded[at + i]]
            for k in range(1, m):
                scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]), coded[at + i + k])
            images += [_header(m), *scan, b"\xff\xd9"]
        at += n
        out.append(b"".join(images))
    return out


@functools.lru_cache(64)
def code_table(codes: tuple[tuple[tuple[int, int], int], ...]) -> list[int]:
    """For 16 bits ahead: length of the code that they begin with << 8 | its symbol, or 0 for none."""
    out = [0] * (1 << 16)
    for (length, code), symbol in codes:
        first = code << (16 - length)
        out[first:first + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
    return out


class Image:
    """What the markers of one baseline image say, and its restart intervals."""

    def __init__(self, data: bytes, at: int):
        self.quant: dict[int, list[int]] = {}
        self.tables: dict[tuple[int, int], dict[tuple[int, int], int]] = {}
        self.restart, self.components = 0, []
        if data[at:at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            if data[at:at + 1] != b"\xff":
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:  # fill
                at += 1
                continue
            length, = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4:at + 2 + length]
            at += 2 + length
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide, ident = body[i] >> 4, body[i] & 15
                    self.quant[ident] = list(struct.unpack_from(">64H" if wide else ">64B", body, i + 1))
                    i += 129 if wide else 65
            elif marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8:
                    raise ValueError("not 8 bits a sample")
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1:i + 17]
                    symbols = body[i + 17:i + 17 + sum(counts)]
                    lengths = [n + 1 for n, c in enumerate(counts) for _ in range(c)]
                    code, last, found = 0, 0, {}
                    for symbol, length in zip(symbols, lengths, strict=True):
                        code <<= length - last
                        found[length, code], last = symbol, length
                        code += 1
                    self.tables[body[i] >> 4, body[i] & 15] = found
                    i += 17 + sum(counts)
            elif marker == 0xDD:
                self.restart, = struct.unpack(">H", body)
            elif marker == 0xDA:
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
        end = re.compile(rb"\xff[^\0\xd0-\xd7]").search(data, at)
        if end is None or not self.components or len(self.scan) != len(self.components):
            raise ValueError("no whole scan")
        self.intervals = [x.replace(b"\xff\0", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", data[at:end.start()])]
        self.end = end.start() + 2
        one = len(self.components) == 1
        self.h, self.v = (1, 1) if one else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))

    def grey(self) -> bool:
        return len(self.components) == 1

    def thumbnail(self, dc: np.ndarray) -> np.ndarray:
        """Means of the luminance blocks from their DC coefficients."""
        q = self.quant[self.components[0][3]][0]
        return np.clip((dc.astype(np.int64) * q + 4) // 8 + 128, 0, 255).astype(np.uint8)

    def lookup(self) -> np.ndarray:
        """For 16 bits ahead: difference << 5 | bits used, or 0 where they do not settle a DC-only block."""
        dc_id, ac_id = self.scan[self.components[0][0]]
        dc, ac = self.tables[0, dc_id], self.tables[1, ac_id]
        out = np.zeros(1 << 16, np.int64)
        eob = next(((n, c) for (n, c), s in ac.items() if s == 0), None)
        if eob is None:
            return out
        for (length, code), cat in dc.items():
            used = length + cat + eob[0]
            if used > 16:
                continue
            for value in range(1 << cat):
                diff = value if cat == 0 or value >> (cat - 1) else value - (1 << cat) + 1
                at = ((code << cat | value) << eob[0] | eob[1]) << (16 - used)
                out[at:at + (1 << (16 - used))] = diff * 32 + used
        return out

    def slow(self, interval: bytes, blocks: int) -> tuple[list[int], int]:
        """DC coefficients of luminance in ``blocks`` units of one interval, symbol by symbol.

        Each step reads the four bytes at its place, so time is in proportion to the interval.
        """
        n, pos = len(interval) * 8, 0
        data = interval + bytes(8)
        kinds = {(kind, ident): code_table(tuple(sorted(found.items()))) for (kind, ident), found in self.tables.items()}

        def ahead() -> int:
            at = pos >> 3
            return int.from_bytes(data[at:at + 4], "big") << (pos & 7) & 0xFFFFFFFF

        def forward(k: int) -> None:
            nonlocal pos
            pos += k
            if pos > n:
                raise ValueError("the scan ends early")

        def symbol(found: list[int]) -> int:
            got = found[ahead() >> 16]
            if not got:
                raise ValueError("no such code")
            forward(got >> 8)
            return got & 255

        def number(cat: int) -> int:
            if not cat:
                return 0
            value = ahead() >> (32 - cat)
            forward(cat)
            return value if value >> (cat - 1) else value - (1 << cat) + 1

        before, out = dict.fromkeys(self.scan, 0), []
        for _ in range(blocks):
            for k, (ident, h, v, _q) in enumerate(self.components):
                dc, ac = (kinds[kind, self.scan[ident][kind]] for kind in (0, 1))
                for _ in range(1 if self.grey() else h * v):
                    before[ident] += number(symbol(dc))
                    if k == 0:
                        out.append(before[ident])
                    at = 1
                    while at < 64:
                        run = symbol(ac)
                        if run == 0:
                            break
                        at += (run >> 4) + 1
                        if run & 15:
                            forward(run & 15)
        return out, pos

    def whole(self) -> np.ndarray:
        """The thumbnail, symbol by symbol."""
        units, each = self.across * self.down, self.restart or self.across * self.down
        found = [self.slow(x, min(each, units - i * each))[0] for i, x in enumerate(self.intervals) if i * each < units]
        dc = np.array([y for x in found for y in x])
        if len(self.intervals) < -(-units // each):
            raise ValueError("an interval is missing")
        if self.grey():
            return self.thumbnail(dc.reshape(self.down, self.across))
        _, h, v, _ = self.components[0]
        return self.thumbnail(dc.reshape(self.down, self.across, v, h).transpose(0, 2, 1, 3).reshape(self.down * v, self.across * h))


def _lanes(intervals: list[bytes], blocks: int, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """DC coefficients, a row for each interval, and which rows the lookup could not settle."""
    buf = np.frombuffer(b"\xff\xff\xff\xff".join([*intervals, b""]), np.uint8).astype(np.int64)
    ahead = buf[:-3] << 24 | buf[1:-2] << 16 | buf[2:-1] << 8 | buf[3:]
    sizes = np.fromiter(map(len, intervals), np.int64, len(intervals))
    pos = np.concatenate(([0], np.cumsum(sizes + 4)[:-1])) * 8
    last = pos + sizes * 8
    level, bad = np.zeros(len(intervals), np.int64), np.zeros(len(intervals), bool)
    out = np.empty((blocks, len(intervals)), np.int16)
    for k in range(blocks):
        found = lookup[ahead[pos >> 3] >> (16 - (pos & 7)) & 0xFFFF]
        bad |= found == 0
        pos += found & 31
        level += found >> 5
        out[k] = level
    return out.T, bad | (pos > last)


def thumbnails(media: list[bytes]) -> list[list[np.ndarray]]:
    """For each value the DC-only luminance thumbnails of its images."""
    images: list[list[Image]] = []
    for data in media:
        own, at = [], 0
        while at < len(data):
            own.append(Image(data, at))
            at = own[-1].end
        images.append(own)
    done: dict[int, np.ndarray] = {}
    kinds: dict[tuple, list[Image]] = {}
    for im in (im for own in images for im in own):
        whole_rows = im.grey() and im.restart == im.across and len(im.intervals) == im.down
        if whole_rows:
            kinds.setdefault((im.across, repr(sorted(im.tables.items())), repr(im.scan)), []).append(im)
        else:
            done[id(im)] = im.whole()
    for group in kinds.values():
        lookup, across = group[0].lookup(), group[0].across
        rows = [x for im in group for x in im.intervals]
        parts = []
        for i in range(0, len(rows), LANES):
            dc, bad = _lanes(rows[i:i + LANES], across, lookup)
            dc = np.ascontiguousarray(dc)
            for k in np.flatnonzero(bad):
                dc[k] = group[0].slow(rows[i + k], across)[0]
            parts.append(dc)
        at, dc = 0, np.concatenate(parts)
        for im in group:
            done[id(im)] = im.thumbnail(dc[at:at + im.down])
            at += im.down
    return [[done[id(im)] for im in own] for own in images]


def average_hash(thumb: np.ndarray) -> str:
    """Which of 8 x 8 cells are lighter than their mean, as 16 hexadecimal digits."""
    r, c = ((np.arange(8) * n) // 8 for n in thumb.shape)
    r2, c2 = (np.maximum((np.arange(1, 9) * n) // 8, i + 1) for n, i in zip(thumb.shape, (r, c), strict=True))
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumb, axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
    cell = (total[np.ix_(r2, c2)] - total[np.ix_(r, c2)] - total[np.ix_(r2, c)] + total[np.ix_(r, c)]) / ((r2 - r)[:, None] * (c2 - c)[None, :])
    return np.packbits((cell > cell.mean()).ravel()).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text in UTF-8, and that text filled to a positive multiple of WIDTH bytes."""
    raw = (text or "").encode()
    return len(raw), raw + FILL * (-len(raw) % WIDTH if raw else WIDTH)


def _described(media: list[bytes]) -> list[tuple[bytes, str]]:
    """Payload and feature of each stored value."""
    out = []
    for own in thumbnails(media):
        feature = ";".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}:{average_hash(t)}" for t in own)
        out.append((b"".join(t.tobytes() for t in own), feature))
    return out


#: Bytes of text that are stored and read back at a time.
CHUNK = 4 << 20


def _chunks(texts: Iterable[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    held, size = [], 0
    for t in texts:
        held.append(payload_of(t))
        size += len(held[-1][1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def store_column(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """``df`` with the text stored as a binary JPEG column."""
    df = df.drop(out)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{out}` binary"])
    at = df.columns.index(text)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [m for part in _chunks(b.column(at).to_pylist()) for m in encode([p for _, p in part])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(media, pa.binary())], names=[*b.schema.names, out])

    return df.mapInArrow(stored, schema)


def thumbnail_column(df: DataFrame, media: str = "media", out: str = "thumbnail") -> DataFrame:
    """``df`` with an array of (width, height, thumb_width, thumb_height, samples, hash), one for each image in ``media``.

    Null and empty values have no images.
    """
    df = df.drop(out)
    fields = "width int, height int, thumb_width int, thumb_height int, samples binary, hash string"
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{out}` array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"])
    at = df.columns.index(media)
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("thumb_width", pa.int32()), ("thumb_height", pa.int32()),
                               ("samples", pa.binary()), ("hash", pa.string())]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for data in b.column(at).to_pylist():
                own, pos = [], 0
                while pos < len(data or b""):
                    im = Image(data, pos)
                    t = thumbnails([data[pos:im.end]])[0][0]
                    own.append({"width": im.width, "height": im.height, "thumb_width": t.shape[1], "thumb_height": t.shape[0],
                                "samples": t.tobytes(), "hash": average_hash(t)})
                    pos = im.end
                found.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, out])

    return df.mapInArrow(read, schema)


def media_features(df: DataFrame, text: str = "text") -> DataFrame:
    """The other columns with what the stored bytes of ``text`` say when read back."""
    names = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kept = [c for c in df.columns if c != text and c not in names]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in kept),
                        "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"])
    out = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for part in _chunks(x.as_py() for x in b.column(len(kept))):
                media = encode([p for _, p in part])
                for (n, _), m, (back, feature) in zip(part, media, _described(media), strict=True):
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = zip(*rows, strict=True) if rows else [[] for _ in out]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], *(pa.array(c, f.type) for c, f in zip(cols, out, strict=True))], names=[*kept, *out.names])

    return df.select(*kept, text).mapInArrow(described, schema)


def op9_media_jpeg(spark, sf_dir):
    return media_features(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""Progressive JPEG: a decoder that gathers scans into coefficient arrays, and a lossless carrier for bytes.

Decoder: each scan adds a band of coefficients (spectral selection) or one more bit of them (successive approximation)
to integer arrays; after the last scan they are dequantised, inverse-transformed with numpy, chroma is brought to full
size and the result is an RGB tensor. Entropy-coded data is read symbol by symbol, or, where the tables of a scan leave
every block the same number of bits, for all blocks at once.

Carrier: each byte is one quantised coefficient of a 4:4:4 image with quantisation 1, so 192 bytes are one 8x8 cell of
three components. A byte becomes a coefficient of magnitude 127 to 255, never zero: no runs, no ends of block, and every
scan has constant-length codes. Scans: DC without its last bit; AC 1 to 5 and 6 to 63 of each component without the last
bit; the last bit of DC; the last bits of AC. The payload's cell count stands in a comment, since a picture is a full
rectangle and large payloads leave cells at its end.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestack.llm.common import own_columns, read_table, texts_of

CELL = 192
#: Cells in a row of the picture; 65535 pixels are the format's limit.
ROW = 4096
#: Fixed values of the format: the place in the 8x8 block of the k-th coefficient, along the zigzag.
ZIGZAG = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])
#: Rows are the basis functions of the 8-point inverse cosine transform, orthonormal.
BASIS = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)], np.float32)


#: A marker that ends entropy-coded data.
MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


class BadImage(ValueError):
    pass


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def stuff(data: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 0xFF."""
    full = np.flatnonzero(data == 0xFF)
    return np.insert(data, full + 1, 0).tobytes() if len(full) else data.tobytes()


def unstuff(data: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(data[:-1] == 0xFF) + 1 if len(data) else np.empty(0, np.int64)
    return np.delete(data, full) if len(full) else data


def _one_code(kind: int, symbol: int) -> bytes:
    """A Huffman table whose one symbol has the code 0."""
    return bytes([kind << 4, 1, *[0] * 15, symbol])


def _scan(components: list[int], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, tables)), first, last, high << 4 | low]))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG of which ``decode`` gives back the payload, a positive multiple of 192 bytes."""
    if not payload or len(payload) % CELL:
        raise ValueError("the payload is a positive multiple of 192 bytes")
    cells = len(payload) // CELL
    width = min(cells, ROW)
    height = -(-cells // width)
    grid = np.zeros((width * height, 3, 64), np.uint8)
    grid[:cells] = np.frombuffer(payload, np.uint8).reshape(cells, 3, 64)
    up = grid >= 128
    #: Bytes of 128 and more are the coefficients 128 to 255; smaller ones -254 to -127 (DC) or -255 to -128 (AC).
    dc = np.where(up[:, :, 0], grid[:, :, 0].astype(np.int16), grid[:, :, 0].astype(np.int16) - 254)
    magnitude = np.where(up[:, :, 1:], grid[:, :, 1:], ~grid[:, :, 1:])
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", cells)), _segment(0xDB, bytes([0, *[1] * 64]))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, height * 8, width * 8, 3) + bytes(x for c in (1, 2, 3) for x in (c, 0x11, 0))))
    # DC but its last bit: one code bit, seven bits of value, three components; a restart after every cell, so none depends on another
    half = dc >> 1
    code = np.where(half > 0, half, half + 127).astype(np.uint8)
    first = np.empty((len(grid), 5), np.uint8)
    first[:, :3], first[:, 3], first[:, 4] = code, 0xFF, 0xD0 + np.arange(len(grid)) % 8
    out += [_segment(0xC4, _one_code(0, 7)), _segment(0xDD, struct.pack(">H", 1)), _scan([1, 2, 3], 0, 0, 0, 0, 1), first.tobytes()[:-2], _segment(0xDD, b"\0\0")]
    # AC but the last bits: one code bit (no run, size 7) and seven bits of value: a byte each, below 128
    out.append(_segment(0xC4, _one_code(1, 7)))
    value = np.where(up[:, :, 1:], magnitude >> 1, ~(magnitude >> 1) & 0x7F).astype(np.uint8)
    for c in range(3):
        for a, b in ((1, 5), (6, 63)):
            out += [_scan([c + 1], 0, a, b, 0, 1), np.ascontiguousarray(value[:, c, a - 1 : b]).tobytes()]
    # the last bit of DC
    out += [_scan([1, 2, 3], 0, 0, 0, 1, 0), stuff(_packed((dc & 1).astype(np.uint8).ravel()))]
    # the last bits of AC: one code bit for "no more new coefficients", then a bit for each that there is
    out.append(_segment(0xC4, _one_code(1, 0)))
    for c in range(3):
        bits = np.zeros((len(grid), 64), np.uint8)
        bits[:, 1:] = magnitude[:, c] & 1
        out += [_scan([c + 1], 0, 1, 63, 1, 0), stuff(np.packbits(bits, axis=1).ravel())]
    out.append(b"\xff\xd9")
    return b"".join(out)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits to bytes, the last one filled with ones."""
    return np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8))))


class Component(NamedTuple):
    h: int
    v: int
    quant: int
    across: int  # blocks that the component itself has
    down: int
    wide: int  # blocks with those that fill the last cells
    coefficients: np.ndarray  # (high, wide, 64), zigzag order


class Picture:
    """State of a decoder between scans."""

    def __init__(self, content: bytes):
        self.quants: dict[int, np.ndarray] = {}
        self.huffman: dict[int, list] = {}
        self.components: dict[int, Component] = {}
        self.comment = b""
        self.restart = 0
        self.width = self.height = 0
        #: Whether the components are red, green and blue themselves.
        self.plain = False
        try:
            self._read(content)
        except (KeyError, IndexError, AttributeError, ValueError, struct.error) as e:
            raise e if isinstance(e, BadImage) else BadImage(f"a damaged segment: {e}") from e

    def _read(self, content: bytes) -> None:
        if content[:2] != b"\xff\xd8":
            raise BadImage("no start of image")
        at = 2
        while True:
            if at + 2 > len(content) or content[at] != 0xFF:
                raise BadImage(f"no marker at byte {at}")
            marker = content[at + 1]
            if marker == 0xD9:
                return
            if at + 4 > len(content):
                raise BadImage("the file is cut off")
            size = struct.unpack_from(">H", content, at + 2)[0]
            body, at = content[at + 4 : at + 2 + size], at + 2 + size
            if at > len(content):
                raise BadImage("a segment is cut off")
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.plain = body[11] == 0
            elif marker == 0xDB:
                self._quant(body)
            elif marker == 0xC4:
                self._codes(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker in (0xC0, 0xC1, 0xC2):
                self._frame(body)
                self.progressive = marker == 0xC2
            elif marker == 0xDA:
                end = self._end(content, at)
                self._scan(body, content[at:end])
                at = end
            elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise BadImage(f"frames of kind {marker:#x} are not read")

    @staticmethod
    def _end(content: bytes, at: int) -> int:
        """Where the next marker other than a restart stands."""
        found = MARKER.search(content, at)
        if not found:
            raise BadImage("a scan without an end")
        return found.start()

    def _quant(self, body: bytes) -> None:
        while body:
            wide, n = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quants[n] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else "u1").astype(np.float32)
            body = body[1 + size :]

    def _codes(self, body: bytes) -> None:
        while body:
            counts, symbols, code, at = body[1:17], body[17:], 0, 0
            table = {}
            for length, n in enumerate(counts, 1):
                for _ in range(n):
                    table[length, code] = symbols[at]
                    code, at = code + 1, at + 1
                code <<= 1
            self.huffman[body[0]] = table
            body = body[17 + at :]

    def _frame(self, body: bytes) -> None:
        precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if precision != 8 or not self.height or not self.width or n not in (1, 3):
            raise BadImage("only 8-bit pictures of one or three components are read")
        parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if not all(1 <= x <= 4 for p in parts for x in p[1:3]):
            raise BadImage("sampling factors are 1 to 4")
        self.h, self.v = max(p[1] for p in parts), max(p[2] for p in parts)
        self.cells_across, self.cells_down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for name, h, v, q in parts:
            across, down = -(-(-(-self.width * h // self.h)) // 8), -(-(-(-self.height * v // self.v)) // 8)
            wide, high = self.cells_across * h, self.cells_down * v
            self.components[name] = Component(h, v, q, across, down, wide, np.zeros((high, wide, 64), np.int32))

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        parts = [(self.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            first, last, high, low = 0, 63, 0, 0
        raw = np.frombuffer(data, np.uint8)
        if not self._scan_at_once(parts, first, last, high, low, raw):
            SymbolReader(self, parts, first, last, high, low).run(data)

    def _scan_at_once(self, parts: list, first: int, last: int, high: int, low: int, raw: np.ndarray) -> bool:
        """Reads scans in which every block has the same number of bits; says whether this was one.

        That holds where the table has one symbol, which takes one bit, and that symbol fixes all else.
        """
        blocks = self.cells_across * self.cells_down
        if any((c.h, c.v) != (1, 1) for c, _ in parts) or (self.h, self.v) != (1, 1) or not self.progressive:
            return False
        coefficients = [c.coefficients.reshape(-1, 64) for c, _ in parts]
        if first == 0 and high:
            bits = np.unpackbits(unstuff(raw), count=blocks * len(parts)) if not self.restart else None
            if bits is None:
                return False
            for k, target in enumerate(coefficients):
                target[:, 0] |= bits[k :: len(parts)].astype(np.int32) << low
            return True
        tables = [self.huffman.get((0 if first == 0 else 16) + (t >> 4 if first == 0 else t & 15), {}) for _, t in parts]
        if any(len(t) != 1 or (1, 0) not in t for t in tables):
            return False
        symbols = {t[1, 0] for t in tables}
        if len(symbols) != 1:
            return False
        symbol = symbols.pop()
        if first == 0:
            # each cell stands alone only if a restart follows it; its bits fill whole bytes
            if self.restart != 1 or symbol != 7 or len(raw) != blocks * (len(parts) + 2) - 2:
                return False
            cells = np.concatenate((raw, np.array([0xFF, 0xD0], np.uint8))).reshape(blocks, len(parts) + 2)[:, : len(parts)]
            if (cells >= 128).any():
                return False
            for k, target in enumerate(coefficients):
                target[:, 0] = _extended(cells[:, k], 7) << low
            return True
        band, target = slice(first, last + 1), coefficients[0]
        if self.restart:
            return False
        if high == 0:
            if symbol != 7 or len(raw) != blocks * (last - first + 1) or (raw >= 128).any():
                return False
            target[:, band] = _extended(raw.reshape(blocks, -1), 7) * (1 << low)
            return True
        if symbol or not target[:, band].all() or (last - first + 2) % 8:
            return False
        data = unstuff(raw)
        if len(data) != blocks * (last - first + 2) // 8:
            return False
        bits = np.unpackbits(data).reshape(blocks, -1)[:, 1:].astype(np.int32) << low
        target[:, band] += np.where(target[:, band] > 0, bits, -bits)
        return True

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8: all scans so far, dequantised, inverse-transformed and at full size, whatever the ratio.

        Three components are luma and chroma, unless an Adobe segment or their names say that they are colours.
        """
        planes = []
        for c in self.components.values():
            high, wide = c.coefficients.shape[:2]
            block = np.empty((high * wide, 64), np.float32)
            block[:, ZIGZAG] = c.coefficients.reshape(-1, 64) * self.quants[c.quant]
            block = (block.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS
            plane = block.reshape(high, wide, 8, 8).transpose(0, 3, 1, 2).reshape(high * 8, wide * 8) + 128
            if c.v != self.v or c.h != self.h:
                plane = plane[np.arange(self.height) * c.v // self.v][:, np.arange(self.width) * c.h // self.h]
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            rgb = planes * 3
        elif self.plain or tuple(self.components) == tuple(b"RGB"):
            rgb = planes
        else:
            y, b, r = planes[0], planes[1] - 128, planes[2] - 128
            rgb = [y + np.float32(1.402) * r, y - np.float32(0.344136) * b - np.float32(0.714136) * r, y + np.float32(1.772) * b]
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, plane in enumerate(rgb):
            out[:, :, k] = np.clip(np.rint(plane), 0, 255)
        return out


def _extended(code: np.ndarray, size: int) -> np.ndarray:
    """Values of ``size`` bits as the format signs them."""
    code = code.astype(np.int32)
    return np.where(code >> (size - 1), code, code - (1 << size) + 1)


class SymbolReader:
    """The general path: reads a scan of any tables symbol by symbol."""

    def __init__(self, picture: Picture, parts: list, first: int, last: int, high: int, low: int):
        self.picture, self.parts = picture, parts
        self.first, self.last, self.high, self.low = first, last, high, low

    def run(self, data: bytes) -> None:
        pieces, at, start = [], 0, 0
        while (at := data.find(b"\xff", at)) >= 0:
            if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
                pieces.append(data[start:at])
                start = at + 2
            at += 2
        pieces.append(data[start:])
        units = list(self._units())
        step = self.picture.restart or len(units) or 1
        for k, i in enumerate(range(0, len(units), step)):
            self.data = pieces[k].replace(b"\xff\x00", b"\xff") if k < len(pieces) else b""
            self.at, self.run_left, self.previous = 0, 0, [0] * len(self.parts)
            for unit in units[i : i + step]:
                for k_part, block in unit:
                    self._block(k_part, block)

    def _units(self) -> Iterator[list]:
        p = self.picture
        if len(self.parts) == 1:
            c = self.parts[0][0]
            for y in range(c.down):
                for x in range(c.across):
                    yield [(0, c.coefficients[y, x])]
            return
        for my in range(p.cells_down):
            for mx in range(p.cells_across):
                yield [(k, c.coefficients[my * c.v + y, mx * c.h + x]) for k, (c, _) in enumerate(self.parts) for y in range(c.v) for x in range(c.h)]

    def _bits(self, n: int) -> int:
        value = 0
        for _ in range(n):
            byte = self.data[self.at >> 3] if self.at >> 3 < len(self.data) else 0xFF
            value = value << 1 | byte >> (7 - (self.at & 7)) & 1
            self.at += 1
        if self.at > 8 * len(self.data) + 64:
            raise BadImage("a scan has too few bits")
        return value

    def _symbol(self, kind: int, k: int) -> int:
        t = self.parts[k][1]
        table = self.picture.huffman.get(kind << 4 | (t & 15 if kind else t >> 4), {})
        code = 0
        for length in range(1, 17):
            code = code << 1 | self._bits(1)
            if (found := table.get((length, code))) is not None:
                return found
        raise BadImage("no such code")

    def _value(self, size: int) -> int:
        v = self._bits(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def _block(self, k: int, block: np.ndarray) -> None:
        at = self.first
        if at == 0:
            if self.high:
                block[0] |= self._bits(1) << self.low
            else:
                self.previous[k] += self._value(self._symbol(0, k))
                block[0] = self.previous[k] << self.low
            if not self.last:
                return
            at = 1
        (self._refine if self.high else self._new)(k, block, at)

    def _new(self, k: int, block: np.ndarray, at: int) -> None:
        if self.run_left:
            self.run_left -= 1
            return
        while at <= self.last:
            run, size = divmod(self._symbol(1, k), 16)
            if size:
                at += run
                if at > 63:
                    raise BadImage("a run past the block")
                block[at] = self._value(size) * (1 << self.low)
                at += 1
            elif run == 15:
                at += 16
            else:
                self.run_left = (1 << run) - 1 + (self._bits(run) if run else 0)
                return

    def _correct(self, block: np.ndarray, at: int) -> None:
        if self._bits(1):
            block[at] += (1 << self.low) if block[at] > 0 else -(1 << self.low)

    def _refine(self, k: int, block: np.ndarray, at: int) -> None:
        if not self.run_left:
            while at <= self.last:
                run, size = divmod(self._symbol(1, k), 16)
                new = 0
                if size:
                    new = (1 if self._bits(1) else -1) * (1 << self.low)
                elif run < 15:
                    self.run_left = (1 << run) + (self._bits(run) if run else 0)
                    break
                while at <= self.last:
                    if block[at]:
                        self._correct(block, at)
                    elif run == 0:
                        if new:
                            block[at] = new
                        at += 1
                        break
                    else:
                        run -= 1
                    at += 1
        if self.run_left:
            for i in range(at, self.last + 1):
                if block[i]:
                    self._correct(block, i)
            self.run_left -= 1


def payload_of(picture: Picture) -> bytes:
    """The bytes that ``encode`` stored."""
    if len(picture.comment) != 8 or len(picture.components) != 3:
        raise BadImage("not a carrier of bytes")
    cells = struct.unpack(">Q", picture.comment)[0]
    parts = [c.coefficients.reshape(-1, 64) for c in picture.components.values()]
    if cells > len(parts[0]):
        raise BadImage("fewer cells than the comment says")
    grid = np.stack([p[:cells] for p in parts], 1)
    out = np.where(grid > 0, grid, grid + 255).astype(np.uint8)
    dc = grid[:, :, 0]
    out[:, :, 0] = np.where(dc > 0, dc, dc + 254)
    return out.tobytes()


def padded(text: bytes) -> bytes:
    return text + b" " * (CELL if not text else -len(text) % CELL)


def feature_of(rgb: np.ndarray) -> str:
    """Mean of each channel, in thousandths, and the CRC of the tensor."""
    means = ",".join(str(int(x)) for x in rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (rgb.size // 3))
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{means}:{zlib.crc32(rgb.tobytes()):08x}"


_MEDIA = "doc_id long, n_bytes long, media binary"
_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a progressive JPEG. Null texts are empty; empty ones are one cell of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                texts = [t or b"" for t in texts_of(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, _MEDIA)


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb) of stored pictures, ours or others': the full-resolution tensor, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column(1)):
                rgb = Picture(content.as_py()).rgb()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([rgb.shape[0]]), pa.array([rgb.shape[1]]), pa.array([rgb.tobytes()])], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height long, width long, rgb binary")


def digests(media: DataFrame) -> DataFrame:
    """What reading the stored bytes back gives, one row per picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(2):
                content = content.as_py()
                picture = Picture(content)
                payload = payload_of(picture)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(content), hashlib.sha256(content).hexdigest(), feature_of(picture.rgb())))
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, _DIGEST)


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. Null and empty texts are one cell of spaces; equal texts give equal values; repeated rows and null ids
    stay; very long texts are one large picture; other columns are ignored; an empty table gives an empty result."""
    return digests(store(read_table(spark, sf_dir, "documents")))

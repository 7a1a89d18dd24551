import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lodestack.llm import jpeg


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> (n - 1 - i) & 1 for i in range(n)]

    def bytes(self):
        return jpeg.stuff(jpeg._packed(np.array(self.bits, np.uint8)))


#: A table in which all 255 byte values but 0xFF have codes of eight bits, and that of nine.
FLAT = bytes([*[0] * 7, 255, 1, *[0] * 7, *range(256)])


def symbol(out, s):
    out.put(s, 8) if s < 255 else out.put(510, 9)


def value(out, v):
    size = abs(v).bit_length()
    out.put(v if v >= 0 else v + (1 << size) - 1, size)
    return size


def put_value(out, v):
    size = abs(v).bit_length()
    symbol(out, size)
    value(out, v)


def toward_zero(v, low):
    return (abs(v) >> low) * (1 if v >= 0 else -1)


def ac_first(blocks, a, b, low):
    out = Bits()
    for block in blocks:
        run = 0
        for k in range(a, b + 1):
            v = toward_zero(int(block[k]), low)
            if not v:
                run += 1
                continue
            while run > 15:
                symbol(out, 0xF0)
                run -= 16
            symbol(out, run << 4 | abs(v).bit_length())
            value(out, v)
            run = 0
        if run:
            symbol(out, 0)
    return out.bytes()


def ac_refine(blocks, a, b, low):
    """One end-of-block run for every stretch of blocks that get no new coefficient."""
    out, waiting, bits = Bits(), 0, []

    def flush():
        nonlocal waiting, bits
        if waiting:
            n = waiting.bit_length() - 1
            symbol(out, n << 4)
            out.put(waiting - (1 << n), n)
        for bit in bits:
            out.put(bit, 1)
        waiting, bits = 0, []

    for block in blocks:
        new = [k for k in range(a, b + 1) if abs(int(block[k])) >> low == 1]
        run, own = 0, []
        for k in range(a, b + 1):
            m = abs(int(block[k])) >> low
            if k > (new[-1] if new else -1):
                if m > 1:
                    own.append(m & 1)
                continue
            if m == 0:
                run += 1
                if run == 16:
                    flush()
                    symbol(out, 0xF0)
                    for bit in own:
                        out.put(bit, 1)
                    own, run = [], 0
            elif m > 1:
                own.append(m & 1)
            else:
                flush()
                symbol(out, run << 4 | 1)
                out.put(int(block[k] > 0), 1)
                for bit in own:
                    out.put(bit, 1)
                own, run = [], 0
        if not new or new[-1] < b:
            waiting += 1
            bits += own
    flush()
    return out.bytes()


def subsampled(rng, width, height, restart=0):
    """A 4:2:0 picture with runs, ends of block over several blocks, refinement of both kinds; and its coefficients."""
    across, down = -(-width // 16), -(-height // 16)
    shapes = [(2 * down, 2 * across), (down, across), (down, across)]
    blocks = [np.array([[[rng.choice([0, 0, 0, 0, 1, -1, 2, -3, 5, rng.randrange(-60, 60)]) for _ in range(64)] for _ in range(w)] for _ in range(h)]) for h, w in shapes]
    segment, scan = jpeg._segment, lambda parts, a, b, h, low: segment(0xDA, bytes([len(parts), *(x for c in parts for x in (c, 0)), a, b, h << 4 | low]))
    out = [b"\xff\xd8", segment(0xDB, bytes([0, *range(1, 65)])), segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), segment(0xC4, b"\0" + FLAT + b"\x10" + FLAT)]
    order = [[(c, y, x) for c, n in ((0, 2), (1, 1), (2, 1)) for y in range(my * n, my * n + n) for x in range(mx * n, mx * n + n)] for my in range(down) for mx in range(across)]
    if restart:
        out.append(segment(0xDD, struct.pack(">H", restart)))
    pieces = []
    step = restart or len(order)
    for k, i in enumerate(range(0, len(order), step)):
        bits, last = Bits(), [0, 0, 0]
        for c, y, x in (u for cell in order[i : i + step] for u in cell):
            v = int(blocks[c][y, x, 0]) >> 1
            put_value(bits, v - last[c])
            last[c] = v
        pieces += [bits.bytes(), bytes([0xFF, 0xD0 + k % 8])]
    out += [scan([1, 2, 3], 0, 0, 0, 1), *pieces[:-1], segment(0xDD, b"\0\0")]
    own = [(-(-height // 8), -(-width // 8)), *[(-(-(-(-height // 2)) // 8), -(-(-(-width // 2)) // 8))] * 2]
    for c in range(3):
        blocks[c][own[c][0] :, :, 1:] = 0
        blocks[c][:, own[c][1] :, 1:] = 0
        flat = blocks[c][: own[c][0], : own[c][1]].reshape(-1, 64)
        out += [scan([c + 1], 1, 9, 0, 2), ac_first(flat, 1, 9, 2), scan([c + 1], 10, 63, 0, 1), ac_first(flat, 10, 63, 1)]
        out += [scan([c + 1], 1, 9, 2, 1), ac_refine(flat, 1, 9, 1), scan([c + 1], 1, 63, 1, 0), ac_refine(flat, 1, 63, 0)]
    bits = Bits()
    for c, y, x in (u for cell in order for u in cell):
        bits.put(int(blocks[c][y, x, 0]) & 1, 1)
    out += [scan([1, 2, 3], 0, 0, 1, 0), bits.bytes(), b"\xff\xd9"]
    return b"".join(out), blocks


@pytest.mark.parametrize("width, height, restart", [(16, 16, 0), (50, 23, 0), (40, 70, 2)])
def test_general_progressive_scans(width, height, restart):
    content, blocks = subsampled(random.Random(width), width, height, restart)
    picture = jpeg.Picture(content)
    for got, want in zip(picture.components.values(), blocks, strict=True):
        assert (got.coefficients == want).all()
    rgb = picture.rgb()
    assert rgb.shape == (height, width, 3) and rgb.dtype == np.uint8
    y, cb, cr = (p if k == 0 else np.kron(p, np.ones((2, 2))) for k, p in enumerate(slow_planes(blocks, np.arange(1, 65))))
    assert np.abs(slow_rgb(y, cb, cr, height, width) - rgb).max() <= 1


def slow_planes(blocks, quant):
    """Block by block, in double precision."""
    planes = []
    for b in blocks:
        plane = np.zeros((b.shape[0] * 8, b.shape[1] * 8))
        for y in range(b.shape[0]):
            for x in range(b.shape[1]):
                square = np.zeros(64)
                square[jpeg.ZIGZAG] = b[y, x] * quant
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = jpeg.BASIS.T.astype(float) @ square.reshape(8, 8) @ jpeg.BASIS.astype(float) + 128
        planes.append(plane)
    return planes


def slow_rgb(y, cb, cr, height, width):
    y, cb, cr = (p[:height, :width] for p in (y, cb, cr))
    return np.clip(np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], 2), 0, 255)


def flat_blocks(rng, width, height, parts, between=b""):
    """A picture whose blocks are of one value each; parts: (name, h, v). And the planes of each component."""
    segment, h, v = jpeg._segment, max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    values = [np.array([[rng.randrange(-100, 100) for _ in range(across * a)] for _ in range(down * b)]) for _, a, b in parts]
    bits, last = Bits(), [0] * len(parts)
    for my in range(down):
        for mx in range(across):
            for k, (_, a, b) in enumerate(parts):
                for y in range(my * b, my * b + b):
                    for x in range(mx * a, mx * a + a):
                        put_value(bits, int(values[k][y, x]) - last[k])
                        last[k] = int(values[k][y, x])
    frame = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([n, a << 4 | b, 0]) for n, a, b in parts)
    scan = segment(0xDA, bytes([len(parts), *(x for n, _, _ in parts for x in (n, 0)), 0, 0, 0]))
    content = b"".join([b"\xff\xd8", between, segment(0xDB, bytes([0] + [8] * 64)), segment(0xC2, frame), segment(0xC4, b"\0" + FLAT), scan, bits.bytes(), b"\xff\xd9"])
    return content, [np.kron(p, np.ones((8, 8))) + 128 for p in values]


@pytest.mark.parametrize("factors", [((3, 3), (2, 2), (2, 1)), ((2, 1), (1, 1), (1, 1)), ((4, 2), (1, 2), (3, 1)), ((1, 1), (2, 2), (1, 2))])
def test_samplings_of_any_ratio(factors):
    height, width = 37, 51
    content, planes = flat_blocks(random.Random(8), width, height, [(k + 1, *f) for k, f in enumerate(factors)])
    h, v = (max(f[k] for f in factors) for k in (0, 1))
    full = [[[p[y * b // v, x * a // h] for x in range(width)] for y in range(height)] for p, (a, b) in zip(planes, factors, strict=True)]
    assert np.abs(slow_rgb(*map(np.array, full), height, width) - jpeg.Picture(content).rgb()).max() <= 1


@pytest.mark.parametrize("names, between", [((1, 2, 3), b"Adobe\0\x64\0\0\0\0\0"), (tuple(b"RGB"), b"")])
def test_colours_that_are_no_luma_and_chroma(names, between):
    content, planes = flat_blocks(random.Random(9), 24, 16, [(n, 1, 1) for n in names], jpeg._segment(0xEE, between) if between else b"")
    assert (jpeg.Picture(content).rgb() == np.clip(np.stack(planes, 2), 0, 255)).all()


def test_one_component_is_grey():
    content, planes = flat_blocks(random.Random(10), 20, 9, [(1, 1, 1)])
    assert (jpeg.Picture(content).rgb() == np.clip(planes[0][:9, :20, None], 0, 255)).all()


@pytest.mark.parametrize("text", ["", "a river of stones " * 40, "é日本" * 300])
def test_feature_of_a_carrier(text):
    picture = jpeg.Picture(jpeg.encode(jpeg.padded(text.encode())))
    parts = list(picture.components.values())
    planes = slow_planes([c.coefficients for c in parts], picture.quants[parts[0].quant])
    assert {(c.h, c.v, c.quant) for c in parts} == {(1, 1, parts[0].quant)}
    want = slow_rgb(*planes, picture.height, picture.width)
    assert np.abs(want - picture.rgb()).max() <= 1
    size, means, crc = jpeg.feature_of(picture.rgb()).split(":")
    assert size == f"{picture.width}x{picture.height}" and crc == f"{zlib.crc32(picture.rgb().tobytes()):08x}"
    assert np.abs(np.array(means.split(","), float) / 1000 - want.reshape(-1, 3).mean(0)).max() < 1


@pytest.mark.parametrize("cells", [1, 2, 9, 4096, 4099])
def test_carrier_round_trip_and_both_readers(cells, monkeypatch):
    payload = np.random.default_rng(cells).integers(0, 256, 192 * cells, np.uint8).tobytes()
    payload = bytes(range(192)) + bytes(range(64, 256)) + payload[384:] if cells > 1 else b"\x7f\x80\xff\x00" * 48
    content = jpeg.encode(payload)
    fast = jpeg.Picture(content)
    assert jpeg.payload_of(fast) == payload
    if cells < 100:
        monkeypatch.setattr(jpeg.Picture, "_scan_at_once", lambda *_: False)
        slow = jpeg.Picture(content)
        assert jpeg.payload_of(slow) == payload
        assert (slow.rgb() == fast.rgb()).all()


def test_damaged_files_are_refused():
    content = jpeg.encode(b"x" * 384)
    frame = content.index(b"\xff\xc2")
    no_factors = content[: frame + 11] + b"\0" + content[frame + 12 :]
    no_frame = content[:frame] + b"\xff\xfe" + content[frame + 2 :]
    for bad in (content[:-2], content[:100], b"", content[2:], content.replace(b"\xff\xc2", b"\xff\xc9"), no_factors, no_frame):
        with pytest.raises(jpeg.BadImage):
            jpeg.Picture(bad)


def test_whole_texts(spark):
    texts = [None, "", " ", "é" * 96, "a" * 193, "word " * 40_000, "same", "same"]
    df = spark.createDataFrame([(i if i != 2 else None, t, "m", 1) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int").repartition(2)
    rows = {(r.doc_id, r.n_bytes): r for r in jpeg.digests(jpeg.store(df)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        r = rows[i if i != 2 else None, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(jpeg.encode(payload)).hexdigest() and r.media_bytes == len(jpeg.encode(payload))
    assert rows[6, 4].feature == rows[7, 4].feature
    shapes = {(r.height, r.width, len(r.rgb)) for r in jpeg.tensors(jpeg.store(df)).collect()}
    assert (8, 8, 192) in shapes and all(h * w * 3 == n for h, w, n in shapes)
    assert jpeg.digests(jpeg.store(df.limit(0))).collect() == []

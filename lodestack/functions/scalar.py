"""Scalar functions as Column expressions; none needs Python on the executors but gzip."""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own: the first four bytes of a sealed parity shard.
PARITY_MAGIC = b"LSP1"
#: The first four bytes of an encrypted chunk, manifest and wrapped key.
CHUNK_MAGIC, MANIFEST_MAGIC, KEY_MAGIC = b"CSE1", b"CSM1", b"CSK1"
GZIP_MAGIC = b"\x1f\x8b"
UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def _literal(data: bytes) -> Column:
    return F.lit(bytearray(data))


def _binary(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("binary")


def sha256_hex(value: Column | str) -> Column:
    """Identity of a chunk: lower-case hex SHA-256 of its raw bytes."""
    return F.sha2(_binary(value), 256)


def hex_lower(value: Column | str) -> Column:
    return F.lower(F.hex(value))


def is_chunk_id(value: Column | str) -> Column:
    return F.length(value) == 64


def hmac_sha256_hex(key: bytes, message: Column | str) -> Column:
    """RFC 2104 over SHA-256 with the key folded into two literal pads."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(_literal(bytes(b ^ 0x36 for b in key)), _binary(message)), 256)
    return F.sha2(F.concat(_literal(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def file_id(path: Column | str, key: bytes | None = None, obfuscate: bool = False) -> Column:
    """Name of a file's parity directory: keyed if names are to be hidden and there is a key."""
    return hmac_sha256_hex(key, path) if obfuscate and key else sha256_hex(path)


def seal(payload: Column | str, key: bytes, magic: bytes = CHUNK_MAGIC) -> Column:
    """magic, nonce (12 bytes), AES-GCM ciphertext, tag (16 bytes). Without magic: pass ``b""``."""
    sealed = F.aes_encrypt(_binary(payload), _literal(key), F.lit("GCM"))
    return F.concat(_literal(magic), sealed) if magic else sealed


def is_sealed(payload: Column | str, magic: bytes = CHUNK_MAGIC) -> Column:
    return F.substring(payload, 1, len(magic)) == _literal(magic)


def unseal(payload: Column | str, key: bytes, magic: bytes = CHUNK_MAGIC) -> Column:
    """Decrypts what ``seal`` made; a wrong key or changed byte is an error."""
    body = F.substring(payload, len(magic) + 1, 2**31 - 1) if magic else F.col(payload) if isinstance(payload, str) else payload
    return F.aes_decrypt(body, _literal(key), F.lit("GCM"))


def try_unseal(payload: Column | str, key: bytes, magic: bytes = CHUNK_MAGIC) -> Column:
    """As ``unseal``, but null where it fails."""
    body = F.substring(payload, len(magic) + 1, 2**31 - 1) if magic else F.col(payload) if isinstance(payload, str) else payload
    return F.try_aes_decrypt(body, _literal(key), F.lit("GCM"))


def _pack(payload: pa.Array) -> pa.Array:
    def pack(data: bytes) -> bytes:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    return pa.array([None if v is None else pack(v) for v in payload.to_pylist()], pa.binary())


def _unpack(payload: pa.Array) -> pa.Array:
    def unpack(data: bytes) -> bytes | None:
        try:
            return zlib.decompress(data, 31)
        except zlib.error:
            return None

    return pa.array([None if v is None else unpack(v) for v in payload.to_pylist()], pa.binary())


def gzip(payload: Column | str) -> Column:
    """Python by Arrow batches: Spark has no such function."""
    return F.arrow_udf(_pack, "binary")(payload)


def gunzip(payload: Column | str) -> Column:
    """Null where the bytes are no whole gzip stream."""
    return F.arrow_udf(_unpack, "binary")(payload)


def fanout_path(chunk_id: Column | str) -> Column:
    return F.concat_ws("/", F.substring(chunk_id, 1, 2), F.substring(chunk_id, 3, 2), chunk_id)


def stripe_name(stripe_id: Column | str) -> Column:
    return F.format_string("stripe-%08d", stripe_id)


def parse_stripe_name(name: Column | str) -> Column:
    return F.regexp_extract(name, "-(.*)$", 1).try_cast("long")


def snapshot_name(taken_at: Column | str) -> Column:
    """Needs a session time zone of UTC."""
    return F.date_format(taken_at, "'SNAP_'yyyy-MM-dd'T'HH-mm-ss'Z'")


def parse_snapshot_name(name: Column | str) -> Column:
    return F.try_to_timestamp(name, F.lit("'SNAP_'yyyy-MM-dd'T'HH-mm-ss'Z'"))


def human_bytes(n: Column | str) -> Column:
    """Two decimals in steps of 1024."""
    n = F.col(n) if isinstance(n, str) else n
    out = F.when(n < 1024, F.format_string("%.2f B", n.cast("double")))
    for k, unit in enumerate(UNITS[1:], 1):
        scaled = F.format_string(f"%.2f {unit}", n.cast("double") / float(1024**k))
        out = out.when(n < 1024 ** (k + 1), scaled) if k < len(UNITS) - 1 else out.otherwise(scaled)
    return out


def sanitize(name: Column | str) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def parse_number(text: Column | str) -> Column:
    """Integers may have ``_`` between digits."""
    return F.replace(text, F.lit("_"), F.lit("")).cast("long")


def file_mode(is_link: Column, is_dir: Column) -> Column:
    return F.when(is_link, "L").when(is_dir, "D").otherwise("F")


def slashes(path: Column | str) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def next_pow2(x: int) -> int:
    return 1 << max(0, x - 1).bit_length()


def bloom_size(n: int, bits_per_element: int = 10, max_k: int = 30) -> tuple[int, int]:
    """(bits, hash functions): at least 2^20 bits. Few entries would ask for hundreds of functions; they are capped."""
    m = max(1 << 20, next_pow2(min(2**31 - 9, n * bits_per_element)))
    return m, min(max_k, max(1, round(m / max(1, n) * math.log(2))))


def bloom_positions(chunk_id: Column | str, m_bits: Column | int, k: int) -> Column:
    """Array of the k bit positions of a chunk id: h1 = L0 xor L16, h2 = L8 xor rotl(h1, 1), (h1 + i h2) folded to 31 bits.

    In 32-bit halves, so that nothing overflows: ANSI arithmetic would raise.
    """
    low32 = 0xFFFFFFFF
    part = [F.conv(F.substring(chunk_id, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(6)]
    h1_hi, h1_lo = part[0].bitwiseXOR(part[4]), part[1].bitwiseXOR(part[5])
    rot_hi = F.shiftleft(h1_hi, 1).bitwiseAND(low32).bitwiseOR(F.shiftright(h1_lo, 31))
    rot_lo = F.shiftleft(h1_lo, 1).bitwiseAND(low32).bitwiseOR(F.shiftright(h1_hi, 31))
    h2_hi, h2_lo = part[2].bitwiseXOR(rot_hi), part[3].bitwiseXOR(rot_lo)

    def position(i: int) -> Column:
        lo = h1_lo + h2_lo * i
        hi = h1_hi + h2_hi * i + F.shiftright(lo, 32)
        return lo.bitwiseXOR(hi).bitwiseAND(0x7FFFFFFF) % (F.lit(m_bits) if isinstance(m_bits, int) else m_bits)

    return F.array(*map(position, range(k)))

"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

An archive is a byte string. ``write_archives`` makes a table of them (archive, n_records, content) and
``read_archives`` reads such a table, or any files opened with Spark's ``binaryFile`` source, so that whatever store
Spark reaches will do. Writing deals whole tasks into archives of bounded size; nothing is shuffled but digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import materialise, read_table

#: Magic number of the skippable frame that carries the dictionary.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICT_BYTES = 64 << 10
#: The dictionary is trained on at most so many pages and bytes.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 4 << 20
ARCHIVE_BYTES = 4 << 20
#: Bytes of an archive that are handed to the decoder at once.
PIECE = 16 << 10
#: Payloads below this are always stored whole.
REVISIT_BYTES = 1000
LEVEL = 3
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "archive string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string, error string"
_FIELDS = pa.schema(
    [("archive", pa.string()), ("at", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("record_id", pa.string()), ("error", pa.string())]
)


class BadArchive(ValueError):
    pass


def train_dictionary(pages: DataFrame) -> bytes:
    """From a bounded, seeded sample of pages of up to 64 KiB (longer ones are compressed with what these teach); too little text to train on gives an empty dictionary."""
    sample = pages.where("html IS NOT NULL AND octet_length(html) <= 65536").select("html", F.xxhash64("page_id", "html").alias("turn"))
    # numbers first: then only the sample's own pages travel, whatever the number of tasks
    turns = [r.turn for r in sample.select("turn").orderBy("turn").limit(SAMPLE_PAGES).collect()]
    if not turns:
        return b""
    texts, total = [], 0
    for row in sample.where(F.col("turn") <= turns[-1]).orderBy("turn").limit(SAMPLE_PAGES).collect():
        texts.append(row.html.encode())
        total += len(texts[-1])
        if total >= SAMPLE_BYTES:
            break
    if total < 16 * 1024 or len(texts) < 16:
        return b""
    return zstandard.train_dictionary(min(DICT_BYTES, total // 8), texts, level=LEVEL).as_bytes()


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame; the dictionary inside is itself compressed."""
    body = zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b""
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


def _skippable(content: bytes | memoryview, at: int) -> int | None:
    """Where the skippable frame at ``at`` ends, or None if there is none."""
    if len(content) - at < 4 or not 0x184D2A50 <= int.from_bytes(content[at : at + 4], "little") <= 0x184D2A5F:
        return None
    if len(content) - at < 8 or (end := at + 8 + int.from_bytes(content[at + 4 : at + 8], "little")) > len(content):
        raise BadArchive(f"the skippable frame at byte {at} is cut off")
    return end


def take_dictionary(content: bytes) -> tuple[bytes, int]:
    """(dictionary, where the records begin); an archive without such a frame has none."""
    if int.from_bytes(content[:4], "little") != DICT_MAGIC:
        return b"", 0
    end = _skippable(content, 0)
    body = content[8:end]
    if body[:4] != ZSTD_MAGIC:
        return body, end
    try:
        return zstandard.ZstdDecompressor().decompress(body), end
    except zstandard.ZstdError as e:
        raise BadArchive(f"the dictionary does not decode: {e}") from e


def _value(text: str | None) -> str:
    """A header value on one line, readable by ``_plain``."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20").replace("\t", "%09")


def _plain(text: str) -> str:
    for code, char in (("%0D", "\r"), ("%0A", "\n"), ("%20", " "), ("%09", "\t"), ("%25", "%")):
        text = text.replace(code, char)
    return text


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: version line, headers, blank line, block, two line ends. A revisit's block ends after the HTTP headers."""
    block = _http(len(payload)) + (b"" if revisit else payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _value(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if url is None:
        headers[3] = ("X-No-Target", "1")
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    headers.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes, first: bytes) -> dict[str, str]:
    head, *rest = lines.split(b"\r\n")
    if not head.startswith(first):
        raise BadArchive(f"no {first.decode()} line")
    out, name = {}, ""
    for line in rest:
        text = line.decode(errors="replace")
        if text[:1] in (" ", "\t") and name:  # a value may go on in the next line
            out[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name or name != name.strip():
            raise BadArchive("a header line without a name")
        name = name.lower()
        out.setdefault(name, value.strip())
    return out


def _page(urn: str) -> int | None:
    """The page that a record id of ours names; other ids name none."""
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number != urn and number.removeprefix("-").isdigit() else None


def _matches(stated: str, data: bytes) -> bool:
    """Whether a digest header fits: algorithm, colon, base 16 or base 32. Unknown algorithms are taken on trust."""
    name, _, value = stated.partition(":")
    if (name := name.lower().replace("-", "")) not in ("md5", "sha1", "sha256", "sha512"):
        return True
    digest = hashlib.new(name, data).digest()
    return value.lower() == digest.hex() or value.rstrip("=").upper() == base64.b32encode(digest).decode().rstrip("=")


def _unchunked(body: bytes) -> bytes:
    """The entity of a body in HTTP's chunked form."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        try:
            size = int(body[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or line + 2 + size > len(body):
            raise BadArchive("a broken chunk in an HTTP body")
        if not size:
            return b"".join(out)
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def _http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    cut = block.find(b"\r\n\r\n")
    if cut < 0:
        raise BadArchive("HTTP headers without an end")
    return _headers(block[:cut], b"HTTP/"), block[cut + 4 :]


def parse_record(raw: bytes) -> dict:
    """Fields of one decoded frame; raises BadArchive where a header is missing or a length or digest does not hold.

    Any type and id of record will do. The payload of an HTTP response is its body (that of the block, if digests are of
    the chunked form as sent; ``payload_bytes`` counts the same), of any other record its block.
    """
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise BadArchive("headers without an end")
    h = _headers(raw[:end], b"WARC/1.")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in h:
            raise BadArchive(f"no {need}")
    length, block = h["content-length"], raw[end + 4 : -4]
    if not length.isdigit() or raw[-4:] != b"\r\n\r\n" or len(block) != int(length):
        raise BadArchive(f"content-length {length} but the block has {len(block)} bytes")
    if "warc-block-digest" in h and not _matches(h["warc-block-digest"], block):
        raise BadArchive("the block's digest differs")
    kind, stated_digest = h["warc-type"], h.get("warc-payload-digest", "")
    http = h.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    revisit, payload, size = kind == "revisit", block, len(block)
    if revisit:
        headers, body = _http_parts(block) if http and block else ({}, b"")
        if body or not stated_digest or not ("warc-refers-to" in h or "warc-refers-to-target-uri" in h):
            raise BadArchive("a revisit with a body, or without what it refers to")
        payload, stated = None, headers.get("content-length", "")
        size = int(stated) if stated.isdigit() else None
    elif http and kind == "response":
        headers, payload = _http_parts(block)
        stated = headers.get("content-length", "")
        if "chunked" in headers.get("transfer-encoding", "").lower():
            whole = _unchunked(payload)
            payload = payload if stated_digest and not _matches(stated_digest, whole) else whole
        elif stated and (not stated.isdigit() or int(stated) != len(payload)) and h.get("warc-truncated") is None:
            raise BadArchive(f"HTTP content-length {stated} but the payload has {len(payload)} bytes")
        size = len(payload)
    if payload is not None and stated_digest and not _matches(stated_digest, payload):
        raise BadArchive("the payload's digest differs")
    return {
        "page_id": _page(h["warc-record-id"]),
        "url": None if "x-no-target" in h or "warc-target-uri" not in h else _plain(h["warc-target-uri"]),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": stated_digest.removeprefix("sha1:") if payload is None else hashlib.sha1(payload).hexdigest(),
        "refers_to": _page(h.get("warc-refers-to", "")) if revisit else None,
        "payload": payload,
        "record_id": h["warc-record-id"],
    }


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each frame. Other skippable frames are passed over; trailing garbage raises.

    A frame is fed piece by piece, so that only what it takes is copied, however long the archive is.
    """
    dictionary, at = take_dictionary(content)
    try:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    except zstandard.ZstdError as e:
        raise BadArchive(f"the dictionary does not load: {e}") from e
    reader = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < len(content):
        if (end := _skippable(view, at)) is not None:
            at = end
            continue
        if view[at : at + 4] != ZSTD_MAGIC:
            raise BadArchive(f"no frame at byte {at}")
        one, parts, end = reader.decompressobj(), [], at
        try:
            while not one.eof and end < len(content):
                piece = view[end : end + PIECE]
                parts.append(one.decompress(piece))
                end += len(piece)
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at byte {at} does not decode: {e}") from e
        if not one.eof:
            raise BadArchive(f"the frame at byte {at} is cut off")
        yield at, b"".join(parts)
        at = end - len(one.unused_data)


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, n, refers_to (largest page_id with that payload; null for small payloads).

    Digests are partially aggregated before they are shuffled, and only payloads that occur twice are joined back.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    seen = p.where(f"n >= {REVISIT_BYTES}").groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("times"))
    twice = materialise(seen.where("times > 1 AND refers_to IS NOT NULL").select("digest", "n", "refers_to"), "payloads")
    return p.join(twice, ["digest", "n"], "left")


def write_archives(pages: DataFrame, dictionary: bytes, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, n_records, content): archives of about ``size`` payload bytes, one record per row, in shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True, write_content_size=True)
        parts, raw_size = [dictionary_frame(dictionary)], 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, raw_size
            content = b"".join(parts)
            n, parts, raw_size = len(parts) - 1, [dictionary_frame(dictionary)], 0
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest()]), pa.array([n], pa.int64()), pa.array([content], pa.binary())], ["archive", "n_records", "content"])

        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests, refers = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i, page in enumerate(ids):
                payload = batch.column(2)[i].as_buffer()
                payload = payload.to_pybytes() if payload is not None else b""
                revisit = refers[i] is not None and refers[i] != page
                parts.append(packer.compress(record_bytes(page, urls[i], payload, digests[i], refers[i], revisit)))
                raw_size += len(payload)
                if raw_size >= size:
                    yield flush()
        if len(parts) > 1:
            yield flush()

    known = with_references(pages).select("page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to")
    return materialise(known.mapInArrow(run, "archive string, n_records long, content binary"), "warc")


def read_archives(archives: DataFrame, strict: bool = True, payloads: bool = True) -> DataFrame:
    """One row per record, with what ``parse_record`` validated.

    archives: a table with ``content`` and a name in ``archive`` or ``path``. strict: a bad archive or record fails the
    job; else its row has the reason in ``error`` and, after a frame that does not decode, the rest of that archive is
    not read. Every damage is a BadArchive. page_id and refers_to are null for records that ``write_archives`` did not make;
    record_id is theirs.
    """
    name = "archive" if "archive" in archives.columns else "path"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                archive, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                at = 0
                try:
                    for at, raw in frames(content):
                        try:
                            row = parse_record(raw) | {"error": None}
                        except BadArchive as e:
                            if strict:
                                raise
                            row = {"error": str(e)}
                        if not payloads:
                            row["payload"] = None
                        held.append(row | {"archive": archive, "at": at})
                        size += len(raw)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, _FIELDS)
                            held, size = [], 0
                except BadArchive as e:
                    if strict:
                        raise
                    held.append({"archive": archive, "at": at, "error": str(e)})
                if held:
                    yield pa.RecordBatch.from_pylist(held, _FIELDS)

    return archives.select(F.col(name).alias("archive"), "content").mapInArrow(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as records and read back. Null html: an empty payload, always a response. Rows equal in page_id and
    payload are alike: all responses if theirs is the largest page_id. Null page_ids never are what others refer to."""
    pages = read_table(spark, sf_dir, "pages")
    archives = write_archives(pages, train_dictionary(pages))
    return read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS newest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, url,
       CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM d LEFT JOIN m ON m.payload_digest = d.payload_digest AND payload_bytes >= 1000
"""

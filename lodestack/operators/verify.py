"""Does what is stored hash to its name?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalar import CHUNK_MAGIC, gunzip, gzip, is_sealed, seal, sha256_hex, try_unseal, unseal

CODECS = ("raw", "gzip", "aes", "gzip+aes")


def encode_payload(chunks: DataFrame, compress: bool = False, key: bytes | None = None) -> DataFrame:
    """chunks with stored payload, codec and stored_size. The codec is a column: contents are never sniffed."""
    payload = F.col("payload")
    if compress:
        payload = gzip(payload)
    if key:
        payload = seal(payload, key)
    codec = "+".join([*["gzip"] * compress, *["aes"] * bool(key)]) or "raw"
    out = chunks.withColumns({"payload": payload, "codec": F.lit(codec)})
    return out.withColumn("stored_size", F.octet_length("payload").cast("long"))


def decode_payload(chunks: DataFrame, key: bytes | None = None, strict: bool = True) -> DataFrame:
    """The raw payload by the codec column; what cannot be decoded is an error, or null if not strict."""
    sealed, plain = F.col("codec").endswith("aes"), F.col("payload")
    if key:
        opened = unseal("payload", key) if strict else F.when(is_sealed("payload", CHUNK_MAGIC), try_unseal("payload", key))
        plain = F.when(sealed, opened).otherwise(plain)
    else:
        plain = F.when(~sealed, plain)
    opened = chunks.withColumn("payload", plain)
    packed = opened.where(F.col("codec").startswith("gzip")).withColumn("payload", gunzip("payload"))
    return opened.where(~F.col("codec").startswith("gzip")).unionByName(packed)


def chunk_status(decoded: DataFrame) -> DataFrame:
    """decoded with actual_id and status: ok, bad (another hash; a chunk of that hash may exist) or failed (not decodable)."""
    actual = sha256_hex("payload")
    return decoded.withColumns({"actual_id": actual, "status": F.when(F.col("payload").isNull(), "failed").when(actual == F.col("chunk_id"), "ok").otherwise("bad")})


def summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("chunks"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "bad").alias("bad"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("bytes"),
    )


def relocations(status: DataFrame) -> DataFrame:
    """(chunk_id, actual_id): where bad chunks would belong by their contents. Reported, not done: parity repairs better."""
    return status.where("status = 'bad'").select("chunk_id", "actual_id")


def must_hold(status: DataFrame) -> DataFrame:
    """status, failing the job at the first chunk that is not ok."""
    message = F.concat(F.lit("chunk "), F.col("chunk_id"), F.lit(" is "), F.col("status"))
    return status.withColumn("status", F.when(F.col("status") == "ok", F.col("status")).otherwise(F.raise_error(message).cast("string")))

"""Passphrases and wrapped keys; on the driver only, once per repository."""

from __future__ import annotations

import hashlib
import os
import secrets

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestack.functions.scalar import KEY_MAGIC

ITERATIONS = 210_000
PASSPHRASE = "LODESTACK_PASSPHRASE"


def passphrase(given: str | None = None) -> str:
    """The argument, else the environment; there is no prompt."""
    found = given or os.environ.get(PASSPHRASE)
    if not found:
        raise ValueError(f"a passphrase is needed: pass one or set {PASSPHRASE}")
    return found


def derive(phrase: str, salt: bytes, iterations: int = ITERATIONS, length: int = 32) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", phrase.encode(), salt, iterations, length)


def _one(spark: SparkSession, data: bytes, expression) -> bytes | None:
    row = spark.createDataFrame([(bytearray(data),)], "x binary").select(expression.alias("y")).first()
    return None if row.y is None else bytes(row.y)


def wrap_key(spark: SparkSession, master: bytes, phrase: str, iterations: int = ITERATIONS) -> bytes:
    """magic, salt (16), iterations (4, big-endian), nonce (12), sealed master key."""
    salt = secrets.token_bytes(16)
    kek = derive(phrase, salt, iterations)
    return KEY_MAGIC + salt + iterations.to_bytes(4, "big") + _one(spark, master, F.aes_encrypt("x", F.lit(bytearray(kek)), F.lit("GCM")))


def unwrap_key(spark: SparkSession, wrapped: bytes, phrase: str) -> bytes:
    if len(wrapped) < 68 or wrapped[:4] != KEY_MAGIC:
        raise ValueError("no wrapped key")
    kek = derive(phrase, wrapped[4:20], int.from_bytes(wrapped[20:24], "big"))
    master = _one(spark, wrapped[24:], F.try_aes_decrypt("x", F.lit(bytearray(kek)), F.lit("GCM")))
    if master is None:
        raise ValueError("wrong passphrase, or the wrapped key was changed")
    return master


def new_master_key() -> bytes:
    return secrets.token_bytes(32)

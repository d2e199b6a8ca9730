"""Field encryption: authenticated AES in the JVM, marked by a prefix, mixed freely with plain rows.

The key is a parameter (32 characters of hex or any text, hashed to 256 bits); it is passed to Spark as a literal
that the plan redacts when printed, and never stored. Ciphertext differs each time, so it is never joined on.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "ENC:"
FIELDS = ("text", "window_title", "extra_context")
KEY_VARIABLE = "LUMENFRAME_KEY"


def key_from_environment() -> str | None:
    return os.environ.get(KEY_VARIABLE) or None


def is_available(key: str | None = None) -> bool:
    return bool(key or key_from_environment())


def new_key() -> str:
    return os.urandom(32).hex()


def export_key(key: str | None, path: str) -> None:
    """Writes the key to a file that only its owner may read, for another machine; an existing file isn't overwritten."""
    key = key or key_from_environment()
    if not key:
        raise ValueError("no key to export")
    handle = os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(key + "\n")


def import_key(path: str, environment: bool = True) -> str:
    """The key of an exported file; with ``environment`` this process uses it from now on. A blank file is refused."""
    with open(path, encoding="utf-8") as file:
        key = file.read().strip()
    if not key:
        raise ValueError("the file holds no key")
    if environment:
        os.environ[KEY_VARIABLE] = key
    return key


def _key(key: str) -> Column:
    return F.lit(bytearray(hashlib.sha256(key.encode()).digest()))


def is_encrypted(value: Column) -> Column:
    return value.startswith(PREFIX)


def encrypt(value: Column, key: str) -> Column:
    """Null, '' and what is encrypted already stay as they are."""
    cipher = F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value.cast("binary"), _key(key), F.lit("GCM"))))
    return F.when(value.isNull() | (value == "") | is_encrypted(value), value).otherwise(cipher)


def decrypt(value: Column, key: str) -> Column:
    """Plain values stay; what can't be decrypted with this key stays as it is too."""
    body = F.try_to_binary(F.substring(value, len(PREFIX) + 1, 1 << 30), F.lit("base64"))
    plain = F.try_aes_decrypt(body, _key(key), F.lit("GCM")).cast("string")
    return F.when(is_encrypted(value), F.coalesce(plain, value)).otherwise(value)


def encrypt_fields(frames: DataFrame, key: str) -> DataFrame:
    return frames.withColumns({c: encrypt(F.col(c), key) for c in FIELDS})


def decrypt_fields(frames: DataFrame, key: str) -> DataFrame:
    return frames.withColumns({c: decrypt(F.col(c), key) for c in FIELDS})

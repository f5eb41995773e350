"""Maps under a password: AES-256-GCM with a key from PBKDF2-HMAC-SHA256.

The file is JSON with format, version, kdf, iterations, salt, iv and ciphertext (with its tag), the
binary ones in Base64.  Encryption itself runs in the JVM; only key derivation needs Python.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT, KDF = "map-encrypted", "PBKDF2-SHA256"
ITERATIONS, LEAST, MOST = 600_000, 100_000, 5_000_000


def derive_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", unicodedata.normalize("NFC", password).encode(), salt, iterations, 32)


def _keys(password: str):
    @F.pandas_udf("binary")
    def keys(salts: pd.Series, iterations: pd.Series) -> pd.Series:
        # a crafted iteration count must not keep a worker busy
        return pd.Series([derive_key(password, bytes(s), int(n)) if s is not None and LEAST <= (n or 0) <= MOST else None for s, n in zip(salts, iterations)])

    return keys


def encrypt_maps(rows: DataFrame, password: str, *, json_col: str = "json", salt: Column | None = None, iv: Column | None = None, iterations: int = ITERATIONS) -> DataFrame:
    """Adds ``encrypted``; salt (16 bytes) and iv (12 bytes) are random unless given, as tests do."""
    random = lambda n: F.unhex(F.substr(F.replace(F.concat(F.expr("uuid()"), F.expr("uuid()")), F.lit("-"), F.lit("")), F.lit(1), F.lit(2 * n)))
    rows = rows.withColumns({"salt__": salt if salt is not None else random(16), "iv__": iv if iv is not None else random(12)})
    rows = rows.withColumn("key__", _keys(password)("salt__", F.lit(iterations)))
    # the cipher puts the iv in front of ciphertext and tag
    sealed = F.aes_encrypt(F.col(json_col).cast("binary"), F.col("key__"), F.lit("GCM"), F.lit("DEFAULT"), F.col("iv__"))
    body = F.expr("substring(sealed__, 13, length(sealed__) - 12)")
    rows = rows.withColumn("sealed__", sealed)
    file = F.struct(F.lit(FORMAT).alias("format"), F.lit(1).alias("version"), F.lit(KDF).alias("kdf"), F.lit(iterations).alias("iterations"), F.base64("salt__").alias("salt"), F.base64("iv__").alias("iv"), F.base64(body).alias("ciphertext"))
    return rows.withColumn("encrypted", F.to_json(file)).drop("salt__", "iv__", "key__", "sealed__")


def is_encrypted(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.format") == FORMAT, F.lit(False))


def decrypt_maps(rows: DataFrame, password: str, *, encrypted_col: str = "encrypted") -> DataFrame:
    """Adds ``decrypted``; null for a wrong password, a damaged file or an unreasonable iteration count, alike."""
    file = F.from_json(encrypted_col, "format string, kdf string, iterations bigint, salt string, iv string, ciphertext string")
    rows = rows.withColumn("f__", file).withColumn("key__", F.when((F.col("f__.format") == FORMAT) & (F.col("f__.kdf") == KDF), _keys(password)(F.unbase64("f__.salt"), "f__.iterations")))
    plain = F.try_aes_decrypt(F.concat(F.unbase64("f__.iv"), F.unbase64("f__.ciphertext")), F.col("key__"), F.lit("GCM"), F.lit("DEFAULT"))
    return rows.withColumn("decrypted", plain.cast("string")).drop("f__", "key__")

"""Encrypted change lines: ``hex(iv):hex(aes_cbc(gzip(text)))``.

AES runs in Spark; only gzip needs Python, in Arrow batches. Keys reach the
executors as the result of a one-row subquery. A literal key would be printed
in the optimised plan.
"""

from __future__ import annotations

import base64
import gzip
import os
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IV_BYTES = 16
GZIP_HEAD = "1F8B08"  # fixed value: how gzip data begins


def key_column(spark: SparkSession, keys: list[str]) -> Column:
    """All base64 keys as one array column, in the order to try them."""
    row = ([bytearray(base64.b64decode(k)) for k in keys],)
    return spark.createDataFrame([row], "keys array<binary>").scalar()


def _gzip_udf():
    """A new IV followed by the gzipped text.

    Built in a function, so that it travels whole and workers need no package. The IV
    is drawn here, not by ``aes_encrypt``: Spark may compute that once per use of the
    line, each time with another IV, but runs a nondeterministic function only once.
    """
    iv_bytes = IV_BYTES

    def compress(text: pd.Series) -> pd.Series:
        return text.map(
            lambda t: None if t is None else os.urandom(iv_bytes) + gzip.compress(t.encode(), mtime=0)
        )

    return F.pandas_udf(compress, T.BinaryType()).asNondeterministic()


def _gunzip_udf():
    """Text of the first candidate that is whole gzip data.

    A wrong key can leave valid padding by chance, so this is the real test. Spark
    is told not to repeat it, else a later filter would decrypt every line twice.
    """

    def first_text(candidates) -> str | None:
        for data in candidates:
            if data is None:
                continue
            try:
                return gzip.decompress(data).decode()
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                continue
        return None

    def decompress(candidates: pd.Series) -> pd.Series:
        return candidates.map(first_text)

    return F.pandas_udf(decompress, T.StringType()).asNondeterministic()


def encrypt_lines(
    df: DataFrame, keys: list[str], text: str, out: str = "value", use: int = 0
) -> DataFrame:
    """Replace a text column by its encrypted line, under key number ``use``."""
    key = F.get(key_column(df.sparkSession, keys), F.lit(use))
    packed = df.withColumn("_packed", _gzip_udf()(F.col(text)))
    iv, data = F.substring("_packed", 1, IV_BYTES), F.expr(f"substring(_packed, {IV_BYTES + 1})")
    sealed = F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv)
    line = F.regexp_replace(F.lower(F.hex(sealed)), f"^(.{{{2 * IV_BYTES}}})", "$1:")
    return packed.withColumn(out, line).drop("_packed", *([text] if text != out else []))


def decrypt_lines(
    df: DataFrame, keys: list[str], line: str = "value", out: str = "text"
) -> DataFrame:
    """Add the plain text of each line; null when no key fits it."""
    all_keys = key_column(df.sparkSession, keys)
    digits = 2 * IV_BYTES
    # One colon behind the IV, whole bytes; any other character makes unhex give null.
    well_formed = (F.instr(line, ":") == digits + 1) & (F.length(line) % 2 == 1)
    joined = F.concat(F.substring(line, 1, digits), F.substr(F.col(line), F.lit(digits + 2)))
    sealed = F.when(well_formed, F.unhex(joined))
    opened = df.withColumn("_opened", F.array(*[
        F.try_aes_decrypt(sealed, F.get(all_keys, F.lit(i)), F.lit("CBC"), F.lit("PKCS"))
        for i in range(len(keys))
    ]))
    # Only what begins like gzip data travels to Python: one candidate, nearly always.
    likely = F.filter("_opened", lambda c: F.hex(F.substring(c, 1, 3)) == GZIP_HEAD)
    return opened.withColumn(out, _gunzip_udf()(likely)).drop("_opened")

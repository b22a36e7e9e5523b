"""Encrypted change lines as typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.crypto import decrypt_lines
from leadflow.functions.records import coerce_record, drop_zero_dates
from leadflow.functions.timestamps import stamp
from leadflow.schemas import struct_type
from leadflow.sources.json_records import decode_json, strict


def check_on_error(on_error: str, quarantine: str | None = None) -> None:
    if on_error not in ("fail", "quarantine"):
        raise ValueError(f"on_error must be fail or quarantine, not {on_error}")
    if on_error == "quarantine" and not quarantine:
        raise ValueError("name the quarantine table")


def cdc_records(
    lines: DataFrame,
    keys: Sequence[str],
    schema: str | T.StructType,
    on_error: str = "fail",
    now=None,
) -> DataFrame:
    """Encrypted lines as typed, stamped records; the same for batch and stream.

    With ``on_error="quarantine"`` bad lines stay, with ``_line`` and ``_error`` set.
    """
    check_on_error(on_error, "any")
    target = struct_type(schema)
    decoded = decode_json(decrypt_lines(lines, list(keys)), target)
    if on_error == "fail":
        records = stamp(strict(decoded).select("_record.*"), now=now)
        return drop_zero_dates(coerce_record(records, target, on_bad="fail")).select(*target.names)
    records = stamp(
        decoded.select("_record.*", F.col("value").alias("_line"), "_error"), now=now
    )
    typed = drop_zero_dates(coerce_record(records, target))
    unread = F.when(
        F.size("_bad_fields") > 0,
        F.concat(F.lit("unreadable "), F.array_join("_bad_fields", ", ")),
    )
    return typed.withColumn("_error", F.coalesce("_error", unread)).select(
        *target.names, "_line", "_error"
    )

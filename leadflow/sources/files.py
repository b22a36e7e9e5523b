"""Text files by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _glob(prefix: str) -> str:
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", prefix) + "*"


def text_lines(reader, path: str, prefix: str = "", contains: str = "") -> DataFrame:
    """Lines of the files whose name starts with, and contains, the given texts.

    ``reader`` is ``spark.read`` or ``spark.readStream``. The name filter is on
    file metadata, so other files are listed but never opened.
    """
    lines = reader.option("pathGlobFilter", _glob(prefix)).text(path)
    if contains:
        lines = lines.filter(F.contains(F.col("_metadata.file_name"), F.lit(contains)))
    return lines.select("value")


def list_files(spark: SparkSession, path: str, prefix: str = "", contains: str = "") -> DataFrame:
    """One row per matching file, without reading the contents."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _glob(prefix))
        .load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )
    return files.filter(F.contains("file_name", F.lit(contains)))

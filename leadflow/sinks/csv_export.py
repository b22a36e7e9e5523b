"""Gzipped CSV per client, and where each uploaded file goes afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.records import stringify_times
from leadflow.sinks.tables import counted

# The file format. Every field and header is quoted, a quote is
# escaped by a backslash, a lone backslash stays, null is printed as None.
FORMAT = {
    "header": True,
    "quoteAll": True,
    "escape": "\\",
    "charToEscapeQuoteEscaping": "\0",
    "nullValue": "None",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
MAX_RECORDS_PER_FILE = 1_000_000


def float_text(value: Column) -> Column:
    """Shortest text of a double; plain digits from 0.0001 up to 1e16."""
    size = F.abs(value)
    text = value.cast("string")
    digits = F.regexp_replace(text.cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    power = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(\d)", "e+$1")
    power = F.regexp_replace(F.regexp_replace(power, r"E-(\d)$", "e-0$1"), "E-", "e-")
    return (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size >= 1e7) & (size < 1e16), digits)
        .when((size >= 1e-4) & (size < 1e-3), digits)
        .when((size >= 1e16) | ((size > 0) & (size < 1e-4)), power)
        .otherwise(text)
    )


def _printable(df: DataFrame) -> DataFrame:
    changed = {}
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.BooleanType):
            changed[field.name] = F.initcap(column.cast("string"))
        elif isinstance(field.dataType, T.DoubleType):
            changed[field.name] = float_text(column)
    return stringify_times(df.withColumns(changed) if changed else df)


def export_csv(
    df: DataFrame, path: str, key: str = "client", max_records: int = MAX_RECORDS_PER_FILE, run: str | None = None
) -> Observation:
    """One folder of CSV files per client; returns the row count's Observation.

    Rows are brought together by client with a rebalance, which splits a client
    that is too big for one task and merges the small ones. A big client so gets
    several files, each with a header.

    With ``run``, a column, each of its values gets a folder of its own with all clients in it. Other runs in
    ``path`` stay; only folders of the same value are replaced.
    """
    by = [key] if run is None else [run, key]
    rows, seen = counted(_printable(df).hint("rebalance", *by))
    writer = rows.write.partitionBy(*by).options(
        **FORMAT, maxRecordsPerFile=max_records, compression="gzip"
    )
    if run is not None:
        # each write has a staging folder of its own, so several can write below one path
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.csv(path)
    return seen


def read_export(spark, path: str, columns: list[str], key: str = "client") -> DataFrame:
    """Read an export back as text; the client comes from the folder name.

    ``None`` and the empty text are both read as written: null and "".
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*columns, key]])
    rows = spark.read.schema(schema).options(**FORMAT, multiLine=True).csv(path)
    # A folder of several exports adds its own partition column.
    return rows.select(*schema.names)


def route_uploads(results: DataFrame) -> DataFrame:
    """Add ``route`` to upload results (``name, code, body``): processed or failed.

    An upload counts only with code 200 and a ``file`` in the answer.
    """
    accepted = F.get_json_object("body", "$.file")
    done = (F.col("code") == 200) & accepted.isNotNull()
    return results.withColumns({
        "accepted_file": F.when(done, accepted),
        "route": F.when(F.coalesce(done, F.lit(False)), "processed").otherwise("failed"),
    })


def move_files(moves: DataFrame, partitions: int) -> None:
    """Move each file from ``path`` to ``target``, ``partitions`` at a time, on the executors.

    A file that is at its target already, as after a repeated task, stays there.
    """

    def run(batches):  # a nested function travels whole to the workers
        import re

        from pyarrow import fs

        def place(name: str):
            # Only the store is told by its URI: Spark leaves blanks in paths as they are.
            scheme, host, path = re.match(r"^(?:(\w+):(?://([^/]*))?)?(.*)$", name, re.S).groups()
            if scheme in (None, "file"):
                return fs.LocalFileSystem(), path
            files, base = fs.FileSystem.from_uri(f"{scheme}://{host or ''}/")
            return files, base.rstrip("/") + path

        for batch in batches:
            for path, target in zip(batch["path"], batch["target"]):
                (files, source), (_, there) = place(path), place(target)
                before, after = (f.type for f in files.get_file_info([source, there]))
                if before == fs.FileType.NotFound and after == fs.FileType.File:
                    continue
                files.create_dir(there.rsplit("/", 1)[0], recursive=True)
                files.move(source, there)
            yield batch[["target"]]

    spread = moves.repartition(partitions, "path")
    spread.mapInPandas(run, "target string").write.format("noop").mode("overwrite").save()

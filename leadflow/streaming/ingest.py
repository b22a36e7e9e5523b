"""Arriving files: change lines to the lake, leads to scores.

Which files were consumed is kept in the stream's checkpoint, so a repeated run takes
only new files. The change ingest of the batch job is the same stream, run until it has
nothing left.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadflow.functions.timestamps import pinned
from leadflow.operators.scoring import FEATURES, Predictor, lead_scores
from leadflow.schemas import struct_type
from leadflow.sinks.state import scratch
from leadflow.sinks.tables import counted, fit
from leadflow.sources.changes import cdc_records, check_on_error
from leadflow.sources.files import text_lines

LOAD = "load"  # partition column of the lake: which batch of which ingest a row came with
OWNERS = "_loads"  # folder of the lake, not read with it: the checkpoint behind each name


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id that a stream's checkpoint has from its first start on; None before."""
    try:
        lines = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").collect()  # one line
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    return json.loads(lines[0].value)["id"] if lines else None


def _owners(spark: SparkSession, lake: str, name: str) -> set[str]:
    """The checkpoints that load into a lake under a name."""
    folder = f"{lake.rstrip('/')}/{OWNERS}/{name}"
    # Makes an empty list the first time, else does nothing.
    spark.createDataFrame([], "value string").write.mode("ignore").text(folder)
    return {r.value for r in spark.read.text(folder).collect()}


def claim_name(spark: SparkSession, lake: str, name: str, own: str | None, keep: bool = False) -> None:
    """End the job where another checkpoint loads into the lake under this name; ``keep`` makes the name this one's.

    Of two that begin at once, at least one finds the other.
    """
    if keep and own not in _owners(spark, lake, name):
        line = spark.createDataFrame([(own,)], "value string").coalesce(1)
        line.write.mode("append").text(f"{lake.rstrip('/')}/{OWNERS}/{name}")
    others = _owners(spark, lake, name) - {own}
    if others:
        raise ValueError(
            f"another checkpoint loads into {lake} as {name}: its batches would be overwritten. Give each "
            "checkpoint a name of its own, or none"
        )


def stream_cdc(
    spark: SparkSession,
    source: str,
    lake: str,
    checkpoint: str,
    keys: Sequence[str],
    schema: str | T.StructType,
    prefix: str = "",
    contains: str = "",
    archive: str | None = None,
    files_per_batch: int = 1_000,
    on_error: str = "fail",
    quarantine: str | None = None,
    available_now: bool = True,
    now=None,
    name: str | None = None,
    loaded: list[tuple[int, int]] | None = None,
) -> StreamingQuery:
    """Start the ingest of new files. Bad lines end it, or go to ``quarantine``.

    Each batch is a partition of the lake, named after the ingest and the batch's number. A batch that is
    repeated after a failure overwrites its own partition, so no row counts twice. An ingest is
    known by its checkpoint's own id, so any number of them share a lake; a ``name`` may stand for that id,
    and then is this checkpoint's alone: another one that uses it ends with an error. Lines are
    decoded once, also when some go aside. ``loaded`` collects rows and rejected lines by batch.

    ``archive`` moves consumed files aside for tidiness only, at some later time.
    """
    check_on_error(on_error, quarantine)
    target = struct_type(schema)
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = text_lines(reader, source, prefix, contains)
    if name is not None:
        claim_name(spark, lake, name, checkpoint_id(spark, checkpoint))
    known: list[str] = []

    def ingest() -> str:
        """How this ingest's batches are named; its id is there by its first batch."""
        if not known:
            own = checkpoint_id(spark, checkpoint)
            if name is not None:
                claim_name(spark, lake, name, own, keep=True)
            known.append(name or own)
        return known[0]

    def put(rows: DataFrame, folder: str, number: int) -> int:
        made, seen = counted(rows)
        made.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{LOAD}={ingest()}-{number}")
        return seen.get["n"]

    def write(batch: DataFrame, number: int) -> None:
        records = cdc_records(batch, keys, target, on_error, pinned(now))
        if on_error == "fail":
            rows, bad = put(fit(records, target), lake, number), 0
        else:
            with scratch(records, "decoded") as made:
                good = made.filter(F.col("_error").isNull()).drop("_line", "_error")
                aside = made.filter(F.col("_error").isNotNull()).select("_line", "_error")
                rows, bad = put(fit(good, target), lake, number), put(aside, quarantine, number)
        if loaded is not None:
            loaded.append((rows, bad))

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_scores(
    spark: SparkSession,
    source: str,
    schema: str | T.StructType,
    out: str,
    checkpoint: str,
    predictor: Predictor,
    features: Sequence[str] = FEATURES,
    available_now: bool = True,
) -> StreamingQuery:
    """Score leads as their parquet files arrive. The folder ``out`` is this stream's alone."""
    leads = spark.readStream.schema(struct_type(schema)).parquet(source)
    writer = lead_scores(leads, predictor, features).writeStream.format("parquet").outputMode(
        "append"
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)

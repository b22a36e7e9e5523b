"""Status history of uploaded files: open and closed rows, changed as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions.timestamps import hours_before, ntz, utc_now
from leadflow.operators.latest import latest_per_key
from leadflow.schemas import table_schema
from leadflow.sinks.tables import fit

RUNNING_HOURS = 24


def running_files(history: DataFrame, now=None, hours: int = RUNNING_HOURS) -> DataFrame:
    """Files whose open row is running and not older than ``hours`` hour marks."""
    recent = F.col("start_date") >= hours_before(utc_now(now), hours)
    is_open = (F.col("status") == "running") & F.col("end_date").isNull()
    return history.filter(is_open & recent).select("client", "file", "src_table", "start_date")


def open_rows(files: DataFrame, now=None, status: str = "running") -> DataFrame:
    """New open rows for files (``client, file, src_table``)."""
    rows = files.select("client", "file", "src_table").withColumns({
        "status": F.lit(status), "start_date": utc_now(now),
    })
    return fit(rows, table_schema("data_source_status"))


def change_status(history: DataFrame, changes: DataFrame, now=None) -> DataFrame:
    """The history after changes (``client, file, src_table, new_status``).

    A change closes every open running row of its file and adds one row with the
    new status in lower case, both with the same time.
    """
    time = utc_now(now)
    changed_files = changes.select("file").distinct().withColumn("_changed", F.lit(True))
    ends = F.col("_changed") & (F.col("status") == "running") & F.col("end_date").isNull()
    closed = (
        history.join(changed_files, "file", "left")
        .withColumn("end_date", F.when(ends, time).otherwise(F.col("end_date")))
        .select(*history.columns)
    )
    added = changes.select(
        "client", "file", "src_table",
        F.lower("new_status").alias("status"),
        time.alias("start_date"),
        ntz(F.lit(None)).cast("timestamp_ntz").alias("end_date"),
    )
    return closed.unionByName(added.select(*history.columns))


def one_answer(answers: DataFrame, file: str = "file", time: str = "answered_at") -> DataFrame:
    """One answer per file: the latest where answers have a time.

    Without times, equal answers count once, and different ones for a file end the job.
    """
    rest = [c for c in answers.columns if c not in (file, time)]
    if time in answers.columns:
        return latest_per_key(answers, [file], time, rest).drop(time)
    whole = F.struct(*rest)
    both = answers.groupBy(file).agg(F.min(whole).alias("_a"), F.max(whole).alias("_b"))
    differ = F.raise_error(F.concat(F.lit("different answers for "), F.col(file)))
    same = F.col("_a").eqNullSafe(F.col("_b"))
    answer = F.when(same, F.col("_a")).otherwise(differ.cast(both.schema["_a"].dataType))
    return both.withColumn("_a", answer).select(file, "_a.*")


def import_gate(running: DataFrame, reported: DataFrame) -> DataFrame:
    """Running files with the reported status, ``UNKNOWN`` where none is, and what
    follows from it: import the file's entities, change its status.

    Each file has one row, however often its status was reported (``one_answer``).
    """
    known = [c for c in ("file", "status", "answered_at") if c in reported.columns]
    latest = one_answer(reported.select(*known)).withColumnRenamed("status", "new_status")
    status = F.coalesce("new_status", F.lit("UNKNOWN"))
    return running.join(latest, "file", "left").withColumns({
        "new_status": status,
        "imports": status == "SUCCEEDED",
        "changes": status != "RUNNING",
    })

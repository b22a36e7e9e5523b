"""Status history of files as events: a change adds its own rows, intervals follow from the events' order.

Events come in the order in which they were added (``seq``), which need not be that of their times.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadflow.functions.timestamps import hours_before, ntz, utc_now
from leadflow.operators.latest import latest_per_key
from leadflow.operators.status import RUNNING_HOURS, change_status, running_files
from leadflow.schemas import table_schema
from leadflow.sinks.keyed import KeyedTable
from leadflow.sinks.state import StateTable
from leadflow.sinks.tables import fit

EVENTS = (
    "client string, file string, src_table string, status string, at timestamp_ntz, until timestamp_ntz, "
    "change boolean, seq bigint"
)


def opened(history: DataFrame) -> DataFrame:
    """Events of history rows: each begins at its start; a row that has an end keeps it."""
    rows = fit(history, table_schema("data_source_status")).withColumnsRenamed({"start_date": "at", "end_date": "until"})
    return rows.withColumn("change", F.lit(False))


def changed(changes: DataFrame, now=None) -> DataFrame:
    """Events of changes (``client, file, src_table, new_status``)."""
    return changes.select(
        "client", "file", "src_table", F.lower("new_status").alias("status"), utc_now(now).alias("at"),
        ntz(F.lit(None)).cast("timestamp_ntz").alias("until"), F.lit(True).alias("change"),
    )


def intervals(events: DataFrame) -> DataFrame:
    """The history that events make: an open running row ends at the next change of its file, all others as they say."""
    # from the last event of a file backwards, so that a row's frame only grows
    later = Window.partitionBy("file").orderBy(F.desc("seq")).rangeBetween(Window.unboundedPreceding, -1)
    next_change = F.max_by(F.when(F.col("change"), F.col("at")), F.when(F.col("change"), -F.col("seq"))).over(later)
    runs = (F.col("status") == "running") & F.col("until").isNull()
    end = F.when(runs, next_change).otherwise(F.col("until"))
    return events.withColumn("_end", end).select(
        "client", "file", "src_table", "status", F.col("at").alias("start_date"), F.col("_end").alias("end_date")
    )


def as_of(events: DataFrame, time: str | dt.datetime) -> DataFrame:
    """The history as it stood at a time: what came later had not begun, and had ended nothing."""
    known = F.when(F.col("until") <= ntz(time), F.col("until"))
    return intervals(events.filter(F.col("at") <= ntz(time)).withColumn("until", known))


def current(events: DataFrame) -> DataFrame:
    """The last event of each file; of several that came together the one with the latest time."""
    last = latest_per_key(events, ["file"], "seq", ["at", "status", "client", "src_table"])
    return last.select("client", "file", "src_table", "status", F.col("at").alias("since"), "until")


class StatusLog:
    """A status history that only grows. Small commits are merged into a new base by and by (``KeyedTable``)."""

    def __init__(self, spark: SparkSession, path: str, **options):
        self.table = KeyedTable(spark, path, EVENTS, ["file"], **options)

    @property
    def events(self) -> DataFrame:
        return self.table.read()

    def read(self) -> DataFrame:
        return intervals(self.events)

    def _add(self, events: DataFrame) -> int:
        return self.table.append(events.withColumn("seq", F.lit(self.table.next_number()).cast("bigint")))

    def append(self, history: DataFrame) -> int:
        return self._add(opened(history))

    def change(self, changes: DataFrame, now=None) -> int:
        """Add one event for each change; nothing else is written."""
        return self._add(changed(changes, now))

    def running(self, now=None, hours: int = RUNNING_HOURS) -> DataFrame:
        """``running_files`` of the history, from what can matter: recent open running rows, and changes."""
        recent = (F.col("at") >= hours_before(utc_now(now), hours)) & (F.col("status") == "running") & F.col("until").isNull()
        return running_files(intervals(self.events.filter(recent | F.col("change"))), now, hours)


def running(status: StateTable | StatusLog, now=None, hours: int = RUNNING_HOURS) -> DataFrame:
    """The running files of a status table of either make."""
    return status.running(now, hours) if isinstance(status, StatusLog) else running_files(status.read(), now, hours)


def change(status: StateTable | StatusLog, changes: DataFrame, now=None) -> None:
    """Change files in a status table of either make."""
    if isinstance(status, StatusLog):
        status.change(changes, now)
    else:
        status.update(changes, lambda history: change_status(history, changes, now))

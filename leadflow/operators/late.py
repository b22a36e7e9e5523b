"""The late lane of an export: rows that arrive below a committed checkpoint, delivered once."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.timestamps import ntz
from leadflow.operators.window import TIME, late_rows

DAY = "day"


class ExportRecord:
    """Which rows were exported: their ids by table and by day of their time. It is only added to.

    ``ids`` name a row. Rows of the same id and time are one row to it.
    """

    def __init__(self, spark: SparkSession, path: str, schema, ids: Sequence[str]):
        self.spark, self.path, self.ids = spark, path.rstrip("/"), list(ids)
        named = [f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in [*ids, TIME]]
        self._stored = f"{', '.join(named)}, src_table string, {DAY} date"
        spark.createDataFrame([], self._stored).write.mode("ignore").partitionBy("src_table", DAY).parquet(self.path)

    def _keyed(self, df: DataFrame, table: str) -> DataFrame:
        return df.select(*self.ids, TIME, F.lit(table).alias("src_table"), F.col(TIME).cast("date").alias(DAY))

    def add(self, rows: DataFrame, table: str) -> None:
        # one file a day at most from each task's part of it, instead of a file for each task and day
        keyed = self._keyed(rows, table).repartition("src_table", DAY, F.pmod(F.xxhash64(*self.ids), F.lit(16)))
        keyed.write.mode("append").partitionBy("src_table", DAY).parquet(self.path)

    def missing(self, source: DataFrame, table: str, until: dt.datetime, since: str | dt.datetime | None = None) -> DataFrame:
        """Rows of the source before ``until``, from ``since`` on, that were never exported.

        Only the record's days from ``since`` on are read. Both sides meet by their ids and times, so
        one time that very many rows have doesn't gather them in one task.
        """
        rows = late_rows(source, until)
        recorded = self.spark.read.schema(self._stored).parquet(self.path).filter(F.col("src_table") == table)
        if since is not None:
            rows = rows.filter(F.col(TIME) >= ntz(since))
            recorded = recorded.filter(F.col(DAY) >= ntz(since).cast("date"))
        return rows.join(recorded, self._same(rows, recorded), "left_anti")

    def _same(self, a: DataFrame, b: DataFrame) -> list[Column]:
        return [a[c].eqNullSafe(b[c]) for c in [*self.ids, TIME]]

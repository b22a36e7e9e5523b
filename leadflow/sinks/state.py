"""State tables: parquet folders that jobs read, add to, and change a few partitions at a time.

Rows are dealt into partitions by the hash of their keys, so that a row never moves. A change
reads only the partitions of the rows that it is about, writes their new content in full to
a scratch folder, and then puts it in their place with a dynamic partition overwrite. Until that
last step, which only copies, the old rows are in force. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.schemas import struct_type
from leadflow.session import shared_folder
from leadflow.sinks.tables import upsert

PART = "_part"


@contextmanager
def scratch(
    df: DataFrame, name: str, work: str | None = None, partition_by: Sequence[str] = ()
) -> Iterator[DataFrame]:
    """The frame as a table below ``work`` or the shared folder, emptied afterwards.

    For results that are used several times and must be made once. Each use has a folder of its own, so jobs
    that run at once can share a work folder.
    """
    spark = df.sparkSession
    path = f"{work.rstrip('/')}/{name}-{uuid.uuid4().hex}" if work else shared_folder(spark, name)
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
    df.write.mode("overwrite").parquet(path, partitionBy=[*partition_by] or None)
    try:
        yield spark.read.schema(plain).parquet(path)
    finally:
        spark.createDataFrame([], plain).write.mode("overwrite").parquet(path)


class StateTable:
    """``parts`` is the number of partitions; it must stay the same for the table's whole life."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str],
        parts: int = 16,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.parts = parts
        # Parquet keeps no "not null", so a frame read back could not be written again.
        self.schema = T.StructType([
            T.StructField(f.name, f.dataType) for f in struct_type(schema)
        ])
        self._stored = T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])
        # Makes an empty table the first time, else does nothing.
        spark.createDataFrame([], self._stored).write.mode("ignore").partitionBy(PART).parquet(self.path)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.to(self.schema).withColumn(PART, self._part())

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self._stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop(PART)

    def append(self, df: DataFrame) -> None:
        self._dealt(df).write.mode("append").partitionBy(PART).parquet(self.path)

    def update(self, about: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the partitions that the keys of ``about`` fall into by ``change`` of their rows.

        ``change`` sees all rows of those partitions; it may add and alter rows, but not
        leave a partition without any.
        """
        found = about.select(self._part().alias(PART)).distinct().collect()  # at most ``parts`` numbers
        if not found:
            return
        old = self._all().filter(F.col(PART).isin([r[PART] for r in found])).drop(PART)
        with scratch(self._dealt(change(old)), "state-update") as new:
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                PART
            ).parquet(self.path)

    def merge(self, rows: DataFrame) -> None:
        """Put rows, one per key, in the place of those with the same keys."""
        with scratch(rows.to(self.schema), "state-merge") as made:
            self.update(made, lambda old: upsert(old, made, self.keys))

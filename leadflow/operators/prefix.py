"""Running sums over a whole table in order, without one task that holds it.

Rows are dealt into ranges of their order, each range's total is one row on the driver, and the totals
before a range are what its own running sums start from.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.sinks.state import scratch

RANGE = "_range"
RANGE_ROWS = 4_000_000  # rows of a range, about


@contextmanager
def in_ranges(
    df: DataFrame, order: str, value: str, ranges: int | None = None, work: str | None = None
) -> Iterator[tuple[DataFrame, list[tuple[int, int]]]]:
    """The frame with its range in ``_range``, and total and start of each range's ``value``, in order.

    Equal values of ``order`` share a range. The dealt rows are a scratch table, so a repeated task finds
    the same ranges. By default there is a range for each ``RANGE_ROWS`` rows.
    """
    with scratch(df, "ordered", work) as rows:
        if ranges is None:
            ranges = max(1, -(-rows.count() // RANGE_ROWS))
        dealt = rows.repartitionByRange(ranges, order).withColumn(RANGE, F.spark_partition_id())
        with scratch(dealt, "ranges", work) as made:
            found = made.groupBy(RANGE).agg(F.sum(value).alias("n")).collect()  # a row for each range
            totals = {r[RANGE]: r.n for r in found}
            held = [totals.get(r, 0) for r in range(max(totals, default=-1) + 1)]
            yield made, list(zip(held, accumulate(held, initial=0)))


@contextmanager
def running_sums(
    df: DataFrame, order: str, value: str, ranges: int | None = None, work: str | None = None
) -> Iterator[DataFrame]:
    """The frame with the sum of ``value`` of all rows up to each row's in ``running``, rows that tie counting together."""
    with in_ranges(df, order, value, ranges, work) as (made, totals):
        spark = df.sparkSession
        starts = spark.createDataFrame([(r, str(start)) for r, (_, start) in enumerate(totals)], f"{RANGE} int, _start string")
        starts = starts.withColumn("_start", F.col("_start").cast(made.schema[value].dataType))
        # peers of the same order share the frame, as with any range frame
        inside = F.sum(value).over(Window.partitionBy(RANGE).orderBy(order))
        yield made.withColumn("_inside", inside).join(F.broadcast(starts), RANGE).select(
            *df.columns, (F.col("_start") + F.col("_inside")).alias("running")
        )

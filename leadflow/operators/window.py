"""Checkpointed windows over an ingestion time, for incremental export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.timestamps import EPOCH, next_checkpoint, ntz
from leadflow.operators.prefix import RANGE, in_ranges
from leadflow.schemas import EXPORT_COLUMNS
from leadflow.sinks.state import StateTable, scratch
from leadflow.sinks.tables import rows_frame

TIME = "ingestion_timestamp"
WINDOW = "_window"
BUCKETS = 4_096
MICROSECOND = dt.timedelta(microseconds=1)


@dataclass(frozen=True)
class ExportWindow:
    """One window; both ends belong to it."""

    job: str
    target: str
    first: dt.datetime
    last: dt.datetime | None

    @property
    def has_data(self) -> bool:
        return self.last is not None


def source_times(sources: Mapping[str, DataFrame], first: dt.datetime | str) -> DataFrame:
    """Times from ``first`` on with their table. Only several sources are united
    as a set; a single one keeps its repeated times."""
    parts = [
        df.filter(F.col(TIME) >= ntz(first)).select(TIME, F.lit(name).alias("tbl"))
        for name, df in sources.items()
    ]
    times = reduce(DataFrame.unionByName, parts)
    return times.distinct() if len(parts) > 1 else times


def time_counts(sources: Mapping[str, DataFrame], first: dt.datetime | str) -> DataFrame:
    """How many rows each time from ``first`` on has: all that cutting windows needs."""
    return source_times(sources, first).groupBy(TIME).agg(F.count(F.lit(1)).alias("n"))


def nth_time(counts: DataFrame, n: int | None = None) -> dt.datetime | None:
    """Greatest time of the first ``n`` rows, or of all when there are fewer or no bound.

    Found by counting, not by sorting: each pass splits the range into buckets,
    adds them up on the executors and keeps the bucket in which the n-th row lies.
    No task ever holds the n rows, and a later pass reads only its own range.
    """
    low, high, rows = counts.agg(F.min(TIME), F.max(TIME), F.sum("n")).first()
    if low is None or n is None or rows <= n:
        return high
    while low < high:
        inside = counts.filter(F.col(TIME).between(ntz(low), ntz(high)))
        width = max(1, -(-((high - low) // MICROSECOND + 1) // BUCKETS))
        # A difference of zone-free times, so no clock change can disturb the order.
        seconds = (F.col(TIME) - ntz(low)).cast("interval second").cast("decimal(24,6)")
        offset = (seconds * 1_000_000).cast("bigint")
        buckets = inside.groupBy(F.floor(offset / width).alias("b")).agg(
            F.sum("n").alias("n"), F.min(TIME).alias("low"), F.max(TIME).alias("high")
        )
        # One row per bucket, BUCKETS at most, reaches the driver.
        for bucket in sorted(buckets.collect(), key=lambda r: r.b):
            if n <= bucket.n:
                low, high = bucket.low, bucket.high
                break
            n -= bucket.n
    return high


def saved_checkpoint(checkpoints: DataFrame, job: str, target: str) -> dt.datetime:
    """Where a job stands: its greatest checkpoint. Checkpoints only ever move on, so
    they are added to their table and never changed."""
    saved = checkpoints.filter((F.col("dag_id") == job) & (F.col("src_table") == target))
    return saved.agg(F.max("checkpoint")).first()[0] or dt.datetime.fromisoformat(EPOCH)


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("dag_id", "src_table").agg(F.max("checkpoint").alias("checkpoint"))


def _steps(times: pa.Table, max_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The times of a range in order, the rows up to each, and after which time a window that begins behind it ends."""
    at = times.column(TIME).cast(pa.timestamp("us")).to_numpy().astype(np.int64)
    order = np.argsort(at, kind="stable")
    rows = np.cumsum(times.column("n").to_numpy()[order])
    return at[order], rows, np.searchsorted(rows, rows + max_rows)


def _left_open(times: pa.Table, max_rows: int) -> pa.Table:
    """For each time of a range that can be the first to end a window there: how many rows stand behind the last
    end. Jumps from end to end are doubled until all have arrived."""
    _, rows, after = _steps(times, max_rows)
    own = np.arange(len(rows))
    last = np.where(after < len(rows), np.minimum(after, len(rows) - 1), own)  # of each end, the next one there
    while (last[last] != last).any():
        last = last[last]
    left = rows[-1] - rows[last]
    first = np.concatenate([[0], rows[:-1]]) < max_rows
    return pa.table({
        RANGE: pa.array(times.column(RANGE).to_numpy()[:1].repeat(first.sum()), pa.int32()),
        "upto": pa.array(rows[first], pa.int64()), "left": pa.array(left[first], pa.int64()),
    })


def _ends(times: pa.Table, max_rows: int, open_rows: int) -> pa.Table:
    """The last times of the windows that end in a range, ``open_rows`` rows before it being in an open one."""
    at, rows, after = _steps(times, max_rows)
    found, end = [], int(np.searchsorted(rows, max_rows - open_rows))
    while end < len(rows):
        found.append(at[end])
        end = int(after[end])
    return pa.table({"last": pa.array(np.array(found, np.int64), pa.timestamp("us"))})


def window_ends(
    counts: DataFrame, max_rows: int, ranges: int | None = None, work: str | None = None
) -> list[dt.datetime]:
    """The last time of every full window over the counted times, in order.

    Each window ends with the time of its ``max_rows``-th row, so where it ends depends on all before. The
    times are cut into ranges; each range works out, for all its possible first ends at once, how many
    rows it leaves open. The driver follows that from range to range, one look-up each, and then all ranges
    list their ends in one pass. The number of jobs depends on the number of ranges only.
    """
    with in_ranges(counts, TIME, "n", ranges, work) as (dealt, totals):
        opened = [0] * len(totals)
        if len(totals) > 1:
            left = dealt.groupBy(RANGE).applyInArrow(
                lambda t: _left_open(t, max_rows), f"{RANGE} int, upto bigint, left bigint"
            )
            with scratch(left, "left-open", work) as left:
                for r, (total, _) in enumerate(totals[:-1]):
                    if opened[r] + total < max_rows:
                        opened[r + 1] = opened[r] + total
                        continue
                    ends = left.filter((F.col(RANGE) == r) & (F.col("upto") >= max_rows - opened[r]))
                    opened[r + 1] = ends.agg(F.min_by("left", "upto")).first()[0]

        def listed(key: tuple, times: pa.Table) -> pa.Table:
            return _ends(times, max_rows, opened[key[0].as_py()])

        ends = dealt.groupBy(RANGE).applyInArrow(listed, "last timestamp_ntz")
        return sorted(r["last"] for r in ends.collect())  # one row a window


def cut_windows(
    checkpoints: DataFrame,
    job: str,
    target: str,
    sources: Mapping[str, DataFrame],
    max_rows: int | None = None,
    work: str | None = None,
) -> Iterator[ExportWindow]:
    """All windows behind a job's checkpoint, each over at most ``max_rows`` rows and ties.

    The sources are read once, to count the rows of each time. All windows are cut from
    those counts together, however many there are. The last one has no data.
    """
    first = saved_checkpoint(checkpoints, job, target)
    with scratch(time_counts(sources, first), "window-counts", work) as counts:
        newest = counts.agg(F.max(TIME)).first()[0]
        ends = window_ends(counts, max_rows, work=work) if max_rows and newest is not None else []
    if newest is not None and (not ends or ends[-1] < newest):
        ends.append(newest)
    for last in ends:
        yield ExportWindow(job, target, first, last)
        first = last + MICROSECOND
    yield ExportWindow(job, target, first, None)


def get_window(
    checkpoints: DataFrame,
    job: str,
    target: str,
    sources: Mapping[str, DataFrame],
    max_rows: int | None = None,
) -> ExportWindow:
    """The next window of a job. It alone is looked for, by counting in ever finer buckets."""
    first = saved_checkpoint(checkpoints, job, target)
    with scratch(time_counts(sources, first), "window-counts") as counts:
        return ExportWindow(job, target, first, nth_time(counts, max_rows))


def in_window(df: DataFrame, window: ExportWindow) -> DataFrame:
    """Rows of the window. Rows that tie with its last time all belong to it."""
    return df.filter(F.col(TIME).between(ntz(window.first), ntz(window.last)))


def _place(ends: np.ndarray) -> Column:
    """The number of the window that a time up to the last end lies in: one binary search a row."""

    @F.arrow_udf("int")
    def place(times: pa.Array) -> pa.Array:
        at = times.cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(ends, at), pa.int32())

    return place(F.col(TIME).cast("timestamp_ntz"))


def in_windows(df: DataFrame, windows: Sequence[ExportWindow]) -> DataFrame:
    """Rows of consecutive windows, with the number of each row's window, from 0 on, in ``_window``.

    All rows are placed in one pass. Only the ends of the windows go to the tasks.
    """
    if not windows:
        return df.filter(F.lit(False)).withColumn(WINDOW, F.lit(None).cast("int"))
    ends = np.array([w.last for w in windows], "datetime64[us]").astype(np.int64)
    span = ExportWindow(windows[0].job, windows[0].target, windows[0].first, windows[-1].last)
    return in_window(df, span).withColumn(WINDOW, _place(ends))


def export_columns(df: DataFrame, table: str, *also: str) -> DataFrame:
    if table not in EXPORT_COLUMNS:
        raise ValueError(f"no export columns for {table}")
    return df.select(*EXPORT_COLUMNS[table], *also)


def commit_window(checkpoints: StateTable, *windows: ExportWindow) -> bool:
    """Move the job's checkpoint just behind the window, or behind each of several. Call it after the sink.

    One row a window, those of a job and table in one file, so they are there or not.
    """
    rows = [
        {"dag_id": w.job, "src_table": w.target, "checkpoint": w.last} for w in windows if w.has_data
    ]
    if not rows:
        return False
    rows = rows_frame(checkpoints.spark, rows, checkpoints.schema).withColumn(
        "checkpoint", next_checkpoint(F.col("checkpoint"))
    )
    checkpoints.append(rows.coalesce(1))
    return True


def late_rows(arrivals: DataFrame, checkpoint) -> DataFrame:
    """Arrived rows that lie before a committed checkpoint, so are never exported."""
    return arrivals.filter(F.col(TIME) < ntz(checkpoint))

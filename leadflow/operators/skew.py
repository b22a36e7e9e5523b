"""Joins that stay spread when one key holds a large part of a side.

Adaptive execution can split a hot key only on the preserved side of an outer
join, and only directly above two shuffles. A chain of left joins has neither.
So a caller may look up the hot keys once (``hot_keys``) and hand them to each join.
Rows of all other keys are joined plainly. Rows of a hot key are dealt into parts on
its hot side and copied once per part on the other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.session import shared_folder
from leadflow.sinks.tables import counted

HOT_ROWS = 1_000_000  # rows of one key that a single task should take at most
CHUNK = 1_000  # copies of a row that travel as one, at least


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, with their numbers ``n``; None without any.

    Counted exactly, each task first on its own, and written, so that several joins can use
    it. It has at most one row for every ``hot_rows`` rows of the frame and stays on the executors.
    """
    many = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found, seen = counted(many.filter(F.col("n") > hot_rows))
    path = shared_folder(df.sparkSession, "hot-keys")
    found.write.parquet(path)
    return df.sparkSession.read.schema(many.schema).parquet(path) if seen.get["n"] else None


def product(left: DataFrame | None, right: DataFrame | None, key: str) -> DataFrame | None:
    """Hot keys of a join's result; a key that is not hot on a side counts once there."""
    if left is None or right is None:
        return left if right is None else right
    both = left.withColumnRenamed("n", "_ln").join(right.withColumnRenamed("n", "_rn"), key, "full")
    one = F.lit(1)
    return both.select(key, (F.coalesce("_ln", one) * F.coalesce("_rn", one)).alias("n"))


def _columns(df: DataFrame) -> list[str]:
    """Columns to group and hash by; a map allows neither."""
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def _chunks(df: DataFrame) -> DataFrame:
    """Distinct rows with ``_n`` copies each, very many copies as several rows.

    Equal rows would all be dealt into one part. Counting them first leaves rows that differ.
    """
    one = F.lit(1).cast("bigint")
    if len(_columns(df)) < len(df.columns):
        return df.withColumns({"_c": F.lit(0).cast("bigint"), "_n": one})
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_all"))
    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt("_all")).cast("bigint"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("_all") / size) - 1)
    rows = rows.withColumn("_size", size).withColumn("_c", F.explode(numbers))
    left_over = F.col("_all") - F.col("_c") * F.col("_size")
    return rows.withColumn("_n", F.least("_size", left_over)).drop("_all", "_size")


def split_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    left_hot: DataFrame | None = None,
    right_hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner or left join on one key, with the given hot keys (``key, n``) split."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    if left_hot is None and right_hot is None:
        return left.join(right, key, how)
    spark = left.sparkSession
    none = spark.createDataFrame([], (left_hot if left_hot is not None else right_hot).schema)

    def parts(n: str) -> Column:
        return F.coalesce(F.ceil(F.col(n) / hot_rows), F.lit(1)).cast("int")

    plan = (
        (none if left_hot is None else left_hot).withColumnRenamed("n", "_ln")
        .join((none if right_hot is None else right_hot).withColumnRenamed("n", "_rn"), key, "full")
        .select(key, parts("_ln").alias("_lp"), parts("_rn").alias("_rp"))
        .filter("_lp > 1 or _rp > 1")
    )
    out = [*left.columns, *[c for c in right.columns if c != key]]
    rest = plan.select(key)
    cold = left.join(rest, key, "left_anti").join(right.join(rest, key, "left_anti"), key, how)

    def side(df: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        rows = _chunks(df.join(rest, key, "left_semi")).join(plan, key)
        # A fixed function of the row, so a retried task deals the same way.
        row_hash = F.xxhash64("_c", *[F.col(f"`{c}`") for c in _columns(df)])
        dealt = F.pmod(row_hash, F.col(own)).cast("int")
        copied = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.withColumn(own_part, dealt).withColumn(other_part, copied).drop("_c")

    a = side(left, "_lp", "_rp", "_l", "_r").drop("_lp")
    b = side(right, "_rp", "_lp", "_r", "_l").drop("_lp", "_rp")
    joined = a.join(b.withColumnRenamed("_n", "_m"), [key, "_l", "_r"], how)
    if how == "left":
        # A key cut on the right has rows there, so a copy that met none is void.
        joined = joined.filter(F.col("_m").isNotNull() | (F.col("_rp") == 1))
    repeats = F.col("_n") * F.coalesce("_m", F.lit(1))
    hot = joined.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), repeats)))
    return cold.select(*out).unionByName(hot.select(*out))

"""Appending to, replacing and upserting into tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.schemas import struct_type
from leadflow.session import shared_folder


def fit(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The frame in the order and types of a table; missing columns become null.

    Columns that the table lacks are an error and are never dropped silently.
    """
    schema = struct_type(schema)
    extra = [c for c in df.columns if c not in schema.names]
    if extra:
        raise ValueError(f"columns not in the table: {', '.join(extra)}")
    return df.to(schema)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame with a row count that is known after its write, without a second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str]):
    writer = df.write.mode(mode)
    return writer.partitionBy(*partition_by) if partition_by else writer


def _save(df: DataFrame, table: str, mode: str, partition_by: Sequence[str]) -> None:
    writer = _writer(df, mode, partition_by)
    if "/" in table:
        writer.parquet(table)
    else:
        writer.format("parquet").saveAsTable(table)


def append(
    df: DataFrame, table: str, schema: str | T.StructType, partition_by: Sequence[str] = ()
) -> int:
    """Append under the table's schema; returns the number of rows written."""
    rows, seen = counted(fit(df, schema))
    _save(rows, table, "append", partition_by)
    return seen.get["n"]


def replace(df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> None:
    """Make the query result the table's whole content.

    The result is first made in full in the shared folder. A query that fails leaves the
    old table as it is; only a copy takes its place.
    """
    path = shared_folder(df.sparkSession, "replace")
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _save(made, table, "overwrite", partition_by)
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def replace_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Replace a catalog table, laid out by key. Joins of tables with the same key
    and number of buckets then need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def rows_frame(
    spark: SparkSession, rows: Sequence[dict], schema: str | T.StructType
) -> DataFrame:
    """Literal rows by column name; absent values are null, unknown names an error."""
    schema = struct_type(schema)
    unknown = sorted({k for r in rows for k in r} - set(schema.names))
    if unknown:
        raise ValueError(f"columns not in the table: {', '.join(unknown)}")
    values = [tuple(r.get(n) for n in schema.names) for r in rows]
    return spark.createDataFrame(values, schema)


def one_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, ending the job at a key that has several."""
    rest = [c for c in rows.columns if c not in keys]
    grouped = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row")
    )
    named = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    several = F.raise_error(F.concat(F.lit("several rows for key "), named))
    row = F.when(F.col("_n") == 1, F.col("_row")).otherwise(several.cast(grouped.schema["_row"].dataType))
    return grouped.withColumn("_row", row).select(
        *[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in rows.columns]
    )


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows without a newer version, plus the new rows; two for a key end the job."""
    new = one_per_key(rows.select(*target.columns), keys)
    return target.join(rows.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(new)

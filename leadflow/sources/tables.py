"""Tables and queries as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a parquet folder when the name is a path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_source(
    spark: SparkSession,
    table: str | None = None,
    query: str | None = None,
    args: dict | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """A whole table, or a query with bound ``:values`` and ``{frame}`` names."""
    if table and query:
        raise ValueError("give a table or a query, not both")
    if not table and not query:
        raise ValueError("give a table or a query")
    if table:
        return load_table(spark, table)
    return spark.sql(query, args=args, **frames)


def query_file(spark: SparkSession, path: str, args: dict | None = None, **frames) -> DataFrame:
    """Run the query kept in a text file, with the same placeholders."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).take(1))
    return read_source(spark, query=text, args=args, **frames)


def destination_schema(spark: SparkSession, table: str) -> T.StructType:
    """Schema of the table to load into, fetched once while planning."""
    return load_table(spark, table).schema

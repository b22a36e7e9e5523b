"""Helpers that several operators share: tables cut from their lineage, and components of a graph."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.session import shared_folder


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_noted: list[list[tuple[str, DataFrame]]] = []  # by open ``emptied``: the tables written inside


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    if _noted:
        _noted[-1].append((path, made))
    return made


@contextmanager
def emptied(spark: SparkSession) -> Iterator[None]:
    """Empties, in the end, the tables that operators wrote for themselves inside. What they return reads those
    tables, so it must be stored inside too."""
    _noted.append([])
    try:
        yield
    finally:
        for path, made in _noted.pop():
            spark.createDataFrame([], made.schema).write.mode("overwrite").parquet(path)


def values(batch: pa.Array, step: int = 500) -> Iterator:
    """The values of an Arrow array, made a few at a time: a batch's texts don't stand in memory twice."""
    for at in range(0, len(batch), step):
        yield from batch.slice(at, step).to_pylist()


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of every node that ``edges`` (``u, v``) name; root is the smallest node it reaches.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller
    ones (large star, small star), so that chains shrink by a factor a round. Every round is
    a table in the shared folder; the driver only sees the count and the checksum of its edges.
    """
    edges = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(
            small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges"
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

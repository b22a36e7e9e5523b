"""Tables that are changed by adding: each change is a commit of its own rows, merged when the table is read.

A commit is a folder of rows sorted by key, and one line in the table's list of commits that makes it count. Its
rows are added to what is there, or take the place of all rows that earlier commits have for their key. A
base is a commit that holds all that counts; earlier ones are passed over. A change writes its own rows only, and
a reader sees whole commits: a new base is there with its line, not while it is copied. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.schemas import struct_type
from leadflow.sinks.tables import one_per_key

COMMIT = "_commit"
MARK = "_mark"
ADDED, PUT, GONE = 0, 1, 2  # beside earlier rows of the key; in their place; in their place, and no row itself
COMMITS = "number bigint, base boolean, n bigint, puts bigint, label string"
FEW_KEYS = 1_000  # of one column: asked for by value, so that files and row groups are passed over


class KeyedTable:
    """``share`` and ``commits``: a change that makes the rows since the last base more than that share of it, or
    the commits since more than that many, is followed by a new base."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str | T.StructType, keys: Sequence[str],
        share: float = 0.25, commits: int = 50,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.share, self.most_commits = share, commits
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in struct_type(schema)])
        own = [T.StructField(MARK, T.IntegerType()), T.StructField(COMMIT, T.LongType())]
        self._stored = T.StructType([*self.schema.fields, *own])
        spark.createDataFrame([], COMMITS).write.mode("ignore").parquet(f"{self.path}/commits")

    # The list of commits

    def _lines(self) -> DataFrame:
        return self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits")

    def commits(self) -> list:
        """The commits from the last base on; a new base ends the list before it."""
        lines = self._lines()
        base = lines.agg(F.coalesce(F.max(F.when(F.col("base"), F.col("number"))), F.lit(0)).alias("n")).first().n
        return sorted(lines.filter(F.col("number") >= base).collect(), key=lambda c: c.number)

    def next_number(self) -> int:
        """The number of the next commit; they only grow."""
        return (self._lines().agg(F.max("number")).first()[0] or 0) + 1

    def has(self, label: str | None) -> bool:
        """Whether a commit of this label counts or has counted."""
        return label is not None and not self._lines().filter(F.col("label") == label).isEmpty()

    # Reading

    def _folder(self, number: int) -> str:
        return f"{self.path}/rows/{COMMIT}={number}"

    def _rows(self, commits: Sequence) -> DataFrame:
        if not commits:
            return self.spark.createDataFrame([], self._stored)
        paths = [self._folder(c.number) for c in commits]
        return self.spark.read.schema(self._stored).option("basePath", f"{self.path}/rows").parquet(*paths)

    def _counting(self, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Rows in whose place no later commit has put others. Those that do so are since the last base, so few."""
        commits = self.commits()
        rows, puts = only(self._rows(commits)), [c for c in commits if c.puts]
        if puts:
            newest = only(self._rows(puts)).filter(F.col(MARK) != ADDED).groupBy(*self.keys).agg(
                F.max(COMMIT).alias("_put")
            )
            same = [rows[k].eqNullSafe(newest[k]) for k in self.keys]
            rows = rows.join(newest, [*same, newest["_put"] > rows[COMMIT]], "left_anti").filter(F.col(MARK) != GONE)
        return rows.drop(COMMIT, MARK)

    def read(self) -> DataFrame:
        """All rows that count."""
        return self._counting()

    def of_keys(self, about: DataFrame) -> DataFrame:
        """The rows that count of the keys of ``about``.

        A few keys are looked for by their values: a base's files are of different key ranges and have bloom
        filters, so only the row groups that can hold one are read.
        """
        keys = about.select(*self.keys).distinct()
        if len(self.keys) == 1:
            named = keys.limit(FEW_KEYS + 1).collect()
            if len(named) <= FEW_KEYS and all(r[0] is not None for r in named):
                values = [r[0] for r in named]
                return self._counting(lambda rows: rows.filter(F.col(self.keys[0]).isin(values)))

        def asked(rows: DataFrame) -> DataFrame:
            return rows.join(keys, [rows[k].eqNullSafe(keys[k]) for k in self.keys], "left_semi")

        return self._counting(asked)

    # Writing

    def _commit(self, rows: DataFrame, base: bool = False, label: str | None = None) -> int:
        """Write marked rows as the next commit. A folder of its number can only be of a commit that failed."""
        number = self.next_number()
        if base:  # a change's rows are made once, so only a base is dealt anew
            rows = rows.repartitionByRange(*self.keys)
        seen = Observation("commit")
        mark = F.col(MARK)
        counted = rows.sortWithinPartitions(*self.keys).observe(
            seen, F.count_if(mark != GONE).alias("n"), F.count_if(mark != ADDED).alias("puts")
        )
        writer = counted.write.mode("overwrite")
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", base)
        writer.parquet(self._folder(number))
        n = seen.get["n"]
        line = self.spark.createDataFrame([(number, base, n, seen.get["puts"], label)], COMMITS)
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return n

    def _marked(self, df: DataFrame, mark: int | Column) -> DataFrame:
        return df.to(self.schema).withColumn(MARK, F.lit(mark))

    def _gone(self, about: DataFrame) -> DataFrame:
        return self._marked(about.select(*self.keys).distinct(), GONE)

    def change(
        self, added: DataFrame | None = None, put: DataFrame | None = None, about: DataFrame | None = None,
        label: str | None = None,
    ) -> int:
        """Add rows, put others in the place of those of their keys, and end what is there of the keys of ``about``.

        All of it is one commit. A ``label`` names it: a change of a label that was there already does
        nothing, so a job that is repeated after a failure changes nothing twice. Returns the number of rows.
        """
        if self.has(label):
            return 0
        parts = [self._marked(df, mark) for df, mark in ((added, ADDED), (put, PUT)) if df is not None]
        if about is not None:
            parts.append(self._gone(about))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more)
        n = self._commit(rows, label=label)
        commits = self.commits()
        base = sum(c.n for c in commits if c.base)
        since = [c for c in commits if not c.base]
        if len(since) > self.most_commits or base and sum(c.n for c in since) > self.share * base:
            self.compact()
        return n

    def append(self, df: DataFrame, label: str | None = None) -> int:
        """Add rows; earlier ones of their keys stay."""
        return self.change(added=df, label=label)

    def merge(self, rows: DataFrame, label: str | None = None) -> int:
        """Put rows, one per key, in the place of those with the same keys; two for a key end the job."""
        return self.change(put=one_per_key(rows.to(self.schema), self.keys), label=label)

    def update(self, about: DataFrame, change: Callable[[DataFrame], DataFrame], label: str | None = None) -> int:
        """Put ``change`` of the rows of ``about``'s keys in their place; a key that it has no row for is gone."""
        return self.change(put=change(self.of_keys(about)), about=about, label=label)

    def replace(self, df: DataFrame, label: str | None = None) -> int:
        """Make rows the whole content. They are written once, and count from their line on; until then the old ones do."""
        return 0 if self.has(label) else self._base(df, label)

    def compact(self) -> int:
        """Write all that counts as a new base."""
        return self._base(self.read())

    def _base(self, df: DataFrame, label: str | None = None) -> int:
        """A reader that has begun goes on with the commits that it listed; those before the last base are emptied."""
        old = [c.number for c in self.commits()]
        n = self._commit(self._marked(df, ADDED), base=True, label=label)
        for number in range(1, min(old, default=1)):
            self._empty(number)
        return n

    def _empty(self, number: int) -> None:
        """Leave an old commit's folder without rows, if it has some."""
        try:
            gone = self.spark.read.schema(self.schema).parquet(self._folder(number)).isEmpty()
        except AnalysisException:
            return
        if not gone:
            self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self._folder(number))

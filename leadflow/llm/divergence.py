"""Source divergence audit: how the sources of a language differ by their terms, from count-level bitmaps.

For each group (language and source) and each count, a bitmap has the terms that occur so often there. Two
bitmaps' AND, counted, is one cell of the two groups' joint table, and a cell's contribution depends on its two
counts alone. Cells with a zero count follow from the others by complement, so no bitmap of absent
terms is made.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadflow.llm.common import values, written

LETTERS = bytes(c if 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
SLICE = 1 << 20  # bytes of a text whose terms stand in memory at a time
HELD = 300_000  # counts that a task gathers before it passes them on
BUCKET = 4_096  # terms of a language that are numbered together, about
BITS = 64  # terms of a bitmap


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time: letters and all that isn't ASCII, A-Z lower-cased."""
    data = text.encode().lower().translate(LETTERS)
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > SLICE:
            stop = data.rfind(b" ", at, at + SLICE) + 1 or data.find(b" ", at + SLICE) + 1 or len(data)
        yield data[at:stop].split()
        at = stop


KIND = pa.schema([(c, pa.string()) for c in ("lang", "source", "term")] + [(c, pa.int64()) for c in ("n", "docs")])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group; a row without a term says that the group is there."""

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            names = list(own)
            n = len(names) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                pa.array([None, *(w.decode() for w in names)], pa.string()),
                pa.array([0, *(own[w][0] for w in names)], pa.int64()),
                pa.array([0, *(own[w][1] for w in names)], pa.int64()),
            ], schema=KIND)

    held: dict[tuple[str, str], dict[bytes, list[int]]] = defaultdict(dict)
    size = 0
    for b in batches:
        keys = zip(b.column("lang").to_pylist(), b.column("source").to_pylist())
        for key, text in zip(keys, values(b.column("text"))):
            own, found = held[key], Counter()
            for part in terms(text):
                found.update(part)
            for w, n in found.items():
                at = own.get(w)
                if at is None:
                    own[w] = [n, 1]
                    size += 1
                else:
                    at[0] += n
                    at[1] += 1
            if size >= HELD:
                yield from rows()
                held, size = defaultdict(dict), 0
    yield from rows()


def _share(n: Column | str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exactly."""
    n = F.col(n) if isinstance(n, str) else n
    above = F.lit(1_000_000_000).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + 1)
    below = (F.col(total) + F.col(kept)).cast("decimal(20,0)")
    return F.call_function("div", above, below) + 1


def _gain(p: str, q: str) -> Column:
    """floor((p - q)^2 / q), exactly."""
    away = (F.col(p) - F.col(q)).cast("decimal(19,0)")
    return F.call_function("div", away * away, F.col(q).cast("decimal(19,0)"))


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same on arrays; shares are at most 10^9 + 1, so squares fit."""
    return (p - q) * (p - q) // q


CELLS = "lang string, source string, other string, cells long"


def _joint(levels: pa.Table) -> pa.Table:
    """For the bitmaps of a bucket: what the cells with two positive counts add to each ordered pair of groups.

    A cell counts by how far it is from what its two margins would be worth with a zero beside them, which
    is what the complement gives every term of a margin (see ``divergence``).
    """
    sources = sorted(set(levels.column("source").to_pylist()))
    number = {s: i for i, s in enumerate(sources)}
    own = np.fromiter((number[s] for s in levels.column("source").to_pylist()), np.int64, levels.num_rows)
    p, p0 = (levels.column(c).to_numpy().astype(np.int64) for c in ("p", "p0"))
    bits, place = levels.column("bits").to_numpy().view(np.uint64), levels.column("place").to_numpy()
    total = np.zeros((len(sources), len(sources)), np.int64)
    met = np.zeros((len(sources), len(sources)), bool)
    order = np.argsort(place, kind="stable")
    ends = np.flatnonzero(np.diff(place[order])) + 1
    for word in np.split(order, ends):
        for at in range(0, len(word), 256):  # rows of the joint table, some at a time
            some = word[at : at + 256]
            n = np.bitwise_count(bits[some][:, None] & bits[word][None, :]).astype(np.int64)
            i, j = np.nonzero(n)
            i, j, n = some[i], word[j], n[i, j]
            apart = own[i] != own[j]
            i, j, n = i[apart], j[apart], n[apart]
            worth = gain(p[i], p[j]) - gain(p[i], p0[j]) - gain(p0[i], p[j]) + gain(p0[i], p0[j])
            np.add.at(total, (own[i], own[j]), n * worth)
            met[own[i], own[j]] = True
    a, b = np.nonzero(met)
    return pa.table({
        "lang": pa.array([levels.column("lang")[0].as_py()] * len(a), pa.string()),
        "source": pa.array([sources[x] for x in a], pa.string()),
        "other": pa.array([sources[x] for x in b], pa.string()), "cells": pa.array(total[a, b], pa.int64()),
    })


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every group, which is a language and one of its sources.

    A language keeps the terms that ``least_docs`` of its documents have. A group gives a kept term the share
    p = 1 + floor(10^9 (count + 1) / (N + V)), N being its kept occurrences, V the kept terms; a language
    likewise. Part ``pair``: how far the group is from each other source of its language, as the
    sum of floor((p - q)^2 / q) over all kept terms (0 without any). Part ``term``: its ``top`` terms
    by the same measure against its language, of those that it has and uses more. Ranks go by value, then item.

    Null texts, languages and sources are empty ones. Groups without terms take part. Repeated rows are
    documents of their own; ids and other columns are not read. Very long texts are read by slices. The
    result has a row for each ordered pair of a language's sources, whatever the number of terms.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = named.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    # one shuffle by term serves the sums of a group and those of the language
    sums = made.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    term = Window.partitionBy("lang", "term")
    counts = written(
        sums.withColumns({
            "all_n": F.sum("n").over(term), "all_docs": F.sum("docs").over(term),
            "first": F.row_number().over(term.orderBy("source")) == 1,
        }).where(F.col("term").isNull() | (F.col("all_docs") >= least_docs)),
        "term-counts",
    )
    kept = counts.where(F.col("term").isNotNull()).drop("docs", "all_docs")

    langs = counts.groupBy("lang").agg(
        F.coalesce(F.sum(F.when(F.col("term").isNotNull() & F.col("first"), F.col("all_n"))), F.lit(0)).alias("lang_n"),
        F.count(F.when(F.col("term").isNotNull() & F.col("first"), 1)).alias("v"),
    )
    groups = written(counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n")).join(langs, "lang"), "groups")

    told = kept.join(groups, ["lang", "source"]).withColumns({
        "p": _share("n", "group_n", "v"), "q": _share("all_n", "lang_n", "v"),
    })
    by_term = told.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gain("p", "q").alias("value")
    )

    buckets = max(1, kept.where("first").count() // BUCKET)
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket")
    numbered = kept.select("lang", "source", "n", "all_n", "term", bucket).withColumn(
        # neighbours in number are about as frequent: their bitmaps have few levels
        "number", F.dense_rank().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("all_n"), "term")) - 1
    )
    bit = F.expr(f"shiftleft(1L, number % {BITS})")
    levels = numbered.groupBy(
        "lang", "bucket", F.floor(F.col("number") / BITS).cast("long").alias("place"), "source", "n"
    ).agg(F.bit_or(bit).alias("bits"))
    levels = written(levels, "levels")

    none = F.lit(0)
    shares = groups.where("v > 0").select(
        "lang", "source", "group_n", "v", _share(none, "group_n", "v").alias("p0")
    )
    levelled = levels.join(shares, ["lang", "source"]).withColumn("p", _share("n", "group_n", "v"))
    cells = levelled.select("lang", "bucket", "place", "source", "p", "p0", "bits").groupBy("lang", "bucket")
    cells = cells.applyInArrow(_joint, CELLS)
    cells = cells.groupBy("lang", "source", "other").agg(F.sum(F.col("cells").cast("decimal(38,0)")).alias("cells"))

    margins = levelled.groupBy("lang", "source", "p", "p0").agg(F.sum(F.bit_count("bits")).alias("m"))
    beside = shares.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    facing = margins.join(beside, "lang").where("source <> other")
    times = F.col("m").cast("decimal(19,0)")
    rows_margin = facing.groupBy("lang", "source", "other").agg(
        F.sum(times * (_gain("p", "q0") - _gain("p0", "q0"))).alias("of_rows")
    )
    # the columns' margins: the other group's levels against this group's zero share
    columns_margin = facing.select(
        "lang", F.col("other").alias("source"), F.col("source").alias("other"),
        (times * (_gain("q0", "p") - _gain("q0", "p0"))).alias("x"),
    ).groupBy("lang", "source", "other").agg(F.sum("x").alias("of_columns"))

    here = groups.select("lang", "source", "v").join(
        groups.select("lang", F.col("source").alias("other")), "lang"
    ).where("source <> other")
    keys = ["lang", "source", "other"]
    own = shares.select("lang", "source", "p0")
    pairs = here.join(own, ["lang", "source"], "left").join(beside, ["lang", "other"], "left")
    for more in (cells, rows_margin, columns_margin):
        pairs = pairs.join(more, keys, "left")
    total = sum(
        (F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)")) for c in ("cells", "of_rows", "of_columns")),
        F.when(F.col("v") > 0, F.col("v").cast("decimal(19,0)") * _gain("p0", "q0")).otherwise(F.lit(0)).cast("decimal(38,0)"),
    )
    by_pair = pairs.select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), total.cast("long").alias("value")
    )

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    first = by_term.withColumn("rank", rank).where(F.col("rank") <= top)
    return by_pair.withColumn("rank", rank).unionByName(first).select("lang", "source", "part", "item", "value", "rank")

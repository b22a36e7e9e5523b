"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 16, 512  # bytes of a chunk; the last one of a text may be shorter
MASK_BITS = 4  # a cut after one position in 16, on average, once a chunk has its least length
LOWEST_BIT = 24  # of the hash's bits that decide a cut: they depend on the last 28 bytes, not on 44 or more
REACH = 160  # characters in a row that must repeat


def _gear() -> np.ndarray:
    """A fixed random number for each byte value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 0x9E37) for b in range(256)], np.uint64)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + gear(byte), so that the last 64 bytes decide it.

    Sums of 2, 4, .. 64 bytes are built from those of half as many.
    """
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16, 32):
        if shift < len(h):
            h[shift:] = h[shift:] + (h[:-shift] << np.uint64(shift))
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Where chunks end: before a character's first byte, where the hash's bits say so or the chunk is full."""
    n = len(data)
    if not n:
        return []
    bits = (rolling(data) >> np.uint64(LOWEST_BIT)) & np.uint64((1 << MASK_BITS) - 1)
    first = np.ones(n + 1, bool)
    first[:-1] = (data & 0xC0) != 0x80
    wanted = np.flatnonzero((bits == 0) & first[1:]) + 1
    out, at = [], 0
    for c in [*wanted.tolist(), n]:
        while c - at > MOST:
            stop = at + MOST
            while not first[stop]:
                stop -= 1
            out.append(stop)
            at = stop
        if c - at >= LEAST or c == n:
            if c > at:
                out.append(c)
            at = c
    return out


CHUNK = "doc_id long, place long, a long, b long"  # place: start, stop and, in the last bit, whether the text has it before


def _chunks(id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, starts, stops, digests, again = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                raw = (text or "").encode("utf-8", "replace")
                if not raw or pd.isna(doc_id):
                    continue
                data = np.frombuffer(raw, np.uint8)
                ends = cuts(data)
                begins = [0, *ends[:-1]]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                seen: set[bytes] = set()
                for x, y in zip(begins, ends):
                    d = digest(raw[x:y])
                    digests.append(d)
                    again.append(d in seen)
                    seen.add(d)
                ids += [int(doc_id)] * len(ends)
                starts.append(chars[begins])
                stops.append(chars[ends])
            if ids:
                halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                place = np.concatenate(starts).astype(np.int64) << 33 | np.concatenate(stops).astype(np.int64) << 1
                yield pd.DataFrame({
                    "doc_id": ids, "place": place | np.array(again, np.int64), "a": halves[:, 0], "b": halves[:, 1],
                })

    return run


def chunks(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """CHUNK rows of all texts: place (code points) and 128-bit digest, in few bytes, since all of them are shuffled."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInPandas(_chunks(id_col), CHUNK)


def repeats(docs: DataFrame, id_col: str = "doc_id", reach: int = REACH) -> DataFrame:
    """``doc_id, start, stop, n_chunks, first_doc_id, n_docs, copy``: the passages of each text that other texts have too.

    Chunks are told by their digests. A digest is counted once for each text, so that a hot one reaches
    the shuffle as one row a task. Neighbouring chunks that several texts have make one passage;
    it counts from ``reach`` characters on. ``first_doc_id`` is the smallest id that holds any chunk of it,
    ``n_docs`` the most texts that hold one, and ``copy`` says that each of its chunks stands in a text of
    smaller id too: dropping those passages leaves every chunk once.

    Null and empty texts, and rows with a null id, have no passages. Rows that share an id count as
    one text where their chunks are equal. Ids are whole numbers. Very long texts are cut in time and memory in
    proportion to their length. What stands before a passage moves its first cuts, so up to 28 bytes and a part of a
    chunk at either end don't count towards ``reach``.
    """
    own = chunks(docs, id_col)
    held = own.where(F.col("place") % 2 == 0).groupBy("a", "b").agg(
        F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")
    )
    common = held.where("first_doc_id <> last").drop("last")
    met = own.join(common, ["a", "b"]).withColumn("place", F.shiftright("place", 1))
    hits = met.select("doc_id", "place", "n_docs", "first_doc_id").distinct().select(
        "doc_id", F.shiftright("place", 32).cast("int").alias("start"),
        F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("stop"), "n_docs", "first_doc_id",
    )
    edge = F.expr("start <> lag(stop, 1, -1) over (partition by doc_id order by start, stop)")
    runs = hits.withColumn("edge", edge.cast("int")).withColumn(
        "run", F.expr("sum(edge) over (partition by doc_id order by start, stop)")
    )
    return (
        runs.groupBy("doc_id", "run")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_chunks"),
            F.min("first_doc_id").alias("first_doc_id"), F.max("n_docs").alias("n_docs"),
            F.min((F.col("first_doc_id") < F.col("doc_id")).cast("int")).cast("boolean").alias("copy"),
        )
        .where(F.col("stop") - F.col("start") >= reach)
        .drop("run")
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", reach: int = REACH) -> DataFrame:
    """``doc_id, text`` of every row, without the passages that a text of smaller id has: see ``repeats``.

    Texts without such a passage stay as they are; a text that is a copy as a whole becomes empty.
    """
    gone = (
        repeats(docs, id_col, reach).where("copy").groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans):
            if t is not None and own is not None and len(own):
                parts, at = [], 0
                for x in own:
                    parts.append(t[at : x["start"]])
                    at = x["stop"]
                t = "".join([*parts, t[at:]])
            out.append(t)
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col(id_col).alias("doc_id"), "text").join(gone, "doc_id", "left")
    return rows.select("doc_id", without("text", "spans").alias("text"))

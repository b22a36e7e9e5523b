"""Exact top-k inner products over bit-sliced blocks of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import written

BLOCK_ROWS = 16_384
LARGEST = 1 << 52  # of scaled components: beyond it a double has no place for their last digits
LOW = 62  # bits of a score's lower part: both parts fit a long, whatever the score


def quantised(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null, not finite or out of range."""
    v = F.col(vector) if isinstance(vector, str) else vector
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    usable = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return F.when(usable, F.transform(scaled, lambda x: F.floor(x).cast("long")))


class SlicedBlock:
    """Rows of one width as bitmaps: one for each bit of each component, lifted by the component's minimum."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray, keys: np.ndarray | None = None):
        self.ids, self.low, self.slices = ids, low, slices  # slices: [dimension, bit, word]
        self.keys = ids if keys is None else keys  # of rows, where several share an id
        self.words = slices.shape[2]
        rows = np.zeros(self.words * 64, bool)
        rows[: len(ids)] = True
        self.all = np.packbits(rows, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, keys: np.ndarray | None = None) -> SlicedBlock:
        """``ids`` ascending, one row of ``vectors`` for each."""
        low = vectors.min(axis=0)
        lifted = (vectors - low).T.astype(np.int64)
        bits = max(1, int(lifted.max(initial=0)).bit_length())
        words = -(-len(ids) // 64)
        slices = np.zeros((vectors.shape[1], bits, words), np.uint64)
        padded = np.zeros((vectors.shape[1], words * 64), bool)
        for b in range(bits):
            padded[:, : len(ids)] = (lifted >> b) & 1
            slices[:, b] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        return cls(ids, low, slices, keys)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The sum's bitmaps, least significant first, and what to add to it for the inner product.

        A component times a weight is its slices at each signed digit of the weight; a negative digit
        takes the complement. Bitmaps of one significance go through full adders until one is left.
        """
        bits = self.slices.shape[1]
        top = (1 << bits) - 1
        piles: dict[int, list[np.ndarray]] = {}
        added = int(np.dot(query.astype(object), self.low.astype(object))) if len(query) else 0
        for d, weight in enumerate(query.tolist()):
            left, at = abs(weight), 0
            while left:
                if left & 1:
                    digit = 2 - (left & 3)
                    left -= digit
                    plus = (digit > 0) == (weight > 0)
                    for b in range(bits):
                        piles.setdefault(at + b, []).append(self.slices[d, b] if plus else ~self.slices[d, b])
                    if not plus:
                        added -= top << at
                left >>= 1
                at += 1
        out, at = [], 0
        while any(p >= at for p in piles):
            pile = piles.pop(at, [])
            over = piles.setdefault(at + 1, [])
            while len(pile) > 2:
                a, b, c = pile.pop(), pile.pop(), pile.pop()
                ab = a ^ b
                pile.append(ab ^ c)
                over.append((a & b) | (ab & c))
            if len(pile) == 2:
                a, b = pile
                pile = [a ^ b]
                over.append(a & b)
            out.append(pile[0] if pile else np.zeros(self.words, np.uint64))
            if not over:
                del piles[at + 1]
            at += 1
        return out, added

    def top(self, query_key: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows but the query's own, ties to the smaller id."""
        sums, added = self.scores(query)
        sure, maybe = np.zeros(self.words, np.uint64), self.all.copy()
        for own in np.flatnonzero(self.keys == query_key).tolist():  # one at most
            maybe[own // 64] &= ~np.uint64(1 << (own % 64))
        have = 0  # rows that are surely among the k
        for s in reversed(sums):
            ones = maybe & s
            n = int(np.bitwise_count(ones).sum())
            if have + n > k:
                maybe = ones
            else:
                sure |= ones
                maybe &= ~s
                have += n
                if have == k:
                    break
        rows = self._rows(sure)
        if have < k:  # rows that tie on every slice: the boundary
            rows = np.sort(np.concatenate([rows, self._rows(maybe, k - have)]))
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        wide = len(sums) >= LOW or abs(added) >> LOW  # then Python's integers
        found = np.zeros(len(rows), object if wide else np.int64)
        for i, s in enumerate(sums):
            found += ((s[word] >> bit) & np.uint64(1)).astype(found.dtype) << i
        return self.ids[rows], found + added

    def _rows(self, bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
        words = np.flatnonzero(bitmap)[:most]
        set_ = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(-1, 64)
        at, bit = np.nonzero(set_)
        return (words[at] * 64 + bit)[:most]


PART = "block long, kind int, at long, id long, packed binary, low long"


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One block's rows as the parts of its index: ids and keys, then a part for each component."""
    rows = rows.sort_values(["vec_id", "key"])
    ids, keys = rows["vec_id"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
    block = SlicedBlock.of(ids, np.stack(rows["v"].to_numpy()).astype(np.int64))
    packed = [np.stack([ids, keys]).tobytes(), *[s.tobytes() for s in block.slices]]
    n = len(packed)
    return pd.DataFrame({
        "block": [rows["block"].iat[0]] * n, "kind": [0] + [1] * (n - 1), "at": range(-1, n - 1), "id": [0] * n,
        "packed": packed, "low": [0, *block.low.tolist()],
    })


FOUND = "query_key long, query_id long, vec_id long, high long, low long"


def _answers(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's parts come before its queries; one block is held at a time."""
        ids = keys = block = None
        parts: list[tuple[int, bytes]] = []
        for batch in batches:
            out = []
            for kind, at, own, packed, low in zip(*[batch[c] for c in ("kind", "at", "id", "packed", "low")]):
                if kind == 0:
                    (ids, keys), parts, block = np.frombuffer(packed, np.int64).reshape(2, -1), [], None
                elif kind == 1:
                    parts.append((low, packed))
                else:
                    if block is None:
                        words = -(-len(ids) // 64)
                        slices = np.stack([np.frombuffer(p, np.uint64).reshape(-1, words) for _, p in parts])
                        block, parts = SlicedBlock(ids, np.array([x for x, _ in parts], np.int64), slices, keys), []
                    found, scores = block.top(at, np.frombuffer(packed, np.int64), k)
                    out.append(pd.DataFrame({
                        "query_key": at, "query_id": own, "vec_id": found, "high": (scores >> LOW).astype(np.int64),
                        "low": (scores & ((1 << LOW) - 1)).astype(np.int64),
                    }))
            if out:
                yield pd.concat(out)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each query row, ties to the smaller id.

    ``vectors`` has ``vec_id`` and integer components ``v`` (see ``quantised``); ``queries`` picks its
    query rows. Rows with a null id or vector, and empty vectors, take no part. Rows that share an id are rows of
    their own: each is a candidate for the others, and each query row has a list. Vectors are compared with those of
    their own width only. Ranks are exact whatever the sums; a score that a long can't hold is null.

    Rows are dealt by a key of their own into blocks of about ``block_rows``; a block is one bit-sliced index. Each
    query visits each block and leaves ``k`` rows there, of which the best are chosen.
    """
    own = vectors.where("vec_id is not null and v is not null and size(v) > 0")
    own = own.select("vec_id", F.col("v").cast("array<long>").alias("v"), queries.alias("asks"))
    own = written(own.withColumn("key", F.monotonically_increasing_id()), "search-vectors")
    widths = own.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    shape = widths.select("width", F.ceil(F.col("n") / block_rows).alias("blocks"))
    placed = own.withColumn("width", F.size("v")).join(shape, "width")
    number = F.pmod(F.xxhash64("key"), F.col("blocks"))
    block = F.col("width").cast("long") * (1 << 40) + number
    index = written(
        placed.select(block.alias("block"), "vec_id", "key", "v").groupBy("block").applyInPandas(_index, PART),
        "search-index",
    )
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    little = F.udf(lambda v: np.array(v, np.int64).tobytes(), "binary", useArrow=True)
    asked = placed.where("asks").withColumn("packed", little("v")).withColumn("number", every).select(
        (F.col("width").cast("long") * (1 << 40) + F.col("number")).alias("block"),
        F.lit(2).alias("kind"), F.col("key").alias("at"), F.col("vec_id").alias("id"), "packed",
        F.lit(0).cast("long").alias("low"),
    )
    best = (
        index.unionByName(asked)
        .repartition("block").sortWithinPartitions("block", "kind", "at")
        .mapInPandas(_answers(k), FOUND)
    )
    order = "partition by query_key order by high desc, low desc, vec_id"
    ranked = best.withColumn("rank", F.expr(f"row_number() over ({order})")).where(F.col("rank") <= k)
    score = F.when(F.col("high").between(-2, 1), F.col("high") * (1 << LOW) + F.col("low"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))

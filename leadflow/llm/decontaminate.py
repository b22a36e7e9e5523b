"""Benchmark decontamination with an FM-index for each shard of the training texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leadflow.llm.common import values, written

WINDOW = 10
SHARD_WORDS = 1 << 20  # indexed words of a shard, unless one document alone has more
BLOCK_WORDS = 2_000_000  # benchmark words that a broadcast may hold
STRIDE = 8  # every so many positions of a run are sampled

#: Lower-cases A-Z and blanks every byte that is not part of a word.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class WaveletRanks:
    """A sequence of small numbers as bit rows, one for each bit, with popcount sums: the wavelet matrix."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.rows, self.sums, self.zeros = len(symbols), [], [], []
        now = symbols
        for b in reversed(range(bits)):
            ones = ((now >> b) & 1).astype(bool)
            padded = np.zeros((len(now) // 64 + 1) * 64, bool)
            padded[: len(now)] = ones
            row = np.packbits(padded, bitorder="little").view(np.uint64)
            count = np.zeros(len(row) + 1, np.int64)
            np.cumsum(np.bitwise_count(row), out=count[1:])
            self.rows.append(row)
            self.sums.append(count)
            self.zeros.append(len(now) - int(count[-1]))
            now = np.concatenate([now[~ones], now[ones]])
        self.bits = bits

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.rows[level][word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.sums[level][word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._ones(level, at), self._ones(level, start)
            at = np.where(one, self.zeros[level] + a, at - a)
            start = np.where(one, self.zeros[level] + b, start - b)
        return at - start

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before it."""
        symbol, start = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            one = (self.rows[level][word] >> bit) & np.uint64(1) == 1
            a, b = self._ones(level, at), self._ones(level, start)
            at = np.where(one, self.zeros[level] + a, at - a)
            start = np.where(one, self.zeros[level] + b, start - b)
            symbol = symbol * 2 + one
        return symbol, at - start


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of ``text`` in order. Zeros end a run: each counts as smaller than words and than later zeros."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + n
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    rank = _dense(rank, order)
    step = 1
    while n and rank.max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = _dense(key, order)
        step *= 2
    return order


def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    in_order = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(in_order[1:] != in_order[:-1])]) if len(key) else 0
    return rank


class FMIndex:
    """The index of runs of word numbers, each run closed by a zero."""

    def __init__(self, text: np.ndarray, symbols: int, stride: int = STRIDE):
        order = suffix_order(text)
        bwt = text[order - 1]  # before the first run stands the last zero
        self.ranks = WaveletRanks(bwt.astype(np.int64), max(1, int(symbols).bit_length()))
        counts = np.bincount(text, minlength=symbols + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # smaller symbols
        run_start = np.zeros(len(text), np.int64)
        ends = np.flatnonzero(text == 0)
        run_start[ends[:-1] + 1] = ends[:-1] + 1
        offset = np.arange(len(text)) - np.maximum.accumulate(run_start)
        sampled = (offset % stride == 0)[order]
        self.sampled = WaveletRanks(sampled.astype(np.int64), 1)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row range of each phrase (word numbers, filled up with zeros), by backward steps over all at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.ranks.size)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            word = phrases[live, lengths[live] - 1 - step]
            low[live] = self.before[word] + self.ranks.rank(word, low[live])
            high[live] = self.before[word] + self.ranks.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: steps back to a sampled position; a run's first position is one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit, rank = self.sampled.read(at[open_])
            done = open_[hit == 1]
            out[done] = self.samples[rank[hit == 1]] + steps[done]
            open_ = open_[hit == 0]
            word, before = self.ranks.read(at[open_])
            at[open_] = self.before[word] + before
            steps[open_] += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, as numbers of the block's words from 1 on."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                holders.setdefault(tuple(own[i : i + window]), set()).add(item)
        self.items = [sorted(x) for x in holders.values()]
        self.lengths = np.array([len(x) for x in holders], np.int64)
        self.table = np.zeros((len(holders), int(self.lengths.max(initial=1))), np.int64)
        for i, x in enumerate(holders):
            self.table[i, : len(x)] = x
        self.shortest = int(self.lengths.min(initial=window))

    def search(self, documents: list[np.ndarray]) -> list[tuple[np.ndarray, list[str]]]:
        """For each document's word numbers (0: not a word of the block): its spans of hit words, and the items found.

        A phrase lies within a run of the block's words, so the shard's index holds the runs that are
        long enough for the shortest phrase; everything else cannot match and is left out.
        """
        runs, places = [], []  # of each indexed word its document and place
        for d, numbers in enumerate(documents):
            inside = np.concatenate([[False], numbers != 0, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            start, stop = edge[::2], edge[1::2]
            long = stop - start >= self.shortest
            for a, b in zip(start[long].tolist(), stop[long].tolist()):
                runs.append(numbers[a:b])
                places.append((d, a, b))
        found: list[list] = [[np.zeros((0, 2), np.int64), []] for _ in documents]
        if not runs or not len(self.lengths):
            return [(s, i) for s, i in found]
        close = np.zeros(1, np.int64)
        text = np.concatenate([x for run in runs for x in (run, close)])
        index = FMIndex(text, len(self.numbers))
        low, high = index.search(self.table, self.lengths)
        hits = np.flatnonzero(high > low)
        times = (high - low)[hits]
        phrase = np.repeat(hits, times)
        rows = np.concatenate([np.arange(a, b) for a, b in zip(low[hits], high[hits])]) if len(hits) else hits
        at = index.locate(rows)
        starts = np.cumsum([0, *[b - a + 1 for _, a, b in places]])
        run = np.searchsorted(starts, at, side="right") - 1
        place = np.array(places)[run] if len(run) else np.zeros((0, 3), np.int64)
        first = at - starts[run] + place[:, 1]
        order = np.lexsort([first, place[:, 0]])
        cuts = np.flatnonzero(np.diff(place[order, 0], prepend=-1))
        for part in np.split(order, cuts[1:]) if len(order) else []:
            d = int(place[part[0], 0])
            spans = merged(first[part], first[part] + self.lengths[phrase[part]])
            found[d] = [spans, sorted({x for p in np.unique(phrase[part]) for x in self.items[p]})]
        return [(s, i) for s, i in found]


def merged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Spans, sorted by start, with those that touch or overlap made one."""
    far = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > far[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], far[last]], axis=1)


FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _searched(block: Phrases, batch: pa.Array, shard_words: int) -> list[tuple[int, np.ndarray, list[str]]]:
    """Words, spans and items of each text of an Arrow batch, whose rows are dealt into shards."""
    number = block.numbers.get
    out, shard, size = [], [], 0
    for t in chain(values(batch), [END]):
        if t is END or size >= shard_words:
            out += [(len(x), *found) for x, found in zip(shard, block.search(shard))] if shard else []
            shard, size = [], 0
        if t is not END:
            numbers = np.array([number(w, 0) for w in words_of(t)], np.int32)
            shard.append(numbers)
            size += len(numbers)
    return out


END = object()


def _findings(phrases: Broadcast, text: Column, shard_words: int) -> Column:
    """FOUND for each text against one block of phrases."""

    @F.arrow_udf(FOUND)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = _searched(phrases.value, batch, shard_words)
            spans = [[{"start": a, "stop": b} for a, b in spans.tolist()] for _, spans, _ in out]
            yield pa.StructArray.from_arrays([
                pa.array([n for n, _, _ in out], pa.int64()), pa.array(spans, SPANS),
                pa.array([items for _, _, items in out], pa.list_(pa.string())),
            ], ["n_words", "spans", "items"])

    return of.asNondeterministic()(text)  # so that no filter makes Spark run it again


CUT = "n_words long, gone long, new string"


def _cuttings(phrases: Broadcast, text: Column, shard_words: int) -> Column:
    """CUT for each text against one block: its words, how many of them are hit, and what is left where some are."""

    @F.arrow_udf(CUT)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = _searched(phrases.value, batch, shard_words)
            new = [cut(t, spans.tolist()) if len(spans) else None for t, (_, spans, _) in zip(values(batch), out)]
            yield pa.StructArray.from_arrays([
                pa.array([n for n, _, _ in out], pa.int64()),
                pa.array([int((spans[:, 1] - spans[:, 0]).sum()) for _, spans, _ in out], pa.int64()),
                pa.array(new, pa.string()),
            ], ["n_words", "gone", "new"])

    return of.asNondeterministic()(text)


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items, a bounded block at a time; an item with more words than a block has is one of its own."""
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len(words_of(row[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


class _Search:
    """The search of texts for a benchmark. One block of it is on the driver and with the tasks at a time."""

    def __init__(
        self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
        block_words: int = BLOCK_WORDS,
    ):
        named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")
        blocks = _blocks(named, block_words)
        first, self.second = next(blocks, []), next(blocks, None)
        self.docs, self.context, self.shard_words = docs, docs.sparkSession.sparkContext, shard_words
        self.blocks = (Phrases(x, window) for x in chain([first], [] if self.second is None else [self.second], blocks))

    def once(self, column) -> Column | None:
        """``column`` of the texts if one block holds the whole benchmark."""
        if self.second is not None:
            return None
        return column(self.context.broadcast(next(self.blocks)), F.col("text"), self.shard_words)

    def rows(self) -> DataFrame:
        """``row, n_words, spans, items`` of each row, block by block: what each finds is a table of its own."""
        keyed = written(
            self.docs.select(F.struct("*").alias("row")).withColumn("key", F.monotonically_increasing_id()), "searched"
        )
        hits = words = None
        for block in self.blocks:
            held = self.context.broadcast(block)
            found = keyed.select("key", _findings(held, F.col("row.text"), self.shard_words).alias("f"))
            part = written(found.select("key", "f.*").where(F.lit(hits is None) | (F.size("items") > 0)), "hits")
            held.destroy()
            words = part.select("key", "n_words") if words is None else words
            part = part.where(F.size("items") > 0).select("key", "spans", "items")
            hits = part if hits is None else hits.unionByName(part)
        both = hits.groupBy("key").agg(
            _union(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        none = [F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")]
        return keyed.join(words, "key").join(both, "key", "left").select("row", "n_words", *none)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row: its hit words as merged spans, and the items found.

    A shard is a run of rows that a task reads, up to ``shard_words`` words or a longer text; texts are
    never shuffled. Phrases reach the tasks as a broadcast of at most ``block_words`` benchmark words;
    a larger benchmark has several, one after the other, each in a pass of its own. Null and empty texts
    have no words; a null item id counts as the text ``null``; items without words find nothing.
    Repeated rows come back as often as they came. A very long text is a shard of its own, in memory
    as the numbers of its words.
    """
    search = _Search(docs, benchmark, **options)
    found = search.once(_findings)
    if found is None:
        return search.rows().select(F.col("row").getField(id_col).alias("doc_id"), "n_words", "spans", "items")
    return docs.select(F.col(id_col).alias("doc_id"), found.alias("f")).select("doc_id", "f.*")


def _union(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""

    def add(done, x):
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(
            (F.size(done) > 0) & (x["start"] <= last["stop"]),
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)),
        ).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), add)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (counted in words) and what stands between them."""
    raw = text.encode("utf-8", "replace")
    word = np.frombuffer(raw.translate(FOLD), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, stop = edge[::2], edge[1::2]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : start[a]])
        at = stop[b - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8")


@F.arrow_udf(StringType())
def _cut_texts(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([
        t if t is None or not s else cut(t, [(x["start"], x["stop"]) for x in s])
        for t, s in zip(values(text), values(spans))
    ], pa.string())


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with the hit spans cut out of the texts, and ``n_chars`` (where there is one) counted anew.

    Rows that have no word left are dropped; rows without hits stay as they are, null and empty
    texts too, and so do all other columns. See ``find`` for the bounds.
    """
    search = _Search(docs, benchmark, **options)
    found = search.once(_cuttings)
    if found is None:
        gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
        new = F.when(F.size("spans") > 0, _cut_texts("row.text", "spans"))
        each = search.rows().select("row", "n_words", gone.alias("gone"), new.alias("new"))
    else:
        each = docs.select(F.struct("*").alias("row"), found.alias("f")).select("row", "f.*")
    some = each.where((F.col("gone") == 0) | (F.col("gone") < F.col("n_words")))
    return with_text(some, docs, F.coalesce("new", "row.text"), F.col("gone") > 0)


def with_text(rows: DataFrame, docs: DataFrame, new: Column, changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``row``, with the new text, and its length in ``n_chars`` where it changed."""
    out = []
    for field in docs.schema:
        old = F.col("row").getField(field.name)
        if field.name == "text":
            old = new
        elif field.name == "n_chars":
            old = F.when(changed, F.length(new).cast(field.dataType)).otherwise(old)
        out.append(old.alias(field.name))
    return rows.select(*out)

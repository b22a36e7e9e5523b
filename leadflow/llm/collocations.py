"""Phrase collocations: n-gram counts in weighted acyclic automata, united by prefix range, looked up by composition.

Each task counts the n-grams of its share of the texts, sorts them and turns them into automata over words,
whose arcs carry the counts; one automaton holds one range of prefixes. The automata of a range are united,
their weights summed. The parts of candidate phrases, sorted too, run through the united automata of
their own ranges to get their counts.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leadflow.llm.common import values, written

NO_LANG = "und"
BREAK = b"."  # stands for every sign that parts pieces, so no word holds it
SIGNS = b".,;:!?\n\x0b\x0c\r"
TO_BREAKS = bytes.maketrans(SIGNS, BREAK * len(SIGNS))
SLICE = 1 << 20  # bytes of a text that are cut into words at a time
SHARD = 2_000_000  # words whose n-grams make one shard's automata
RANGE_CHARS = 8 << 20  # characters of text for each range of prefixes
MOST_RANGES = 1 << 16

Grams = list[tuple[np.ndarray, np.ndarray]]  # by length from 1 on: rows of word numbers in order, and their counts


@dataclass
class Automaton:
    """A minimal acyclic automaton over words, each arc with the count of the n-gram that ends there.

    The arcs of state ``s`` stand from ``start[s]`` to ``start[s + 1]``, by label; a label is a place in
    ``words``, which are sorted. State 0 has no arcs, the last state is the root. A weight of 0: no n-gram ends.
    """

    words: list[bytes]
    start: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def build(cls, words: list[bytes], grams: Grams) -> Automaton:
        """From sorted n-grams, the longest first: states are frozen in order, equal ones are one through a register."""
        register: dict[bytes, int] = {b"": 0}
        arcs, sizes, n = [], [0], 0
        above = np.empty((0, len(grams)), np.int64), np.empty(0, np.int64)
        for k in range(len(grams), 0, -1):
            own, weight = grams[k - 1]
            rows = np.concatenate([own, above[0]])
            weights = np.concatenate([weight, np.zeros(len(above[1]), np.int64)])
            targets = np.concatenate([np.zeros(len(weight), np.int64), above[1]])
            order, first = _order(rows, len(words))
            if not len(order):
                above = np.empty((0, k - 1), np.int64), np.empty(0, np.int64)
                continue
            rows = rows[order][first]
            weights, targets = np.add.reduceat(weights[order], first), np.maximum.reduceat(targets[order], first)
            packed = np.stack([rows[:, -1], weights, targets], 1)
            heads = rows[:, :-1]
            begins = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(1)]))
            ends = np.append(begins[1:], len(rows))
            raw, width = packed.tobytes(), packed.itemsize * 3
            states = np.empty(len(begins), np.int64)
            for i, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())):
                key = raw[a * width : b * width]
                state = register.get(key)
                if state is None:
                    n += 1
                    state = register[key] = n
                    arcs.append(key)
                    sizes.append(b - a)
                states[i] = state
            above = heads[begins], states
        held = np.frombuffer(b"".join(arcs), np.int64).reshape(-1, 3)
        return cls(words, np.concatenate([[0], np.cumsum(sizes)]), held[:, 0], held[:, 1], held[:, 2])

    def grams(self, longest: int) -> Grams:
        """All n-grams in order, by length; those that don't end have weight 0."""
        out: Grams = []
        rows, states = np.empty((1, 0), np.int64), np.array([len(self.start) - 2])
        for _ in range(longest):
            n = self.start[states + 1] - self.start[states]
            at = np.repeat(self.start[states] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            rows = np.concatenate([np.repeat(rows, n, axis=0), self.label[at][:, None]], axis=1)
            states = self.target[at]
            out.append((rows, self.weight[at]))
        return out

    def compose(self, phrases: list[list[bytes]]) -> list[int]:
        """The weight of each phrase, 0 for those that aren't there: all phrases take their next arc together."""
        place = {w: i for i, w in enumerate(self.words)}
        labels = np.full((len(phrases), max(map(len, phrases), default=0)), -1, np.int64)
        for i, phrase in enumerate(phrases):
            labels[i, : len(phrase)] = [place.get(w, -2) for w in phrase]
        size = len(self.words) + 1
        arcs = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)) * size + self.label
        states = np.full(len(phrases), len(self.start) - 2)
        found = np.zeros(len(phrases), np.int64)
        for k in range(labels.shape[1]):
            moves = labels[:, k] != -1
            wanted = np.where(labels[:, k] >= 0, states * size + labels[:, k], -1)
            at = np.minimum(np.searchsorted(arcs, wanted), max(len(arcs) - 1, 0))
            hit = moves & (len(arcs) > 0) & (arcs[at] == wanted if len(arcs) else False)
            found = np.where(moves, np.where(hit, self.weight[at] if len(arcs) else 0, 0), found)
            states = np.where(moves, np.where(hit, self.target[at] if len(arcs) else 0, 0), states)
        return found.tolist()

    def dump(self) -> bytes:
        parts = [narrow(x) for x in (self.start, self.label, self.weight, self.target)]
        return pickle.dumps((b" ".join(self.words), *parts), 5)

    @classmethod
    def load(cls, data: bytes) -> Automaton:
        words, *parts = pickle.loads(data)
        return cls(words.split(b" ") if words else [], *[x.astype(np.int64) for x in parts])


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as they need."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max))


def _order(rows: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """How rows of word numbers are sorted, and where each different row begins then."""
    width = rows.shape[1]
    if width * max(n_words, 1).bit_length() < 63:
        key = np.zeros(len(rows), np.int64)
        for k in range(width):
            key = (key << max(n_words, 1).bit_length()) | rows[:, k]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order]) != 0
    else:
        order = np.lexsort([rows[:, k] for k in reversed(range(width))])
        new = (np.diff(rows[order], axis=0) != 0).any(1)
    return order, np.flatnonzero(np.concatenate([[True], new])) if len(rows) else np.empty(0, np.int64)


def summed(rows: np.ndarray, weights: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, with the sum of their weights."""
    order, first = _order(rows, n_words)
    if not len(order):
        return rows, weights
    return rows[order[first]], np.add.reduceat(weights[order], first)


def united(automata: list[Automaton], longest: int, least: int = 1) -> Automaton:
    """One automaton with the sums of all weights; n-grams below ``least`` are left out."""
    words = sorted(set().union(*(a.words for a in automata)))
    place = {w: i for i, w in enumerate(words)}
    nothing = np.empty(0, np.int64)
    all_grams = [[(nothing.reshape(0, k + 1), nothing)] for k in range(longest)]
    for a in automata:
        own = np.fromiter(map(place.__getitem__, a.words), np.int64, len(a.words))
        for k, (rows, weights) in enumerate(a.grams(longest)):
            kept = weights > 0
            all_grams[k].append((own[rows[kept]], weights[kept]))
    out = []
    for parts in all_grams:
        rows, weights = summed(np.concatenate([r for r, _ in parts]), np.concatenate([w for _, w in parts]), len(words))
        out.append((rows[weights >= least], weights[weights >= least]))
    return only_used(words, out)


def only_used(words: list[bytes], grams: Grams) -> Automaton:
    """The automaton of some n-grams, over the words that they have."""
    used = np.unique(np.concatenate([rows.ravel() for rows, _ in grams]))
    again = [(np.searchsorted(used, rows).reshape(rows.shape), weights) for rows, weights in grams]
    return Automaton.build([words[i] for i in used.tolist()], again)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def ranges_of(rows: np.ndarray, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each n-gram: prefixes of two words (one, where there is one) are ordered by a hash, and its span cut evenly."""
    h = hashes[rows[:, 0]]
    with np.errstate(over="ignore"):
        if rows.shape[1] > 1:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[rows[:, 1]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def words_of(text: str) -> Iterator[list[bytes]]:
    """The words of a text a slice at a time, ``BREAK`` between its pieces."""
    data = text.encode().lower().translate(TO_BREAKS)  # bytes have A-Z lower-cased only
    at = 0
    while at < len(data):
        stop = len(data)
        if stop - at > SLICE:
            stop = data.rfind(BREAK, at, at + SLICE) + 1 or data.find(BREAK, at + SLICE) + 1 or len(data)
        yield data[at:stop].replace(BREAK, b" . ").split()
        at = stop


class Shard:
    """The n-grams of some texts by language."""

    def __init__(self, longest: int):
        self.longest, self.held = longest, 0
        self.ids: dict[str, list[np.ndarray]] = defaultdict(list)
        self.places: dict[str, defaultdict] = {}

    def add(self, lang: str, text: str) -> None:
        places = self.places.get(lang)
        if places is None:
            places = self.places[lang] = defaultdict()
            places.default_factory = places.__len__
            places[BREAK]  # the first number
        for words in words_of(text):
            ids = np.fromiter(map(places.__getitem__, words), np.int32, len(words))
            self.ids[lang] += [ids, np.zeros(1, np.int32)]
            self.held += len(ids)

    def automata(self, ranges: int) -> Iterator[tuple[str, int, bytes]]:
        """Language, range and automaton, for each range that has n-grams; the shard is empty afterwards."""
        for lang, parts in self.ids.items():
            names = list(self.places[lang])
            order = sorted(range(len(names)), key=names.__getitem__)
            words = [names[i] for i in order]
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            ids = rank[np.concatenate(parts)]
            plain = ids != rank[0]
            hashes = hashed(words)
            by_range = []
            for k in range(1, self.longest + 1):
                whole = len(ids) - k + 1
                if whole <= 0:
                    rows = np.empty((0, k), np.int32)
                else:
                    inside = np.logical_and.reduce([plain[i : whole + i] for i in range(k)])
                    rows = np.stack([ids[i : whole + i][inside] for i in range(k)], 1)
                rows, n = summed(rows, np.ones(len(rows), np.int64), len(words))
                own = ranges_of(rows, hashes, ranges)
                sort = np.argsort(own, kind="stable")  # in a range they stay in order
                by_range.append((rows[sort], n[sort], np.searchsorted(own[sort], np.arange(ranges + 1))))
            for r in range(ranges):
                grams = [(rows[at[r] : at[r + 1]], n[at[r] : at[r + 1]]) for rows, n, at in by_range]
                if any(len(n) for _, n in grams):
                    yield lang, r, only_used(words, grams).dump()
        self.__init__(self.longest)


def shards(docs: DataFrame, lang: Column, longest: int, ranges: int) -> DataFrame:
    """``lang, part, automaton``: the automata of each shard of ``docs``, one for each range of prefixes."""

    def rows(made: Iterator[tuple[str, int, bytes]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, bytes]] = []
        for x in made:
            held.append(x)
            if len(held) == 64:
                yield batch(held)
                held = []
        yield batch(held)

    def batch(held: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([x[0] for x in held], pa.string()), "part": pa.array([x[1] for x in held], pa.int32()),
            "automaton": pa.array([x[2] for x in held], pa.binary()),
        })

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(longest)
        for b in batches:
            for own, text in zip(b.column("lang").to_pylist(), values(b.column("text"))):
                if text:
                    shard.add(own, text)
                    if shard.held >= SHARD:
                        yield from rows(shard.automata(ranges))
        yield from rows(shard.automata(ranges))

    named = docs.select(F.coalesce(lang, F.lit(NO_LANG)).alias("lang"), "text")
    return named.mapInArrow(build, "lang string, part int, automaton binary")


def united_by_range(made: DataFrame, longest: int, least: int) -> DataFrame:
    """``lang, part, n, automaton``: the automata of each range united; ``n`` are the words that it counts, rare ones too."""

    def unite(found: pa.Table) -> pa.Table:
        automata = [Automaton.load(x) for x in values(found.column("automaton").combine_chunks())]
        n = sum(int(a.grams(1)[0][1].sum()) for a in automata)
        whole = united(automata, longest, least)
        return pa.table({
            "lang": found.column("lang")[:1], "part": found.column("part")[:1], "n": pa.array([n], pa.int64()),
            "automaton": pa.array([whole.dump()], pa.binary()),
        })

    return made.groupBy("lang", "part").applyInArrow(unite, "lang string, part int, n long, automaton binary")


def phrases(united_rows: DataFrame, longest: int, ranges: int) -> DataFrame:
    """``lang, phrase, a`` of all n-grams of two words and more, and for each cut ``k`` its two parts and their ranges."""
    kind = T.StructType.fromDDL(
        "lang string, phrase string, a long, k int, left string, left_part int, right string, right_part int"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data in zip(b.column("lang").to_pylist(), values(b.column("automaton"), 1)):
                automaton = Automaton.load(data)
                hashes = hashed(automaton.words)
                text = [w.decode() for w in automaton.words]
                for n, (own, weights) in enumerate(automaton.grams(longest), 1):
                    own, weights = own[weights > 0], weights[weights > 0]
                    joined = [" ".join(text[i] for i in row) for row in own.tolist()]
                    for k in range(1, n):
                        left, right = own[:, :k], own[:, k:]
                        yield pa.RecordBatch.from_pydict({
                            "lang": pa.array([lang] * len(own), pa.string()), "phrase": pa.array(joined, pa.string()),
                            "a": pa.array(weights, pa.int64()), "k": pa.array([k] * len(own), pa.int32()),
                            "left": pa.array([" ".join(text[i] for i in row) for row in left.tolist()], pa.string()),
                            "left_part": pa.array(ranges_of(left, hashes, ranges), pa.int32()),
                            "right": pa.array([" ".join(text[i] for i in row) for row in right.tolist()], pa.string()),
                            "right_part": pa.array(ranges_of(right, hashes, ranges), pa.int32()),
                        })

    return united_rows.select("lang", "automaton").mapInArrow(rows, kind)


def part_counts(cut: DataFrame, united_rows: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of each different part: the parts of a range, sorted, composed with its automaton."""
    asked = cut.select("lang", F.col("left").alias("phrase"), F.col("left_part").alias("part")).unionByName(
        cut.select("lang", F.col("right").alias("phrase"), F.col("right_part").alias("part"))
    ).distinct()

    def look_up(asked_rows: pa.Table, automata: pa.Table) -> pa.Table:
        parts = sorted(asked_rows.column("phrase").to_pylist())
        found = [0] * len(parts)
        if parts:
            automaton = Automaton.load(automata.column("automaton")[0].as_py())
            found = automaton.compose([p.encode().split(b" ") for p in parts])
        lang = pa.array(asked_rows.column("lang").to_pylist(), pa.string())
        return pa.table({"lang": lang, "phrase": pa.array(parts, pa.string()), "f": pa.array(found, pa.int64())})

    grouped = asked.groupBy("lang", "part"), united_rows.groupBy("lang", "part")
    return grouped[0].cogroup(grouped[1]).applyInArrow(look_up, "lang string, phrase string, f long")


def _whole(c: str, digits: int) -> Column:
    return F.col(c).cast(f"decimal({digits},0)")


def collocations(
    docs: DataFrame, lang: Column | str = "lang", longest: int = 3, least: int = 10, share: int = 50,
    top: int = 2_000, ranges: int | None = None,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language whose words occur together.

    Phrases have 2 to ``longest`` words and occur ``least`` times or more. Cut after k words, a phrase scores
    floor(10^6 a^2 / (l r)), l and r being the counts of its parts; its lowest cut counts, of equal ones the
    first. A phrase inside a longer one that has ``share`` percent of its occurrences is dropped. ``top``
    phrases a language come back, by score, then a, then the phrase's bytes.

    Null languages are ``und``; null and empty texts have no words; repeated rows count as often as they
    come; ids and other columns are not read. Very long texts are cut into words a slice at a time, at the
    ends of pieces. ``ranges`` grows with the text (one for each 8 million characters of it), so the
    automaton of a range has a size that doesn't. n-grams with a common prefix of two words share a
    range; no shorter prefix, however common, ties n-grams together.
    """
    lang = F.col(lang) if isinstance(lang, str) else lang
    if ranges is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        ranges = int(min(max(8, -(-chars // RANGE_CHARS)), MOST_RANGES))
    found = written(united_by_range(shards(docs, lang, longest, ranges), longest, least), "automata")
    cut = written(phrases(found, longest, ranges), "phrases")
    counts = written(part_counts(cut, found), "part-counts")

    left = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    million = F.lit(1_000_000).cast("decimal(7,0)")
    above, below = million * _whole("a", 15) * _whole("a", 15), _whole("l", 19) * _whole("r", 19)
    scored = scored.withColumns({"above": above, "below": below})
    best = scored.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut")
    )

    words = F.split("phrase", " ")
    whole = cut.where("k = 1").select("lang", "a", words.alias("w"))
    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("w") - 1),
        lambda m: F.transform(
            F.sequence(F.lit(1), F.size("w") - m + 1), lambda at: F.array_join(F.slice("w", at, m), " ")
        ),
    ))
    held = whole.where(F.size("w") > 2).select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))  # the first of each part, then of those: no task ranks a whole language
    first = kept.withColumn("salt", salt).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    ).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    n = found.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.where(F.col("rank") <= top).join(n, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

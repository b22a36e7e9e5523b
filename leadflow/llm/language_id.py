"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import values

UNDETERMINED = "und"
RANKS = 300  # n-grams of a profile
SALTS = 8
MAX_LANGUAGES = 1_000
GAP = 0x20  # what stands around words
LETTER = 21  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """A key for each letter, letter pair and letter triple of the words of a text; words have a gap on both sides.

    A key holds its one to three code points whole, so that no two n-grams share one.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, GAP)
    solid = np.ones(len(points), bool)
    solid[1:] = letter[1:] | letter[:-1]  # one gap between words
    points = np.concatenate([[GAP], points[solid], [GAP]])
    letter = points != GAP
    one = points[letter]
    two = ((points[:-1] << LETTER) | points[1:])[letter[:-1] | letter[1:]]
    three = ((points[:-2] << 2 * LETTER) | (points[1:-1] << LETTER) | points[2:])[letter[1:-1]]
    return np.concatenate([one, two, three])


def ranked(keys: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent keys, best first; of equal counts the smaller key comes first."""
    distinct, counts = np.unique(keys, return_counts=True)
    return distinct[np.argsort(-counts, kind="stable")[:ranks]]


class Profiles:
    """The ranks of each language's most frequent n-grams."""

    def __init__(self, languages: list[str], keys: list[list[int]], ranks: int = RANKS):
        self.languages, self.ranks = languages, ranks
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *map(np.asarray, keys)])).astype(np.int64)
        self.places = np.full((len(self.keys) + 1, len(languages)), -1, np.int64)  # the last row: in no profile
        for i, own in enumerate(keys):
            self.places[np.searchsorted(self.keys, np.asarray(own, np.int64)), i] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the smallest out-of-place distance, and one less that distance's share of the largest.

        Text without letters, or no profile to compare with, gives ``und`` and 0. Equal distances
        go to the language first in order.
        """
        own = ranked(grams(text), self.ranks)
        if not len(own) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys)) if len(self.keys) else np.zeros(len(own), int)
        places = self.places[at]
        off = np.where(places < 0, self.ranks, np.abs(places - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(off.argmin())
        return self.languages[best], float(1 - off[best] / (self.ranks * len(own)))


PENDING = 1 << 18  # n-grams of a language that wait to be added up


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, places = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.bincount(places, weights=np.concatenate([c for _, c in parts]), minlength=len(keys))
    return keys, n.astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of the partition for each language, a batch at a time."""
    for batch in batches:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: Counter[str] = Counter()
        for lang, text in zip(values(batch.column("lang")), values(batch.column("text"))):
            part = np.unique(grams(text), return_counts=True)
            kept.setdefault(lang, []).append(part)
            waiting[lang] += len(part[0])
            if waiting[lang] > PENDING:
                kept[lang], waiting[lang] = [_added(kept[lang])], 0
        for lang, own in kept.items():
            keys, n = _added(own)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys, "n": n}
            )


def learn(docs: DataFrame, ranks: int = RANKS) -> Profiles:
    """Profiles from all rows of ``docs`` (``text, lang``); rows with a null language or text teach nothing.

    n-grams are counted in the tasks, summed by Spark, and cut to the best of each language, first
    within salted parts. At most ``MAX_LANGUAGES`` profiles of ``ranks`` rows reach the driver.
    """
    counted = (
        docs.where("lang is not null").select("lang", "text")
        .mapInArrow(_counts, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    part = counted.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    best = part.withColumn(
        "place", F.expr("row_number() over (partition by lang, salt order by n desc, gram)")
    ).where(F.col("place") <= ranks)
    top = best.withColumn("rank", F.expr("row_number() over (partition by lang order by n desc, gram)")).where(
        F.col("rank") <= ranks
    )
    rows = top.select("lang", "rank", "gram").limit(MAX_LANGUAGES * ranks + 1).toArrow().to_pandas()
    if len(rows) > MAX_LANGUAGES * ranks:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = rows.sort_values(["lang", "rank"])
    languages = sorted(rows["lang"].unique())
    return Profiles(languages, [rows.loc[rows["lang"] == x, "gram"].tolist() for x in languages], ranks)


def prediction(profiles: Profiles, text: str | Column = "text") -> Column:
    """A struct of ``lang_pred`` and ``score`` (0 to 1) for each text."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(profiles)

    @F.arrow_udf("lang_pred string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        for batch in batches:
            said = [model.predict(t) for t in values(batch)]
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                ["lang_pred", "score"],
            )

    return of.asNondeterministic()(text)  # so that no filter makes Spark run it again


def in_fold(id_col: str | Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of ``folds``; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, learnt from the rows of the other folds.

    Rows with a null id are predicted, but neither held out nor learnt from. Null texts and texts
    without a letter are ``und`` with score 0. Repeated rows come back as often as they came.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), "text", "lang")
    profiles = learn(own.where(F.col("doc_id").isNotNull() & ~in_fold("doc_id")))
    said = own.select("doc_id", in_fold("doc_id").alias("held_out"), prediction(profiles).alias("said"))
    return said.select("doc_id", "held_out", "said.lang_pred", "said.score")

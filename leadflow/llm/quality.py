"""Quality classifier: cumulative-link regression on graded ratings over hashed words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import values

BUCKETS = 1 << 30
SAMPLE = 20_000  # labelled rows that a fit takes at most
SUPPORT = 4  # rated texts that must have a bucket
SCREEN = 6.0  # standard deviations by which a bucket's grades must differ from all words'


class _Memo(dict):
    """A word's value, found once; emptied when it has grown, so that a task's memory stays bounded."""

    def __init__(self, find: Callable[[bytes], float], most: int = 1_000_000):
        super().__init__()
        self.find, self.most = find, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = self.find(word)
        return value


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def words_of(text: str | None) -> set[bytes]:
    """A text's different words (A-Z lower-cased, cut at blanks), whole and without signs at the ends."""
    words = set((text or "").encode("utf-8", "replace").lower().split())
    words |= {w.strip(b".,;:!?\"'()") for w in words}
    words.discard(b"")
    return words


def hashed(text: str | None, buckets: Mapping[bytes, int]) -> np.ndarray:
    words = words_of(text)
    return np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(threshold k - score): one score for all grades, thresholds in order.

    Only ``kept`` buckets, in order, have a weight.
    """

    kept: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def weight(self, word: bytes) -> float:
        b = bucket(word)
        at = int(np.searchsorted(self.kept, b))
        return float(self.weights[at]) if at < len(self.kept) and self.kept[at] == b else 0.0

    def grades(self, score: np.ndarray) -> np.ndarray:
        """The probability of each grade, one row for each score."""
        upto = _sigmoid(self.thresholds - np.asarray(score, float)[:, None])
        edge = np.zeros((len(upto), 1))
        return np.diff(np.concatenate([edge, upto, edge + 1], axis=1), axis=1)


def screened(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """The buckets that say something: enough texts have them, and the words of some grade have them by ``SCREEN``
    standard deviations more or less often than all words have."""
    if not rows:
        return np.zeros(0, np.int64)
    of = [np.concatenate([np.zeros(0, np.int64), *[r for r, g in zip(rows, grades) if g == k]]) for k in range(n_grades)]
    total = max(1, sum(map(len, of)))
    distinct = [np.unique(x, return_counts=True) for x in of]
    all_ = np.unique(np.concatenate([d for d, _ in distinct])).astype(np.int64)
    seen = np.zeros((n_grades, len(all_)))
    for k, (d, n) in enumerate(distinct):
        seen[k, np.searchsorted(all_, d)] = n
    count = seen.sum(axis=0)
    share = np.array([len(x) for x in of])[:, None] / total
    z = np.abs(seen - count * share) / np.sqrt(np.maximum(count * share * (1 - share), 1e-9))
    return all_[(count >= SUPPORT) & (z.max(axis=0, initial=0) >= SCREEN)]


def train(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, rounds: int = 300, ridge: float = 1e-5,
    step: float = 0.05, balance: float = 0.5,
) -> OrdinalModel:
    """The model of least penalised deviance over screened buckets, by full-batch adaptive gradient steps.

    A text's score is the sum of its buckets' weights. Grades weigh by their share to the power of ``-balance``:
    0 leaves them as they are, 1 makes them even.

    Thresholds are a first one and positive gaps. Without rows the thresholds give all grades about an even chance.
    """
    k = n_grades - 1
    gaps = np.concatenate([[-0.5 * k], np.full(k - 1, 1.0)]) if k else np.zeros(0)
    free = np.concatenate([[gaps[0]], np.log(gaps[1:])]) if k else gaps  # a first threshold, logs of gaps
    kept = screened(rows, grades, n_grades)
    weights = np.zeros(len(kept))
    if len(rows):
        found = [np.searchsorted(kept, r[np.isin(r, kept)]) for r in rows]
        flat = np.concatenate(found).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        share = np.bincount(grades, minlength=n_grades)
        weight = ((len(rows) / np.maximum(share, 1)) ** balance)[grades]
        weight /= weight.sum()
        moments = [np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(k), np.zeros(k)]
        at = np.arange(len(rows))
        for t in range(1, rounds + 1):
            theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
            score = np.bincount(row, weights=weights[flat], minlength=len(rows))
            upto = np.concatenate(
                [np.zeros((len(rows), 1)), _sigmoid(theta - score[:, None]), np.ones((len(rows), 1))], axis=1
            )
            slope = upto * (1 - upto)
            p = np.maximum(upto[at, grades + 1] - upto[at, grades], 1e-12)
            d_score = weight * (slope[at, grades + 1] - slope[at, grades]) / p
            d_theta = np.zeros(n_grades + 1)
            np.add.at(d_theta, grades + 1, -weight * slope[at, grades + 1] / p)
            np.add.at(d_theta, grades, weight * slope[at, grades] / p)
            inner = d_theta[1:-1]
            d_free = np.concatenate([[inner.sum()], [inner[i:].sum() * np.exp(free[i]) for i in range(1, k)]])
            d_weights = np.bincount(flat, weights=d_score[row], minlength=len(kept)) + ridge * weights
            for x, g, (m, v) in ((weights, d_weights, (0, 1)), (free, d_free, (2, 3))):
                moments[m] = 0.9 * moments[m] + 0.1 * g
                moments[v] = 0.999 * moments[v] + 0.001 * g * g
                x -= step * (moments[m] / (1 - 0.9**t)) / (np.sqrt(moments[v] / (1 - 0.999**t)) + 1e-8)
    theta = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])) if k else np.zeros(0)
    return OrdinalModel(kept, weights, theta)


def grade(quality: str | Column = "quality", toxic: str | Column = "toxic") -> Column:
    """0: toxic, 1: of low quality, 2: good; null if both ratings are null."""
    q, t = (F.col(c) if isinstance(c, str) else c for c in (quality, toxic))
    rated = F.when(t == 1, 0).when(q == 0, 1).when(q == 1, 2).when(t == 0, 2)
    return rated.cast("int")


def fit(
    docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", **options,
) -> OrdinalModel:
    """The model from rated texts (``ratings``: id, ``grade``).

    At most ``sample`` ratings are taken, those of the smallest hashes of their ids, which is a
    documented bound: they are the broadcast side of the join, and the buckets of at most ``sample`` of their
    different texts the only rows that reach the driver. Of several ratings of an id the lowest grade counts. Null ids, null grades
    and grades that are not in 0 .. n_grades - 1 are left out.
    """
    usable = ratings.where(F.col(id_col).isNotNull() & F.col("grade").between(0, n_grades - 1))
    chosen = (
        usable.groupBy(F.col(id_col).alias("rated_id")).agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample)
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = _Memo(bucket)
        for batch in batches:
            yield pd.DataFrame({
                "rated_id": batch["rated_id"], "grade": batch["grade"], "h": batch["h"],
                "buckets": [hashed(t, buckets).astype("<i4").tobytes() for t in batch["text"]],
            })

    own = docs.select(F.col(id_col).alias("rated_id"), F.xxhash64("text").alias("h"), "text")
    once = own.join(F.broadcast(chosen), "rated_id").dropDuplicates(["rated_id", "h"])  # in each task first
    rows = once.orderBy("rated_id", "h").limit(sample).mapInPandas(
        run, "rated_id long, grade int, h long, buckets binary"
    ).toArrow().to_pandas().sort_values(["rated_id", "h"])
    own_buckets = [np.frombuffer(b, "<i4") for b in rows["buckets"]]
    return train(own_buckets, rows["grade"].to_numpy(np.int64), n_grades, **options)


def judgement(model: OrdinalModel, text: str | Column = "text") -> Column:
    """A struct of each text's ``expected`` grade, ``tail`` (the probability of the highest grade) and ``lowest`` (of grade 0)."""
    held = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("expected double, tail double, lowest double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = held.value
        weights = _Memo(fitted.weight)
        for batch in batches:
            p = fitted.grades(np.array([sum(map(weights.__getitem__, words_of(t))) for t in values(batch)]))
            yield pa.StructArray.from_arrays(
                [pa.array(x) for x in (p @ np.arange(p.shape[1]), p[:, -1].copy(), p[:, 0].copy())],
                ["expected", "tail", "lowest"],
            )

    return of.asNondeterministic()(text)


def classify(
    docs: DataFrame, ratings: DataFrame, least_tail: float = 0.5, id_col: str = "doc_id", **options
) -> DataFrame:
    """``doc_id, expected, tail, lowest, grade, selected`` of every row, by a model fitted on the rated ones.

    ``grade`` is the most likely grade, the lower of equal ones; ``selected`` are the rows whose highest grade has
    at least probability ``least_tail``. Null and empty texts have no words and take the thresholds' grades.
    Repeated rows come back as often as they came, and are learnt once.
    """
    model = fit(docs, ratings, id_col=id_col, **options)
    said = docs.select(F.col(id_col).alias("doc_id"), judgement(model).alias("said")).select("doc_id", "said.*")
    between = 1 - F.col("tail") - F.col("lowest")
    likely = (
        F.when((F.col("lowest") >= between) & (F.col("lowest") >= F.col("tail")), 0)
        .when(between >= F.col("tail"), 1).otherwise(2)
    )
    return said.withColumn("grade", likely).withColumn("selected", F.col("tail") >= least_tail)

"""Predictions on leads and texts, insight requests, drift of a value.

A predictor is a function on batches, ``Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]``.
Spark repeats failed tasks, so calls to a service must be safe to repeat.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.rules import polarity, priority, tier
from leadflow.schemas import struct_type

FEATURES = ["age", "engagement_score", "page_views"]

Predictor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Answer codes of an insight request that stand for "no rows".
NO_INSIGHT_CODES = (102, 204, 402)

# Default words of the offline sentiment score.
POSITIVE_WORDS = ["good", "great", "excellent", "happy", "helpful", "love", "easy", "fast", "thanks"]
NEGATIVE_WORDS = ["bad", "poor", "terrible", "unhappy", "useless", "hate", "hard", "slow", "problem"]


def predict(
    df: DataFrame, features: Sequence[str], predictor: Predictor, outputs: str, once: bool = False
) -> DataFrame:
    """Add the predictor's output columns (DDL) to every row.

    Only the features travel to Python; all other columns stay in the JVM. A later
    filter on an output makes Spark predict again to apply it early. Say ``once`` for a
    costly predictor; then no later filter at all moves in front of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from predictor(batches)

    kind = struct_type(outputs)
    udf = F.pandas_udf(run, kind)
    udf = udf.asNondeterministic() if once else udf
    scored = df.withColumn("_prediction", udf(F.struct(*features)))
    return scored.select(*[c for c in df.columns if c not in kind.names], "_prediction.*")


def logistic_predictor(weights: dict[str, float], intercept: float, digits: int = 6) -> Predictor:
    """A fixed logistic model as a batch predictor, output ``lead_score``."""

    def run(batches):
        for batch in batches:
            z = sum(batch[f].astype(float) * w for f, w in weights.items()) + intercept
            yield pd.DataFrame({"lead_score": (1 / (1 + np.exp(-z))).round(digits)})

    return run


def logistic_score(weights: dict[str, float], intercept: float, digits: int = 6) -> Column:
    """The same model as a column, for rows that should not leave the JVM."""
    terms = [F.col(f).cast("double") * w for f, w in weights.items()]
    z = reduce(lambda a, b: a + b, terms) + intercept
    return F.round(1 / (1 + F.exp(-z)), digits)


def predict_with_model(df: DataFrame, model: PipelineModel, out: str = "lead_score") -> DataFrame:
    """Score with a fitted Spark ML pipeline: the probability of class 1.

    Use a saved and loaded model. A model just fitted keeps its training summary,
    which Spark cannot send to the executors once the session has observed a query.
    """
    made = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return made.select(*[c for c in df.columns if c != out], out)


def lexicon_score(
    text: Column, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS
) -> Column:
    """Balance of positive and negative words from -1 to 1; 0 without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def hits(vocabulary: Sequence[str]) -> Column:
        known = F.array(*[F.lit(w) for w in vocabulary])
        return F.size(F.filter(words, lambda w: F.array_contains(known, w)))

    good, bad = hits(positive), hits(negative)
    # The maximum keeps the divisor above zero when no word is known.
    balance = (good - bad) / F.greatest(good + bad, F.lit(1))
    return F.when(text.isNotNull(), balance)


def lead_scores(
    leads: DataFrame, predictor: Predictor, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Scores of processed leads."""
    return predict(leads.filter(F.col("processed")), features, predictor, "lead_score double")


def prioritised(leads: DataFrame) -> DataFrame:
    """Leads (``lead_id, name, lead_score, sentiment_score``) with label, tier and final priority."""
    return leads.select(
        "lead_id", "name", "lead_score", "sentiment_score",
        polarity(F.col("sentiment_score")).alias("sentiment_label"),
        tier(F.col("lead_score")).alias("tier"),
        priority(F.col("lead_score"), F.col("sentiment_score")).alias("final_priority"),
    )


def ask_service(
    insight_id: str,
    fetch: Callable[[str, str, list[str]], tuple[int, list[dict]]],
    partitions: int,
    max_ids: int = 1_000,
) -> Callable[[DataFrame], DataFrame]:
    """A function from entities to a service's answers: ``entity_id, code, body``.

    ``fetch(client, insight_id, entity_ids)`` returns a code and rows. Entities are
    spread by id, whatever their client, and each request holds ids of one client,
    ``max_ids`` at most. ``partitions`` is the number of requests at a time, which the service sets.
    """

    def ask(client: str, ids: list[str]) -> pd.DataFrame:
        code, rows = fetch(client, insight_id, ids)
        # A request that gave no rows is answered for its first entity alone.
        entities = [r["entity_id"] for r in rows] if code == 200 else ids[:1]
        bodies = [json.dumps(r) for r in rows] if code == 200 else [None]
        return pd.DataFrame(
            {"entity_id": entities, "code": [code] * len(entities), "body": bodies}, dtype=object
        )

    def run(batches):
        client, ids = None, []
        for batch in batches:
            for next_client, entity in zip(batch["client"], batch["entity_id"]):
                if ids and (next_client != client or len(ids) == max_ids):
                    yield ask(client, ids)
                    ids = []
                client = next_client
                ids.append(entity)
        if ids:
            yield ask(client, ids)

    def answers(pending: DataFrame) -> DataFrame:
        # Spread first: the distinct then needs no shuffle of its own.
        return (
            pending.select("client", "entity_id")
            .repartition(partitions, "client", "entity_id")
            .distinct()
            .sortWithinPartitions("client")
            .mapInPandas(run, "entity_id string, code int, body string")
        )

    return answers


def insight_bodies(answers: DataFrame, insight_id: str) -> DataFrame:
    """``entity_id, body`` of the answers that have rows; an answer that is neither rows
    nor "no rows" ends the job."""
    failure = F.raise_error(F.concat(
        F.lit(f"{insight_id} answer for "), F.col("entity_id"), F.lit(": code "),
        F.col("code").cast("string"),
    ))
    empty = F.col("code").isin(*NO_INSIGHT_CODES)
    body = F.when(F.col("code") == 200, F.col("body")).when(~F.coalesce(empty, F.lit(False)), failure)
    return answers.select("entity_id", body.alias("body")).filter(F.col("body").isNotNull())


def value_bucket(value: Column, low: float, high: float, buckets: int) -> Column:
    """Equal-width bucket 0..n-1; -1 and n hold what lies outside."""
    place = F.floor((value - low) / (high - low) * buckets)
    return F.least(F.greatest(place, F.lit(-1)), F.lit(buckets))


def drift(
    df: DataFrame, is_reference: Column, bucket: Column, by: Sequence[str], floor: float = 1e-4
) -> DataFrame:
    """Population stability index of a value per group, reference against the rest.

    One pass counts both periods per bucket; only those few counts go on. An empty
    bucket takes the share ``floor``.
    """
    counts = df.groupBy(*by, bucket.alias("bucket")).agg(
        F.count_if(is_reference).alias("r"), F.count_if(~is_reference).alias("c")
    )
    # The window holds one row per bucket of a group.
    group = Window.partitionBy(*by)
    shares = counts.select(
        *by,
        F.greatest(F.col("r") / F.sum("r").over(group), F.lit(floor)).alias("r"),
        F.greatest(F.col("c") / F.sum("c").over(group), F.lit(floor)).alias("c"),
    )
    part = (F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))
    return shares.groupBy(*by).agg(F.sum(part).alias("psi"))

"""Priorities of leads as scores and feedback arrive, in whatever order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadflow.operators.scoring import lexicon_score, prioritised
from leadflow.schemas import struct_type
from leadflow.sinks.keyed import KeyedTable

PRIORITIES = (
    "lead_id bigint, name string, lead_score double, sentiment_score double, sentiment_label string, tier string, "
    "final_priority string"
)


def lead_state(scores: DataFrame, feedback: DataFrame) -> DataFrame:
    """``lead_id, scored, mood`` by lead: the newest score with its name, and the mean of all feedback scores.

    ``scores`` has ``lead_id, name, lead_score, scored_at``, ``feedback`` has ``lead_id, mood``. Both are
    one stream of events, so the state is one row for each lead, whichever side came first; it grows with
    leads, not with events. Tasks add up their own events before they are dealt by lead.
    """
    scored = F.struct("name", "lead_score")
    none = F.lit(None)
    events = scores.select("lead_id", scored.alias("scored"), "scored_at", none.cast("double").alias("mood")).unionByName(
        feedback.select(
            "lead_id", none.cast("struct<name:string,lead_score:double>").alias("scored"),
            none.cast("timestamp_ntz").alias("scored_at"), "mood",
        )
    )
    return events.groupBy("lead_id").agg(
        F.max_by("scored", "scored_at").alias("scored"), F.avg("mood").alias("mood")
    )


def stream_priority(
    spark: SparkSession,
    scores: str,
    scores_schema: str | T.StructType,
    feedback: str,
    feedback_schema: str | T.StructType,
    out: KeyedTable,
    checkpoint: str,
    score: Callable = lexicon_score,
    files_per_batch: int = 1_000,
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the priorities of all scored leads in ``out`` as files of scores and of feedback arrive.

    A batch puts new rows for the leads that it changed and for no others. A batch that is repeated puts the same
    rows again. Feedback that comes before its lead's score waits in the state. Texts that
    are processed already are left out, as in the batch job.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    scored = reader.schema(struct_type(scores_schema)).parquet(scores)
    texts = reader.schema(struct_type(feedback_schema)).parquet(feedback).filter(~F.col("sentiment_processed"))
    moods = texts.select("lead_id", score(F.col("feedback_text")).alias("mood"))

    def put(changed: DataFrame, number: int) -> None:
        known = changed.filter(F.col("scored").isNotNull()).select(
            "lead_id", "scored.*", F.round("mood", 6).alias("sentiment_score")
        )
        out.merge(prioritised(known))

    writer = lead_state(scored, moods).writeStream.outputMode("update").foreachBatch(put).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()

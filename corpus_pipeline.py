"""The corpus pipeline: five stages from raw documents to a weighted mix, each a job of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm import decontaminate, language_id, mixing, secret_scan, simhash
from leadflow.llm.common import table, written
from leadflow.llm.queries import MIX_WEIGHTS, mix_domain


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the corpus's languages: those without letters (null and empty texts too) are rejected, and those
    that have nothing in common with any language's profile, such as texts of a script that none is written in.

    A document whose ``lang`` is null gets the predicted language; given ones stay.
    """
    profiles = language_id.learn(docs.where(F.col("doc_id").isNotNull() & ~language_id.in_fold("doc_id")))
    said = docs.select(F.struct("*").alias("row"), language_id.prediction(profiles).alias("said"))
    known = said.where((F.col("said.lang_pred") != language_id.UNDETERMINED) & (F.col("said.score") > 0))
    out = [
        (F.coalesce(F.col("row.lang"), F.col("said.lang_pred")) if c == "lang" else F.col("row").getField(c)).alias(c)
        for c in docs.columns
    ]
    return known.select(*out)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id."""
    return simhash.keep_one(docs, words=3, distance=3)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages, which are cut out; documents that were nothing else go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mark."""
    return secret_scan.redact(docs)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: a row for each epoch of a document, its text cut where only its first tokens are taken."""
    picked = mixing.mix(docs, mix_domain(), MIX_WEIGHTS, share=0.5, max_epochs=4, seed=7, carry=["text"])
    return picked.withColumn("text", mixing.taken_text("text", "n_tokens", "n_taken"))


STAGES = [
    ("language_id", language), ("simhash_dedup", near_duplicates), ("decontamination", decontamination),
    ("secret_scan", secrets), ("mixing", mix),
]

#: No stage but the last can be said in SQL: rank profiles, SimHash, and the randomness tests are not.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

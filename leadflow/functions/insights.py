"""Wide insight bodies (one JSON key per client or corpus) to nested scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.schemas import insight_table, table_schema


def score_array(body: Column, label: str, whole: bool) -> Column:
    """``{"entity_id": .., "a": 1.9}`` to ``[(a, 1)]`` or, not whole, ``[(a, 1.9)]``.

    A null score stays null; a body that is no object, and a score that is no number, end the job.
    """
    keys = F.from_json(body, "map<string,string>", {"mode": "FAILFAST"})
    entries = F.map_entries(F.map_filter(keys, lambda k, v: k != "entity_id"))

    def entry(e: Column) -> Column:
        score = e["value"].try_cast("double")
        no_number = F.raise_error(F.concat(
            F.lit("score "), e["key"], F.lit(" is no number: "), e["value"]
        ))
        lost = e["value"].isNotNull() & (score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")))
        score = F.when(lost, no_number.cast("double")).otherwise(score)
        return F.struct(e["key"].alias(label), score.cast("int" if whole else "double").alias("score"))

    return F.transform(entries, entry)


def is_readable(body: Column, insight_id: str) -> Column:
    """Whether ``reshape_insight`` can read a body."""
    if insight_id in ("match-score", "adopt-curve"):
        values = F.map_values(F.map_filter(F.from_json(body, "map<string,string>"), lambda k, v: k != "entity_id"))

        def number(v: Column) -> Column:
            score = v.try_cast("double")
            limit = 2.0**31 if insight_id == "match-score" else float("inf")
            return v.isNull() | (~F.isnan(score) & (F.abs(score) < limit))

        readable = F.forall(values, lambda v: F.coalesce(number(v), F.lit(False)))
    else:
        wire = f"{_ddl(insight_id)}, _corrupt string"
        parsed = F.from_json(body, wire, {"columnNameOfCorruptRecord": "_corrupt"})
        readable = parsed["_corrupt"].isNull()
    return F.coalesce(readable & F.json_object_keys(body).isNotNull(), F.lit(False))


def match_scores(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("scores", score_array(F.col(body), "client", whole=True)).drop(body)


def adopt_curve(df: DataFrame, body: str = "body") -> DataFrame:
    return df.withColumn("scores", score_array(F.col(body), "corpus", whole=False)).drop(body)


def _fields(insight_id: str):
    return [
        f for f in table_schema(insight_table(insight_id)).fields
        if f.name not in ("entity_id", "ingestion_timestamp")
    ]


def _ddl(insight_id: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _fields(insight_id))


def reshape_insight(df: DataFrame, insight_id: str, body: str = "body") -> DataFrame:
    """Turn one fetched body per row into the columns of the insight's table.

    The two score insights become nested arrays; the others keep their fields. An unreadable
    body ends the job; set it aside before with ``is_readable``.
    """
    if insight_id == "match-score":
        return match_scores(df, body)
    if insight_id == "adopt-curve":
        return adopt_curve(df, body)
    parsed = F.from_json(F.col(body), _ddl(insight_id), {"mode": "FAILFAST"})
    return df.withColumns({f.name: parsed[f.name] for f in _fields(insight_id)}).drop(body)

"""Declared table schemas (DDL) and the fixed names that belong to them."""

from __future__ import annotations

from pyspark.sql import types as T

# Column lists of the two exported tables.
EXPORT_COLUMNS = {
    "staging.zleads": [
        "client", "first_name", "last_name", "email", "email2", "email3", "phone", "phone2",
        "phone3", "twitter", "city", "state", "zip", "country", "gender", "age",
    ],
    "staging.contacts": [
        "client", "first_name", "last_name", "email", "email2", "email3", "phone", "phone2",
        "phone3", "twitter", "city", "state", "zip", "country",
    ],
}

# The insights that are refreshed.
INSIGHT_IDS = [
    "match-score", "persuasion", "relationship-fit", "channel", "adopt-curve", "archetypes",
]

# Fields of an uploaded contact and the JSON type each must have.
CONTACT_FIELDS = {
    "id": "BIGINT",
    "first_name": "STRING", "last_name": "STRING",
    "email": "STRING", "email2": "STRING", "email3": "STRING",
    "phone": "STRING", "phone2": "STRING", "phone3": "STRING",
    "twitter": "STRING", "city": "STRING", "state": "STRING", "zip": "STRING",
    "country": "STRING",
}
CONTACT_REQUIRED = ["id", "first_name", "last_name"]

TABLES = {
    "lake.contacts": (
        "id bigint, first_name string, last_name string, email string, email2 string, "
        "email3 string, phone string, phone2 string, phone3 string, twitter string, "
        "city string, state string, zip string, country string, client string, "
        "ingestion_timestamp timestamp_ntz"
    ),
    "entities": (
        "entity_id string, email string, phone string, twitter string, client string, "
        "file string, ingestion_timestamp timestamp_ntz"
    ),
    "match_score": (
        "entity_id string, scores array<struct<client:string,score:int>>, "
        "ingestion_timestamp timestamp_ntz"
    ),
    "adopt_curve": (
        "entity_id string, scores array<struct<corpus:string,score:double>>, "
        "ingestion_timestamp timestamp_ntz"
    ),
    "persuasion": "entity_id string, persuasion array<string>, ingestion_timestamp timestamp_ntz",
    "channel": "entity_id string, preferences array<string>, ingestion_timestamp timestamp_ntz",
    "relationship_fit": "entity_id string, prediction string, ingestion_timestamp timestamp_ntz",
    "archetypes": "entity_id string, archetype string, ingestion_timestamp timestamp_ntz",
    "data_source_status": (
        "client string, file string, src_table string, status string, "
        "start_date timestamp_ntz, end_date timestamp_ntz"
    ),
    "checkpoint": "dag_id string, src_table string, checkpoint timestamp_ntz",
}


def struct_type(ddl: str | T.StructType) -> T.StructType:
    """The StructType of a DDL text; a StructType passes through."""
    return ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)


def table_schema(name: str) -> T.StructType:
    return struct_type(TABLES[name])


def insight_table(insight_id: str) -> str:
    """Destination table of an insight id: dashes become underscores."""
    return insight_id.replace("-", "_")

"""JSON texts as typed records: change lines, entity bodies, contact uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.contacts import contact_errors, contact_fields, contact_values
from leadflow.functions.records import text_schema
from leadflow.functions.timestamps import utc_now
from leadflow.operators.status import one_answer
from leadflow.schemas import struct_type

# Answers that stand for "nothing there yet".
EMPTY_ENTITY_CODES = (102, 204)
NO_DATA_ERROR = "No Data Found"


def decode_json(df: DataFrame, schema: str | T.StructType, text: str = "text") -> DataFrame:
    """Add the record of each JSON line, dates still as text, and ``_error``.

    ``_error`` names a line without text, that is no JSON object, whose values do not
    fit, or with top-level fields that the schema does not have; null for a good line.
    """
    target = text_schema(struct_type(schema))
    wire = T.StructType([*target.fields, T.StructField("_corrupt", T.StringType())])
    known = F.array(*[F.lit(n) for n in target.names])
    record = F.from_json(F.col(text), wire, {"columnNameOfCorruptRecord": "_corrupt"})
    extras = F.array_except(F.json_object_keys(F.col(text)), known)
    error = (
        F.when(F.col(text).isNull(), "not decrypted")
        .when(F.col("_record").isNull() | F.col("_record._corrupt").isNotNull(), "bad json")
        .when(extras.isNull(), "not an object")
        .when(F.size(extras) > 0, F.concat(F.lit("unknown "), F.array_join(extras, ", ")))
    )
    decoded = df.withColumn("_record", record).withColumn("_error", error)
    return decoded.withColumn("_record", F.col("_record").dropFields("_corrupt"))


def strict(df: DataFrame) -> DataFrame:
    """End the job at the first line with an ``_error``."""
    checked = F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")))
    return df.withColumn("_record", F.coalesce(checked, F.col("_record"))).drop("_error")


def entity_answer(code: Column, body: Column) -> Column:
    """``ok``, ``empty`` or ``error`` for an answer to an entity request."""
    no_data = (code == 400) & (F.get_json_object(body, "$.error") == NO_DATA_ERROR)
    return (
        F.when(code == 200, "ok")
        .when(code.isin(*EMPTY_ENTITY_CODES) | no_data, "empty")
        .otherwise("error")
    )


def reported_status(answers: DataFrame) -> DataFrame:
    """Status per file of job answers (``file, code, body``), ``UNKNOWN`` without one.

    Any code but 200 ends the job; such a file must not be closed as unknown.
    """
    failure = F.raise_error(F.concat(
        F.lit("status answer for "), F.col("file"), F.lit(": "), F.col("code").cast("string")
    ))
    status = F.coalesce(F.get_json_object("body", "$.status"), F.lit("UNKNOWN"))
    time = ["answered_at"] if "answered_at" in answers.columns else []
    return answers.select(
        "file", F.when(F.col("code") == 200, status).otherwise(failure).alias("status"), *time
    )


_ENTITY_BODY = "array<struct<entity_id:string,email:string,phone:string,twitter:string>>"


def entities_from_answers(answers: DataFrame, files: DataFrame, now=None) -> DataFrame:
    """Entity rows of the files' answers (``file, code, body``), one answer per file.

    An answer that is neither rows nor "nothing there" ends the job.
    """
    verdict = entity_answer(F.col("code"), F.col("body"))
    failure = F.raise_error(F.concat(
        F.lit("entity answer for "), F.col("file"), F.lit(": "), F.col("code").cast("string")
    ))
    rows = F.when(verdict == "ok", F.from_json("body", _ENTITY_BODY, {"mode": "FAILFAST"})).when(
        verdict == "error", failure.cast(_ENTITY_BODY)
    )
    return (
        files.select("client", "file")
        .join(one_answer(answers), "file")
        .select("client", "file", F.explode(rows).alias("e"))
        .select("e.*", "client", "file")
        .withColumn("ingestion_timestamp", utc_now(now))
    )


def contact_rows(uploads: DataFrame, body: str = "body") -> DataFrame:
    """One row per contact of uploaded ``{"contacts": [..]}`` bodies.

    A body without the ``contacts`` list gives one row without a contact.
    """
    listed = F.from_json(
        F.get_json_object(F.col(body), "$.contacts"), "array<string>", {"mode": "PERMISSIVE"}
    )
    return uploads.withColumn("contact", F.explode_outer(listed)).drop(body)


def check_contacts(contacts: DataFrame, contact: str = "contact") -> DataFrame:
    """Replace contact texts by their fields plus ``_errors``."""
    errors = F.when(F.col(contact).isNull(), F.array(F.lit("no contact"))).otherwise(
        contact_errors(F.col("_values"))
    )
    # Mistyped values of a rejected contact are not read at all.
    values = contacts.withColumn("_values", contact_values(F.col(contact)))
    checked = values.withColumn("_errors", errors)
    fields = F.when(F.size("_errors") == 0, contact_fields(F.col(contact)))
    return checked.withColumn("_c", fields).select(
        *[c for c in contacts.columns if c != contact], "_c.*", "_errors"
    )


def accept_batches(checked: DataFrame, batch: str) -> DataFrame:
    """Only the contacts of batches in which every contact is valid.

    The faulty batches are reduced to distinct ids before they are joined, so a
    very large batch stays spread over many tasks. The frame is used twice: hand over a
    written one, so that no body is parsed again.
    """
    faulty = checked.filter(F.size("_errors") > 0).select(batch).distinct()
    return checked.join(faulty, batch, "left_anti").drop("_errors")

"""Checks of uploaded contacts, as columns over their JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.schemas import CONTACT_FIELDS, CONTACT_REQUIRED


def contact_values(body: Column) -> Column:
    """Field name to value, untyped; null when the text is no JSON object.

    Put it in a column of its own, so that each text is parsed once.
    """
    return F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")


def contact_errors(values: Column) -> Column:
    """Array of what is wrong with one contact's values; empty when it is valid."""

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_element_at(values, F.lit(field)))

    missing = [
        F.when(F.coalesce(kind(f), F.lit("VOID")) == "VOID", F.lit(f"missing {f}"))
        for f in CONTACT_REQUIRED
    ]
    mistyped = [
        F.when(~kind(f).isin(wanted, "VOID"), F.lit(f"{f} is not {wanted.lower()}"))
        for f, wanted in CONTACT_FIELDS.items()
    ]
    known = F.array(*[F.lit(f) for f in CONTACT_FIELDS])
    unknown = F.transform(
        F.array_except(F.map_keys(values), known), lambda k: F.concat(F.lit("unknown "), k)
    )
    errors = F.concat(F.array_compact(F.array(*missing, *mistyped)), unknown)
    return F.when(values.isNull(), F.array(F.lit("not an object"))).otherwise(errors)


def contact_fields(body: Column) -> Column:
    """The contact as a struct. Read it only where there are no errors."""
    ddl = ", ".join(f"{name} {kind.lower()}" for name, kind in CONTACT_FIELDS.items())
    return F.from_json(body, ddl)

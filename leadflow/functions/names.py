"""Id lists and the parts of table, file and export names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_id_list(text: Column) -> Column:
    """Only digits and commas."""
    return ~text.rlike("[^0-9,]")


def id_list(text: Column) -> Column:
    """``3,1,,3,2`` to ``[3, 1, 2]``; null when the text is no id list.

    Equal texts collapse before the conversion, so ``1,01`` keeps both.
    """
    parts = F.array_distinct(F.filter(F.split(text, ","), lambda p: p != ""))
    return F.when(is_id_list(text), F.transform(parts, lambda p: p.cast("bigint")))


def export_name(table: Column, client: Column, file: Column) -> Column:
    return F.concat_ws("-", table, client, file)


def export_client(name: Column) -> Column:
    """The client inside an export name. A client with a dash is cut short here;
    readers of an export take the client from its partition folder instead."""
    return F.split_part(name, F.lit("-"), F.lit(2))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(
        F.startswith(text, F.lit(prefix)), F.substr(text, F.lit(len(prefix) + 1))
    ).otherwise(text)


def relative_name(path: Column, prefix: str) -> Column:
    """File name below a prefix; null for the prefix folder itself."""
    name = F.replace(path, F.lit(f"{prefix}/"), F.lit(""))
    return F.when(name != "", name)


def pseudonym(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def numeric_suffix(name: Column) -> Column:
    """Number after the last dash; null when that part is not all digits."""
    tail = F.substring_index(name, "-", -1)
    return F.when(tail.rlike("^[0-9]+$"), tail.try_cast("bigint"))


def file_order(name: Column) -> list[Column]:
    """Sort columns for files: by numeric suffix, then the others by name."""
    return [numeric_suffix(name).asc_nulls_last(), name.asc()]

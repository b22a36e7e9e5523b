"""Schema walks: change the leaves of nested records in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions import timestamps as ts
from leadflow.schemas import struct_type

Leaf = Callable[[Column, T.DataType], "Column | None"]

_TIMES = (T.TimestampNTZType, T.TimestampType, T.DateType)


def map_leaves(value: Column, kind: T.DataType, leaf: Leaf) -> Column | None:
    """The value with every leaf mapped, or None when nothing in it changes."""
    if isinstance(kind, T.StructType):
        parts = {f.name: map_leaves(value.getField(f.name), f.dataType, leaf) for f in kind}
        if all(p is None for p in parts.values()):
            return None
        kept = [
            (value.getField(name) if part is None else part).alias(name)
            for name, part in parts.items()
        ]
        return F.when(value.isNotNull(), F.struct(*kept))
    if isinstance(kind, T.ArrayType):
        if map_leaves(F.lit(None), kind.elementType, leaf) is None:
            return None
        return F.transform(value, lambda e: map_leaves(e, kind.elementType, leaf))
    if isinstance(kind, T.MapType):
        if map_leaves(F.lit(None), kind.valueType, leaf) is None:
            return None
        return F.transform_values(value, lambda _, v: map_leaves(v, kind.valueType, leaf))
    return leaf(value, kind)


def map_record(df: DataFrame, leaf: Leaf) -> DataFrame:
    changed = {}
    for field in df.schema:
        column = map_leaves(F.col(f"`{field.name}`"), field.dataType, leaf)
        if column is not None:
            changed[field.name] = column
    return df.withColumns(changed) if changed else df


def stringify_times(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Dates and times to text, texts with a zero date to null, at any depth."""

    def leaf(value: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, _TIMES):
            return ts.pattern_text(value, kind, pattern) if pattern else ts.plain_text(value, kind)
        return ts.drop_zero_date(value) if isinstance(kind, T.StringType) else None

    return map_record(df, leaf)


def stringify_decimals(df: DataFrame) -> DataFrame:
    return map_record(
        df, lambda v, kind: v.cast("string") if isinstance(kind, T.DecimalType) else None
    )


def drop_zero_dates(df: DataFrame) -> DataFrame:
    return map_record(
        df, lambda v, kind: ts.drop_zero_date(v) if isinstance(kind, T.StringType) else None
    )


def text_schema(kind: T.DataType) -> T.DataType:
    """The same type with text in place of dates and times, as they arrive in JSON."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, text_schema(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(text_schema(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, text_schema(kind.valueType))
    return T.StringType() if isinstance(kind, _TIMES) else kind


def _typed(text: Column, kind: T.DataType, layouts) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        return ts.parse_datetime(text, layouts)
    if isinstance(kind, T.TimestampType):
        return ts.parse_timestamp(text, layouts)
    return ts.parse_date(text, layouts)


def _coerce(
    value: Column, source: T.DataType, target: T.DataType, layouts, path: str, fail: bool
) -> Column:
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        present = set(source.names)
        parts = [
            (
                _coerce(
                    value.getField(f.name), source[f.name].dataType, f.dataType, layouts,
                    f"{path}.{f.name}", fail,
                )
                if f.name in present
                else F.lit(None).cast(f.dataType)
            ).alias(f.name)
            for f in target
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        kinds = source.elementType, target.elementType
        return F.transform(value, lambda e: _coerce(e, *kinds, layouts, path, fail))
    if isinstance(target, T.MapType) and isinstance(source, T.MapType):
        kinds = source.valueType, target.valueType
        typed = F.transform_values(value, lambda _, v: _coerce(v, *kinds, layouts, path, fail))
        return typed if source.keyType == target.keyType else typed.cast(target)
    if source == target or not isinstance(source, T.StringType):
        return value if source == target else value.cast(target)
    typed = (
        _typed(value, target, layouts) if isinstance(target, _TIMES) else value.try_cast(target)
    )
    if not fail:
        return typed
    # Part of the value itself: a filter on it would make Spark parse twice.
    error = F.raise_error(F.concat(F.lit(f"unreadable {path}: "), value))
    unread = value.isNotNull() & ~F.contains(value, F.lit(ts.ZERO_DATE))
    return F.coalesce(typed, F.when(unread, error))


def _bad(raw: Column, typed: Column, source: T.DataType, target: T.DataType, path: str) -> list:
    """(path, condition) for every text leaf that its target type could not hold."""
    if isinstance(target, T.StructType) and isinstance(source, T.StructType):
        found = []
        for f in target:
            if f.name in source.names:
                found += _bad(
                    raw.getField(f.name), typed.getField(f.name), source[f.name].dataType,
                    f.dataType, f"{path}.{f.name}",
                )
        return found
    if isinstance(target, T.ArrayType) and isinstance(source, T.ArrayType):
        kinds = source.elementType, target.elementType
        paths = [p for p, _ in _bad(F.lit(None), F.lit(None), *kinds, path)]

        def any_element(i: int) -> Column:
            pairs = F.zip_with(raw, typed, lambda r, t: _bad(r, t, *kinds, path)[i][1])
            return F.coalesce(F.exists(pairs, lambda bad: bad), F.lit(False))

        return [(p, any_element(i)) for i, p in enumerate(paths)]
    if isinstance(target, T.MapType) and isinstance(source, T.MapType):
        kinds = source.valueType, target.valueType
        paths = [p for p, _ in _bad(F.lit(None), F.lit(None), *kinds, path)]

        def any_value(i: int) -> Column:
            # A map's values keep their order when they are changed.
            pairs = F.zip_with(
                F.map_values(raw), F.map_values(typed), lambda r, t: _bad(r, t, *kinds, path)[i][1]
            )
            return F.coalesce(F.exists(pairs, lambda bad: bad), F.lit(False))

        return [(p, any_value(i)) for i, p in enumerate(paths)]
    if not isinstance(source, T.StringType) or isinstance(target, T.StringType):
        return []
    lost = raw.isNotNull() & typed.isNull()
    return [(path, F.coalesce(lost & ~F.contains(raw, F.lit(ts.ZERO_DATE)), F.lit(False)))]


def coerce_record(
    df: DataFrame,
    target: str | T.StructType,
    on_bad: str = "null",
    layouts=ts.LAYOUTS,
) -> DataFrame:
    """Give the target's fields their types, at any depth; other columns stay.

    Unreadable text becomes null and its path is listed in ``_bad_fields``, or
    with ``on_bad="fail"`` ends the job. A zero date is plainly null.
    """
    if on_bad not in ("null", "fail"):
        raise ValueError(f"on_bad must be null or fail, not {on_bad}")
    target = struct_type(target)
    typed, raw, bad = {}, {}, []
    for field in target:
        if field.name not in df.columns:
            continue
        source, value = df.schema[field.name].dataType, F.col(f"`{field.name}`")
        if source == field.dataType:
            continue
        typed[field.name] = _coerce(
            value, source, field.dataType, layouts, field.name, on_bad == "fail"
        )
        kept = f"_raw_{field.name}"
        conditions = _bad(F.col(f"`{kept}`"), value, source, field.dataType, field.name)
        if conditions:
            raw[kept] = value
            bad += conditions
    if on_bad == "fail":
        return df.withColumns(typed) if typed else df
    # Two steps, so that every text is parsed once and only compared afterwards.
    both = df.withColumns({**raw, **typed}) if typed else df
    names = F.array(*[F.when(condition, F.lit(path)) for path, condition in bad])
    return both.withColumn("_bad_fields", F.array_compact(names.cast("array<string>"))).drop(*raw)

"""A declarative query: named parts of a SELECT, put together as DataFrame calls."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.sources.tables import load_table

PARTS = {
    "with", "from", "join", "unnest", "select", "where", "args", "group", "having", "order",
    "limit", "union",
}


def run_spec(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    """Build the frame of a spec. Its parts, all optional but ``from`` or ``union``:

    - ``with``: names for specs or frames that other parts may use as sources
    - ``from``: a source or a list of them, each plain or ``(source, alias)``; a
      source is a frame, a nested spec, a name from ``with`` or a table. A list is
      joined by what ``where`` says: its ANDed ``alias.column = alias.column`` texts must
      tie all sources together, so that no two of them are joined row by row
    - ``join``: list of ``(source, alias, condition, how)``
    - ``unnest``: ``(array expression, alias)``, one row per element
    - ``where``: texts or ``(text, "AND" | "OR")`` in SQL precedence
    - ``args``: values for ``:names`` in ``where``
    - ``group``, ``having``: grouping columns, and a condition on the result
    - ``select``: expressions or ``(expression, alias)``; with ``group``, aggregates
    - ``order``: columns or ``(column, "asc" | "desc")``; ``limit``: a number
    - ``union``: ``("all" | "distinct", [specs])``; one spec alone stays as it is
    """
    unknown = set(spec) - PARTS
    if unknown:
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    return _build(spark, spec, {})


def _source(spark: SparkSession, source: Any, names: Mapping[str, Any]) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Mapping):
        return _build(spark, source, names)
    return _source(spark, names[source], names) if source in names else load_table(spark, source)


def _aliased(spark: SparkSession, item: Any, names: Mapping[str, Any]) -> DataFrame:
    source, alias = item if isinstance(item, tuple) else (item, None)
    df = _source(spark, source, names)
    return df.alias(alias) if alias else df


def _columns(items) -> list[Column]:
    pairs = [i if isinstance(i, tuple) else (i, None) for i in items]
    return [F.expr(e).alias(a) if a else F.expr(e) for e, a in pairs]


def _where(items) -> str:
    """One SQL condition, so that AND binds before OR as it does in SQL."""
    text = ""
    for item in items:
        condition, word = item if isinstance(item, tuple) else (item, "AND")
        if word.upper() not in ("AND", "OR"):
            raise ValueError(f"conditions are joined by AND or OR, not {word}")
        text += f" {word.upper()} {condition}" if text else condition
    return text


def _bind(df: DataFrame, condition: str, args: Mapping[str, Any]) -> DataFrame:
    """Filter with ``:name`` values bound by type, never pasted into the text."""
    if not args:
        return df.filter(F.expr(condition))
    # Values become columns, which Catalyst folds back into the pushed-down filter.
    bound = df.withColumns({f"_arg_{k}": F.lit(v) for k, v in args.items()})
    # A text in quotes stays as it is.
    named = re.sub(
        r"('(?:[^'\\]|\\.)*')|(?<![\w:]):([A-Za-z_]\w*)",
        lambda m: m[1] or f"`_arg_{m[2]}`", condition,
    )
    return bound.filter(F.expr(named)).drop(*[f"_arg_{k}" for k in args])


_EQUAL = re.compile(r"^\s*`?(\w+)`?\.`?\w+`?\s*=\s*`?(\w+)`?\.`?\w+`?\s*$")


def _check_joined(sources: list, where) -> None:
    items = [w if isinstance(w, tuple) else (w, "AND") for w in where]
    aliases = [s[1] if isinstance(s, tuple) else None for s in sources]
    met = [m.groups() for text, _ in items if (m := _EQUAL.match(text))]
    reached = set(aliases[:1])
    for _ in aliases:
        reached |= {x for pair in met if reached & set(pair) for x in pair}
    if None in aliases or any(word.upper() == "OR" for _, word in items) or not set(aliases) <= reached:
        raise ValueError("a list of sources needs aliases and a where that joins each by an equal column")


def _build(spark: SparkSession, spec: Mapping[str, Any], names: Mapping[str, Any]) -> DataFrame:
    names = {**names, **spec.get("with", {})}
    if "union" in spec:
        kind, parts = spec["union"]
        frames = [_source(spark, p, names) for p in parts]
        df = reduce(DataFrame.unionByName, frames)
        df = df.distinct() if kind.lower() == "distinct" and len(frames) > 1 else df
    else:
        sources = spec["from"] if isinstance(spec["from"], list) else [spec["from"]]
        if len(sources) > 1:
            _check_joined(sources, spec.get("where", []))
        df = reduce(DataFrame.join, [_aliased(spark, s, names) for s in sources])
    for source, alias, condition, how in spec.get("join", []):
        df = df.join(_aliased(spark, (source, alias), names), F.expr(condition), how)
    if "unnest" in spec:
        array, alias = spec["unnest"]
        df = df.withColumn(alias, F.explode(F.expr(array)))
    if spec.get("where"):
        df = _bind(df, _where(spec["where"]), spec.get("args", {}))
    if "group" in spec:
        df = df.groupBy(*_columns(spec["group"])).agg(*_columns(spec["select"]))
        df = df.filter(F.expr(spec["having"])) if "having" in spec else df
    elif "select" in spec:
        df = df.select(*_columns(spec["select"]))
    if "order" in spec:
        pairs = [o if isinstance(o, tuple) else (o, "asc") for o in spec["order"]]
        df = df.orderBy(*[F.desc(c) if d.lower() == "desc" else F.asc(c) for c, d in pairs])
    return df.limit(spec["limit"]) if "limit" in spec else df

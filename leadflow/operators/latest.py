"""The latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """One whole row per key, the one with the greatest ``order`` and tiebreak.

    An aggregate, not a window: each task first reduces its own rows to one per
    key, so a key with very many rows never meets in one task.
    """
    rank = F.struct(F.col(order), *[F.col(t) for t in tiebreak])
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), rank).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*df.columns)

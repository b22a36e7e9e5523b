"""Drift of a value between a reference and what came after: by quantile bins, and by the two-sample distance."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.operators.prefix import running_sums
from leadflow.session import shared_folder
from leadflow.sinks.state import scratch

WHOLE = "decimal(38,0)"


def quantile_cuts(df: DataFrame, is_reference: Column, value: str, by: Sequence[str], bins: int, accuracy: int) -> DataFrame:
    """``by, cuts``: the values that cut each group's reference into ``bins`` equal parts, from a mergeable sketch.

    Each task makes a sketch of its rows; sketches are merged, so no task sorts a group. The rank of a
    cut is off by at most one in ``accuracy`` of the reference's rows.
    """
    places = [i / bins for i in range(1, bins)]
    sketch = F.percentile_approx(F.when(is_reference, F.col(value)), places, accuracy)
    return df.groupBy(*by).agg(sketch.alias("cuts"))


def quantile_counts(
    df: DataFrame, is_reference: Column, value: str, by: Sequence[str], bins: int = 10, accuracy: int = 10_000
) -> DataFrame:
    """``by, bin, r, c``: reference rows and others in each bin of the reference's quantiles."""
    cuts = quantile_cuts(df, is_reference, value, by, bins, accuracy).select(
        *[F.col(b).alias(f"_{b}") for b in by], "cuts"
    )
    rows = df.select(*by, value, is_reference.alias("_reference")).filter(F.col(value).isNotNull())
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    place = sum(
        (F.coalesce(F.col(value) > F.get("cuts", F.lit(i)), F.lit(False)).cast("int") for i in range(bins - 1)), F.lit(0)
    )
    return rows.join(cuts, same).groupBy(*by, place.alias("bin")).agg(
        F.count_if("_reference").alias("r"), F.count_if(~F.col("_reference")).alias("c")
    )


def quantile_drift(
    df: DataFrame, is_reference: Column, value: str, by: Sequence[str], bins: int = 10, accuracy: int = 10_000,
    floor: float = 1e-4,
) -> DataFrame:
    """``by, psi``: the population stability index over bins that hold equal parts of the reference.

    Where fixed widths leave most rows in few bins, these follow the value's own distribution.
    """
    counts = quantile_counts(df, is_reference, value, by, bins, accuracy)
    group = Window.partitionBy(*by)  # a row for each bin of a group
    shares = counts.select(*by, *[
        F.greatest(F.col(n) / F.sum(n).over(group), F.lit(floor)).alias(n) for n in ("r", "c")
    ])
    return shares.groupBy(*by).agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def two_sample_distance(
    df: DataFrame, is_reference: Column, value: str, by: Sequence[str], ranges: int | None = None, work: str | None = None
) -> DataFrame:
    """``by, r, c, distance``: the greatest distance of the two distribution functions of each group, exactly.

    A row of the reference weighs as many as the group has others, and the other way round, with a
    minus. So the running sum over all groups and values in order is zero again at each group's end, and at each
    value it is the distance there, in whole numbers. No group, however large, is sorted in one task.
    """
    keys = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*keys, F.col(value).alias("_value")).alias("_key")).agg(
        F.count_if(is_reference).cast(WHOLE).alias("r"), F.count_if(~is_reference).cast(WHOLE).alias("c")
    )
    named = [F.col(f"_key._by{i}").alias(b) for i, b in enumerate(by)]
    with scratch(counts, "value-counts", work) as counts:
        totals = counts.groupBy(*named).agg(F.sum("r").cast(WHOLE).alias("r_all"), F.sum("c").cast(WHOLE).alias("c_all"))
        totals = totals.filter("r_all > 0 and c_all > 0")
        others = totals.select(*[F.col(b).alias(f"_{b}") for b in by], "r_all", "c_all")
        same = [F.col(f"_key._by{i}").eqNullSafe(F.col(f"_{b}")) for i, b in enumerate(by)]
        weight = (F.col("r") * F.col("c_all") - F.col("c") * F.col("r_all")).cast(WHOLE)
        weighed = counts.join(others, same).select("_key", weight.alias("weight"))
        with running_sums(weighed, "_key", "weight", ranges, work) as sums:
            widest = sums.groupBy(*named).agg(F.max(F.abs("running")).alias("_most"))
            whole = [F.col(n).cast("double") for n in ("_most", "r_all", "c_all")]
            found = widest.join(totals, [widest[b].eqNullSafe(totals[b]) for b in by]).select(
                *[widest[b] for b in by], F.col("r_all").cast("long").alias("r"), F.col("c_all").cast("long").alias("c"),
                (whole[0] / whole[1] / whole[2]).alias("distance"),
            )
            # a row a group, kept where the caller can read it after the scratch tables are gone
            out = f"{work.rstrip('/')}/distances-{uuid.uuid4().hex}" if work else shared_folder(df.sparkSession, "distances")
            found.write.parquet(out)
            return df.sparkSession.read.schema(found.schema).parquet(out)

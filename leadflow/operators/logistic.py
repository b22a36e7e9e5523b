"""A logistic lead score fitted in Spark: reweighted least squares from summed normal equations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.sinks.state import scratch


@dataclass(frozen=True)
class LogisticFit:
    weights: dict[str, float]
    intercept: float
    errors: dict[str, float]  # standard errors, of the intercept under ""
    log_likelihood: float
    rounds: int
    rows: int


def _sums(rows: DataFrame, columns: Sequence[Column], label: Column, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass: the information matrix, the gradient and the log-likelihood at ``beta``, all sums on the executors."""
    z = sum((c * F.lit(float(b)) for c, b in zip(columns, beta)), F.lit(0.0))
    p = 1 / (1 + F.exp(-z))
    terms = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)], p.alias("p"), z.alias("z"), label.alias("y"))
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    weight = F.col("p") * (1 - F.col("p"))
    # log(1 + e^z) without overflow
    rise = F.greatest("z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("z")))
    found = terms.agg(
        *[F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs],
        *[F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)],
        F.sum(F.col("y") * F.col("z") - rise),
    ).first()
    information = np.zeros((k, k))
    for (i, j), value in zip(pairs, found):
        information[i, j] = information[j, i] = value
    return information, np.array(found[len(pairs) : len(pairs) + k]), found[-1]


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, rounds: int = 30, tolerance: float = 1e-10, work: str | None = None
) -> LogisticFit:
    """The weights of greatest likelihood for a boolean label.

    Each round is one pass that adds up k(k+1)/2 products, so only those sums reach the driver, whatever the number
    of rows. Features are centred and scaled inside, steps that don't help are halved. Rows with a null
    or a value that isn't finite take no part. A label that the features separate, or that has one value
    only, has no such weights and ends the job, as do features that depend on each other.
    """
    columns = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    narrow = df.select(*columns, F.col(label).cast("double").alias("y"))
    finite = F.col("y").isNotNull()
    for i in range(len(features)):
        finite &= F.col(f"f{i}").isNotNull() & ~F.isnan(f"f{i}") & (F.abs(f"f{i}") < F.lit(math.inf))
    with scratch(narrow.filter(finite), "features", work) as rows:
        first = rows.agg(
            F.count(F.lit(1)), F.avg("y"), *[F.avg(f"f{i}") for i in range(len(features))],
            *[F.stddev_pop(f"f{i}") for i in range(len(features))],
        ).first()
        n, share = first[0], first[1]
        if not n or share in (0.0, 1.0):
            raise ValueError("the label must have both values")
        means, spreads = list(first[2 : 2 + len(features)]), [s or 1.0 for s in first[2 + len(features) :]]
        scaled = [F.lit(1.0)] + [(F.col(f"f{i}") - m) / s for i, (m, s) in enumerate(zip(means, spreads))]
        beta = np.zeros(len(scaled))
        beta[0] = math.log(share / (1 - share))
        information, gradient, height = _sums(rows, scaled, F.col("y"), beta)
        for done in range(1, rounds + 1):
            try:
                step = np.linalg.solve(information, gradient)
            except np.linalg.LinAlgError:
                raise ValueError("the features depend on each other") from None
            while True:
                tried = _sums(rows, scaled, F.col("y"), beta + step)
                if tried[2] >= height - 1e-9 * abs(height) or np.abs(step).max() < tolerance:
                    break
                step /= 2
            beta = beta + step
            information, gradient, height = tried
            if np.abs(beta).max() > 50:
                raise ValueError("the features separate the label: its weights have no bound")
            if np.abs(step).max() < tolerance:
                break
        else:
            raise ValueError(f"no weights after {rounds} rounds")
    if np.linalg.cond(information) > 1e13:
        raise ValueError("the features depend on each other")
    back = np.eye(len(beta))  # from scaled weights to those of the features as they are
    for i, (m, s) in enumerate(zip(means, spreads), 1):
        back[i, i], back[0, i] = 1 / s, -m / s
    raw, spread = back @ beta, back @ np.linalg.inv(information) @ back.T
    errors = np.sqrt(np.diag(spread))
    return LogisticFit(
        dict(zip(features, raw[1:].tolist())), float(raw[0]), dict(zip(["", *features], errors.tolist())), float(height), done, n
    )

"""URL filter: rules by host and path, and a language-model ratio for the URLs that no rule fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.llm.common import ascii_lower, written

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
         ("com/de/", "block")]
ORDER = 5  # the longest context, in bytes
HOT = 10_000  # windows with over 1/HOT of the rows, of which there are fewer than HOT, are looked up in the tasks
UNIT = 1e11  # parts of a nat in which log ratios are added up: whole numbers, so that their order doesn't matter
SLICE = 1 << 20  # bytes of URLs that a task reads at once
ALPHABET = 256


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null and for no ``://``."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #``; empty for null and for no ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def read_of(url: Column) -> Column:
    """What the models read behind the host: path, query and fragment; of a URL without ``://`` all of it; empty for null."""
    rest = _rest(url)
    behind = F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1, F.length(rest))
    return F.coalesce(F.when(F.locate("://", url) > 0, behind).otherwise(url), F.lit(""))


def ruling(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """A struct of the longest fitting rule and its verdict; null where none fits. Of equal length the first one wins."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # later ones, longer, are asked first
        name, _, tail = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(host: str, read: str) -> bytes:
    """What the models read: host, path, query and fragment, with a mark at each end."""
    return b"\x02" + f"{host}{read}".encode("utf-8", "replace") + b"\x03"


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """For each byte but the first, one row: the keys of the byte with each context before it, from none to ``order``.

    A key holds the context's length and its bytes whole. It is -1 where the text begins too late.
    """
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    out = np.full((max(len(data) - 1, 0), order + 1), -1, np.int64)
    value = data.copy()
    for k in range(order + 1):
        if k:
            value[k:] |= data[:-k] << (8 * k)
        at = max(k, 1)
        out[at - 1 :, k] = value[at:] | (k << 56)
    return out


class MarkovModel:
    """How often bytes follow contexts of every length up to the order: the definition, in memory. ``log_ratios``
    has the same probabilities as tables."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        self.key, self.n = np.append(key[order], np.iinfo(np.int64).max), np.append(n[order], 0).astype(float)
        context = self.key[:-1] >> 8
        self.context, first, kinds = np.unique(context, return_index=True, return_counts=True)
        self.kinds = np.append(kinds, 1).astype(float)
        self.after = np.append(np.add.reduceat(self.n[:-1], first) if len(first) else first, 0).astype(float)
        self.context = np.append(self.context, np.iinfo(np.int64).max)

    def log_probability(self, keys: np.ndarray) -> float:
        """Nats of a text: each order is smoothed with the one below by as many pseudo-counts as the context has
        different bytes (Witten and Bell), and a context that is not kept leaves it to the order below."""
        at = np.searchsorted(self.key, keys)
        n = np.where(self.key[at] == keys, self.n[at], 0)
        context = keys >> 8
        at = np.searchsorted(self.context, context)
        seen = (self.context[at] == context) & (keys >= 0)
        after, kinds = self.after[at], self.kinds[at]
        p = np.full(len(keys), 1 / ALPHABET)
        for k in range(keys.shape[1]):
            p = np.where(seen[:, k], (n[:, k] + kinds[:, k] * p) / (after[:, k] + kinds[:, k]), p)
        return float(np.log(p).sum())


def windows(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text but its first, the text's number and the byte's longest key: see ``grams``.

    All shorter keys of the byte are suffixes of it, so that it decides the byte's probability.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key, value = data.copy(), data.copy()
    for k in range(1, order + 1):
        value[k:] |= data[:-k] << (8 * k)
        key = np.where(offset >= k, value | (k << 56), key)
    real = offset > 0
    return owner[real], key[real]


def _slices(batch: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """The batch's rows and texts, about ``SLICE`` bytes at a time."""
    texts, size, at = [], 0, 0
    for i, (h, p) in enumerate(zip(batch["host"], batch["read"])):
        texts.append(features(h, p))
        size += len(texts[-1])
        if size >= SLICE:
            yield batch.iloc[at : i + 1], texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield batch.iloc[at:], texts


SEEN = ["allow", "allow_held", "block", "block_held"]


def _counts(order: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per slice and window, how often it occurs in the URLs of each verdict, and how many URLs to judge have it."""
        for batch in batches:
            for rows, texts in _slices(batch):
                owner, key = windows(texts, order)
                key, at = np.unique(key, return_inverse=True)
                verdict, held = rows["verdict"].to_numpy(object), rows["held"].to_numpy(bool)
                out = {"key": key}
                for i, name in enumerate(SEEN):
                    own = (verdict == name[:5]) & (held == bool(i % 2))
                    out[name] = np.bincount(at[own[owner]], minlength=len(key))
                asked = (held | pd.isna(rows["verdict"]).to_numpy(bool))[owner]
                once = np.unique(owner[asked] * len(key) + at[asked]) % len(key)
                out["asked"] = np.bincount(once, minlength=len(key))
                yield pd.DataFrame(out)

    return run


def _order(key: Column) -> Column:
    return F.shiftright(key, 56).cast("int")


def log_ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, trial, final`` of each window that is asked for: its log-likelihood as part of an accepted URL less that
    as part of a rejected one, in ``UNIT`` parts of a nat, by the rows that aren't held back and by all.

    ``counted`` has how often each window occurs. Every n-gram is a suffix of windows, so its count is a
    sum of theirs; none is left out. A context has at most 256 bytes after it, and a key is prolonged by
    at most 256 bytes: no key of these joins is hot.
    """
    k = F.col("order")
    suffix = F.expr("(key & (shiftleft(1L, 8 * (order + 1)) - 1)) | shiftleft(order * 1L, 56)")
    every = (
        counted.withColumn("asked", (F.col("asked") > 0).cast("int"))
        .withColumn("order", F.explode(F.sequence(F.lit(0), _order(F.col("key")))))
        .withColumn("whole", (k == _order(F.col("key"))).cast("int") * F.col("asked"))
        .withColumn("key", suffix)
        .groupBy("key").agg(*[F.sum(c).alias(c) for c in SEEN], F.max("asked").alias("asked"), F.max("whole").alias("whole"))
    )
    context = Window.partitionBy(F.shiftright("key", 8))
    models = {
        "trial_allow": F.col("allow"), "trial_block": F.col("block"),
        "final_allow": F.col("allow") + F.col("allow_held"), "final_block": F.col("block") + F.col("block_held"),
    }
    grams_ = every.select(
        "key", "asked", "whole",
        *[
            F.struct(n.alias("n"), F.sum(n).over(context).alias("after"),
                     F.sum((n > 0).cast("long")).over(context).alias("kinds")).alias(name)
            for name, n in models.items()
        ],
    ).where("asked = 1").withColumn("order", _order(F.col("key")))
    grams_ = written(grams_.drop("asked"), "url-grams")
    level, out = None, None
    for i in range(order + 1):
        own = grams_.where(k == i)
        if i:
            parent = F.expr(f"(key & {(1 << 8 * i) - 1}L) | {(i - 1) << 56}L")
            below = level.select(F.col("key").alias("parent"), *[F.col(m).alias(f"{m}_below") for m in models])
            own = own.withColumn("parent", parent).join(below, "parent")
        level = written(own.select("key", "whole", *[
            _smoothed(F.col(m), F.col(f"{m}_below") if i else F.lit(1 / ALPHABET)).alias(m) for m in models
        ]), "url-probabilities")
        out = level if out is None else out.unionByName(level)
    return out.where("whole = 1").select("key", *[
        F.round((F.log(f"{m}_allow") - F.log(f"{m}_block")) * UNIT).cast("long").alias(m) for m in ("trial", "final")
    ])


def _smoothed(own: Column, below: Column) -> Column:
    """Witten and Bell: see ``MarkovModel.log_probability``."""
    n, after, kinds = (own[c].cast("double") for c in ("n", "after", "kinds"))
    return F.when(after > 0, (n + kinds * below) / (after + kinds)).otherwise(below)


def _parts(order: int, key: np.ndarray, trial: np.ndarray, final: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per URL, a row with its length and the sum of its hot windows (``key`` is below 0 and its own), and a row for
        each other window."""
        for batch in batches:
            for rows, texts in _slices(batch):
                owner, own = windows(texts, order)
                uid, held = rows["uid"].to_numpy(np.int64), rows["held"].to_numpy(bool)
                kinds, at = np.unique(own, return_inverse=True)
                pair, times = np.unique(owner * len(kinds) + at, return_counts=True)
                owner, own = pair // len(kinds), kinds[pair % len(kinds)]
                at = np.searchsorted(key, own)
                hot = key[at] == own
                sums = np.zeros(len(rows), np.int64)
                value = np.where(held[owner], trial[at], final[at]) * times
                np.add.at(sums, owner[hot], value[hot])
                length = np.bincount(owner, weights=times, minlength=len(rows)).astype(np.int64)
                yield pd.DataFrame({"uid": uid, "key": -1 - uid, "held": held, "times": length, "hot": sums})
                owner, own, times = owner[~hot], own[~hot], times[~hot]
                yield pd.DataFrame({"uid": uid[owner], "key": own, "held": held[owner], "times": times, "hot": 0})

    return run


def ratios(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``uid, ratio`` of the rows that are held back (by the models of the others) or have no verdict (by all's):
    log-likelihood as an accepted URL less that as a rejected one, in nats a byte.

    The tables of windows and n-grams grow with the input and stay in Spark. The driver gets the windows
    that make up more than one in ``HOT`` of the rows to join, which would be hot keys: fewer than ``HOT`` of them.
    """
    kinds = "key long, " + ", ".join(f"{c} long" for c in [*SEEN, "asked"])
    counted = written(
        rows.select("host", "read", "verdict", "held").mapInPandas(_counts(order), kinds)
        .groupBy("key").agg(*[F.sum(c).alias(c) for c in [*SEEN, "asked"]]),
        "url-windows",
    )
    found = written(log_ratios(counted, order), "url-ratios")
    total = counted.agg(F.sum("asked")).first()[0] or 0
    hot = found.join(counted.where(F.col("asked") * HOT > total).select("key"), "key").orderBy("key").toArrow()
    past = np.append(hot["key"].to_numpy(), np.iinfo(np.int64).max)
    parts = rows.where("held or verdict is null").select("uid", "host", "read", "held").mapInPandas(
        _parts(order, past, np.append(hot["trial"].to_numpy(), 0), np.append(hot["final"].to_numpy(), 0)),
        "uid long, key long, held boolean, times long, hot long",
    )
    one = F.when(F.col("key") < 0, F.col("hot")).otherwise(
        F.col("times") * F.when(F.col("held"), F.col("trial")).otherwise(F.col("final"))
    )
    length = F.when(F.col("key") < 0, F.col("times"))
    return parts.join(found, "key", "left").groupBy("uid").agg(
        (F.sum(one) / UNIT / F.sum(length)).alias("ratio")
    )


STEPS = 1_000  # of a nat, in which ratios are counted for the threshold


def threshold(counts: pd.DataFrame) -> float:
    """The ratio from which URLs pass: halfway between the steps where balanced accuracy is best, 0 if one side is missing."""
    rows = counts.sort_values("step")
    allow, block = rows["allow"].to_numpy(float), rows["block"].to_numpy(float)
    if not len(rows) or not allow.sum() or not block.sum():
        return 0.0
    passed = 1 - np.concatenate([[0], np.cumsum(allow)]) / allow.sum()
    stopped = np.concatenate([[0], np.cumsum(block)]) / block.sum()
    steps = rows["step"].to_numpy(float)
    edges = np.concatenate([[steps[0]], (steps[1:] + steps[:-1] + 1) / 2, [steps[-1] + 1]]) / STEPS
    good = passed + stopped
    best = np.flatnonzero(good >= good.max() - 1e-12)
    return float(edges[best[np.abs(edges[best]).argmin()]])


def judge(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", order: int = ORDER, folds: int = 5
) -> DataFrame:
    """``page_id, host, path, rule, verdict, ratio`` of every row.

    Where a rule fits, it decides, and the URL is an example for the models: allowed ones are accepted,
    blocked ones rejected. Other URLs are allowed if their ratio reaches the calibrated threshold: that of
    the best balanced accuracy on every fifth URL (by hash), which a first pair of models doesn't see. The
    final models learn from all rows. Counts by 1/1000 nat are all that the threshold takes.

    The models read whole URLs from the host on, rules host and path. Null URLs and URLs without ``://`` have an empty
    host and path and are judged like any other, the latter by their text. A very long URL is read whole. Ratios of
    URLs with a rule are null. Repeated rows come back, and teach, as often as they came.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), read_of(F.col("url")).alias("read")
    )
    ruled = split.withColumn("by_rule", ruling(F.col("host"), F.col("path"), rules))
    held = F.col("by_rule").isNotNull() & (F.pmod(F.xxhash64("host", "path"), F.lit(folds)) == 0)
    rows = written(ruled.select(
        F.monotonically_increasing_id().alias("uid"), "page_id", "host", "path", "read", "by_rule.rule", "by_rule.verdict",
        held.alias("held"),
    ), "urls")
    scored = written(rows.where("held or verdict is null").join(ratios(rows, order), "uid"), "url-scored")
    counts = scored.where("held").select("verdict", F.floor(F.col("ratio") * STEPS).alias("step")).groupBy("step").agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("allow"),
        F.sum((F.col("verdict") == "block").cast("long")).alias("block"),
    )
    least = threshold(counts.toArrow().to_pandas())
    said = F.when(F.col("ratio") >= least, "allow").otherwise("block")
    return rows.where("verdict is not null").select(
        "page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("ratio")
    ).unionByName(
        scored.where("not held").select("page_id", "host", "path", "rule", said.alias("verdict"), "ratio")
    )

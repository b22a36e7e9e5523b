"""Mixing sources to target weights by budgets on a domain-language-source tree. DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import written

LEVELS = ["domain", "lang", "source"]
BUCKET_DIGITS = 3  # hexadecimal digits of a row's place that tell its bucket: 4,096 of them
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str | Column) -> Column:
    """The number of words, cut at ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int, epoch: Column, key: Column) -> Column:
    """Where a row stands in an epoch: an md5 as hexadecimal text, anew for each epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for value, w in sorted(weights.items()):
        out = F.when(F.col(name) == value, F.lit(w).cast("long")).otherwise(out)
    return out


def budgets(
    leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, share: float, max_epochs: int
) -> DataFrame:
    """``domain, lang, source, held, granted`` of every leaf that gets tokens; ``leaves`` has what each one holds.

    A node can take its leaves' tokens ``max_epochs`` times. From the root on, a node's budget goes to its
    children by weight, and none gets more than it can take: children in order of how soon they are
    full; one that fills up leaves the rest to its siblings. What a whole subtree can't take was
    never given to it, so its parent's siblings have it: siblings first, ancestors after them. Budgets
    are whole tokens, rounded down.
    """
    # a weight of 0 on the way takes a leaf out of the tree: nothing is granted for what it holds
    open_ = F.lit(True)
    for level in LEVELS:
        open_ &= _weight(level, weights.get(level, {})) > 0
    tree = leaves.withColumn("takes", F.when(open_, F.col("held") * max_epochs).otherwise(F.lit(0)))
    total = F.least(F.sum("takes"), F.lit(budget) if budget is not None else F.floor(F.sum("held") * share))
    nodes = tree.agg(total.cast("long").alias("granted")).withColumn("root", F.lit(0))
    above: list[str] = ["root"]
    tree = tree.where("takes > 0").withColumn("root", F.lit(0))
    for i, level in enumerate(LEVELS):
        keys = ["root", *LEVELS[: i + 1]]
        child = tree.groupBy(*keys).agg(F.sum("takes").alias("takes")).withColumn("w", _weight(level, weights.get(level, {})))
        child = child.join(nodes, above)
        order = f"partition by {', '.join(above)} order by takes / w, {level}"
        before = "rows between unbounded preceding and 1 preceding"
        child = child.withColumn("filled", F.expr(f"coalesce(sum(takes) over ({order} {before}), 0)")).withColumn(
            "left_w", F.expr(f"sum(w) over ({order} rows between current row and unbounded following)")
        )
        # a child is full if its even share of what the fuller ones left would be more than it can take
        child = child.withColumn("full", F.expr("takes * left_w <= w * (granted - filled)"))
        sums = f"partition by {', '.join(above)}"
        child = child.withColumn("used", F.expr(f"coalesce(sum(case when full then takes end) over ({sums}), 0)"))
        child = child.withColumn("open_w", F.expr(f"sum(case when not full then w end) over ({sums})"))
        grant = F.expr("case when full then takes else (w * (granted - used)) div open_w end")
        nodes = child.select(*keys, grant.alias("granted"))
        above = keys
    return leaves.join(nodes, LEVELS).where("granted > 0").select(*LEVELS, "held", "granted")


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]] | None = None, budget: int | None = None,
    share: float = 0.5, max_epochs: int = 4, seed: int = 7, id_col: str = "doc_id", carry: list[str] | None = None,
) -> DataFrame:
    """The selected rows: ``doc_id, domain, lang, source, epoch, n_tokens, n_taken`` and the columns of ``carry``.

    ``budget`` is a number of tokens, or else ``share`` of all of them. ``weights`` has whole numbers by
    value for each of domain, lang and source; what it doesn't name weighs 1, and 0 leaves a node out. A
    leaf repeats its rows in epochs, each in a seeded order of its own: whole epochs first, and of
    the last one the first tokens, so that its last row may be taken in part (``n_taken``).

    Null domains, languages and sources are the value ``none``. Rows without words take no part. Rows with a null id
    are placed as the text ``null``; repeated rows, and rows that share an id, are rows of their own, in order
    of their tokens. An empty table selects nothing. Products of a weight and the tokens must fit a long.
    """
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(domain.cast("string"), F.lit("none")).alias("domain"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in LEVELS[1:]],
        tokens("text").alias("n_tokens"), *[F.col(c).alias(f"carried_{c}") for c in carry or []],
    ).where("n_tokens > 0")
    narrow = written(named.select("doc_id", *LEVELS, "n_tokens"), "mixing-rows")
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("held"))
    granted = budgets(leaves, weights or {}, budget, share, max_epochs).select(
        *LEVELS, F.expr("granted div held").alias("whole"), F.expr("granted % held").alias("rest")
    )
    granted = written(granted, "mixing-budgets")  # a row for each leaf: Spark knows its size from here on

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bucket = F.substring("place", 1, BUCKET_DIGITS)
    placed = narrow.join(granted.where("rest > 0"), LEVELS).withColumn("place", place(seed, F.col("whole"), key))
    sums = placed.groupBy(*LEVELS, bucket.alias("bucket")).agg(
        F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")
    )
    # per leaf at most 4,096 buckets: the one in which the budget ends, and the tokens before it
    order = f"partition by {', '.join(LEVELS)} order by bucket"
    edges = sums.withColumn("before", F.expr(f"sum(n) over ({order}) - n")).where("before < rest and before + n >= rest")
    edges = edges.select(*LEVELS, F.col("bucket").alias("edge"), F.col("before").alias("before_edge"))
    plan = written(granted.join(edges, LEVELS, "left"), "mixing-plan")

    rows = named.join(plan, LEVELS).withColumn("place", place(seed, F.col("whole"), key))
    out = ["doc_id", *LEVELS, "epoch", "n_tokens", "n_taken", *[f"carried_{c}" for c in carry or []]]
    below = F.when((F.col("rest") > 0) & (bucket < F.col("edge")), 1).otherwise(0)
    whole = rows.withColumn("times", F.col("whole") + below).where("times > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1))
    ).withColumn("n_taken", F.col("n_tokens")).select(*out)
    edge = rows.where((F.col("rest") > 0) & (bucket == F.col("edge"))).withColumn("epoch", F.col("whole"))
    order = f"partition by {', '.join(LEVELS)} order by place, n_tokens rows between unbounded preceding and 1 preceding"
    edge = edge.withColumn("start", F.expr(f"before_edge + coalesce(sum(n_tokens) over ({order}), 0)"))
    edge = edge.where("start < rest").withColumn("n_taken", F.expr("least(n_tokens, rest - start)")).select(*out)
    both = whole.unionByName(edge)
    return both.select(*out[:7], *[F.col(f"carried_{c}").alias(c) for c in carry or []])


def taken_text(text: str | Column, n_tokens: str | Column, n_taken: str | Column) -> Column:
    """The text's first ``n_taken`` words, joined by single blanks; the text as it is where all are taken."""
    t, n, k = (F.col(c) if isinstance(c, str) else c for c in (text, n_tokens, n_taken))
    words = F.filter(F.split(t, BLANK), lambda w: w != "")
    return F.when(k >= n, t).otherwise(F.array_join(F.slice(words, F.lit(1), k.cast("int")), " "))

"""A sentiment model learnt from rated texts: log-odds of words and word pairs, from counts alone.

Training is one count of features by rating. The model is a table that grows with the texts' vocabulary, so
texts meet it in a join, not in a broadcast of unknown size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.rules import polarity, strength

SMOOTHING = 1.0
MIN_TEXTS = 3
LEAST = 3.0


def features(text: Column) -> Column:
    """The different words of a text and pairs of neighbouring words, in lower case; a pair has a space inside."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")

    def with_pairs(words: Column) -> Column:
        n = F.greatest(F.size(words) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
        return F.array_distinct(F.concat(words, pairs))

    return F.transform(F.array(words), with_pairs)[0]  # the words are a variable there, cut once


def feature_counts(rated: DataFrame) -> DataFrame:
    """``feature, n_pos, n_neg``: how many positive and negative texts have a feature, of ``text, positive``.

    Each task adds its own texts up before anything is shuffled, so a word of every text costs a row a task.
    """
    known = rated.filter(F.col("positive").isNotNull() & F.col("text").isNotNull())
    return known.select("positive", F.explode(features(F.col("text"))).alias("feature")).groupBy("feature").agg(
        F.count_if("positive").alias("n_pos"), F.count_if(~F.col("positive")).alias("n_neg")
    )


def train(
    rated: DataFrame, min_texts: int = MIN_TEXTS, smoothing: float = SMOOTHING, least: float = LEAST
) -> DataFrame:
    """The model: ``feature, n_pos, n_neg, weight`` of the features of at least ``min_texts`` texts that tell the ratings apart.

    A weight is the log of how much more often positive texts have the feature than negative ones, with
    ``smoothing`` texts of either kind added to those that have it and to those that don't. It must be ``least``
    times its standard error: of very many features most differ by chance, and together they would drown the others.
    """
    totals = rated.filter(F.col("positive").isNotNull() & F.col("text").isNotNull()).agg(
        F.count_if("positive").alias("_pos"), F.count_if(~F.col("positive")).alias("_neg")
    )

    def odds(n: str, total: str) -> Column:
        return (F.col(n) + smoothing) / (F.col(total) + 2 * smoothing)

    kept = feature_counts(rated).filter(F.col("n_pos") + F.col("n_neg") >= min_texts)
    weight = F.log(odds("n_pos", "_pos") / odds("n_neg", "_neg"))
    error = F.sqrt(1 / (F.col("n_pos") + smoothing) + 1 / (F.col("n_neg") + smoothing))
    weighed = kept.join(F.broadcast(totals)).withColumn("weight", weight)  # totals: one row
    return weighed.filter(F.abs("weight") >= least * error).select("feature", "n_pos", "n_neg", "weight")


def _key_scores(texts: DataFrame, model: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The different texts with their digests, and ``_key, known, score`` of those with known features.

    A text goes nowhere but to the pass that makes it different; its features go to the join by its digest.
    """
    different = texts.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull()).distinct()
    keyed = different.withColumn("_key", F.sha2("_text", 256))
    asked = keyed.select("_key", F.explode(features(F.col("_text"))).alias("feature"))
    met = asked.join(model.select("feature", "weight"), "feature").groupBy("_key").agg(
        F.count(F.lit(1)).alias("known"), F.sum("weight").alias("_sum")
    )
    return keyed, met.select("_key", "known", F.tanh(F.col("_sum") / F.sqrt("known") / 2).alias("score"))


def text_scores(texts: DataFrame, model: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with ``known``, how many of its features the model has, and ``score`` from -1 to 1, of every different text.

    The score is tanh of half the mean weight of its known features times the root of their number: features
    of a text go together, so their odds don't multiply in full. 0 without any. Null texts are left out.
    """
    keyed, met = _key_scores(texts, model, text)
    return keyed.join(met, "_key", "left").select(
        F.col("_text").alias(text), F.coalesce("known", F.lit(0)).alias("known"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def with_sentiment(feedback: DataFrame, model: DataFrame, text: str = "feedback_text") -> DataFrame:
    """Rows with score, label and strength of their text by the model, in place of those they have.

    Equal texts are scored once; a null text has no score.
    """
    _, met = _key_scores(feedback, model, text)
    out = [c for c in feedback.columns if c not in ("sentiment_score", "sentiment_label", "sentiment_strength")]
    scored = feedback.select(*out).withColumn("_key", F.sha2(text, 256)).join(
        met.select("_key", F.col("score").alias("_score")), "_key", "left"
    )
    score = F.when(F.col(text).isNotNull(), F.coalesce("_score", F.lit(0.0)))
    return scored.withColumn("_score", score).select(
        *out, F.col("_score").alias("sentiment_score"), polarity(F.col("_score")).alias("sentiment_label"),
        strength(F.col("_score")).alias("sentiment_strength"),
    )


def fold(key: Column, folds: int = 5) -> Column:
    """The fold of a row, from its key alone."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % folds


def held_out(rated: DataFrame, key: str, folds: int = 5, **options) -> DataFrame:
    """``key, positive, score`` of fold 0, scored by a model of all other folds."""
    own = fold(F.col(key), folds)
    model = train(rated.filter(own != 0), **options)
    tested = rated.filter((own == 0) & F.col("positive").isNotNull() & F.col("text").isNotNull())
    return with_sentiment(tested.select(key, "positive", "text"), model, "text").select(
        key, "positive", F.col("sentiment_score").alias("score")
    )


def accuracy(scored: DataFrame) -> DataFrame:
    """``n, right, auc``: texts, those on the right side of 0, and how likely a positive text scores above a negative one.

    The area is a sum over the different scores in order, each with the negatives below it; ties count half.
    """
    counts = scored.groupBy("score").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"),
        F.count_if((F.col("score") > 0) == F.col("positive")).alias("right"),
    )
    # one row for each different score of the tested texts, which are a sample by design
    below = F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1))
    area = F.col("p") * (F.coalesce(below, F.lit(0)) + F.col("n") / 2)
    return counts.withColumn("_area", area).agg(
        F.sum(F.col("p") + F.col("n")).alias("n"), F.sum("right").alias("right"),
        (F.sum("_area") / F.sum("p") / F.sum("n")).alias("auc"),
    )

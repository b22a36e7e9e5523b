"""The trained sentiment model against plain counts."""

import math
import random
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadflow.operators import sentiment_model as model
from leadflow.plans import jobs
from leadflow.sinks.keyed import KeyedTable

DDL = "id int, text string, positive boolean"


def plain_features(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def plain_model(rated, min_texts, smoothing=1.0):
    pos, neg = Counter(), Counter()
    for _, text, positive in rated:
        if text is not None and positive is not None:
            (pos if positive else neg).update(plain_features(text))
    n = [sum(p is want and t is not None for _, t, p in rated) for want in (True, False)]
    odds = lambda c, total: (c + smoothing) / (total + 2 * smoothing)
    return {
        f: (pos[f], neg[f], math.log(odds(pos[f], n[0]) / odds(neg[f], n[1])))
        for f in set(pos) | set(neg) if pos[f] + neg[f] >= min_texts
    }


texts = st.lists(st.sampled_from(["good", "Bad", "very", "not", "été", "3", "--"]), max_size=7).map(" ".join)
RATED = st.lists(st.tuples(st.none() | texts, st.none() | st.booleans()), min_size=1, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(RATED)
def test_model_and_scores_equal_plain_counts(spark, rows, drawn):
    rated = [(i, t, p) for i, (t, p) in enumerate(drawn)]
    df = rows(rated, DDL)
    learnt = model.train(df, min_texts=2, least=0)
    want = plain_model(rated, 2)
    found = {r.feature: (r.n_pos, r.n_neg, r.weight) for r in learnt.collect()}
    assert found.keys() == want.keys()
    assert all(found[f][:2] == want[f][:2] and math.isclose(found[f][2], want[f][2]) for f in want)
    scores = {r.text: (r.known, r.score) for r in model.text_scores(df, learnt).collect()}
    assert scores.keys() == {t for _, t, _ in rated if t is not None}
    for text, (known, score) in scores.items():
        met = [want[f][2] for f in plain_features(text) if f in want]
        assert known == len(met)
        assert math.isclose(score, math.tanh(sum(met) / math.sqrt(len(met)) / 2) if met else 0.0, abs_tol=1e-12)


def reviews(n):
    moods = {True: ["quick", "kind", "works well"], False: ["late", "rude", "breaks"]}
    return [(i, f"the order {i % 7} was {moods[i % 2 == 0][i % 3]}, it said", i % 2 == 0) for i in range(n)]


def test_held_out_texts_are_told_apart(rows):
    scored = model.held_out(rows(reviews(200), DDL), "id", least=2)
    found = model.accuracy(scored).first()
    assert found.n == scored.count() > 20 and found.right == found.n and found.auc == 1.0


def test_features_that_differ_by_chance_are_left_out(rows):
    draw = random.Random(7)
    noise = [f"w{i}" for i in range(400)]
    texts = [(i, " ".join(draw.sample(noise, 40)) + (" kind" if i % 2 else " rude"), i % 2 == 1) for i in range(120)]
    learnt = {r.feature for r in model.train(rows(texts, DDL)).collect()}
    assert {"kind", "rude"} <= learnt and len(learnt) < 8


def test_area_counts_ties_half(rows):
    found = model.accuracy(rows([(True, 1.0), (True, 0.0), (False, 0.0), (False, -1.0)], "positive boolean, score double"))
    assert tuple(found.first()) == (4, 3, 0.875)


def test_jobs_train_and_score(spark, rows, folder):
    assert jobs.train_sentiment(rows(reviews(60), DDL), f"{folder}/model", least=1).rows > 5
    ddl = "lead_id int, turn int, feedback_text string, sentiment_processed boolean, sentiment_label string, sentiment_score double"
    feedback = KeyedTable(spark, f"{folder}/feedback", ddl, ["lead_id"])
    feedback.append(rows([
        (1, 1, "it works well", False, None, None), (1, 2, "old", True, "Neutral", 0.0),
        (2, 1, "rude and late", False, None, None), (3, 1, None, False, None, None), (4, 1, "it works well", None, None, None),
        (5, 1, "it works well", False, None, None),
    ], ddl))
    learnt = spark.read.parquet(f"{folder}/model")
    assert jobs.score_sentiment(feedback, model=learnt).rows == 4
    assert jobs.score_sentiment(feedback, model=learnt).state == "skipped"
    found = {(r.lead_id, r.turn): (r.sentiment_processed, r.sentiment_label) for r in feedback.read().collect()}
    assert found == {
        (1, 1): (True, "Positive"), (1, 2): (True, "Neutral"), (2, 1): (True, "Negative"), (3, 1): (True, None),
        (4, 1): (None, None), (5, 1): (True, "Positive"),
    }

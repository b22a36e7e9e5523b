import collections

from compare import connect, difference
from pyspark.sql import functions as F

from leadflow.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def budget_by_hand(held, weights, total, epochs):
    """Budgets by filling one child after the other, for one tree of (domain, lang, source) tokens."""
    out = {}

    def give(prefix, budget):
        if len(prefix) == 3:
            out[prefix] = budget
            return
        kids = collections.defaultdict(int)
        for leaf, n in held.items():
            if leaf[: len(prefix)] == prefix:
                kids[leaf[: len(prefix) + 1]] += n * epochs
        level = mixing.LEVELS[len(prefix)]
        w = {k: weights.get(level, {}).get(k[-1], 1) for k in kids}
        left, budget_left, grants = {k for k in kids if w[k]}, budget, {}
        while True:  # children that can't take their share are full; the others share what they leave
            full = {k for k in left if kids[k] * sum(w[x] for x in left) <= w[k] * budget_left}
            if not full:
                break
            first = min(full, key=lambda k: kids[k] / w[k])
            grants[first] = kids[first]
            budget_left -= kids[first]
            left.discard(first)
        for k in left:
            grants[k] = w[k] * budget_left // sum(w[x] for x in left)
        for k, b in grants.items():
            give(k, b)

    give((), min(total, sum(held.values()) * epochs))
    return {k: b for k, b in out.items() if b}


def test_query_equals_oracle(spark):
    con = connect(SF)
    assert difference(queries.op3_mixing(spark, SF), con, queries.oracles()["op3_mixing"]) is None


def leaves(spark, held):
    return spark.createDataFrame([(*k, n) for k, n in held.items()], "domain string, lang string, source string, held long")


def test_shortage_goes_to_siblings_first(spark):
    held = {("a", "en", "x"): 10, ("a", "en", "y"): 1_000, ("a", "de", "x"): 1_000, ("b", "en", "x"): 1_000}
    got = {tuple(r)[:3]: r.granted for r in mixing.budgets(leaves(spark, held), {}, 800, 0, 1).collect()}
    assert got == budget_by_hand(held, {}, 800, 1)
    assert got["a", "en", "x"] == 10 and got["a", "en", "y"] == 190  # its sibling has what x lacks
    assert got["a", "de", "x"] == 200 and got["b", "en", "x"] == 400


def test_shortage_of_a_subtree_goes_to_its_parents_siblings(spark):
    held = {("a", "en", "x"): 10, ("a", "en", "y"): 20, ("a", "de", "x"): 1_000, ("b", "en", "x"): 50, ("b", "fr", "z"): 900}
    weights = {"domain": {"a": 3}, "lang": {"fr": 0}, "source": {"y": 7}}
    for total in (1, 77, 400, 5_000):
        got = {tuple(r)[:3]: r.granted for r in mixing.budgets(leaves(spark, held), weights, total, 0, 2).collect()}
        want = {k: n for k, n in held.items() if k[1] != "fr"}
        assert sum(got.values()) <= total
        assert got == budget_by_hand(want, weights, total, 2)


def test_nothing_is_granted_for_what_has_no_weight(spark):
    """Whichever level a weight of 0 is at, what is below it leaves the budget to the others."""
    held = {("a", "en", "x"): 100, ("a", "en", "y"): 900, ("b", "en", "x"): 1_000}
    for weights in ({"source": {"y": 0}}, {"source": {"y": 0}, "domain": {"a": 5}}):
        got = {tuple(r)[:3]: r.granted for r in mixing.budgets(leaves(spark, held), weights, 1_000, 0, 1).collect()}
        assert got == {("a", "en", "x"): 100, ("b", "en", "x"): 900}
    got = mixing.budgets(leaves(spark, held), {"domain": {"a": 0, "b": 0}}, 1_000, 0, 1).collect()
    assert got == []


def test_epochs_take_whole_rounds_and_then_a_prefix(documents):
    docs = documents([(i, "w " * (i % 4 + 1), "en", "s") for i in range(50)])
    total = sum(i % 4 + 1 for i in range(50))
    rows = mixing.mix(docs, F.lit("d"), budget=total * 2 + 31, max_epochs=3).collect()
    assert sum(r.n_taken for r in rows) == total * 2 + 31
    by_epoch = collections.Counter(r.epoch for r in rows)
    assert by_epoch[0] == by_epoch[1] == 50 and sum(r.n_taken < r.n_tokens for r in rows) <= 1
    again = mixing.mix(docs.repartition(7), F.lit("d"), budget=total * 2 + 31, max_epochs=3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    other = mixing.mix(docs, F.lit("d"), budget=31, seed=8).collect()
    first = mixing.mix(docs, F.lit("d"), budget=31, seed=7).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in first}


def test_odd_rows(odd, none):
    rows = mixing.mix(odd, F.col("source"), share=1.0, max_epochs=2, carry=["text"]).collect()
    words = [len((r.text or "").split()) for r in odd.collect()]
    assert sum(r.n_taken for r in rows) <= sum(words)
    assert {r.domain for r in rows} <= {"none", "s0", "s1", "s2"} and all(r.n_tokens > 0 for r in rows)
    assert mixing.mix(none, F.lit("d")).collect() == []


def test_taken_text(spark):
    df = spark.createDataFrame([(" a  b\nc ", 3, 2), (" a  b ", 2, 2), ("", 0, 0)], "t string, n long, k long")
    assert [r[0] for r in df.select(mixing.taken_text("t", "n", "k")).collect()] == ["a b", " a  b ", ""]


def test_plan_has_no_python(documents):
    docs = documents([(i, "a b", "en", "s") for i in range(9)])
    plan = mixing.mix(docs, F.lit("d"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

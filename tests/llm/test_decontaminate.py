import random
import re

import numpy as np
from compare import connect, difference
from hypothesis import given, settings
from hypothesis import strategies as st

from leadflow.llm import decontaminate, queries
from leadflow.llm.decontaminate import FMIndex, Phrases, suffix_order, words_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, other in items:
            own = plain_words(other)
            n = min(window, len(own))
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add("null" if item is None else str(item))
        out.append((doc_id, len(words), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


def found(df):
    rows = []
    for r in df.collect():
        hit = [w for s in r.spans for w in range(s["start"], s["stop"])]
        assert len(hit) == len(set(hit))
        rows.append((r.doc_id, r.n_words, tuple(sorted(hit)), tuple(r["items"])))
    return sorted(rows, key=str)


def test_query_equals_oracle(spark):
    con = connect(SF)
    assert difference(queries.op6_decontamination(spark, SF), con, queries.OP6_SQL) is None


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words(text):
    assert words_of(text) == [w.encode() for w in plain_words(text)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 5))
def test_index_finds_all_places(runs, stride):
    text = np.array([x for r in runs for x in (*r, 0)])
    order = suffix_order(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text, 4, stride)
    phrases = [p for r in runs for p in (r[:2], r[-3:], r)] + [[4, 4, 4, 1], [2]]
    width = max(map(len, phrases))
    table = np.array([p + [0] * (width - len(p)) for p in phrases])
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        at = [i for i in range(len(text) - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == at


def made(n_docs, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [(None, "w1 w2 w3"), (3, None), (50, "Ä1 x-Y")]
    docs = []
    for i in range(n_docs):
        body = draw.choices(words, k=draw.randrange(60))
        for _ in range(draw.randrange(3)):
            body[draw.randrange(len(body) + 1):0] = (draw.choice(items)[1] or "").split()
        docs.append((i % 40 if i % 7 else None, ", ".join(body).replace("w1", "W1")))
    return docs, items


def test_equals_brute_force_in_shards_and_blocks(spark):
    docs, items = made(80, 5)
    df = spark.createDataFrame([(*d, "x", "x") for d in docs], "doc_id long, text string, spans string, f0 string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for options in ({}, {"shard_words": 50}, {"block_words": 20}):
        assert found(decontaminate.find(df, bench, **options)) == want


def test_removal_leaves_the_rest(spark):
    text = "Start, here! One two THREE four; five -- six end. Ünd"
    bench = spark.createDataFrame([(1, "one two three four"), (2, "four five six")], "item_id long, text string")
    rows = [(1, text, len(text), "x"), (2, "one two three four", 18, "x"), (3, None, 3, "x"), (4, "clean", 5, "x"), (5, "..", 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, row string")
    for options in ({}, {"block_words": 1}):
        got = decontaminate.remove(df, bench, **options)
        assert got.columns == df.columns
        new = "Start, here!  end. Ünd"
        assert sorted(map(tuple, got.collect())) == [(1, new, len(new), "x"), *rows[2:]]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "fox jumps over the lazy"), (2, "word5 the of 5"), (3, "")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert found(decontaminate.find(odd, bench)) == brute(rows, items)
    assert found(decontaminate.find(odd, bench.where("item_id > 9"))) == brute(rows, [])
    assert decontaminate.find(none, bench).collect() == []
    assert decontaminate.remove(odd, bench).count() == 11


def test_phrases_are_told_apart_once():
    block = Phrases([("1", "a b a b a b a b a b a b"), ("2", "a b a b a b a b a b")])
    assert len(block.items) == 2 and block.items[0] == ["1", "2"]

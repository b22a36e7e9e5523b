import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import language_id, queries

SF = "/root/testdata/sf0.01"


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    out = Counter()
    for w in filter(None, words):
        out.update(w)
    line = " " + " ".join(filter(None, words)) + " "
    if len(line) > 2:
        out.update(line[i : i + 2] for i in range(len(line) - 1))
        out.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    return out


def key(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def brute_rank(counts, ranks=300):
    return [g for g, _ in sorted(((key(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))[:ranks]]


def brute_predict(profiles, text):
    own = brute_rank(brute_grams(text))
    if not own or not profiles:
        return "und", 0.0
    far = {}
    for lang in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[lang])}
        far[lang] = sum(abs(place[g] - i) if g in place else 300 for i, g in enumerate(own))
    best = min(far, key=far.get)
    return best, 1 - far[best] / (300 * len(own))


def is_held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("text", ["", None, "A", "don't stop", "İx ßÀ 漢字", "a  b\n\nc", "..", "Nähe, 42x!"])
def test_grams(text):
    assert sorted(language_id.grams(text).tolist()) == sorted(key(g) for g in brute_grams(text).elements())


def test_query_equals_brute_force_and_is_right(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    counts = {}
    for d in docs:
        if d.lang is not None and not is_held(d.doc_id):
            counts.setdefault(d.lang, Counter()).update(brute_grams(d.text))
    profiles = {g: brute_rank(c) for g, c in counts.items()}
    got = {r.doc_id: r for r in queries.op5_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs[::7]:
        r = got[d.doc_id]
        lang, score = brute_predict(profiles, d.text)
        assert (r.held_out, r.lang_pred) == (is_held(d.doc_id), lang) and abs(r.score - score) < 1e-12
    held = [got[d.doc_id].lang_pred == d.lang for d in docs if is_held(d.doc_id) and d.lang is not None]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_held_out_rows_teach_nothing(documents):
    rows = [(i, "aaa bbb ccc" if is_held(i) else "xxx yyy zzz", "aa" if is_held(i) else "xx", "s") for i in range(60)]
    got = language_id.identify(documents(rows)).collect()
    assert {r.lang_pred for r in got} == {"xx"}
    assert all(r.held_out == is_held(r.doc_id) for r in got)


def test_odd_rows(odd, none):
    got = language_id.identify(odd).collect()
    assert len(got) == 11
    by_text = {r.doc_id: r for r in got}
    for i in (3, 4, 5, 6):
        assert by_text[i].lang_pred == "und" and by_text[i].score == 0
    assert all(0 <= r.score <= 1 for r in got) and by_text[7].lang_pred == "en"
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert language_id.identify(none).collect() == []
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_equal_distances_take_the_first_language():
    same = language_id.ranked(language_id.grams("abc")).tolist()
    assert language_id.Profiles(["b", "c"], [same, same]).predict("abc") == ("b", 1.0)

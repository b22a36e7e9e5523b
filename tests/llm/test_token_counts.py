import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.llm import queries, token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda text: len(model.encode(text or "", num_threads=1))


def test_query_equals_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_token_counts(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n = library(docs[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096), r.doc_id


PIECES = [
    "the", "ing", " ", "  ", "▁", "\n", "\t", "\r\n", "tion", "un", "a", "b", "aaaa", "é", "é", "漢", "🎈", "<s>",
    "<0x41>", "<unk>", "\x00", " ", "ſ", "0", "12", ".", "...", "----", "://", "ab", "hello", "World", "İ", "﻿",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES) | st.text(max_size=3), max_size=16).map("".join))
def test_every_prefix_equals_library(text):
    text = text.encode("utf-8", "ignore").decode()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
    assert token_counts.prefix_counts(token_counts.prefix_store(text, PATH)).tolist() == want


def test_long_runs_without_spaces(library):
    for text in ("a" * 5000, "=" * 3000, " " * 4001, "abcabcx" * 700, "漢字" * 900, "\n" * 2000):
        assert token_counts.prefix_counts(token_counts.prefix_store(text, PATH))[-1] == library(text)


def test_wide_steps_hold_the_same(monkeypatch):
    texts = ["wide steps hold the same counts", "", None, "🎈 x", "wide steps"]
    narrow = [token_counts.prefix_counts(x).tolist() for x in token_counts.prefix_stores(texts, PATH)]
    model = token_counts.steps_of(PATH)[0].model

    class Full(token_counts.Steps):
        def learn(self, texts):
            raise OverflowError

    monkeypatch.setattr(token_counts, "steps_of", lambda path: (Full(model), token_counts.WideSteps(model)))
    wide = token_counts.prefix_stores(texts, PATH)
    assert [x[0] for x in wide] == [8] * 5
    assert [token_counts.prefix_counts(x).tolist() for x in wide] == narrow


def test_parts_learnt_together_are_those_learnt_alone(monkeypatch):
    texts = ["a aa aab ab abc abcd b bc", "xylophone xylophones", "aab  abc", "x" * 60 + " " + "x" * 61]
    alone = [token_counts.prefix_store(t, PATH) for t in texts]
    model = token_counts.steps_of(PATH)[0].model
    monkeypatch.setattr(token_counts, "KEPT", 5)
    monkeypatch.setattr(token_counts, "steps_of", lambda path: (token_counts.Steps(model),) * 2)
    assert token_counts.prefix_stores(texts, PATH) == alone


def test_budgets_and_prefixes(spark, documents, library):
    texts = ["the internationalisation of words", "a  b   c", "", None, "x" * 300, "漢字 and 🎈 balloons"]
    rows = token_counts.count_tokens(documents([(i, t, "en", "s") for i, t in enumerate(texts)]), PATH, limit=8)
    asked = rows.select(
        "doc_id", "over_limit", token_counts.longest_prefix("prefix", F.lit(5)).alias("fits"),
        token_counts.tokens_of_prefix("prefix", F.lit(7)).alias("n7"),
        token_counts.tokens_of_prefix("prefix", F.lit(None)).alias("none"),
        token_counts.longest_prefix("prefix", F.lit(-1)).alias("less"),
    )
    for r in asked.collect():
        text = texts[r.doc_id] or ""
        assert r.fits == max(i for i in range(len(text) + 1) if library(text[:i]) <= 5)
        assert r.n7 == library(text[:7]) and r.over_limit == (library(text) > 8)
        assert r.none is None and r.less is None


def test_truncation(documents, library):
    docs = documents([(1, "one two three four five six seven", "en", "s"), (2, None, None, None), (3, "", "en", "s")])
    got = token_counts.truncate(docs, PATH, 4)
    assert got.columns == docs.columns
    by_id = {r.doc_id: r for r in got.collect()}
    assert library(by_id[1].text) <= 4 and by_id[1].text == "one two three four" and by_id[1].row == "x"
    assert by_id[2].text is None and by_id[3].text == ""


def test_odd_rows(odd, none, library):
    want = sorted((r.doc_id or 0, library(r.text), len((r.text or "").encode())) for r in odd.collect())
    got = token_counts.count_tokens(odd, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_bytes) for r in got) == want
    assert token_counts.count_tokens(none, PATH).collect() == []


def test_pairs_that_stay_are_those_that_merge_to_themselves():
    model = token_counts.steps_of(PATH)[0].model
    tokens = sorted(model.halves)[::37]
    pairs = [(t[:i], t[i:]) for t in tokens for i in range(1, len(t))] + list(zip(tokens, tokens[1:]))
    pairs = [p for p in pairs if all(len(x) == 1 or x in model.halves for x in p)]
    assert len(pairs) > 1000
    assert [p for p in pairs if model.stays(*p) != (model.merged("".join(p))[0] == [*p])] == []

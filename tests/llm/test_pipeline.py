import pytest

import corpus_pipeline
from leadflow.llm import decontaminate, secret_scan
from leadflow.llm.common import table, written
from leadflow.llm.simhash import fingerprint

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_dedup", "decontamination", "secret_scan", "mixing",
    ]


def test_stages_by_brute_force(spark):
    """Each stage on what the one before kept, against its decision by hand."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    first = written(stage["language_id"](spark, docs, SF), "t1")
    want = sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
    assert first.columns == columns and sorted(r.doc_id for r in first.collect()) == want

    second = written(stage["simhash_dedup"](spark, first, SF), "t2")
    fps = {r.doc_id: fingerprint(r.text) for r in first.collect()}
    group = {i: i for i in fps}
    for _ in range(len(fps)):
        new = {i: min(group[j] for j in fps if (fps[i] ^ fps[j]) % (1 << 64) == 0 or ((fps[i] ^ fps[j]) % (1 << 64)).bit_count() <= 3) for i in fps}
        if new == group:
            break
        group = new
    kept = second.collect()
    assert second.columns == columns and sorted(r.doc_id for r in kept) == sorted(set(group.values()))

    third = written(stage["decontamination"](spark, second, SF), "t3")
    assert third.columns == columns
    left = decontaminate.find(third, table(spark, SF, "benchmark")).where("size(spans) > 0").count()
    assert left == 0
    clean = {r.doc_id: r.text for r in second.collect()}
    hit = {r.doc_id for r in decontaminate.find(second, table(spark, SF, "benchmark")).where("size(spans) > 0").collect()}
    for r in third.collect():
        assert r.doc_id in hit or r.text == clean[r.doc_id]
    assert set(clean) - {r.doc_id for r in third.collect()} <= hit

    fourth = written(stage["secret_scan"](spark, third, SF), "t4")
    assert fourth.columns == columns and fourth.count() == third.count()
    before = {r.doc_id: r.text for r in third.collect()}
    for r in fourth.collect():
        assert not secret_scan.base_spans(r.text) and len(secret_scan.base_spans(before[r.doc_id])) <= r.text.count("<secret>")
        assert "<secret>" in r.text or r.text == before[r.doc_id]

    last = stage["mixing"](spark, fourth, SF).collect()
    assert {r.doc_id for r in last} <= {r.doc_id for r in fourth.collect()}
    assert all(len(r.text.split()) == r.n_taken for r in last if r.n_taken < r.n_tokens)


@pytest.mark.parametrize("at", range(5))
def test_stages_take_odd_tables(spark, odd, none, at):
    name, stage = corpus_pipeline.STAGES[at]
    got = stage(spark, odd, SF)
    if name != "mixing":
        assert got.columns == odd.columns and got.count() <= 11
    assert got.count() > 0
    assert stage(spark, none, SF).collect() == []


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.n_taken > 0 for r in rows)

"""Late lane, names of loads, drift by order, priorities as a stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators.drift import quantile_counts, quantile_drift, two_sample_distance
from leadflow.operators.late import ExportRecord
from leadflow.plans import jobs
from leadflow.schemas import table_schema
from leadflow.sinks.csv_export import read_export
from leadflow.sinks.keyed import KeyedTable
from leadflow.sinks.state import StateTable
from leadflow.streaming import ingest
from leadflow.streaming.priority import PRIORITIES, stream_priority


def T(text):
    return dt.datetime.fromisoformat(text)


# Late lane


CONTACTS = (
    "id bigint, client string, first_name string, last_name string, email string, email2 string, email3 string, "
    "phone string, phone2 string, phone3 string, twitter string, city string, state string, zip string, "
    "country string, ingestion_timestamp timestamp_ntz"
)


@pytest.fixture
def source(rows):
    def make(values):
        return rows([(i, "a", f"n{i}", *[None] * 12, T(t)) for i, t in values], CONTACTS)

    return make


def test_late_rows_are_delivered_once(spark, source, folder):
    checkpoints = StateTable(spark, f"{folder}/c", table_schema("checkpoint"), ["dag_id", "src_table"], 2)
    record = ExportRecord(spark, f"{folder}/record", source([]).schema, ["id"])
    args = "staging.contacts", checkpoints
    first = source([(1, "2020-01-01"), (2, "2020-01-02"), (3, "2020-01-03")])
    assert jobs.export_table(first, *args, f"{folder}/out", record=record, max_rows=2).rows == 3
    assert jobs.export_late(first, *args, record, f"{folder}/late").state == "skipped"
    # one row at a time that was exported already, one on a day without any, one not late, one with a null id
    more = first.unionByName(source([(4, "2020-01-02"), (5, "2019-12-01"), (6, "2020-01-04"), (None, "2020-01-01")]))
    bounded = jobs.export_late(more, *args, record, f"{folder}/late", since="2020-01-01")
    assert bounded.rows == 2
    assert jobs.export_late(more, *args, record, f"{folder}/late").rows == 1
    assert jobs.export_late(more, *args, record, f"{folder}/late").state == "skipped"
    assert jobs.export_table(more, *args, f"{folder}/out", record=record).rows == 1
    names = lambda lane: sorted(
        r.first_name for r in read_export(spark, f"{folder}/{lane}/staging.contacts", ["first_name"]).collect()
    )
    assert names("out") == ["n1", "n2", "n3", "n6"] and names("late") == ["n4", "n5", "nNone"]


def test_late_upload_that_fails_is_late_again(spark, source, folder):
    checkpoints = StateTable(spark, f"{folder}/c", table_schema("checkpoint"), ["dag_id", "src_table"], 2)
    record = ExportRecord(spark, f"{folder}/record", source([]).schema, ["id"])
    args = "staging.contacts", checkpoints
    jobs.export_table(source([(1, "2020-01-02")]), *args, f"{folder}/out", record=record)
    late = source([(1, "2020-01-02"), (2, "2020-01-01")])
    refuse = lambda client, path: (500, "")
    with pytest.raises(RuntimeError, match="failed to upload"):
        jobs.export_late(late, *args, record, f"{folder}/late", upload=refuse, uploads_at_once=1)
    accept = lambda client, path: (200, '{"file":"f"}')
    assert jobs.export_late(late, *args, record, f"{folder}/late", upload=accept, uploads_at_once=1).rows == 1


# Names of loads


def test_a_name_belongs_to_one_checkpoint(spark, folder):
    lake = f"{folder}/lake"
    ingest.claim_name(spark, lake, "x", None)
    ingest.claim_name(spark, lake, "x", "id-1", keep=True)
    ingest.claim_name(spark, lake, "x", "id-1", keep=True)
    ingest.claim_name(spark, lake, "y", "id-2", keep=True)
    for own in (None, "id-2"):
        with pytest.raises(ValueError, match="another checkpoint"):
            ingest.claim_name(spark, lake, "x", own)
    with pytest.raises(ValueError, match="another checkpoint"):  # began at the same time
        ingest.claim_name(spark, lake, "x", "id-3", keep=True)
    assert ingest.checkpoint_id(spark, f"{folder}/none") is None


# Drift


def test_distance_of_two_samples(rows):
    draw = random.Random(5)
    values = [(draw.choice(["a", "b", None]), draw.randrange(30) / 4, draw.random() < 0.4) for _ in range(400)]
    values += [("only", 1.0, True), ("a", None, True), ("a", 2.0, False)]
    df = rows(values, "g string, v double, ref boolean")
    found = {r.g: (r.r, r.c, r.distance) for r in two_sample_distance(df, F.col("ref"), "v", ["g"], ranges=5).collect()}
    assert found.keys() == {"a", "b", None}
    for g, (r, c, distance) in found.items():
        ref = sorted(v for h, v, x in values if h == g and x and v is not None)
        rest = sorted(v for h, v, x in values if h == g and not x and v is not None)
        steps = [abs(sum(x <= v for x in ref) / len(ref) - sum(x <= v for x in rest) / len(rest)) for v in ref + rest]
        assert (r, c) == (len(ref), len(rest)) and abs(distance - max(steps)) < 1e-12
    assert two_sample_distance(df.limit(0), F.col("ref"), "v", ["g"]).collect() == []


def test_quantile_bins_hold_equal_parts_of_the_reference(rows):
    values = [("a", float(i**2), i % 2 == 0) for i in range(400)] + [("b", 1.0, True), ("b", 5.0, False), ("b", None, False)]
    df = rows(values, "g string, v double, ref boolean")
    counts = quantile_counts(df, F.col("ref"), "v", ["g"], bins=4, accuracy=10_000).collect()
    assert sorted((r.bin, r.r) for r in counts if r.g == "a") == [(i, 50) for i in range(4)]
    assert sorted((r.bin, r.r, r.c) for r in counts if r.g == "b") == [(0, 1, 0), (3, 0, 1)]
    psi = {r.g: r.psi for r in quantile_drift(df, F.col("ref"), "v", ["g"], bins=4).collect()}
    assert psi["a"] < 0.01 and psi["b"] > 1


# Priorities as a stream


def test_stream_priority_in_any_order(spark, rows, folder):
    scores_ddl = "lead_id bigint, name string, lead_score double, scored_at timestamp_ntz"
    feedback_ddl = "lead_id bigint, feedback_text string, sentiment_processed boolean"
    table = KeyedTable(spark, f"{folder}/out", PRIORITIES, ["lead_id"])

    def arrive(scores, feedback):
        rows(scores, scores_ddl).write.mode("append").parquet(f"{folder}/scores")
        rows(feedback, feedback_ddl).write.mode("append").parquet(f"{folder}/feedback")
        before = len(table.commits())
        stream_priority(
            spark, f"{folder}/scores", scores_ddl, f"{folder}/feedback", feedback_ddl, table, f"{folder}/check",
        ).awaitTermination()
        return {r.lead_id: (r.lead_score, r.sentiment_score, r.final_priority) for r in table.read().collect()}, len(table.commits()) - before

    found, _ = arrive([(1, "a", 0.8, T("2024-01-02"))], [(2, "great", False), (1, "bad", True)])
    assert found == {1: (0.8, None, "High Priority Lead")}
    found, _ = arrive([(2, "b", 0.1, T("2024-01-02"))], [(1, "bad", False), (2, "bad", False), (2, "good", False)])
    assert found == {1: (0.8, -1.0, "Review Manually Before Sales"), 2: (0.1, 0.333333, "Consider for Nurturing")}
    # an older score changes nothing, a newer one counts
    found, _ = arrive([(2, "b", 0.9, T("2024-01-01")), (1, "a", 0.2, T("2024-01-03"))], [])
    assert found == {1: (0.2, -1.0, "Low Priority"), 2: (0.1, 0.333333, "Consider for Nurturing")}

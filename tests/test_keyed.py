"""Tables changed by adding commits, and the status history kept as events."""

import datetime as dt
import glob
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.operators import status_log
from leadflow.operators.status import change_status, open_rows, running_files
from leadflow.schemas import table_schema
from leadflow.sinks.keyed import KeyedTable

DDL = "k int, v string"


def T(text):
    return dt.datetime.fromisoformat(text)


def held(table):
    return sorted((r.k is None, r.k or 0, r.v) for r in table.read().collect())


def test_keyed_table(spark, rows, folder):
    table = KeyedTable(spark, f"{folder}/t", DDL, ["k"])
    assert table.read().collect() == [] and table.of_keys(rows([(1, "x")], DDL)).collect() == []
    assert table.append(rows([(i, "old") for i in range(20)], DDL)) == 20
    for i in range(3):
        assert table.merge(rows([(i, f"new{i}"), (100 + i, "added")], DDL)) == 2
    found = {r.k: r.v for r in table.read().collect()}
    assert len(found) == 23 and found[1] == "new1" and found[7] == "old" and found[102] == "added"
    table.append(rows([(1, "more"), (None, "no key")], DDL))
    again = KeyedTable(spark, f"{folder}/t", DDL, ["k"])
    assert again.read().count() == 25
    assert again.update(rows([(1,), (None,)], "k int"), lambda old: old.withColumn("v", F.upper("v"))) == 3
    assert [r.v for r in again.of_keys(rows([(1, "")], DDL)).orderBy("v").collect()] == ["MORE", "NEW1"]
    assert [r.v for r in again.of_keys(rows([(None, "")], DDL)).collect()] == ["NO KEY"]
    before = held(again)
    assert again.compact() == 25 and held(again) == before
    assert [c.base for c in again.commits()] == [True]
    again.merge(rows([(7, "last")], DDL))
    assert [r.v for r in again.of_keys(rows([(7, "")], DDL)).collect()] == ["last"]


def test_two_rows_for_a_key_end_a_merge(spark, rows, folder):
    table = KeyedTable(spark, f"{folder}/t", DDL, ["k"])
    with pytest.raises(Exception, match="several rows for key 1"):
        table.merge(rows([(1, "a"), (1, "b")], DDL))
    assert table.read().collect() == []


def test_a_few_changed_keys_write_little(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k bigint, v bigint, text string", ["k"])
    table.append(spark.range(100_000).select(F.col("id").alias("k"), F.lit(0).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("text")))
    size = lambda: {f: os.path.getsize(f) for f in glob.glob(f"{folder}/t/rows/*/*.parquet")}
    before = size()
    some = spark.range(100).select((F.col("id") * 997 + 13).alias("k"))
    table.update(some, lambda old: old.withColumn("v", F.lit(1)))
    after = size()
    assert all(after[f] == n for f, n in before.items())
    assert sum(n for f, n in after.items() if f not in before) < 0.1 * sum(before.values())
    assert table.read().filter("v = 1").count() == 100 and table.read().count() == 100_000


def test_a_failed_change_keeps_the_old_rows(spark, rows, folder):
    table = KeyedTable(spark, f"{folder}/t", "k int", ["k"])
    table.append(rows([(1,)], "k int"))
    with pytest.raises(Exception, match="boom"):
        table.update(rows([(1,)], "k int"), lambda old: old.select(F.raise_error(F.lit("boom")).cast("int").alias("k")))
    assert [r.k for r in table.read().collect()] == [1]
    # rows of a commit that was never listed don't count, and its number is used again
    rows([(9,)], "k int").write.mode("overwrite").parquet(f"{folder}/t/rows/_commit=2")
    assert [r.k for r in table.read().collect()] == [1]
    table.merge(rows([(2,)], "k int"))
    assert sorted(r.k for r in table.read().collect()) == [1, 2]


def test_one_commit_adds_puts_and_ends_rows_once(spark, rows, folder):
    table = KeyedTable(spark, f"{folder}/t", DDL, ["k"])
    table.append(rows([(1, "a"), (2, "b"), (3, "c"), (4, "d")], DDL))
    changed = {"added": rows([(1, "more"), (3, "new")], DDL), "put": rows([(2, "put")], DDL), "about": rows([(3,), (4,)], "k int")}
    assert table.change(**changed, label="day 1") == 3
    assert table.change(**changed, label="day 1") == 0  # repeated after a failure
    want = [(False, 1, "a"), (False, 1, "more"), (False, 2, "put"), (False, 3, "new")]
    assert held(table) == want
    table.compact()
    assert held(table) == want and table.change(**changed, label="day 1") == 0
    assert table.update(rows([(1,)], "k int"), lambda old: old.filter("v = 'more'")) == 1
    assert table.update(rows([(2,)], "k int"), lambda old: old.limit(0)) == 0
    assert held(table) == [(False, 1, "more"), (False, 3, "new")]


def test_a_replaced_table_is_written_once_and_there_at_once(spark, rows, folder):
    table = KeyedTable(spark, f"{folder}/t", DDL, ["k"])
    table.append(rows([(1, "a"), (2, "b")], DDL))
    old = table.read()
    assert table.replace(rows([(3, "c")], DDL), "v2") == 1 and table.replace(rows([(4, "d")], DDL), "v2") == 0
    assert held(table) == [(False, 3, "c")]
    assert old.count() == 2  # a reader that began before goes on
    with pytest.raises(Exception, match="boom"):
        table.replace(rows([(5, "e")], DDL).withColumn("v", F.raise_error(F.lit("boom")).cast("string")))
    assert held(table) == [(False, 3, "c")]


def scanned(df):
    """Rows that the scans of a frame give on, when it is collected."""
    df.collect()
    plan, out, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan.executedPlan() if hasattr(plan, "executedPlan") and plan.nodeName() == "AdaptiveSparkPlan" else plan)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            out += node.metrics().get("numOutputRows").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return out


def test_few_keys_read_few_rows(spark, folder):
    table = KeyedTable(spark, f"{folder}/t", "k bigint, text string", ["k"])
    table.append(spark.range(80_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("text")).repartition(8))
    table.compact()
    found = table.of_keys(spark.createDataFrame([(70,), (41_000,)], "k bigint"))
    assert sorted(r.k for r in found.collect()) == [70, 41_000]
    assert 0 < scanned(found) <= 40_000


def test_new_bases_come_by_themselves(spark, rows, folder):
    table = KeyedTable(spark, f"{folder}/t", DDL, ["k"], share=0.5, commits=3)
    table.append(rows([(i, "a") for i in range(10)], DDL))
    kinds = []
    for i in range(9):
        table.merge(rows([(i, "b")], DDL))
        kinds.append([c.base for c in table.commits()])
    assert [True] in kinds and max(map(len, kinds)) <= 4
    assert held(table) == [(False, i, "b" if i < 9 else "a") for i in range(10)]
    old = [f for f in glob.glob(f"{folder}/t/rows/*") if spark.read.schema(DDL).parquet(f).isEmpty()]
    assert old  # commits before the last base but one


steps = st.lists(st.tuples(
    st.sampled_from(["append", "merge", "update", "compact"]), st.lists(st.integers(0, 4), max_size=3, unique=True)
), max_size=6)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(steps)
def test_any_changes_equal_a_plain_list(spark, rows, tmp_path_factory, changes):
    table = KeyedTable(spark, str(tmp_path_factory.mktemp("keyed")), DDL, ["k"], share=10, commits=100)
    want = []
    for i, (kind, keys) in enumerate(changes):
        new = [(k, f"{kind}{i}") for k in keys]
        if kind == "append":
            table.append(rows(new, DDL))
            want += new
        elif kind == "merge":
            table.merge(rows(new, DDL))
            want = [r for r in want if r[0] not in keys] + new
        elif kind == "update":
            table.update(rows(new, DDL), lambda old: old.withColumn("v", F.concat("v", F.lit("+"))))
            want = [(k, v + "+") if k in keys else (k, v) for k, v in want]
        else:
            table.compact()
    assert sorted((r.k, r.v) for r in table.read().collect()) == sorted(want)


# The status history as events


FILES = [("a", "f1", "t"), ("a", "f2", "t"), ("b", "f3", "t")]
HISTORY = [
    ("a", "f1", "t", "running", T("2020-01-01 00:00"), None), ("a", "f2", "t", "running", T("2020-01-01 01:00"), None),
    ("b", "f3", "t", "succeeded", T("2020-01-01 02:00"), T("2020-01-01 03:00")),
    ("a", "f1", "t", "running", T("2020-01-01 04:00"), None),
]


def content(df):
    return sorted(map(str, df.select(*table_schema("data_source_status").names).collect()))


def test_events_equal_the_changed_history(spark, rows, folder):
    ddl = table_schema("data_source_status")
    log = status_log.StatusLog(spark, f"{folder}/log")
    history = rows(HISTORY, ddl)
    log.append(history)
    assert content(log.read()) == content(history)
    changes = [
        (T("2020-01-01 05:00"), [("a", "f1", "t", "FAILED")]), (T("2020-01-01 06:00"), [("a", "f2", "t", "RUNNING"), ("b", "f3", "t", "UNKNOWN")]),
        (T("2020-01-01 07:00"), [("a", "f2", "t", "SUCCEEDED")]),
    ]
    stands = [(T("2020-01-01 04:30"), content(history))]
    for now, changed in changes:
        made = rows(changed, "client string, file string, src_table string, new_status string")
        history = change_status(history, made, now)
        log.change(made, now)
        assert content(log.read()) == content(history)
        stands.append((now, content(history)))
        assert sorted(map(str, log.running(now, 24).collect())) == sorted(map(str, running_files(history, now, 24).collect()))
    for time, want in stands:
        assert content(status_log.as_of(log.events, time)) == want
    log.table.compact()
    assert content(log.read()) == content(history)


def test_current_status_and_few_written_rows(spark, rows, folder):
    log = status_log.StatusLog(spark, f"{folder}/log")
    files = rows(FILES, "client string, file string, src_table string")
    log.append(open_rows(files, T("2020-01-01")))
    assert log.change(rows([("a", "f2", "t", "FAILED")], "client string, file string, src_table string, new_status string"), T("2020-01-02")) == 1
    found = {r.file: (r.status, r.since) for r in status_log.current(log.events).collect()}
    assert found == {"f1": ("running", T("2020-01-01")), "f2": ("failed", T("2020-01-02")), "f3": ("running", T("2020-01-01"))}
    assert sorted(r.file for r in log.running(T("2020-01-01 12:00"), 24).collect()) == ["f1", "f3"]

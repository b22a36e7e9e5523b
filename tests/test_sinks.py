import datetime as dt
from decimal import Decimal
import glob
import gzip
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.sinks.csv_export import export_csv, float_text, read_export, route_uploads
from leadflow.sinks.state import StateTable, scratch
from leadflow.sinks.tables import append, fit, replace, rows_frame, upsert
from leadflow.sources.files import list_files, text_lines
from leadflow.sources.tables import destination_schema, query_file, read_source


def files_of(folder, client):
    found = sorted(glob.glob(f"{folder}/client={client}/*.csv.gz"))
    return [gzip.open(f, "rt", newline="").read() for f in found]


def test_csv_bytes(rows, folder):
    df = rows(
        [("a", 'q"uote', "back\\", None, "", " pad ", True, 1.5, dt.datetime(2020, 1, 1, 2, 3, 4)),
         ("a", "two\nlines", "x\\y", "é", ",", "z", False, 1e7, dt.datetime(2020, 1, 1, 0, 0, 0, 5))],
        "client string, s1 string, s2 string, s3 string, s4 string, s5 string, b boolean, "
        "f double, t timestamp_ntz",
    ).coalesce(1)
    seen = export_csv(df, f"{folder}/out")
    header, *lines = files_of(f"{folder}/out", "a")[0].split('"\n')
    assert header == '"s1","s2","s3","s4","s5","b","f","t'
    assert sorted(lines) == sorted([
        '"q\\"uote","back\\","None",""," pad ","True","1.5","2020-01-01 02:03:04',
        '"two\nlines","x\\y","é",",","z","False","10000000.0","2020-01-01 00:00:00.000005',
        "",
    ])
    assert seen.get["n"] == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from('ab"\\,\n\r \t\'é\u2028#'), max_size=8), min_size=1, max_size=30))
def test_csv_bytes_of_any_text(spark, tmp_path_factory, texts):
    """Each line is what joining the quoted, quote-escaped texts gives."""
    folder = str(tmp_path_factory.mktemp("csv"))
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "client string, i int, t string")
    export_csv(df.coalesce(1), f"{folder}/out")
    found = "".join(files_of(f"{folder}/out", "a"))
    for i, t in enumerate(texts):
        escaped = t.replace('"', '\\"')
        assert f'"{i}","{escaped}"\n' in found
    assert len(found) == len('"i","t"\n') + sum(
        len(f'"{i}","') + len(t.replace('"', '\\"')) + 2 for i, t in enumerate(texts)
    )


def test_csv_readback(spark, rows, folder):
    values = [("a-b", None, ""), ("a-b", 'x"y', "None of it"), ("c", "\n", " ")]
    export_csv(rows(values, "client string, x string, y string"), f"{folder}/out")
    back = read_export(spark, f"{folder}/out", ["x", "y"])
    assert sorted(map(str, back.select("client", "x", "y").collect())) == sorted(
        str(r) for r in rows(values, "client string, x string, y string").collect()
    )


def test_csv_splits_a_big_client(spark, folder):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', concat('c', id % 5)) client", "id")
    export_csv(df, f"{folder}/out", max_records=100)
    hot = files_of(f"{folder}/out", "hot")
    assert len(hot) >= 4 and all(f.startswith('"id"\n') for f in hot)
    assert read_export(spark, f"{folder}/out", ["id"]).count() == 1000


@pytest.mark.parametrize("value", [
    0.0, -0.0, 1.0, 0.1, 123456.789, 1e7, 12345678.5, 9.99e15, 1e16, 1.5e20, 1e-3, 1.25e-4, 1e-5,
    -2.5e-7, 1e100, float("inf"), float("-inf"), float("nan"),
])
def test_float_text(rows, value):
    assert rows([(value,)], "f double").select(float_text(F.col("f"))).first()[0] == str(value)


def test_route_uploads(rows):
    df = rows(
        [("a", 200, '{"file":"f1"}'), ("b", 200, "{}"), ("c", 500, '{"file":"f"}'), ("d", 200, None),
         ("e", None, None)],
        "name string, code int, body string",
    )
    found = {r.name: (r.route, r.accepted_file) for r in route_uploads(df).collect()}
    assert found == {
        "a": ("processed", "f1"), "b": ("failed", None), "c": ("failed", None),
        "d": ("failed", None), "e": ("failed", None),
    }


def test_append_aligns_by_name(spark, rows, folder):
    table, ddl = f"{folder}/t", "a bigint, b string, c date"
    assert append(rows([("x", 1)], "b string, a int"), table, ddl) == 1
    assert append(rows([(2,)], "a int"), table, ddl) == 1
    assert sorted(map(tuple, spark.read.parquet(table).select("a", "b", "c").collect())) == [
        (1, "x", None), (2, None, None),
    ]
    with pytest.raises(ValueError, match="zz"):
        fit(rows([(1, 2)], "a int, zz int"), ddl)
    assert destination_schema(spark, table).names == ["a", "b", "c"]


def test_rows_frame(spark):
    df = rows_frame(spark, [{"b": "it's"}, {"a": 1}], "a int, b string")
    assert list(map(tuple, df.collect())) == [(None, "it's"), (1, None)]
    with pytest.raises(ValueError, match="c"):
        rows_frame(spark, [{"c": 1}], "a int")


def test_replace_and_catalog_tables(spark, rows):
    replace(rows([(1,)], "a int"), "replaced_table")
    replace(rows([(2,), (3,)], "a int"), "replaced_table")
    append(rows([(4,)], "a int"), "replaced_table", "a int")
    try:
        assert sorted(r.a for r in read_source(spark, table="replaced_table").collect()) == [2, 3, 4]
    finally:
        spark.sql("drop table replaced_table")


def test_upsert(rows):
    old = rows([("a", 1, 1), ("a", 2, 1), ("b", 1, 1)], "k string, j int, v int")
    new = rows([("a", 1, 9), ("c", 1, 9)], "k string, j int, v int")
    assert sorted(map(tuple, upsert(old, new, ["k", "j"]).collect())) == [
        ("a", 1, 9), ("a", 2, 1), ("b", 1, 1), ("c", 1, 9),
    ]


def test_upsert_ends_at_two_rows_for_a_key(rows):
    old = rows([("a", 1)], "k string, v int")
    with pytest.raises(Exception, match="several rows for key b"):
        upsert(old, rows([("b", 1), ("b", 2), ("c", 1)], "k string, v int"), ["k"]).collect()


def test_state_table(spark, rows, folder):
    ddl = "k int, v string"
    table = StateTable(spark, f"{folder}/state", ddl, ["k"], 3)
    assert table.read().isEmpty()
    table.append(rows([(i, "old") for i in range(20)], ddl))
    for i in range(3):  # reads and changes itself
        table.merge(rows([(i, f"new{i}"), (100 + i, "added")], ddl))
    found = {r.k: r.v for r in table.read().collect()}
    assert len(found) == 23 and found[1] == "new1" and found[7] == "old" and found[102] == "added"
    again = StateTable(spark, f"{folder}/state", ddl, ["k"], 3)
    assert again.read().count() == 23
    table.merge(rows([], ddl))
    assert again.read().count() == 23


def test_a_change_rewrites_its_partitions_only(spark, rows, folder):
    table = StateTable(spark, f"{folder}/state", "k int, v int", ["k"], 8)
    table.append(rows([(i, 0) for i in range(100)], "k int, v int"))
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/state/*/*.parquet")}
    before = files()
    table.merge(rows([(5, 1)], "k int, v int"))
    kept = [f for f, t in files().items() if before.get(f) == t]
    assert len({os.path.dirname(f) for f in kept}) == 7
    assert table.read().filter("v = 1").count() == 1 and table.read().count() == 100


def test_a_failed_change_keeps_the_old_rows(spark, rows, folder):
    table = StateTable(spark, f"{folder}/state", "a int", ["a"], 2)
    table.append(rows([(1,)], "a int"))
    with pytest.raises(Exception, match="boom"):
        table.update(table.read(), lambda old: old.select(F.raise_error(F.lit("boom")).cast("int").alias("a")))
    assert [r.a for r in table.read().collect()] == [1]


def test_scratch_is_emptied(spark, rows, folder):
    with scratch(rows([(1,)], "a int"), "x", f"{folder}/work") as made:
        with scratch(rows([(2,), (3,)], "a int"), "x", f"{folder}/work") as other:  # of a job that runs at once
            assert made.count() == 1 and other.count() == 2
        assert made.count() == 1
    assert len(glob.glob(f"{folder}/work/x-*")) == 2
    assert spark.read.parquet(f"{folder}/work/x-*").count() == 0


def test_read_source_checks(spark, rows, folder):
    with pytest.raises(ValueError):
        read_source(spark)
    with pytest.raises(ValueError):
        read_source(spark, table="t", query="select 1")
    frame = rows([(1, "a"), (2, "b")], "n int, s string")
    found = read_source(spark, query="select s from {t} where n > :low", args={"low": 1}, t=frame)
    assert found.first().s == "b"
    typed = read_source(
        spark, query="select :d as d, :t as t, :f as f, :l as l, :b as b, :s.x as x",
        args={"d": Decimal("1.50"), "t": dt.datetime(2020, 1, 1), "f": 0.5, "b": True,
              "l": F.array(F.lit(1), F.lit(2)), "s": F.struct(F.lit("v").alias("x"))},
    ).first()
    assert (typed.d, typed.f, typed.l, typed.b, typed.x) == (Decimal("1.50"), 0.5, [1, 2], True, "v")
    path = f"{folder}/q.sql"
    with open(path, "w") as f:
        f.write("select s\nfrom {t}\nwhere n = :n")
    assert query_file(spark, path, args={"n": 1}, t=frame).first().s == "a"


def test_text_files_by_name(spark, folder):
    for name, text in {"cdc-1": "a\nb\n", "cdc-x[1]": "c\n", "other-1": "d\n"}.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    with gzip.open(f"{folder}/cdc-2.gz", "wt") as f:
        f.write("z\n")
    lines = lambda **k: sorted(r.value for r in text_lines(spark.read, folder, **k).collect())
    assert lines() == ["a", "b", "c", "d", "z"]
    assert lines(prefix="cdc-") == ["a", "b", "c", "z"]
    assert lines(prefix="cdc-x[") == ["c"]
    assert lines(prefix="cdc", contains="-1") == ["a", "b"]
    listed = list_files(spark, folder, prefix="cdc", contains="2")
    assert [(r.file_name, r.length > 0) for r in listed.collect()] == [("cdc-2.gz", True)]

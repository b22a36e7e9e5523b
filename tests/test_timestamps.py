import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadflow.functions import timestamps as ts
from leadflow.functions.records import (
    coerce_record, drop_zero_dates, stringify_decimals, stringify_times, text_schema,
)
from leadflow.schemas import struct_type


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("value, text", [
    (dt.datetime(2020, 1, 1), "2020-01-01 00:00:00"),
    (dt.datetime(2020, 1, 1, 0, 0, 0, 500000), "2020-01-01 00:00:00.500000"),
    (dt.datetime(1969, 12, 31, 23, 59, 59, 1), "1969-12-31 23:59:59.000001"),
])
def test_default_text_is_that_of_python(rows, value, text):
    df = stringify_times(rows([(value,)], "t timestamp_ntz"))
    assert one(df) == text == str(value)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2200, 1, 1)), min_size=1))
def test_default_text_of_any_time(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "t timestamp_ntz")
    assert [r.t for r in stringify_times(df).collect()] == [str(v) for v in values]


def test_zoned_text_has_its_offset(spark):
    df = spark.sql("select timestamp'2020-01-01 00:00:00.5 UTC' as t, date'2020-02-03' as d")
    assert tuple(stringify_times(df).first()) == ("2020-01-01 00:00:00.500000+00:00", "2020-02-03")


def test_pattern_text_of_a_date(rows):
    df = stringify_times(rows([(dt.date(2020, 1, 1),)], "d date"), ts.CDC_PATTERN)
    assert one(df) == "2020-01-01 00:00:00.000000"


def test_zero_dates(rows):
    df = rows([("0000-00-00 00:00:00",), ("x 0000-00-00 y",), ("2020-01-01",), (None,)], "s string")
    assert [r.s for r in drop_zero_dates(df).collect()] == [None, None, "2020-01-01", None]


def test_nested_text(rows):
    df = rows(
        [([("0000-00-00", 1, dt.datetime(2020, 1, 1))], ["0000-00-00", "a"], {"k": "0000-00-00"})],
        "l array<struct<d:string,n:int,t:timestamp_ntz>>, s array<string>, m map<string,string>",
    )
    row = stringify_times(df).first()
    assert [tuple(e) for e in row.l] == [(None, 1, "2020-01-01 00:00:00")]
    assert row.s == [None, "a"] and row.m == {"k": None}


@pytest.mark.parametrize("text, wanted", [
    ("2020-01-01", dt.datetime(2020, 1, 1)),
    ("2020-01-01 10:11:12.5", dt.datetime(2020, 1, 1, 10, 11, 12, 500000)),
    ("2020-01-01T10:11:12+02:00", dt.datetime(2020, 1, 1, 10, 11, 12)),
    ("20200105", dt.datetime(2020, 1, 5)),
    ("20200105101112", dt.datetime(2020, 1, 5, 10, 11, 12)),
    ("2020/1/5", dt.datetime(2020, 1, 5)),
    ("1/2/2020", dt.datetime(2020, 1, 2)),
    ("1/2/2020 3:4:5", dt.datetime(2020, 1, 2, 3, 4, 5)),
    ("5 Jan 2020", dt.datetime(2020, 1, 5)),
    ("Jan 5, 2020", dt.datetime(2020, 1, 5)),
    ("1/2/2020 10:30", dt.datetime(2020, 1, 2, 10, 30)),
    ("1/2/2020 3:04:05 pm", dt.datetime(2020, 1, 2, 15, 4, 5)),
    ("Jan 2, 2020 10:30:00", dt.datetime(2020, 1, 2, 10, 30)),
    ("january 2, 2020 10:30", dt.datetime(2020, 1, 2, 10, 30)),
    ("2 January 2020", dt.datetime(2020, 1, 2)),
    ("2020-01-02 10:30 PM", dt.datetime(2020, 1, 2, 22, 30)),
    ("2020-1-2 12:00:01 am", dt.datetime(2020, 1, 2, 0, 0, 1)),
    ("Tue, 03 Jan 2020 10:00:00", dt.datetime(2020, 1, 3, 10)),
    ("Friday 3 Jan 2020", dt.datetime(2020, 1, 3)),
    ("01-02-2020", dt.datetime(2020, 1, 2)),
    ("20200102T103000", dt.datetime(2020, 1, 2, 10, 30)),
    ("2 Janvier 2020", None),
    ("1/2/2020 25:00", None),
    ("Someday 3 Jan 2020", None),
    ("2020-02-30", None),
    ("13/13/2020", None),
    ("0000-00-00", None),
    ("12345678901234567890", None),
    ("202001", None),
    ("nope", None),
    ("", None),
    (None, None),
])
def test_parse_datetime(rows, text, wanted):
    df = rows([(text,)], "s string")
    found = df.select(ts.parse_datetime(F.col("s")), ts.is_date(F.col("s"))).first()
    assert tuple(found) == (wanted, wanted is not None)


def test_parse_timestamp_keeps_the_offset(rows):
    df = rows([("2020-01-01T10:00:00+02:00",), ("2020-01-01 08:00:00",)], "s string")
    seconds = df.select(ts.epoch_seconds(ts.parse_timestamp(F.col("s"))).alias("e")).collect()
    assert seconds[0].e == seconds[1].e == 1577865600.0


@pytest.mark.parametrize("start, end, marks", [
    ("2020-01-01 00:59:00", "2020-01-01 02:01:00", 2),
    ("2020-01-01 00:00:00", "2020-01-01 00:59:59.999999", 0),
    ("2019-12-31 23:59:59", "2020-01-01 00:00:00", 1),
    ("1969-12-31 23:30:00", "1970-01-01 00:10:00", 1),
    ("2020-01-02 00:00:00", "2020-01-01 23:00:00", -1),
])
def test_hour_marks(spark, start, end, marks):
    assert one(spark.range(1).select(ts.hour_diff(ts.ntz(end), ts.ntz(start)))) == marks


@settings(max_examples=15, deadline=None)
@given(
    st.datetimes(dt.datetime(1960, 1, 1), dt.datetime(2040, 1, 1)),
    st.lists(st.integers(-10**11, 10**12), min_size=1, max_size=20),
    st.integers(0, 50),
)
def test_the_bound_keeps_the_same_rows_as_the_difference(spark, now, back, hours):
    times = [(now - dt.timedelta(microseconds=m),) for m in back]
    df = spark.createDataFrame(times, "t timestamp_ntz")
    by_bound = F.col("t") >= ts.hours_before(ts.ntz(now), hours)
    by_marks = ts.hour_diff(ts.ntz(now), F.col("t")) <= hours
    assert df.filter(by_bound != by_marks).isEmpty()


def test_zoned_times_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("select timestamp'2020-01-01 00:00:00.5 UTC' as t")
        assert stringify_times(df).first().t == "2020-01-01 00:00:00.500000+00:00"
        assert stringify_times(df, ts.CDC_PATTERN).first().t == "2020-01-01 00:00:00.500000"
        texts = spark.createDataFrame(
            [("2020-01-01",), ("20200101",), ("2020-01-01T01:00:00+01:00",), ("2020-01-01 00:00:00Z",)],
            "s string",
        )
        found = texts.select(ts.epoch_seconds(ts.parse_timestamp(F.col("s"))).alias("e")).collect()
        assert [r.e for r in found] == [1577836800.0] * 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_hour_marks_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # the clock there is put forward between these times
        marks = ts.hour_diff(ts.ntz("2020-03-08 04:00:00"), ts.ntz("2020-03-08 01:00:00"))
        assert one(spark.range(1).select(marks)) == 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_next_checkpoint(spark):
    df = spark.range(1).select(ts.next_checkpoint(ts.ntz("2020-01-01 00:00:00.999999")))
    assert one(df) == dt.datetime(2020, 1, 1, 0, 0, 1)


def test_expiry(rows):
    df = rows([
        ("2020-11-19 01:02:03.123456789 +0000 UTC",), ("2999-11-19 01:02:03.123456789 +0000 UTC",),
        (None,), ("x",), ("2999-11-19 01:02:03 +0000 UTC",),
    ], "s string")
    found = df.select(
        ts.parse_nanoseconds(F.col("s")).cast("string").alias("t"),
        ts.is_expired(F.col("s"), F.current_timestamp()).alias("e"),
    ).collect()
    assert [r.t for r in found] == [
        "2020-11-19 01:02:03.123456", "2999-11-19 01:02:03.123456", None, None, None,
    ]
    assert [r.e for r in found] == [True, False, True, True, True]


def test_stamp(rows):
    df = rows([(1,)], "a int")
    assert ts.stamp(df, "seen", "2020-01-01 00:00:00").first().seen == dt.datetime(2020, 1, 1)
    live = ts.stamp(df).first().ingestion_timestamp
    assert abs((dt.datetime.now(dt.UTC).replace(tzinfo=None) - live).total_seconds()) < 60


def test_coerce_reports_bad_fields(rows):
    df = rows(
        [("nope", [("0000-00-00", 1), ("bad", 2)], "5", None, 7)],
        "a string, l array<struct<d:string,n:int>>, q string, z string, other int",
    )
    row = coerce_record(
        df, "a timestamp_ntz, l array<struct<d:date,n:int>>, q int, z date, absent int"
    ).first()
    assert row.a is None and row.q == 5 and row.z is None and row.other == 7
    assert [tuple(e) for e in row.l] == [(None, 1), (None, 2)]
    assert row._bad_fields == ["a", "l.d"]


def test_coerce_can_fail(rows):
    df = rows([("nope",)], "a string")
    with pytest.raises(Exception, match="unreadable a: nope"):
        coerce_record(df, "a date", on_bad="fail").collect()
    good = rows([("2020-01-01",), ("0000-00-00",), (None,)], "a string")
    found = coerce_record(good, "a date", on_bad="fail").collect()
    assert [r.a for r in found] == [dt.date(2020, 1, 1), None, None]
    with pytest.raises(ValueError):
        coerce_record(df, "a date", on_bad="ignore")


def test_coerce_struct_and_null_records(rows):
    df = rows([(("2020-01-01",), None)], "s struct<d:string>, l array<struct<d:string>>")
    row = coerce_record(df, "s struct<d:date,x:int>, l array<struct<d:date>>").first()
    assert tuple(row.s) == (dt.date(2020, 1, 1), None) and row.l is None and row._bad_fields == []


def test_decimals_and_text_schema(spark):
    df = spark.sql("select cast(1.5 as decimal(10,3)) d, array(struct(cast(0 as decimal(9,9)) e)) l")
    row = stringify_decimals(df).first()
    assert row.d == "1.500" and row.l[0].e == "0.000000000"
    kind = text_schema(struct_type("a date, l array<struct<t:timestamp,n:int>>"))
    assert kind.simpleString() == "struct<a:string,l:array<struct<t:string,n:int>>>"


def test_map_values_are_read(rows):
    df = rows(
        [({"a": "0000-00-00", "b": "Jan 2, 2020"},), ({"a": "never", "b": "2020-01-01"},), (None,), ({},)],
        "m map<string,string>",
    )
    found = [(r.m, r._bad_fields) for r in coerce_record(df, "m map<string,date>").collect()]
    assert found == [
        ({"a": None, "b": dt.date(2020, 1, 2)}, []), ({"a": None, "b": dt.date(2020, 1, 1)}, ["m"]),
        (None, []), ({}, []),
    ]
    with pytest.raises(Exception, match="unreadable m: never"):
        coerce_record(df, "m map<string,date>", on_bad="fail").collect()

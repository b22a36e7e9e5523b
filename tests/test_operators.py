import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import joins, prefix, window
from leadflow.operators.latest import latest_per_key
from leadflow.operators.skew import hot_keys, split_join
from leadflow.operators.spec import run_spec
from leadflow.operators.status import change_status, import_gate, open_rows, running_files
from leadflow.plans import queries
from leadflow.schemas import table_schema
from leadflow.sinks.state import StateTable
from leadflow.sinks.tables import replace_bucketed


def T(text):
    return dt.datetime.fromisoformat(text)


def content(df):
    return sorted(map(str, df.collect()))


# Skew


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of both sides has one key; some keys are on one side only."""
    draw = random.Random(5)

    def side(n, label, keys):
        values = [
            (None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{draw.randrange(keys)}", f"{label}{i}")
            for i in range(n)
        ]
        return spark.createDataFrame(values, f"k string, {label} string")

    return side(600, "l", 40), side(300, "r", 60).filter("k <> 'k7'")


def hot(spark, counts):
    return spark.createDataFrame(list(counts.items()), "k string, n bigint") if counts else None


def test_hot_keys(skewed):
    left, right = skewed
    found = {r.k: r.n for r in hot_keys(left, "k", hot_rows=90).collect()}
    assert set(found) == {"hot"} and found["hot"] > 180
    assert [r.k for r in hot_keys(right, "k", hot_rows=90).collect()] == ["hot"]
    assert hot_keys(left.filter("false"), "k") is None and hot_keys(left, "k") is None


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("left_hot, right_hot", [
    ({}, {}), ({"hot": 196}, {}), ({}, {"hot": 98}), ({"hot": 196}, {"hot": 98}),
    ({"hot": 196, "k7": 30, "absent": 99}, {"hot": 98, "k9": 40}),
])
def test_split_join_equals_plain_join(spark, skewed, how, left_hot, right_hot):
    left, right = skewed
    split = split_join(left, right, "k", how, hot(spark, left_hot), hot(spark, right_hot), hot_rows=10)
    assert split.columns == left.join(right, "k", how).columns
    assert content(split) == content(left.join(right, "k", how))


@pytest.mark.parametrize("chunk", [1_000, 3, 1])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_copies_are_counted_and_come_back(spark, monkeypatch, how, chunk):
    from leadflow.operators import skew

    monkeypatch.setattr(skew, "CHUNK", chunk)
    left = spark.createDataFrame(
        [("hot", "same")] * 40 + [("hot", "other"), ("k", "x"), ("k", "x"), ("z", None), (None, "n")],
        "k string, a string",
    )
    right = spark.createDataFrame(
        [("hot", ["v"])] * 25 + [("hot", ["w"]), ("k", None), ("k", None)], "k string, b array<string>"
    )
    wanted = content(left.join(right, "k", how))
    for hots in [({"hot": 41}, {}), ({}, {"hot": 26}), ({"hot": 41}, {"hot": 26})]:
        assert content(split_join(left, right, "k", how, *(hot(spark, h) for h in hots), hot_rows=4)) == wanted


def test_maps_are_dealt_without_counting(spark):
    left = spark.sql("select 'a' k, map('x', id) m from range(20)")
    right = spark.sql("select 'a' k, 1 v")
    assert split_join(left, right, "k", "inner", hot(spark, {"a": 20}), None, hot_rows=2).count() == 20


def test_only_hot_rows_are_dealt(spark, skewed):
    left, right = skewed
    split = split_join(left, right, "k", "inner", hot(spark, {"hot": 196}), None, hot_rows=20)
    text = split._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(" in text and text.count("LeftAnti") == 2 and text.count("LeftSemi") == 2
    plain = split_join(left, right, "k", "inner")._jdf.queryExecution().optimizedPlan().toString()
    assert plain == left.join(right, "k")._jdf.queryExecution().optimizedPlan().toString() or "pmod" not in plain
    with pytest.raises(ValueError):
        split_join(left, right, "k", "full")


# Profiles


ENTITY = "entity_id string, email string, phone string, twitter string, client string"


@pytest.fixture(scope="module")
def profile_tables(spark):
    frame = spark.createDataFrame
    none = {
        name: frame([], f"entity_id string, {value} string")
        for name, (value, _) in joins.INSIGHT_VALUES.items()
    }
    entities = frame([("e1", "m", "p", "t", "c1"), ("e2", "m", "p", "t", "c2")], ENTITY)
    links = frame([(1, "e1"), (2, "e2"), (3, "e1"), (4, "zz")], "lead_id bigint, entity_id string")
    channel = frame(
        [("e1", ["Email"], T("2020-01-01")), ("e1", ["SMS"], T("2020-01-02")),
         ("e2", ["Phone"], T("2020-01-01"))],
        "entity_id string, preferences array<string>, ingestion_timestamp timestamp_ntz",
    )
    persuasion = frame(
        [("e1", ["Liking"], T("2020-01-01")), ("e1", ["Praise"], T("2020-01-01"))],
        "entity_id string, persuasion array<string>, ingestion_timestamp timestamp_ntz",
    )
    return entities, links, {**none, "channel": channel, "persuasion": persuasion}


def test_two_insight_rows_make_two_profiles(profile_tables):
    rows = joins.profiles(*profile_tables)
    counts = {r.lead_id: r["count"] for r in rows.groupBy("lead_id").count().collect()}
    assert counts == {1: 4, 2: 1, 3: 4}


def test_latest_only_keeps_one_profile(profile_tables):
    found = joins.profiles(*profile_tables, latest_only=True).collect()
    # Of equal times the greater value counts.
    assert {tuple(r.persuasion_angle.persuasion) for r in found if r.lead_id != 2} == {("Praise",)}
    assert sorted(r.lead_id for r in found) == [1, 2, 3]
    first = next(r for r in found if r.lead_id == 1)
    assert first.channel_strategy.preferences == ["SMS"] and first.archetype is None


@pytest.mark.parametrize("options", [{}, {"latest_only": True}])
def test_hot_profiles_are_the_same(profile_tables, options):
    plain = joins.profile_rows(*profile_tables, **options)
    hot_ids = joins.profile_hot_keys(*profile_tables, hot_rows=1)
    assert set(hot_ids) == {"links", "channel", "persuasion"}
    split = joins.profile_rows(*profile_tables, hot=hot_ids, hot_rows=1, **options)
    assert split.columns == plain.columns and content(split) == content(plain)


def test_tenant_and_ids(profile_tables, spark):
    pick = lambda **o: sorted(r.lead_id for r in joins.profiles(*profile_tables, latest_only=True, **o).collect())
    assert pick(client="c1") == [1, 3]
    assert pick(client="c1", ids=[3, 2]) == [3]
    assert pick(ids=[]) == []
    assert pick(ids=spark.createDataFrame([(2,), (2,)], "lead_id bigint")) == [2]


def test_profiles_share_one_partitioning(profile_tables, spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = joins.profile_rows(*profile_tables)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # One shuffle per table, none between the joins.
    assert plan.count("Exchange hashpartitioning(entity_id") == 10


def test_bucketed_tables_join_without_a_shuffle(profile_tables, spark):
    entities, links, insights = profile_tables
    frames = {"b_entities": entities, "b_links": links, **{f"b_{n}": t for n, t in insights.items()}}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, frame in frames.items():
            replace_bucketed(frame, name, "entity_id", 4)
        stored = {n: spark.table(f"b_{n}") for n in insights}
        rows = joins.profile_rows(spark.table("b_entities"), spark.table("b_links"), stored)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert content(rows) == content(joins.profile_rows(*profile_tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in frames:
            spark.sql(f"drop table if exists {name}")


# Site visitors, pending entities, latest rows


def test_site_visitors(rows):
    sites = rows([(1, 10), (2, 10), (3, 99), (4, 11)], "id bigint, user_id bigint")
    visitors = rows(
        [(1, "v1"), (1, "v2"), (3, "v3"), (None, "v4")], "site_id bigint, visitor_id string"
    ).selectExpr(
        "site_id", "visitor_id", "timestamp_ntz'2020-01-01' last_visit_date", "1L visit_count",
        "'ip' ipaddress", "'b' browser_agent", "timestamp_ntz'2020-01-01' created_at",
    )
    users = rows([(10, 7), (11, 8)], "id bigint, tree_user_id bigint")
    codes = rows([(10, "ga", "c")], "user_id bigint, third_party_tracking_company string, tracking_code string")
    found = joins.site_visitors(sites, visitors, users, codes).collect()
    assert sorted((r.site_id, r.visitor_id or "", r.tracking_code or "", r.tree_user_id) for r in found) == [
        (1, "v1", "c", 7), (1, "v2", "c", 7), (2, "", "c", 7), (4, "", "", 8),
    ]


def test_pending_entities(rows):
    entities = rows([("a", "c"), ("b", "c"), ("d", "c")], "entity_id string, client string")
    insight = rows(
        [("a", T("2020-01-01 00:59:00")), ("b", T("2020-01-01 01:00:00")), ("b", T("2019-01-01"))],
        "entity_id string, ingestion_timestamp timestamp_ntz",
    )
    now = F.lit("2020-01-01 03:59:00").cast("timestamp_ntz")
    found = joins.pending_entities(entities, insight, now, 2).collect()
    assert sorted(r.entity_id for r in found) == ["a", "d"]


def test_latest_per_key(rows):
    df = rows(
        [("a", 1, 1, "x"), ("a", 2, 1, "y"), ("a", 2, 2, "z"), ("b", None, 1, "n")],
        "k string, t int, tie int, v string",
    )
    found = latest_per_key(df, ["k"], "t", ["tie"])
    assert found.columns == df.columns
    assert sorted((r.k, r.v) for r in found.collect()) == [("a", "z"), ("b", "n")]


# Windows


def times(spark, values):
    return spark.createDataFrame([(v,) for v in values], "ingestion_timestamp timestamp_ntz")


@pytest.mark.parametrize("buckets", [7, 4_096])
@pytest.mark.parametrize("seed", range(3))
def test_nth_time_equals_a_sort(spark, monkeypatch, seed, buckets):
    monkeypatch.setattr(window, "BUCKETS", buckets)
    draw = random.Random(seed)
    start = T("1969-12-31 12:00:00")
    values = [start + dt.timedelta(microseconds=draw.randrange(10 ** draw.randrange(1, 13)))
              for _ in range(200)]
    values += [values[0]] * 100  # a third of all rows has one time
    counts = window.time_counts({"t": times(spark, values)}, "1960-01-01").cache()
    for n in (1, 2, 99, 150, 299, 300, 301):
        assert window.nth_time(counts, n) == sorted(values)[:n][-1]
    assert window.nth_time(counts) == max(values)


def test_all_windows_come_from_one_count(spark, monkeypatch):
    draw = random.Random(1)
    values = [T("2020-01-01") + dt.timedelta(seconds=draw.randrange(200)) for _ in range(300)]
    calls = []
    counted = window.time_counts
    monkeypatch.setattr(window, "time_counts", lambda *a: calls.append(a) or counted(*a))
    saved = spark.createDataFrame([], table_schema("checkpoint"))
    *found, last = window.cut_windows(saved, "j", "t", {"t": times(spark, values)}, 40)
    assert len(calls) == 1 and not last.has_data
    rest, ends = sorted(values), []
    while rest:
        ends.append(rest[:40][-1])
        rest = [v for v in rest if v > ends[-1]]
    assert [w.last for w in found] == ends


def test_first_window_and_empty_source(spark):
    saved = spark.createDataFrame([], table_schema("checkpoint"))
    found = window.get_window(saved, "j", "t", {"t": times(spark, [T("2020-01-01")])})
    assert (found.first, found.last, found.has_data) == (T("1970-01-01"), T("2020-01-01"), True)
    empty = window.get_window(saved, "j", "t", {"t": times(spark, [])})
    assert empty.has_data is False


def test_several_sources_unite_as_a_set(spark):
    a, b = [T("2020-01-01")] * 5, [T("2020-01-01"), T("2020-01-02")]
    one = window.source_times({"a": times(spark, a)}, window.EPOCH)
    two = window.source_times({"a": times(spark, a), "b": times(spark, b)}, window.EPOCH)
    assert one.count() == 5 and two.count() == 3


def test_ties_and_next_window(spark, folder):
    state = StateTable(spark, f"{folder}/c", table_schema("checkpoint"), ["dag_id", "src_table"], 2)
    values = [T("2020-01-01"), T("2020-01-02"), T("2020-01-02"), T("2020-01-03")]
    source = times(spark, values)
    first = window.get_window(state.read(), "j", "t", {"t": source}, max_rows=2)
    assert window.in_window(source, first).count() == 3  # ties go beyond the bound
    assert window.commit_window(state, first)
    second = window.get_window(state.read(), "j", "t", {"t": source}, max_rows=2)
    assert second.first == T("2020-01-02 00:00:00.000001")
    assert window.in_window(source, second).count() == 1
    window.commit_window(state, second)
    third = window.get_window(state.read(), "j", "t", {"t": source}, max_rows=2)
    assert not third.has_data and not window.commit_window(state, third)
    assert window.latest_checkpoints(state.read()).count() == 1 and state.read().count() == 2
    late = times(spark, [T("2020-01-02 12:00:00"), T("2020-01-04")])
    assert window.late_rows(late, third.first).count() == 1


def test_rows_find_their_windows(spark):
    draw = random.Random(3)
    values = [T("2020-01-01") + dt.timedelta(microseconds=draw.randrange(90)) for _ in range(300)] + [None]
    values += [T("1960-01-01"), T("9000-01-01 00:00:00.000001"), values[0], values[0]]
    source, saved = times(spark, values), spark.createDataFrame([], table_schema("checkpoint"))
    *found, _ = window.cut_windows(saved, "j", "t", {"t": source}, 20)
    placed = window.in_windows(source, found[1:-1])
    rows = [(i, v) for i, w in enumerate(found[1:-1]) for v in values if v and w.first <= v <= w.last]
    assert sorted(map(tuple, placed.select("_window", "ingestion_timestamp").collect())) == sorted(rows)
    assert window.in_windows(source, []).collect() == []


def test_windows_are_not_compared_with_every_row(spark):
    values = [T("2020-01-01") + dt.timedelta(seconds=i) for i in range(20)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries, "view", lambda *a: times(spark, values))
        result = queries.export_windows(spark, "")
    assert [(r.first_time, r.last_time, r.n) for r in result.collect()] == [(T("1970-01-01"), values[-1], 20)]
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unknown_export_table(rows):
    with pytest.raises(ValueError, match="staging.other"):
        window.export_columns(rows([(1,)], "a int"), "staging.other")


def test_window_filter_is_pushed_down(spark, folder):
    times(spark, [T("2020-01-01")]).write.parquet(f"{folder}/t")
    source = spark.read.parquet(f"{folder}/t")
    bounds = window.ExportWindow("j", "t", T("2020-01-01"), T("2020-01-02"))
    plan = window.in_window(source, bounds)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ingestion_timestamp" in plan


# Status


STATUS = "client string, file string, src_table string, status string, start_date timestamp_ntz, end_date timestamp_ntz"


@pytest.fixture
def history(spark):
    row = lambda f, s, start, end=None: ("c", f, "t", s, T(start), end and T(end))
    return spark.createDataFrame([
        row("f1", "running", "2020-01-01 23:30:00"),
        row("f2", "running", "2020-01-01 00:30:00"),
        row("f3", "running", "2020-01-01 23:30:00", "2020-01-02"),
        row("f4", "failed", "2020-01-01 23:30:00"),
        row("f5", "running", "2020-01-01 23:30:00"),
        row("f6", "running", "2020-01-01 23:30:00"),
    ], STATUS)


NOW = "2020-01-02 00:10:00"


def test_running_files(history):
    assert sorted(r.file for r in running_files(history, NOW, 1).collect()) == ["f1", "f5", "f6"]
    assert running_files(history, NOW, 24).count() == 4


def test_gate_and_change(history, rows):
    reported = rows(
        [("f1", "FAILED"), ("f5", "RUNNING"), ("f6", None), ("f9", "FAILED")], "file string, status string"
    )
    gate = import_gate(running_files(history, NOW, 24), reported)
    verdicts = {r.file: (r.new_status, r.imports, r.changes) for r in gate.collect()}
    assert verdicts == {
        "f1": ("FAILED", False, True), "f2": ("UNKNOWN", False, True),
        "f5": ("RUNNING", False, False), "f6": ("UNKNOWN", False, True),
    }
    after = change_status(history, gate.filter("changes"), NOW)
    assert after.count() == 9
    f1 = sorted((r.status, r.start_date, r.end_date) for r in after.filter("file = 'f1'").collect())
    assert f1 == [("failed", T(NOW), None), ("running", T("2020-01-01 23:30:00"), T(NOW))]
    assert after.filter("file = 'f5' and end_date is null").count() == 1
    # Closed rows keep their end.
    assert after.filter("file = 'f3'").first().end_date == T("2020-01-02")


def test_gate_takes_one_answer_per_file(history, rows):
    running = running_files(history, NOW, 24)
    timed = rows(
        [("f1", "RUNNING", T("2020-01-01")), ("f1", "SUCCEEDED", T("2020-01-02")), ("f1", "FAILED", T("2019-01-01"))],
        "file string, status string, answered_at timestamp_ntz",
    )
    assert [r.new_status for r in import_gate(running, timed).collect() if r.file == "f1"] == ["SUCCEEDED"]
    plain = rows([("f1", "RUNNING"), ("f1", "RUNNING"), ("f5", None), ("f5", None)], "file string, status string")
    assert import_gate(running, plain).count() == 4
    with pytest.raises(Exception, match="different answers for f1"):
        import_gate(running, plain.union(rows([("f1", "FAILED")], "file string, status string"))).collect()


def test_open_rows(rows):
    row = open_rows(rows([("c", "f", "t", 1)], "client string, file string, src_table string, x int"), NOW).first()
    assert tuple(row) == ("c", "f", "t", "running", T(NOW), None)


# Specs


@pytest.fixture
def numbers(rows):
    return rows([(i, i % 3, [i, -i]) for i in range(10)], "a int, b int, l array<int>")


def test_where_has_sql_precedence(spark, numbers):
    found = run_spec(spark, {
        "from": numbers, "select": ["a"], "where": ["a = 1", ("b = 2", "OR"), ("a > :low", "and")],
        "args": {"low": 4},
    })
    assert sorted(r.a for r in found.collect()) == [1, 5, 8]


def test_values_are_bound_not_pasted(spark, rows):
    df = rows([("x' or 'a'='a",), ("b",)], "s string")
    found = run_spec(spark, {"from": df, "where": ["s = :v"], "args": {"v": "x' or 'a'='a"}})
    assert found.count() == 1


def test_from_list_is_a_hash_join(spark, numbers):
    found = run_spec(spark, {
        "from": [(numbers, "x"), (numbers, "y")], "where": ["x.a = y.b"], "select": [("y.a", "a")],
    })
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for where in ([], ["x.a > 0"], ["x.a = y.b", ("x.a = 1", "OR")], ["x.a = x.b"]):
        with pytest.raises(ValueError):
            run_spec(spark, {"from": [(numbers, "x"), (numbers, "y")], "where": where})
    with pytest.raises(ValueError):
        run_spec(spark, {"from": [numbers, numbers], "where": ["a = b"]})


def test_quoted_colons_are_no_arguments(spark, rows):
    df = rows([("a:low", 1), ("b", 5)], "s string, n int")
    found = run_spec(spark, {"from": df, "where": ["s = 'a:low'", ("n > :low", "OR")], "args": {"low": 3}})
    assert found.count() == 2


def test_union_of_one_keeps_repeats(spark, rows):
    df = rows([(1,), (1,)], "a int")
    part = {"from": df, "select": ["a"]}
    assert run_spec(spark, {"union": ("distinct", [part])}).count() == 2
    assert run_spec(spark, {"union": ("distinct", [part, part])}).count() == 1
    assert run_spec(spark, {"union": ("all", [part, part])}).count() == 4


def test_spec_parts(spark, numbers):
    found = run_spec(spark, {
        "with": {"some": {"from": numbers, "where": ["a < 6"]}},
        "from": ({"from": "some", "unnest": ("l", "e")}, "s"),
        "join": [(numbers, "n", "s.a = n.a", "left_semi")],
        "where": ["s.e >= 0"],
        "group": ["s.b"], "select": [("count(*)", "n"), ("sum(s.e)", "t")], "having": "n > 1",
        "order": [("t", "desc")], "limit": 2,
    })
    assert [tuple(r) for r in found.collect()] == [(2, 2, 7), (1, 2, 5)]
    with pytest.raises(ValueError, match="groups"):
        run_spec(spark, {"from": numbers, "groups": []})
    with pytest.raises(ValueError, match="AND or OR"):
        run_spec(spark, {"from": numbers, "where": ["a = 1", ("b = 1", "XOR")]})


def test_order_puts_nulls_as_documented(spark, rows):
    df = rows([(None,), (2,), (1,)], "a int")
    pick = lambda d: [r.a for r in run_spec(spark, {"from": df, "order": [("a", d)]}).collect()]
    assert pick("asc") == [None, 1, 2] and pick("desc") == [2, 1, None]


# Running sums over ranges


@pytest.mark.parametrize("ranges", [1, 2, 5, 11])
def test_running_sums(spark, ranges):
    draw = random.Random(ranges)
    values = [(draw.randrange(40), draw.randrange(5)) for _ in range(200)]
    df = spark.createDataFrame(values, "k int, n bigint").repartition(4)
    with prefix.running_sums(df, "k", "n", ranges) as sums:
        found = {(r.k, r.running) for r in sums.collect()}
    assert found == {(k, sum(n for j, n in values if j <= k)) for k, _ in values}
    with prefix.running_sums(df.limit(0), "k", "n") as sums:
        assert sums.collect() == []


@pytest.mark.parametrize("ranges", [1, 3, 8])
@pytest.mark.parametrize("spread, most", [(200, 40), (15, 7), (100_000, 1), (100_000, 33), (30, 1_000)])
def test_window_ends_over_any_ranges(spark, spread, most, ranges):
    draw = random.Random(spread)
    values = [T("2020-01-01") + dt.timedelta(seconds=draw.randrange(spread)) for _ in range(300)]
    values += [values[7]] * 50
    counts = window.time_counts({"t": times(spark, values)}, "1960-01-01")
    rest, ends = sorted(values), []
    while len(rest) >= most:
        ends.append(rest[:most][-1])
        rest = [v for v in rest if v > ends[-1]]
    assert window.window_ends(counts, most, ranges) == ends


def test_number_of_jobs_does_not_grow_with_windows(spark):
    values = [T("2020-01-01") + dt.timedelta(seconds=i) for i in range(2_000)]
    counts = window.time_counts({"t": times(spark, values)}, "1960-01-01").cache()
    counts.count()
    jobs = []
    for most in (500, 10):
        group = f"windows-{most}"
        spark.sparkContext.setJobGroup(group, group)
        assert len(window.window_ends(counts, most, 3)) == 2_000 // most
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0


def test_counted_join_broadcasts_small_sides_only(rows):
    big = rows([(i % 5, i) for i in range(20)] + [(None, 99)], "k int, v int")
    small = rows([(1, "a"), (2, "b"), (None, "n")], "k int, s string")
    few, many = (joins.join_counted(big, small, ["k"], n) for n in (3, 2))
    assert content(few) == content(many) and few.count() == 8
    plans = ["ResolvedHint (strategy=broadcast)" in d._jdf.queryExecution().analyzed().toString() for d in (few, many)]
    assert plans == [True, False]

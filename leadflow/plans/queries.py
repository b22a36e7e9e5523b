"""The registered queries: every operator over the provided tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions import names, timestamps as ts
from leadflow.functions.crypto import decrypt_lines, encrypt_lines
from leadflow.functions.insights import adopt_curve, match_scores, reshape_insight
from leadflow.functions.records import coerce_record, stringify_decimals, stringify_times
from leadflow.operators import joins, sentiment_model as model
from leadflow.operators.drift import quantile_cuts, quantile_drift, two_sample_distance
from leadflow.operators.late import ExportRecord
from leadflow.operators.latest import latest_per_key
from leadflow.operators.logistic import fit_logistic
from leadflow.operators.scoring import (
    drift, insight_bodies, logistic_predictor, logistic_score, value_bucket,
)
from leadflow.operators.spec import run_spec
from leadflow.operators.status import change_status, import_gate, open_rows, running_files
from leadflow.operators.status_log import StatusLog, as_of
from leadflow.operators.window import (
    WINDOW, ExportWindow, cut_windows, export_columns, get_window, in_window, in_windows, late_rows, latest_checkpoints,
)
from leadflow.plans import jobs
from leadflow.plans.inputs import base, view
from leadflow.schemas import INSIGHT_IDS, EXPORT_COLUMNS, table_schema
from leadflow.session import shared_folder
from leadflow.sinks.csv_export import export_csv, read_export, route_uploads
from leadflow.sinks.keyed import KeyedTable
from leadflow.sinks.state import StateTable
from leadflow.sinks.tables import append, one_per_key, rows_frame
from leadflow.sources.json_records import check_contacts, reported_status
from leadflow.sources.tables import destination_schema, load_table, query_file, read_source
from leadflow.streaming.ingest import stream_cdc, stream_scores
from leadflow.streaming.priority import PRIORITIES, stream_priority

# Demonstration keys; the lines are made with the second one.
KEYS = ["AAECAwQFBgcICQoLDA0ODw==", "EBESExQVFhcYGRobHB0eHw=="]
WEIGHTS = {"age": 0.02, "engagement_score": 0.3, "page_views": 0.1}
INTERCEPT = -3.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _timed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumnRenamed(column, "ingestion_timestamp")


def _score_text(scores: str, label: str) -> Column:
    return F.array_join(
        F.transform(F.array_sort(scores), lambda s: F.concat_ws(":", s[label], s["score"])), ","
    )


# Sources, projections, filters


@query
def scan_select_alias(spark, sf):
    return run_spec(spark, {
        "from": base(spark, sf, "events"),
        "select": ["event_id", ("value * 2", "double_value"), ("'events'", "tbl")],
    })


@query
def filter_and_or(spark, sf):
    return run_spec(spark, {
        "from": base(spark, sf, "orders"),
        "select": ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
        "where": [
            "o_totalprice > :low", ("o_orderstatus = :state", "OR"),
            ("o_orderpriority = '1-URGENT'", "AND"),
        ],
        "args": {"low": 300000.0, "state": "F"},
    })


@query
def bound_query(spark, sf):
    return read_source(
        spark,
        query="""select o_orderkey, o_orderdate, o_totalprice from {orders}
                 where o_orderdate >= cast(:since as timestamp_ntz) and array_contains(:states, o_orderstatus)""",
        args={"since": "1996-01-01 00:00:00", "states": F.array(F.lit("O"), F.lit("P"))},
        orders=base(spark, sf, "orders"),
    )


@query
def time_window_between(spark, sf):
    events = _timed(base(spark, sf, "events"), "ts")
    window = ExportWindow("export", "events", "2024-01-05 00:00:00", "2024-01-20 12:00:00")
    return in_window(events, window).select("event_id", "ingestion_timestamp")


@query
def export_projection(spark, sf):
    return export_columns(view(spark, sf, "staging_contacts"), "staging.contacts")


def _asked(spark, sf) -> DataFrame:
    """Ids of the id lists that come with urgent orders."""
    urgent = base(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    lead = 100000 + F.col("o_custkey")
    text = F.concat_ws(",", lead, F.lit(""), lead + 1, lead)
    return urgent.select(F.explode(names.id_list(text)).alias("lead_id"))


@query
def tenant_id_filter(spark, sf):
    links = joins.select_ids(view(spark, sf, "lead_entities_lk"), "lead_id", _asked(spark, sf))
    entities = view(spark, sf, "entities").filter(F.col("client") == "BUILDING")
    return entities.join(links, "entity_id").select("lead_id", "entity_id", "client", "email")


@query
def flag_filters(spark, sf):
    # Documents without labels have null flags.
    flags = base(spark, sf, "documents").join(base(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id",
        (F.col("quality") == 1).alias("processed"),
        (F.col("toxic") == 1).alias("sentiment_processed"),
    )
    return flags.filter(F.col("processed")).filter(~F.col("sentiment_processed"))


@query
def running_files_(spark, sf):
    history = view(spark, sf, "data_source_status")
    return running_files(history, "1998-08-02 00:30:00", hours=8760)


# Joins


@query
def site_visitors(spark, sf):
    out = shared_folder(spark, "site_visitors")
    jobs.publish_site_visitors(
        out, view(spark, sf, "sites"), view(spark, sf, "site_visitors_in"),
        view(spark, sf, "users"), view(spark, sf, "tracking_codes"),
    )
    return spark.read.parquet(out)


@query
def site_visitors_increment(spark, sf):
    """The same from a first build without the later visits and one region's users, kept up by what was missing."""
    sites, visits, users, codes = [view(spark, sf, n) for n in ("sites", "site_visitors_in", "users", "tracking_codes")]
    later = F.col("last_visit_date") >= ts.ntz("1997-01-01 00:00:00")
    schema = joins.site_visitors(sites, visits, users, codes).schema
    table = KeyedTable(spark, shared_folder(spark, "site_visitors"), schema, ["site_id"], share=10.0)
    known = users.filter("tree_user_id <> 2")
    jobs.publish_site_visitors(table, sites, visits.filter(~later), known, codes)
    changed = sites.join(users.filter("tree_user_id = 2"), sites["user_id"] == users["id"], "left_semi")
    for _ in range(2):  # the second time, as after a failure, changes nothing
        jobs.refresh_site_visitors(
            table, sites, visits, users, codes, visits.filter(later), changed.select(F.col("id").alias("site_id")), "1997",
        )
    return table.read()


def _insights(spark, sf) -> dict[str, DataFrame]:
    plain = [
        "channel", "persuasion", "relationship_fit", "archetypes", "lcv_level",
        "days_to_first_sale_level",
    ]
    return {
        **{name: view(spark, sf, name) for name in plain},
        "match_score": match_scores(view(spark, sf, "match_score_raw")),
        "adopt_curve": adopt_curve(view(spark, sf, "adopt_curve_raw")),
    }


def _flat(nested: DataFrame, kind: str) -> DataFrame:
    return nested.select(
        f"{kind}_id", "entity.*",
        _score_text("match_score", "client").alias("match_score"),
        _score_text("adopt_curve", "corpus").alias("adopt_curve"),
        F.array_join("persuasion_angle.persuasion", "|").alias("persuasion"),
        F.array_join("channel_strategy.preferences", "|").alias("preferences"),
        F.col("relationship_fit.prediction").alias("relationship_fit"),
        "archetype", "lcv_level", "days_to_first_sale_level",
    )


def nested_lead_profiles(spark, sf, **options) -> DataFrame:
    return joins.profiles(
        view(spark, sf, "entities"), view(spark, sf, "lead_entities_lk"), _insights(spark, sf),
        **options,
    )


@query
def lead_profiles(spark, sf):
    return _flat(nested_lead_profiles(spark, sf), "lead")


@query
def requested_profiles(spark, sf):
    """Profiles of one tenant for lists of ids."""
    return _flat(
        nested_lead_profiles(spark, sf, client="BUILDING", ids=_asked(spark, sf)), "lead"
    )


@query
def served_profiles(spark, sf):
    """Asked ids looked up in published profiles, which are laid out by id."""
    nested = nested_lead_profiles(spark, sf)
    table = KeyedTable(spark, shared_folder(spark, "profiles"), nested.schema, ["lead_id"])
    jobs.publish_profiles(
        table, view(spark, sf, "entities"), view(spark, sf, "lead_entities_lk"), _insights(spark, sf)
    )
    return _flat(table.of_keys(_asked(spark, sf)), "lead")


@query
def lead_profiles_latest(spark, sf):
    insights = _insights(spark, sf)
    insights["channel"] = _channel_history(spark, sf)
    insights["persuasion"] = _persuasion_history(spark, sf)
    return _flat(
        joins.profiles(
            view(spark, sf, "entities"), view(spark, sf, "lead_entities_lk"), insights,
            latest_only=True,
        ),
        "lead",
    )


def _channel_history(spark, sf) -> DataFrame:
    """Several channel rows per entity, each with its own time."""
    return base(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.max("ts").alias("ingestion_timestamp")
    ).select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.array("event_type").alias("preferences"), "ingestion_timestamp",
    )


def _persuasion_history(spark, sf) -> DataFrame:
    return base(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        (F.max("o_orderdate") + F.min("o_orderkey") * F.expr("interval '1' second"))
        .alias("ingestion_timestamp")
    ).select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.array("o_orderstatus").alias("persuasion"), "ingestion_timestamp",
    )


@query
def profile_fanout(spark, sf):
    return _fanout(spark, sf)


@query
def profile_fanout_split(spark, sf):
    """The same with every key of over two rows looked up and split."""
    return _fanout(spark, sf, hot_rows=2)


def _fanout(spark, sf, hot_rows: int | None = None) -> DataFrame:
    insights = _insights(spark, sf)
    insights["channel"] = _channel_history(spark, sf)
    insights["persuasion"] = _persuasion_history(spark, sf)
    frames = view(spark, sf, "entities"), view(spark, sf, "lead_entities_lk"), insights
    options = {}
    if hot_rows:
        options = {"hot": joins.profile_hot_keys(*frames, hot_rows), "hot_rows": hot_rows}
    rows = joins.profile_rows(*frames, **options)
    return rows.select(
        "lead_id", "entity_id", F.array_join("preferences", "|").alias("preferences"),
        F.array_join("persuasion", "|").alias("persuasion"),
    )


@query
def contact_profiles(spark, sf):
    nested = joins.profiles(
        view(spark, sf, "entities"), view(spark, sf, "contact_entities_lk"),
        _insights(spark, sf), kind="contact",
    )
    return _flat(nested, "contact")


def _saved_and_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Checkpoints that are there, and newer ones for some of them and for others."""
    target = base(spark, sf, "orders").groupBy("o_custkey").agg(
        F.max("o_orderdate").alias("checkpoint")
    ).select(
        F.lit("export").alias("dag_id"),
        F.concat(F.lit("c-"), F.col("o_custkey")).alias("src_table"), "checkpoint",
    )
    rows = base(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("last")).select(
        F.when(F.col("user_id") % 2 == 0, "export").otherwise("import").alias("dag_id"),
        F.concat(F.lit("c-"), F.col("user_id")).alias("src_table"),
        ts.next_checkpoint(F.col("last")).alias("checkpoint"),
    )
    return target, rows


@query
def upsert_checkpoint(spark, sf):
    target, rows = _saved_and_new(spark, sf)
    table = StateTable(
        spark, shared_folder(spark, "checkpoint"), table_schema("checkpoint"), ["dag_id", "src_table"], 8
    )
    table.append(target)
    table.merge(rows)
    return table.read()


@query
def keyed_upsert(spark, sf):
    """The same in a table of commits: the new rows alone are written, and met when it is read."""
    target, rows = _saved_and_new(spark, sf)
    table = KeyedTable(
        spark, shared_folder(spark, "keyed"), table_schema("checkpoint"), ["dag_id", "src_table"], share=1.0
    )
    table.append(target)
    table.merge(rows)
    return table.read()


@query
def latest_checkpoint(spark, sf):
    """Checkpoints as jobs leave them: one row for each move, the greatest in force."""
    moves = base(spark, sf, "events").select(
        F.lit("export").alias("dag_id"), F.col("event_type").alias("src_table"),
        F.col("ts").alias("checkpoint"),
    )
    table = StateTable(
        spark, shared_folder(spark, "moves"), table_schema("checkpoint"), ["dag_id", "src_table"], 4
    )
    table.append(moves)
    return latest_checkpoints(table.read())


@query
def upsert_duplicates(spark, sf):
    """Customers with one order pass the check of an upsert's keys; how many rows others have."""
    orders = base(spark, sf, "orders").select("o_custkey", "o_orderkey")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    single = one_per_key(
        orders.join(counts.filter("n_orders = 1"), "o_custkey", "left_semi"), ["o_custkey"]
    )
    return counts.join(single, "o_custkey", "left").withColumnRenamed("o_orderkey", "only_order")


@query
def pending_entities(spark, sf):
    return joins.pending_entities(
        view(spark, sf, "entities"), view(spark, sf, "channel"),
        ts.ntz("2024-01-31 00:00:00"), 48,
    )


@query
def cross_join_where(spark, sf):
    return run_spec(spark, {
        "from": [(base(spark, sf, "customer"), "c"), (base(spark, sf, "nation"), "n")],
        "join": [(base(spark, sf, "region"), "r", "n.n_regionkey = r.r_regionkey", "left")],
        "where": ["c.c_nationkey = n.n_nationkey", "c.c_acctbal > 0"],
        "select": ["c.c_custkey", "n.n_name", ("r.r_name", "region")],
    })


# Incremental state


@query
def checkpoint_window(spark, sf):
    events = _timed(base(spark, sf, "events"), "ts")
    orders = _timed(base(spark, sf, "orders"), "o_orderdate")
    saved = rows_frame(
        spark,
        [{"dag_id": "export", "src_table": "events", "checkpoint": _time("2024-01-03 00:00:00")}],
        table_schema("checkpoint"),
    )
    cases = {
        "events": {"events": events},
        "orders": {"orders": orders},
        "both": {"events": events, "orders": orders},
        "none": {"events": events.filter("ingestion_timestamp > timestamp_ntz'2100-01-01'")},
    }
    windows = [
        get_window(saved, "export", target, sources, max_rows=1000)
        for target, sources in cases.items()
    ]
    return spark.createDataFrame(
        [(w.target, w.first, w.last, w.has_data) for w in windows],
        "target string, first_time timestamp_ntz, last_time timestamp_ntz, has_data boolean",
    )


def _time(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@query
def union_distinct_sources(spark, sf):
    def part(table, column):
        return {
            "from": base(spark, sf, table),
            "select": [(column, "ingestion_timestamp"), (f"'{table}'", "tbl")],
        }

    return run_spec(
        spark, {"union": ("distinct", [part("events", "ts"), part("orders", "o_orderdate")])}
    )


@query
def incremental_export(spark, sf):
    source = view(spark, sf, "staging_contacts")
    saved = rows_frame(
        spark,
        [{"dag_id": "export", "src_table": "staging.contacts",
          "checkpoint": _time("2024-01-03 00:00:00")}],
        table_schema("checkpoint"),
    )
    window = get_window(
        saved, "export", "staging.contacts", {"staging.contacts": source}, max_rows=1000
    )
    return export_columns(in_window(source, window), "staging.contacts")


@query
def export_windows(spark, sf):
    """All windows of 500 rows behind the checkpoint, with the rows of each."""
    source = view(spark, sf, "staging_contacts")
    none = rows_frame(spark, [], table_schema("checkpoint"))
    *windows, _ = cut_windows(none, "export", "staging.contacts", {"staging.contacts": source}, 500)
    ends = spark.createDataFrame(
        [(i, w.first, w.last) for i, w in enumerate(windows)],
        f"{WINDOW} int, first_time timestamp_ntz, last_time timestamp_ntz",
    )
    inside = in_windows(source, windows).groupBy(WINDOW).agg(F.count(F.lit(1)).alias("n"))
    return ends.join(inside, WINDOW).select("first_time", "last_time", "n")


@query
def late_export(spark, sf):
    """Clicks arrive after all else was exported: those below the checkpoint go through the late lane, once."""
    source, folder = view(spark, sf, "staging_contacts"), shared_folder(spark, "late_export")
    checkpoints = _checkpoints(spark, folder)
    record = ExportRecord(spark, f"{folder}/record", source.schema, ["id"])
    args = "staging.contacts", checkpoints
    jobs.export_table(source.filter("first_name <> 'click'"), *args, f"{folder}/out", record=record)
    late = [jobs.export_late(source, *args, record, f"{folder}/late") for _ in range(2)]
    jobs.export_table(source, *args, f"{folder}/out", record=record)
    late.append(jobs.export_late(source, *args, record, f"{folder}/late"))
    states = F.lit(" ".join(r.state for r in late)).alias("late_runs")
    parts = [
        read_export(spark, f"{folder}/{lane}/staging.contacts", ["first_name"])
        .groupBy("client", "first_name", F.lit(lane == "late").alias("late")).agg(F.count(F.lit(1)).alias("n"))
        for lane in ("out", "late")
    ]
    return parts[0].unionByName(parts[1]).select("*", states)


@query
def export_job(spark, sf):
    """Export everything behind the checkpoint, then read the files back."""
    return _exported(spark, sf)[0]


def _checkpoints(spark, folder: str) -> StateTable:
    return StateTable(
        spark, f"{folder}/checkpoint", table_schema("checkpoint"), ["dag_id", "src_table"], 2
    )


def _exported(spark, sf, **options):
    source = view(spark, sf, "staging_contacts")
    folder = shared_folder(spark, "export_job")
    checkpoints = _checkpoints(spark, folder)
    result = jobs.export_table(source, "staging.contacts", checkpoints, f"{folder}/out", **options)
    exported = read_export(
        spark, f"{folder}/out/staging.contacts", ["first_name", "last_name", "email"]
    )
    rows = exported.groupBy("client", "first_name").agg(F.count(F.lit(1)).alias("n"))
    return rows, result, checkpoints


@query
def export_drain(spark, sf):
    """The same in windows of 2,000 rows, all cut from one count of the times."""
    rows, result, checkpoints = _exported(spark, sf, max_rows=2_000)
    moved = latest_checkpoints(checkpoints.read()).first()  # one job, one table: one row
    return rows.withColumns({
        "checkpoint": ts.ntz(moved.checkpoint), "several_windows": F.lit(len(result.detail) > 1),
    })


@query
def export_leads(spark, sf):
    """The other exported table, with its own columns."""
    source = view(spark, sf, "staging_contacts")
    wide = source.withColumns({"gender": F.lit(None).cast("string"), "age": F.col("zip").cast("int")})
    folder = shared_folder(spark, "export_leads")
    jobs.export_table(wide, "staging.zleads", _checkpoints(spark, folder), f"{folder}/out")
    columns = [c for c in EXPORT_COLUMNS["staging.zleads"] if c != "client"]
    return read_export(spark, f"{folder}/out/staging.zleads", columns)


@query
def export_moves(spark, sf):
    """Exported files, sent and moved: those of one client are refused."""
    folder = shared_folder(spark, "export_moves")
    export_csv(export_columns(view(spark, sf, "staging_contacts"), "staging.contacts"), f"{folder}/run=1")

    def upload(client, path):  # a nested function travels whole to the workers
        return (500, "") if client == "MACHINERY" else (200, '{"file":"' + path.split("/")[-1] + '"}')

    routed = jobs.route_files(spark, f"{folder}/run=1", folder, "staging.contacts", upload, 4)
    names = routed.select("client", "route").distinct()
    there = [
        read_export(spark, f"{folder}/{route}/staging.contacts", ["first_name"])
        .groupBy("client").agg(F.count(F.lit(1)).alias("n")).withColumn("route", F.lit(route))
        for route in ("processed", "failed")
    ]
    return names.join(there[0].unionByName(there[1]), ["client", "route"])


@query
def export_routing(spark, sf):
    answers = view(spark, sf, "data_source_status").select(
        F.col("file").alias("name"),
        F.when(F.col("status") == "failed", 500).otherwise(200).alias("code"),
        F.when(
            F.col("status") == "running",
            F.concat(F.lit('{"file":"up-'), F.col("file"), F.lit('"}')),
        ).otherwise("{}").alias("body"),
    )
    return route_uploads(answers).select("name", "route", "accepted_file")


@query
def stage_contacts(spark, sf):
    out = shared_folder(spark, "staging_contacts")
    jobs.stage(
        spark, out,
        "id bigint, client string, first_name string, seen_at timestamp_ntz, "
        "upgraded string, ingestion_timestamp timestamp_ntz",
        """select event_id as id, c_mktsegment as client, event_type as first_name, ts as seen_at,
                  case when event_id % 5 = 0 then '0000-00-00 00:00:00' else props end as upgraded
           from {events} join {customer} on user_id = c_custkey""",
        now="2024-02-01 10:00:00.25",
        events=base(spark, sf, "events"), customer=base(spark, sf, "customer"),
    )
    return spark.read.parquet(out)


@query
def late_rows_(spark, sf):
    arrivals = _timed(base(spark, sf, "events"), "ts")
    return late_rows(arrivals, "2024-01-16 00:00:00").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("late_rows"), F.min("ingestion_timestamp").alias("oldest")
    )


@query
def status_history(spark, sf):
    history = view(spark, sf, "data_source_status")
    now = "1998-08-02 00:30:00"
    gate = import_gate(running_files(history, now, 8760), view(spark, sf, "reported_status"))
    changed = change_status(history, gate.filter("changes"), now)
    uploads = base(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.lit("new").alias("client"),
        F.concat(F.lit("g-"), F.col("o_orderkey")).alias("file"),
        F.lit("staging.zleads").alias("src_table"),
    )
    return changed.unionByName(open_rows(uploads, now))


def _status(spark, sf, folder: str) -> StateTable:
    status = StateTable(spark, f"{folder}/status", table_schema("data_source_status"), ["file"], 8)
    status.append(view(spark, sf, "data_source_status"))
    return status


def _status_log(spark, sf) -> StatusLog:
    """The changes and uploads of ``status_history`` as events behind those of the table."""
    log = StatusLog(spark, shared_folder(spark, "status_log"))
    log.append(view(spark, sf, "data_source_status"))
    now = "1998-08-02 00:30:00"
    gate = import_gate(log.running(now, 8760), view(spark, sf, "reported_status"))
    log.change(gate.filter("changes"), now)
    uploads = base(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.lit("new").alias("client"),
        F.concat(F.lit("g-"), F.col("o_orderkey")).alias("file"),
        F.lit("staging.zleads").alias("src_table"),
    )
    log.append(open_rows(uploads, now))
    return log


@query
def status_events(spark, sf):
    """``status_history`` from events: a change writes its own rows, the intervals follow when it is read."""
    return _status_log(spark, sf).read()


@query
def status_as_of(spark, sf):
    """The history as it stood before the changes, from the events that include them."""
    return as_of(_status_log(spark, sf).events, "1996-06-01 12:00:00")


@query
def import_repeated_answers(spark, sf):
    """Files reported several times, each line's ship date being one report: the last one counts."""
    history = view(spark, sf, "data_source_status")
    reported = base(spark, sf, "lineitem").select(
        F.concat(F.lit("f-"), F.col("l_orderkey")).alias("file"),
        F.when(F.col("l_returnflag") == "N", "RUNNING").when(F.col("l_returnflag") == "A", "SUCCEEDED")
        .otherwise("FAILED").alias("status"),
        (F.col("l_shipdate") + F.col("l_linenumber") * F.expr("interval '1' second")).alias("answered_at"),
    )
    gate = import_gate(running_files(history, "1998-08-02 00:30:00", 8760), reported)
    return gate.select("file", "new_status", "imports", "changes")


@query
def import_gate_(spark, sf):
    """The entity import as a job: files, reported status, answers, entity table."""
    folder = shared_folder(spark, "import_gate")
    return _imported(spark, sf, _status(spark, sf, folder), folder)


@query
def import_gate_events(spark, sf):
    """The same with the status kept as events, run twice: what was imported isn't imported again."""
    folder = shared_folder(spark, "import_gate_events")
    status = StatusLog(spark, f"{folder}/status")
    status.append(view(spark, sf, "data_source_status"))
    return _imported(spark, sf, status, folder, runs=2)


def _imported(spark, sf, status: StateTable | StatusLog, folder: str, runs: int = 1) -> DataFrame:
    now = "1998-08-02 00:30:00"
    order = F.col("o_orderkey")
    body = F.to_json(F.array(
        F.struct(
            F.concat(F.lit("e"), order).alias("entity_id"),
            F.concat(order, F.lit("@example.com")).alias("email"),
        ),
        F.struct(F.concat(F.lit("x"), order).alias("entity_id"), F.lit(None).alias("email")),
    ))
    answers = base(spark, sf, "orders").select(
        F.concat(F.lit("f-"), order).alias("file"),
        F.when(order % 5 == 0, 204).when(order % 5 == 1, 400).otherwise(200).alias("code"),
        F.when(order % 5 == 1, '{"error":"No Data Found"}').when(order % 5 > 1, body).alias("body"),
    )
    reported = view(spark, sf, "reported_status").select(
        "file", F.lit(200).alias("code"), F.to_json(F.struct("status")).alias("body")
    )
    for _ in range(runs):
        jobs.import_entities(status, reported_status(reported), answers, f"{folder}/entities", now, 8760)
    left = running_files(status.read(), now, 8760).select(F.col("file").alias("open_file"))
    entities = spark.read.parquet(f"{folder}/entities")
    return entities.join(left, F.col("file") == F.col("open_file"), "left_anti").select(
        "entity_id", "email", "client", "file"
    )


# Aggregates, order


@query
def count_by_client(spark, sf):
    return run_spec(spark, {
        "from": view(spark, sf, "entities"),
        "group": ["client"],
        "select": [("count(*)", "n"), ("count(twitter)", "with_twitter")],
        "having": "n > 10",
    })


@query
def latest_per_key_(spark, sf):
    events = base(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return latest_per_key(events, ["user_id"], "ts", ["event_id"])


@query
def order_limit(spark, sf):
    return run_spec(spark, {
        "from": base(spark, sf, "orders"),
        "select": ["o_orderkey", "o_totalprice"],
        "order": [("o_totalprice", "desc"), "o_orderkey"],
        "limit": 100,
    })


@query
def file_order(spark, sf):
    order = F.col("o_orderkey")
    name = (
        F.when(order % 3 == 0, F.concat(F.lit("cdc-cust-"), order))
        .when(order % 3 == 1, F.concat(F.lit("cdc-x"), order))
        .otherwise(F.concat(F.lit("plain"), order))
    )
    files = base(spark, sf, "orders").select(name.alias("file_name"))
    return files.select(
        "file_name", names.numeric_suffix(F.col("file_name")).alias("suffix")
    ).orderBy(*names.file_order(F.col("file_name")))


@query
def stored_query(spark, sf):
    """A query kept in a text file, over a table found by its name."""
    folder = shared_folder(spark, "stored_query")
    lines = ["select o_orderpriority, count(*) as n", "from {orders}", "where o_totalprice > :low", "group by 1"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/sql")
    orders = load_table(spark, f"{sf.rstrip('/')}/orders.parquet")
    return query_file(spark, f"{folder}/sql", args={"low": 100000.0}, orders=orders)


@query
def load_counts(spark, sf):
    """Rows that loads say they wrote, under the schema of the table that is there."""
    folder = shared_folder(spark, "load_counts")
    parts = base(spark, sf, "part")
    parts.write.parquet(f"{folder}/t")
    schema = destination_schema(spark, f"{folder}/t")
    loads = [
        (name, append(part, f"{folder}/t", schema))
        for name, part in (("all", parts), ("keys", parts.select("p_partkey")))
    ]
    there = spark.read.parquet(f"{folder}/t").count()
    return spark.createDataFrame([*loads, ("table", there)], "load string, n bigint")


@query
def run_spec_(spark, sf):
    return run_spec(spark, {
        "with": {
            "big": {
                "from": base(spark, sf, "orders"),
                "where": ["o_totalprice > :low"], "args": {"low": 200000.0},
            },
        },
        "from": ({
            "from": "big",
            "select": ["o_custkey", "split(o_orderpriority, '-') as words"],
        }, "b"),
        "unnest": ("words", "word"),
        "group": ["o_custkey", "word"],
        "select": [("count(*)", "n")],
        "having": "n > 1",
        "order": [("n", "desc"), "o_custkey", "word"],
    })


# Scalars and records


@query
def hour_marks(spark, sf):
    seen = F.col("l_shipdate") + F.col("l_orderkey") * F.expr("interval '7' minute")
    rows = base(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", seen.alias("seen")
    )
    return rows.select(
        "l_orderkey", "l_linenumber",
        ts.hour_diff(ts.ntz("1998-08-02 00:30:00"), F.col("seen")).cast("bigint").alias("hours"),
        ts.next_checkpoint(F.col("seen")).alias("next_checkpoint"),
    )


@query
def stringify_timestamps(spark, sf):
    rows = base(spark, sf, "events").select(
        "event_id", "ts", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts_second"),
        F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_id") % 3 == 0, "x 0000-00-00 y").otherwise(F.col("event_type"))
        .alias("note"),
    )
    default = stringify_times(rows)
    fixed = stringify_times(rows.select("event_id", F.col("ts_second").alias("ts_fixed"),
                                        F.col("day").alias("day_fixed")), ts.CDC_PATTERN)
    return default.join(fixed, "event_id")


@query
def coerce_strings(spark, sf):
    kind = F.col("event_id") % 16
    raw = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format("ts", "yyyyMMdd"))
        .when(kind == 2, F.date_format("ts", "MM/dd/yyyy"))
        .when(kind == 3, F.concat(F.lit("nope "), F.col("event_id")))
        .when(kind == 4, "0000-00-00 00:00:00")
        .when(kind == 6, F.date_format("ts", "M/d/yyyy H:mm"))
        .when(kind == 7, F.date_format("ts", "MMM d, yyyy H:mm:ss"))
        .when(kind == 8, F.date_format("ts", "d MMMM yyyy"))
        .when(kind == 9, F.date_format("ts", "yyyy-MM-dd hh:mm a"))
        .when(kind == 10, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"))
        .when(kind == 11, F.date_format("ts", "MM-dd-yyyy"))
        .when(kind == 12, F.date_format("ts", "yyyyMMdd'T'HHmmss"))
        .when(kind == 13, F.date_format("ts", "MMMM d, yyyy h:mm:ss a"))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    )
    rows = base(spark, sf, "events").select(
        "event_id", raw.alias("as_datetime"), raw.alias("as_date"), raw.alias("as_timestamp"),
        ts.is_date(raw).alias("is_date"),
    )
    typed = coerce_record(
        rows, "as_datetime timestamp_ntz, as_date date, as_timestamp timestamp"
    )
    return typed.select(
        "event_id", "as_datetime", "as_date",
        ts.epoch_seconds(F.col("as_timestamp")).alias("epoch"),
        "is_date", F.array_join("_bad_fields", ",").alias("bad"),
    )


@query
def nested_coerce(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    items = F.array(
        F.struct(text.alias("d"), F.col("event_id").alias("n")),
        F.struct(F.lit("0000-00-00").alias("d"), F.col("user_id").alias("n")),
        F.struct(F.lit("nope").alias("d"), F.lit(3).cast("bigint").alias("n")),
    )
    rows = base(spark, sf, "events").select("event_id", items.alias("items"))
    typed = coerce_record(rows, "items array<struct<d:timestamp_ntz,n:bigint>>")
    back = stringify_times(typed, ts.CDC_PATTERN)
    return back.select(
        "event_id", F.array_join("_bad_fields", ",").alias("bad"),
        F.posexplode("items").alias("pos", "item"),
    ).select("event_id", "bad", "pos", F.col("item.d").alias("d"), F.col("item.n").alias("n"))


@query
def decimal_text(spark, sf):
    price = F.col("o_totalprice").cast("decimal(15,2)")
    rows = base(spark, sf, "orders").select(
        "o_orderkey", price.alias("price"),
        F.array(F.struct((price * 2).cast("decimal(16,2)").alias("p"))).alias("parts"),
    )
    return stringify_decimals(rows).select(
        "o_orderkey", "price", F.col("parts")[0]["p"].alias("double_price")
    )


@query
def crypto_roundtrip(spark, sf):
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    rows = base(spark, sf, "customer").select(F.to_json(F.struct(*columns)).alias("text"))
    plain = decrypt_lines(encrypt_lines(rows, KEYS, "text", use=1), KEYS)
    ddl = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return plain.select(F.from_json("text", ddl).alias("r")).select("r.*")


@query
def match_scores_(spark, sf):
    scores = match_scores(view(spark, sf, "match_score_raw"))
    return scores.select("entity_id", F.explode("scores").alias("s")).select("entity_id", "s.*")


@query
def adopt_curve_(spark, sf):
    scores = adopt_curve(view(spark, sf, "adopt_curve_raw"))
    return scores.select("entity_id", F.explode("scores").alias("s")).select("entity_id", "s.*")


@query
def id_list_parse(spark, sf):
    text = F.concat_ws(
        ",", F.col("o_custkey"), F.lit(""), F.col("o_orderkey"), F.col("o_custkey"),
        F.when(F.col("o_orderkey") % 11 == 0, "1x"),
    )
    rows = base(spark, sf, "orders").select("o_orderkey", text.alias("ids"))
    return rows.select(
        "o_orderkey", names.is_id_list(F.col("ids")).alias("valid"),
        F.posexplode_outer(names.id_list(F.col("ids"))).alias("pos", "id"),
    )


def _contacts(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    contact = F.struct(
        F.when(key % 17 != 5, key).alias("id"),
        F.lower("c_mktsegment").alias("first_name"),
        F.when(key % 10 != 3, F.col("c_name")).alias("last_name"),
        F.when(key % 29 == 7, F.lit(1)).alias("age"),
    )
    text = F.when(
        key % 13 == 4, F.concat(F.lit('{"id":"'), key, F.lit('","first_name":"a","last_name":"b"}'))
    ).otherwise(F.to_json(contact))
    return base(spark, sf, "customer").select(key, text.alias("contact"))


@query
def contact_validation(spark, sf):
    checked = check_contacts(_contacts(spark, sf))
    return checked.select(
        "c_custkey", "id", "first_name", "last_name", F.array_join("_errors", ";").alias("errors")
    )


@query
def contact_upload(spark, sf):
    """Bodies of two contacts each; a faulty contact rejects its body."""
    second = F.concat(
        F.lit('{"id":'), F.col("c_custkey") + 1000000, F.lit(',"first_name":"x","last_name":"y"}')
    )
    uploads = _contacts(spark, sf).select(
        F.col("c_custkey").alias("batch_id"), F.lit("acme").alias("client"),
        F.concat(F.lit('{"contacts":['), F.col("contact"), F.lit(","), second, F.lit("]}"))
        .alias("body"),
    )
    lake = shared_folder(spark, "lake_contacts")
    jobs.upload_contacts(uploads, lake, now="2024-02-01 00:00:00")
    return spark.read.parquet(lake).select(
        "id", "first_name", "last_name", "email", "client", "ingestion_timestamp"
    )


@query
def name_parts(spark, sf):
    name = names.export_name(F.lit("staging.contacts"), F.col("client"), F.col("file"))
    path = F.concat(F.lit("in/"), F.col("file"))
    return view(spark, sf, "entities").select(
        "entity_id",
        name.alias("export_name"),
        names.export_client(name).alias("client"),
        names.last_part(F.lit("project:lake.zleads")).alias("table_name"),
        names.strip_prefix(F.col("file"), "file-").alias("stripped"),
        names.relative_name(path, "in").alias("relative"),
        names.pseudonym(F.col("entity_id")).alias("pseudonym"),
    )


@query
def ns_timestamps(spark, sf):
    text = F.when(
        F.col("event_id") % 4 < 2,
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("789 +0000 UTC")),
    ).when(F.col("event_id") % 4 == 2, "x")
    rows = base(spark, sf, "events").select("event_id", text.alias("expiry"))
    now = F.lit("2024-01-16 00:00:00+00:00").cast("timestamp")
    return rows.select(
        "event_id", ts.utc_clock(ts.parse_nanoseconds(F.col("expiry"))).alias("expires"),
        ts.is_expired(F.col("expiry"), now).alias("expired"),
    )


# Scores


def _answers(spark, sf, insight_id: str):
    """The answers to an insight's requests: bodies made of the tables, found by entity."""
    body = {"match-score": "scores", "adopt-curve": "scores"}.get(insight_id, insight_id.replace("-", "_"))
    known = view(spark, sf, "insight_answers").select("entity_id", "code", F.col(body).alias("body"))
    return lambda pending: pending.select("entity_id").join(known, "entity_id")


@query
def insight_refresh(spark, sf):
    """The refresh of all insights as a job, twice on one day: the second adds only for
    entities that had no answer, and there is none for them again."""
    folder = shared_folder(spark, "insights")
    for now in ("2024-02-01 00:00:00", "2024-02-01 09:30:00"):
        jobs.refresh_insights(
            view(spark, sf, "entities"), folder, lambda i: _answers(spark, sf, i), now=now
        )
    made = []
    for insight_id in INSIGHT_IDS:
        name = insight_id.replace("-", "_")
        rows = spark.read.parquet(f"{folder}/{name}")
        value = next(c for c in rows.columns if c not in ("entity_id", "ingestion_timestamp"))
        text = F.col(value)
        if name == "match_score":
            text = _score_text(value, "client")
        elif name == "adopt_curve":
            text = _score_text(value, "corpus")
        elif name in ("persuasion", "channel"):
            text = F.array_join(value, "|")
        made.append(rows.select(
            F.lit(name).alias("insight"), "entity_id", "ingestion_timestamp", text.alias("value")
        ))
    return reduce(DataFrame.unionByName, made)


@query
def insight_fetch(spark, sf):
    answers = _answers(spark, sf, "match-score")(view(spark, sf, "entities"))
    scores = reshape_insight(insight_bodies(answers, "match-score"), "match-score")
    return scores.select("entity_id", F.explode("scores").alias("s")).select("entity_id", "s.*")


@query
def lead_scores(spark, sf):
    scored = jobs.lead_scores(
        view(spark, sf, "lead_features"), logistic_predictor(WEIGHTS, INTERCEPT)
    )
    return scored.select("lead_id", "name", "lead_score")


@query
def lead_scores_columns(spark, sf):
    """The same model as a column expression: nothing leaves the JVM."""
    leads = view(spark, sf, "lead_features").filter("processed")
    return leads.select("lead_id", logistic_score(WEIGHTS, INTERCEPT).alias("lead_score"))


@query
def lead_model(spark, sf):
    """Which leads are of high value, by a model fitted to their features."""
    leads = view(spark, sf, "lead_features").join(
        view(spark, sf, "lcv_level"), F.col("lead_id") == F.col("entity_id").cast("bigint")
    ).withColumn("high", F.col("prediction") == "high")
    fitted = fit_logistic(leads, ["engagement_score", "age"], "high")
    terms = [("intercept", fitted.intercept), *fitted.weights.items()]
    return spark.createDataFrame(terms, "term string, weight double").withColumn("weight", F.round("weight", 6))


def _moods(spark, sf) -> DataFrame:
    return jobs.sentiment(view(spark, sf, "feedback"))


@query
def sentiment_update(spark, sf):
    """Scores written into the feedback table; a second run finds nothing to score."""
    feedback = view(spark, sf, "feedback")
    return _updated(StateTable(spark, shared_folder(spark, "feedback"), feedback.schema, ["lead_id"], 8), feedback)


@query
def sentiment_update_keyed(spark, sf):
    """The same in a table of commits, merged into a new base in the end."""
    feedback = view(spark, sf, "feedback")
    return _updated(KeyedTable(spark, shared_folder(spark, "feedback"), feedback.schema, ["lead_id"]), feedback)


def _updated(table: StateTable | KeyedTable, feedback: DataFrame) -> DataFrame:
    table.append(feedback)
    runs = [jobs.score_sentiment(table) for _ in range(2)]
    if isinstance(table, KeyedTable):
        table.compact()
    return table.read().select(
        "lead_id", "turn", "sentiment_processed", "sentiment_label",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        F.lit(runs[1].state).alias("second_run"),
    )


def _rated(spark, sf) -> DataFrame:
    """Rated texts (``rated`` of the derived tables): a rating is some bytes, a text is long."""
    ratings = base(spark, sf, "labels").select("doc_id", F.expr("quality = 1 and toxic = 0").alias("positive"))
    rows = joins.join_counted(base(spark, sf, "documents").select("doc_id", "text"), ratings, ["doc_id"])
    return rows.withColumnRenamed("doc_id", "id")


def _trained(spark, sf) -> DataFrame:
    """The model that the job learns from rated texts."""
    table = shared_folder(spark, "sentiment_model")
    jobs.train_sentiment(_rated(spark, sf).select("text", "positive"), table)
    return spark.read.parquet(table)


@query
def sentiment_model(spark, sf):
    return _trained(spark, sf).withColumn("weight", F.round("weight", 9))


@query
def sentiment_model_scores(spark, sf):
    """Every feedback text by the trained model, answered or not."""
    scored = model.with_sentiment(view(spark, sf, "feedback"), _trained(spark, sf))
    return scored.select(
        "lead_id", "turn", F.round("sentiment_score", 6).alias("sentiment_score"),
        F.round("sentiment_strength", 6).alias("sentiment_strength"),
    )


@query
def sentiment_held_out(spark, sf):
    """Rated texts of one fold by a model of the others."""
    scored = model.held_out(_rated(spark, sf), "id")
    return scored.select("id", "positive", F.round("score", 6).alias("score"))


@query
def sentiment(spark, sf):
    return _moods(spark, sf).select(
        "lead_id", "turn", F.round("sentiment_score", 6).alias("sentiment_score"),
        "sentiment_label", F.round("sentiment_strength", 6).alias("sentiment_strength"),
    )


@query
def priority(spark, sf):
    return jobs.prioritised_leads(lead_scores(spark, sf), _moods(spark, sf))


@query
def drift_psi(spark, sf):
    events = base(spark, sf, "events")
    found = drift(
        events, F.col("ts") < ts.ntz("2024-01-16 00:00:00"),
        value_bucket(F.col("value"), 0.0, 100.0, 10), ["event_type"],
    )
    return found.select("event_type", F.round("psi", 6).alias("psi"))


BINS = 10


def _before() -> Column:
    return F.col("ts") < ts.ntz("2024-01-16 00:00:00")


@query
def drift_quantiles(spark, sf):
    """Drift over bins of the reference's quantiles, and whether the sketch's cuts are within their stated error."""
    events, accuracy = base(spark, sf, "events"), 100_000
    cuts = quantile_cuts(events, _before(), "value", ["event_type"], BINS, accuracy)
    each = cuts.select("event_type", F.posexplode("cuts").alias("i", "cut"))
    ranks = events.filter(_before()).join(each, "event_type").groupBy("event_type", "i").agg(
        F.avg((F.col("value") < F.col("cut")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("cut")).cast("int")).alias("upto"),
    )
    place, error = (F.col("i") + 1) / BINS, 1 / accuracy + 1e-12
    good = ranks.groupBy("event_type").agg(
        F.bool_and((F.col("below") <= place + error) & (F.col("upto") >= place - error)).alias("within")
    )
    found = quantile_drift(events, _before(), "value", ["event_type"], BINS, accuracy)
    return found.join(good, "event_type").select("event_type", F.round("psi", 6).alias("psi"), "within")


@query
def drift_distance(spark, sf):
    """The two-sample distance of each event type's values before and after, from running sums over ranges."""
    found = two_sample_distance(base(spark, sf, "events"), _before(), "value", ["event_type"], ranges=7)
    return found.select("event_type", "r", "c", F.round("distance", 9).alias("distance"))


@query
def stream_priorities(spark, sf):
    """``priority`` kept up by a stream: scores and feedback come in files, the feedback of some leads first."""
    folder = shared_folder(spark, "stream_priority")
    feedback = view(spark, sf, "feedback").repartition(3)
    scores = lead_scores(spark, sf).withColumn("scored_at", ts.ntz("2024-02-01 00:00:00")).repartition(3)
    older = scores.limit(0).unionByName(scores.withColumns({
        "lead_score": F.lit(0.0), "scored_at": ts.ntz("2024-01-01 00:00:00"),
    }))
    table = KeyedTable(spark, f"{folder}/priorities", PRIORITIES, ["lead_id"], share=100.0)

    def run():
        stream_priority(
            spark, f"{folder}/scores", scores.schema, f"{folder}/feedback", feedback.schema, table,
            f"{folder}/checkpoint", files_per_batch=2,
        ).awaitTermination()

    older.write.parquet(f"{folder}/scores")
    feedback.filter("turn = 0").write.parquet(f"{folder}/feedback")
    run()
    scores.write.mode("append").parquet(f"{folder}/scores")
    feedback.filter("turn > 0").write.mode("append").parquet(f"{folder}/feedback")
    run()
    return table.read()


@query
def merge_scores(spark, sf):
    leads = view(spark, sf, "lead_features").withColumn("lead_score", F.lit(None).cast("double"))
    table = StateTable(spark, shared_folder(spark, "leads"), leads.schema, ["lead_id"], 8)
    table.append(leads)
    jobs.score_leads(table, logistic_predictor(WEIGHTS, INTERCEPT))
    return table.read().select("lead_id", "name", "processed", "lead_score")


def _predicted(spark, sf) -> tuple[DataFrame, DataFrame]:
    leads = view(spark, sf, "lead_features").withColumn("lead_score", F.lit(-1.0))
    return leads, lead_scores_columns(spark, sf).join(leads.drop("lead_score"), "lead_id")


@query
def merge_predictions(spark, sf):
    """Scores made elsewhere replace the lead rows they belong to."""
    leads, made = _predicted(spark, sf)
    table = StateTable(spark, shared_folder(spark, "leads"), leads.schema, ["lead_id"], 8)
    table.append(leads)
    table.merge(made)
    return table.read().select("lead_id", "name", "processed", "lead_score")


@query
def keyed_merge(spark, sf):
    """The same in a table of commits, the scores coming by nation; too many of them make a new base."""
    leads, made = _predicted(spark, sf)
    table = KeyedTable(spark, shared_folder(spark, "leads"), leads.schema, ["lead_id"], commits=3)
    table.append(leads)
    nation = base(spark, sf, "customer").select(F.col("c_custkey").alias("lead_id"), F.col("c_nationkey").alias("nation"))
    for region in base(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_set("n_nationkey").alias("n")).collect():
        table.merge(made.join(nation.filter(F.col("nation").isin(region.n)), "lead_id", "left_semi"))
    return table.read().select("lead_id", "name", "processed", "lead_score")


# Sinks


@query
def csv_export_readback(spark, sf):
    out = shared_folder(spark, "csv_export")
    contacts = view(spark, sf, "staging_contacts")
    export_csv(contacts, out)
    return read_export(spark, out, [c for c in contacts.columns if c != "client"])


@query
def append_aligned(spark, sf):
    table = shared_folder(spark, "append_aligned")
    schema = "c_custkey bigint, c_name string, c_nationkey bigint, note string"
    customers = base(spark, sf, "customer")
    append(customers.select("c_nationkey", "c_name", "c_custkey"), table, schema)
    noted = customers.select("c_custkey", F.lower("c_mktsegment").alias("note"))
    append(noted, table, schema)
    append(rows_frame(spark, [{"note": "it's", "c_custkey": -1}], schema), table, schema)
    return spark.read.parquet(table)


# Change files


CHANGE_SCHEMA = (
    "c_custkey bigint, c_name string, opened timestamp_ntz, born date, "
    "visits array<struct<at:timestamp_ntz,n:int>>, marks map<string,date>, "
    "ingestion_timestamp timestamp_ntz"
)


def _change_files(spark, sf, folder: str | None = None, which: Column | None = None) -> str:
    key = F.col("c_custkey")
    record = F.struct(
        key, "c_name",
        F.concat(F.lit("199"), key % 10, F.lit("-01-02 03:04:05.5")).alias("opened"),
        F.when(key % 3 == 0, "0000-00-00").otherwise(F.concat(F.lit("198"), key % 10, F.lit("1231")))
        .alias("born"),
        F.array(
            F.struct(F.lit("2020-01-01").alias("at"), F.lit(1).alias("n")),
            F.struct(F.lit("0000-00-00 00:00:00").alias("at"), (key % 5).cast("int").alias("n")),
        ).alias("visits"),
    )
    rows = base(spark, sf, "customer")
    lines = (rows if which is None else rows.filter(which)).select(F.to_json(record).alias("text"))
    folder = folder or shared_folder(spark, "changes")
    encrypt_lines(lines, KEYS, "text", use=1).write.mode("append").text(folder)
    return folder


def _changes(lake: DataFrame) -> DataFrame:
    return lake.select(
        "c_custkey", "c_name", "opened", "born", F.posexplode("visits").alias("pos", "v")
    ).select("c_custkey", "c_name", "opened", "born", "pos", "v.at", "v.n")


def _run_batch(spark, source, folder, **options):
    return jobs.cdc_to_lake(
        spark, source, f"{folder}/lake", f"{folder}/checkpoint", KEYS, CHANGE_SCHEMA, prefix="part-", **options
    )


@query
def cdc_to_lake(spark, sf):
    source, folder = _change_files(spark, sf), shared_folder(spark, "lake")
    _run_batch(spark, source, folder, contains=".txt")
    return _changes(spark.read.parquet(f"{folder}/lake"))


@query
def cdc_rerun(spark, sf):
    """Files of half the customers, the others' files later, and a run without new files."""
    folder, states = shared_folder(spark, "rerun"), []
    low = base(spark, sf, "customer").agg(F.avg("c_custkey")).first()[0]
    states.append(_run_batch(spark, f"{folder}/in", folder).state)  # there is no folder yet
    for part in (F.col("c_custkey") < low, F.col("c_custkey") >= low):
        _change_files(spark, sf, f"{folder}/in", part)
        states.append(_run_batch(spark, f"{folder}/in", folder).state)
    states.append(_run_batch(spark, f"{folder}/in", folder).state)
    return _changes(spark.read.parquet(f"{folder}/lake")).withColumn("runs", F.lit(" ".join(states)))


@query
def cdc_batch_and_stream(spark, sf):
    """Both ways into one lake, each with files of its own: all rows are there, once."""
    folder = shared_folder(spark, "both_ways")
    low = base(spark, sf, "customer").agg(F.avg("c_custkey")).first()[0]
    _change_files(spark, sf, f"{folder}/in", F.col("c_custkey") < low)
    _change_files(spark, sf, f"{folder}/arriving", F.col("c_custkey") >= low)
    for _ in range(2):
        _run_batch(spark, f"{folder}/in", folder)
        stream_cdc(
            spark, f"{folder}/arriving", f"{folder}/lake", f"{folder}/stream", KEYS, CHANGE_SCHEMA,
            prefix="part-", files_per_batch=2, name="stream",
        ).awaitTermination()
    return _changes(spark.read.parquet(f"{folder}/lake"))


@query
def cdc_two_checkpoints(spark, sf):
    """Two batch jobs with checkpoints of their own load into one lake; a name that one of them has is refused the other."""
    folder = shared_folder(spark, "two_checkpoints")
    low = base(spark, sf, "customer").agg(F.avg("c_custkey")).first()[0]
    refused = 0
    for part, which in (("a", F.col("c_custkey") < low), ("b", F.col("c_custkey") >= low)):
        _change_files(spark, sf, f"{folder}/{part}", which)
        load = lambda **named: jobs.cdc_to_lake(
            spark, f"{folder}/{part}", f"{folder}/lake", f"{folder}/checkpoint-{part}", KEYS, CHANGE_SCHEMA,
            prefix="part-", **named,
        )
        if part == "b":
            try:
                load(name="first")
            except ValueError:
                refused += 1
        load(**({"name": "first"} if part == "a" else {}))
    return _changes(spark.read.parquet(f"{folder}/lake")).withColumn("refused", F.lit(refused))


def _bad_change_files(spark, sf, folder: str) -> None:
    nation = F.col("c_nationkey")
    key = F.col("c_custkey").cast("string")
    text = (
        F.when(nation == 3, F.to_json(F.struct("c_custkey", F.lit("soon").alias("opened"))))
        .when(nation == 4, F.to_json(F.struct("c_custkey", F.lit(1).alias("extra"))))
        .when(nation == 5, F.concat(F.lit('{"c_custkey":'), key, F.lit(',"c_name"')))
        .when(nation == 6, F.to_json(F.struct("c_custkey", F.create_map(
            F.lit("a"), F.lit("0000-00-00"), F.lit("b"), F.lit("Jan 2, 2020")).alias("marks"))))
        .when(nation == 7, F.to_json(F.struct("c_custkey", F.create_map(
            F.lit("a"), F.lit("never")).alias("marks"))))
        .otherwise(F.to_json(F.struct("c_custkey", "c_name")))
    )
    lines = base(spark, sf, "customer").select(text.alias("text"))
    encrypt_lines(lines, KEYS, "text").write.text(folder)


def _loaded_and_bad(spark, folder: str) -> DataFrame:
    loaded = spark.read.parquet(f"{folder}/lake").select("c_custkey", F.lit("").alias("error"))
    bad = decrypt_lines(spark.read.parquet(f"{folder}/bad"), KEYS, "_line").select(
        F.regexp_extract("text", '"c_custkey":([0-9]+)', 1).cast("bigint").alias("c_custkey"),
        F.col("_error").alias("error"),
    )
    return loaded.unionByName(bad)


@query
def cdc_quarantine(spark, sf):
    """Bad records of a load, found again in the quarantine table."""
    folder = shared_folder(spark, "quarantine")
    _bad_change_files(spark, sf, f"{folder}/in")
    _run_batch(spark, f"{folder}/in", folder, on_error="quarantine", quarantine=f"{folder}/bad")
    return _loaded_and_bad(spark, folder)


@query
def cdc_stream_quarantine(spark, sf):
    folder = shared_folder(spark, "stream_quarantine")
    _bad_change_files(spark, sf, f"{folder}/in")
    stream_cdc(
        spark, f"{folder}/in", f"{folder}/lake", f"{folder}/checkpoint", KEYS, CHANGE_SCHEMA,
        prefix="part-", files_per_batch=1, on_error="quarantine", quarantine=f"{folder}/bad",
    ).awaitTermination()
    return _loaded_and_bad(spark, folder)


@query
def stream_cdc_(spark, sf):
    source, folder = _change_files(spark, sf), shared_folder(spark, "stream")
    for _ in range(2):  # the second run finds no new files
        stream_cdc(
            spark, source, f"{folder}/lake", f"{folder}/checkpoint", KEYS, CHANGE_SCHEMA,
            prefix="part-", files_per_batch=2,
        ).awaitTermination()
    return _changes(spark.read.parquet(f"{folder}/lake"))


@query
def stream_scoring(spark, sf):
    folder = shared_folder(spark, "stream_scoring")
    leads = view(spark, sf, "lead_features")
    leads.write.parquet(f"{folder}/leads")
    stream_scores(
        spark, f"{folder}/leads", leads.schema, f"{folder}/scores", f"{folder}/checkpoint",
        logistic_predictor(WEIGHTS, INTERCEPT),
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/scores").select("lead_id", "name", "lead_score")


def registered() -> dict[str, Query]:
    """All queries; a trailing underscore only avoids a name clash in this module."""
    return {name.rstrip("_"): function for name, function in QUERIES.items()}

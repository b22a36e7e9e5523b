"""The jobs: each reads frames, runs one chain of operators and writes its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from contextlib import AbstractContextManager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadflow.functions.insights import is_readable, reshape_insight
from leadflow.functions.names import export_name
from leadflow.functions.records import coerce_record, stringify_times
from leadflow.functions.rules import polarity, strength
from leadflow.functions.timestamps import ntz, pinned, stamp, utc_now
from leadflow.operators.joins import (
    VISIT_COLUMNS, owned_sites, pending_entities, profiles, site_visitors, site_visits,
)
from leadflow.operators.scoring import (
    FEATURES, Predictor, insight_bodies, lead_scores, lexicon_score, prioritised,
)
from leadflow.operators import late, sentiment_model, status_log
from leadflow.operators.status import import_gate, open_rows
from leadflow.operators.status_log import StatusLog
from leadflow.operators.window import (
    WINDOW, ExportWindow, commit_window, cut_windows, export_columns, in_window, in_windows, late_rows,
    saved_checkpoint,
)
from leadflow.schemas import INSIGHT_IDS, insight_table, struct_type, table_schema
from leadflow.sinks.csv_export import export_csv, move_files, route_uploads
from leadflow.sinks.keyed import KeyedTable
from leadflow.sinks.state import StateTable, scratch
from leadflow.sinks.tables import append, counted, replace, upsert
from leadflow.sources.changes import cdc_records, check_on_error
from leadflow.sources.files import list_files
from leadflow.sources.json_records import (
    accept_batches, check_contacts, contact_rows, entities_from_answers,
)
from leadflow.sources.tables import destination_schema, read_source
from leadflow.streaming.ingest import stream_cdc

__all__ = ["cdc_records", "lead_scores"]  # also used from here

BATCH = "_batch"
WINDOWS_AT_ONCE = 1_000  # windows of an export that one job writes


@dataclass(frozen=True)
class JobResult:
    job: str
    state: str  # done or skipped
    rows: int = 0
    rejected: int = 0
    detail: object = None


def _schema(spark: SparkSession, table: str, schema: str | T.StructType | None) -> T.StructType:
    """The given schema, or that of the table to load into."""
    return destination_schema(spark, table) if schema is None else struct_type(schema)


# Change files to the lake


def cdc_to_lake(
    spark: SparkSession,
    source: str,
    lake: str,
    checkpoint: str,
    keys: Sequence[str],
    schema: str | T.StructType | None = None,
    prefix: str = "",
    contains: str = "",
    on_error: str = "fail",
    quarantine: str | None = None,
    now=None,
    name: str | None = None,
) -> JobResult:
    """Load the change files that no run with this checkpoint has loaded; skipped without any.

    No shuffle: decode, type and write each file split alone. Without ``schema`` the lake's
    own is taken. See ``stream_cdc`` for how batches and several ingests share the lake.
    """
    check_on_error(on_error, quarantine)
    target = _schema(spark, lake, schema)
    if "load" in target.names:
        target = T.StructType([f for f in target if f.name != "load"])
    try:
        if list_files(spark, source, prefix, contains).isEmpty():
            return JobResult("cdc_to_lake", "skipped")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return JobResult("cdc_to_lake", "skipped")
    loaded: list[tuple[int, int]] = []
    stream_cdc(
        spark, source, lake, checkpoint, keys, target, prefix, contains, on_error=on_error,
        quarantine=quarantine, now=now, name=name, loaded=loaded,
    ).awaitTermination()
    if not loaded:
        return JobResult("cdc_to_lake", "skipped")
    return JobResult("cdc_to_lake", "done", sum(r for r, _ in loaded), sum(b for _, b in loaded))


# Lake to staging


def stage(
    spark: SparkSession,
    destination: str,
    schema: str | T.StructType | None,
    query: str,
    args: Mapping | None = None,
    now=None,
    **frames: DataFrame,
) -> JobResult:
    """Copy a query's rows to a staging table, stamped, times as plain text first.

    Without a schema, that of the destination is read while planning.
    """
    target = _schema(spark, destination, schema)
    rows = staged(read_source(spark, query=query, args=args, **frames), target, now)
    return JobResult("stage", "done", append(rows, destination, target))


def staged(rows: DataFrame, schema: str | T.StructType, now=None) -> DataFrame:
    """Stamp, write times as text and drop zero dates, then take the table's types."""
    return coerce_record(stringify_times(stamp(rows, now=now)), schema, on_bad="fail")


# Checkpointed export


def upload_files(
    files: DataFrame,
    upload: Callable[[str, str], tuple[int, str]],
    table: str,
    partitions: int,
) -> DataFrame:
    """Hand every exported file to ``upload(client, path)``, ``partitions`` at a time."""

    def run(batches):
        for batch in batches:
            answers = [upload(c, p) for c, p in zip(batch["client"], batch["path"])]
            batch["code"] = [a[0] for a in answers]
            batch["body"] = [a[1] for a in answers]
            yield batch[["client", "path", "code", "body"]]

    # The folder name has special characters as %XX, and a plus as it is.
    folder = F.regexp_extract("path", "/client=([^/]*)/[^/]*$", 1)
    client = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    named = files.select(client.alias("client"), "path")
    sent = named.repartition(partitions, "path").mapInPandas(
        run, "client string, path string, code int, body string"
    )
    file = F.element_at(F.split("path", "/"), -1)
    return sent.withColumn("name", export_name(F.lit(table), F.col("client"), file))


def route_files(
    spark: SparkSession, folder: str, out: str, table: str,
    upload: Callable[[str, str], tuple[int, str]], uploads_at_once: int,
) -> DataFrame:
    """Upload the files of an export and move each below ``out/processed`` or ``out/failed``.

    Returns the routed files. The answers are written before any file moves, so a repeated
    task moves files but sends none again.
    """
    files = list_files(spark, f"{folder}/*", contains=".csv")
    results = f"{out.rstrip('/')}/{table}-uploads/{uuid.uuid4().hex}"
    sent = upload_files(files, upload, table, uploads_at_once)
    route_uploads(sent).write.partitionBy("route").parquet(results)
    routed = spark.read.parquet(results)
    place = F.concat(
        F.lit(f"{out.rstrip('/')}/"), "route", F.lit(f"/{table}"), F.regexp_extract("path", "(/run=.*)$", 1)
    )
    move_files(routed.select("path", place.alias("target")), uploads_at_once)
    return routed


def export_table(
    source: DataFrame,
    table: str,
    checkpoints: StateTable,
    out: str,
    job: str = "export",
    status: StateTable | StatusLog | None = None,
    upload: Callable[[str, str], tuple[int, str]] | None = None,
    uploads_at_once: int | None = None,
    max_rows: int | None = None,
    max_windows: int | None = None,
    now=None,
    work: str | None = None,
    record: late.ExportRecord | None = None,
) -> JobResult:
    """Export everything behind the checkpoint as CSV per client; the checkpoint moves last.

    All rows are one window, or with ``max_rows`` several, each a run of its own; ``max_windows`` ends
    the job earlier. The detail holds the windows. The source is read once to place all rows in their windows.
    ``WINDOWS_AT_ONCE`` windows are then written by one job and committed together. With ``upload`` each
    window is sent and committed on its own: each file is moved to ``processed`` or ``failed`` by its
    answer, the processed ones open a status row, and any failure ends the job with its window
    uncommitted. ``record`` keeps the ids of exported rows, for ``export_late``.
    """
    if upload is not None and not uploads_at_once:
        raise ValueError("say how many uploads the service takes at once")
    found = cut_windows(checkpoints.read(), job, table, {table: source}, max_rows, work)
    windows = [w for w in found if w.has_data][:max_windows]
    send = lambda df: _export(
        df, table, out, status=status, upload=upload, uploads_at_once=uploads_at_once, now=now
    )
    rows = 0
    if len(windows) == 1 and record is None:
        rows = send(in_window(source, windows[0]))
        commit_window(checkpoints, *windows)
    elif windows:
        # what is sent is what is recorded, whatever arrives meanwhile
        with _placed(source, table, windows, work, whole=record is not None) as placed:
            for first in range(0, len(windows), WINDOWS_AT_ONCE):
                several = windows[first : first + WINDOWS_AT_ONCE]
                batch = placed.filter(F.col(BATCH) == first // WINDOWS_AT_ONCE).drop(BATCH)
                if upload is None:
                    rows += _export_runs(batch, table, out)
                    if record is not None:
                        record.add(batch, table)
                    commit_window(checkpoints, *several)
                    continue
                for i, window in enumerate(several, first):
                    exported = batch.filter(F.col(WINDOW) == i)
                    rows += send(exported)
                    if record is not None:
                        record.add(exported, table)
                    commit_window(checkpoints, window)
    return JobResult("export", "done" if windows else "skipped", rows, detail=windows)


def _placed(
    source: DataFrame, table: str, windows: Sequence[ExportWindow], work: str | None, whole: bool
) -> AbstractContextManager[DataFrame]:
    """The rows of all windows as a scratch table, a partition for each ``WINDOWS_AT_ONCE`` of them.

    With ``whole`` it has all columns of the source, else those that are exported.
    """
    rows = in_windows(source, windows)
    rows = rows if whole else export_columns(rows, table, WINDOW)
    rows = rows.withColumn(BATCH, F.floor(F.col(WINDOW) / WINDOWS_AT_ONCE).cast("int"))
    # a batch that is too big for one task is split; within a file, the rows of a window stand together
    dealt = rows.hint("rebalance", BATCH).sortWithinPartitions(BATCH, WINDOW)
    return scratch(dealt, "windows", work, [BATCH])


def _export_runs(df: DataFrame, table: str, out: str) -> int:
    """Write the rows of several windows as one run of CSV files each, in one job; the number of rows."""
    run = F.concat(F.lit(f"{uuid.uuid4().hex}-"), F.col(WINDOW).cast("string"))
    rows = export_columns(df.withColumn("run", run), table, "run")
    return export_csv(rows, f"{out.rstrip('/')}/{table}", run="run").get["n"]


def _export(
    df: DataFrame, table: str, out: str, status=None, upload=None, uploads_at_once=None, now=None
) -> int:
    """Write rows as a run of CSV files and hand these over; the number of rows."""
    folder = f"{out.rstrip('/')}/{table}/run={uuid.uuid4().hex}"
    seen = export_csv(export_columns(df, table), folder)
    if upload is not None:
        routed = route_files(df.sparkSession, folder, out, table, upload, uploads_at_once)
        if status is not None:
            opened = routed.filter(F.col("route") == "processed").select(
                "client", F.col("accepted_file").alias("file"), F.lit(table).alias("src_table"),
            )
            status.append(open_rows(opened, now))
        failed = routed.filter(F.col("route") == "failed").count()
        if failed:
            raise RuntimeError(f"{failed} files of {table} failed to upload, see {out}/failed")
    return seen.get["n"]


def export_late(
    source: DataFrame,
    table: str,
    checkpoints: StateTable,
    record: late.ExportRecord,
    out: str,
    job: str = "export",
    since=None,
    work: str | None = None,
    **delivery,
) -> JobResult:
    """Export the rows that arrived below the committed checkpoint, each once, as a run of their own.

    ``since`` bounds how far back late rows are looked for; ``delivery`` is as in ``export_table``.
    """
    until = saved_checkpoint(checkpoints.read(), job, table)
    with scratch(record.missing(source, table, until, since), "late", work) as rows:
        if rows.isEmpty():
            return JobResult("export_late", "skipped")
        n = _export(rows, table, out, **delivery)
        record.add(rows, table)
    return JobResult("export_late", "done", n)


def count_late(source: DataFrame, checkpoints: DataFrame, job: str, table: str) -> int:
    """Rows of an arrived batch that the committed checkpoint has already passed."""
    return late_rows(source, saved_checkpoint(checkpoints, job, table)).count()


# Imports


def import_entities(
    status: StateTable | StatusLog,
    reported: DataFrame,
    answers: DataFrame,
    entities: str,
    now=None,
    hours: int = 24,
    work: str | None = None,
) -> JobResult:
    """Import entities of finished files, then write every file's new status.

    What was reported is read once: a file that finishes meanwhile waits for the next run. A run that fails
    between the two writes leaves its files running; the next one finds their entities and
    changes the status only.
    """
    now = pinned(now)
    with scratch(import_gate(status_log.running(status, now, hours), reported), "gate", work) as gate:
        if gate.isEmpty():
            return JobResult("import_entities", "skipped")
        schema = table_schema("entities")
        # Makes an empty table before the first import, else does nothing.
        gate.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(entities)
        oldest = gate.agg(F.min("start_date")).first()[0]
        # entities are no older than the start of their file, so only the latest part of the table is read
        there = gate.sparkSession.read.schema(schema).parquet(entities).filter(
            F.col("ingestion_timestamp") >= ntz(oldest)
        ).select("file").distinct()
        new = gate.filter("imports").join(there, "file", "left_anti")
        with scratch(entities_from_answers(answers, new, now), "imported", work) as rows:
            written = append(rows, entities, schema)
        changes = gate.filter("changes").select("client", "file", "src_table", "new_status")
        status_log.change(status, changes, now)
    return JobResult("import_entities", "done", written)


def refresh_insight(
    entities: DataFrame,
    insight_id: str,
    folder: str,
    answers: Callable[[DataFrame], DataFrame],
    now=None,
    hours: int = 24,
    on_error: str = "fail",
    quarantine: str | None = None,
    work: str | None = None,
) -> JobResult:
    """Fetch one insight for the entities that lack a recent one, and append it.

    ``answers`` makes ``entity_id, code, body`` of the waiting entities: ``ask_service`` for a
    service, or a join with bodies at hand. An unreadable body ends the job or goes aside.
    """
    check_on_error(on_error, quarantine)
    now = pinned(now)
    spark = entities.sparkSession
    name = insight_table(insight_id)
    table, schema = f"{folder.rstrip('/')}/{name}", table_schema(name)
    # Makes an empty table before the first refresh, else does nothing.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(table)
    existing = spark.read.schema(schema).parquet(table)
    # Kept apart from the table it is appended to, and asked for only once.
    waiting = pending_entities(entities, existing, utc_now(now), hours)
    with scratch(waiting, f"pending-{name}", work) as pending:
        if pending.isEmpty():
            return JobResult(f"refresh {insight_id}", "skipped")
        with scratch(insight_bodies(answers(pending), insight_id), f"bodies-{name}", work) as bodies:
            bad = 0
            if on_error == "quarantine":
                aside, seen = counted(bodies.filter(~is_readable(F.col("body"), insight_id)))
                aside.write.mode("append").parquet(quarantine)
                bad, bodies = seen.get["n"], bodies.filter(is_readable(F.col("body"), insight_id))
            rows = append(stamp(reshape_insight(bodies, insight_id), now=now), table, schema)
    return JobResult(f"refresh {insight_id}", "done", rows, bad)


def refresh_insights(
    entities: DataFrame,
    folder: str,
    answers: Callable[[str], Callable[[DataFrame], DataFrame]],
    insight_ids: Sequence[str] = INSIGHT_IDS,
    **options,
) -> list[JobResult]:
    """Refresh each insight; ``answers(insight_id)`` says where its answers come from."""
    return [refresh_insight(entities, i, folder, answers(i), **options) for i in insight_ids]


def upload_contacts(
    uploads: DataFrame,
    lake: str,
    batch: str = "batch_id",
    on_error: str = "reject_batch",
    quarantine: str | None = None,
    now=None,
    work: str | None = None,
) -> JobResult:
    """Append contacts of uploaded bodies (``batch_id, client, body``).

    One faulty contact rejects its whole body, or goes alone to the quarantine table.
    The bodies are parsed once.
    """
    if on_error not in ("reject_batch", "quarantine"):
        raise ValueError(f"on_error must be reject_batch or quarantine, not {on_error}")
    if on_error == "quarantine" and not quarantine:
        raise ValueError("name the quarantine table")
    schema = table_schema("lake.contacts")
    texts = contact_rows(uploads).withColumn("_text", F.col("contact"))
    with scratch(check_contacts(texts), "contacts", work) as checked:
        if on_error == "reject_batch":
            good = accept_batches(checked.drop("_text"), batch)
            return JobResult(
                "upload_contacts", "done", append(stamp(good.drop(batch), now=now), lake, schema)
            )
        good = checked.filter(F.size("_errors") == 0).drop("_errors", "_text", batch)
        rows = append(stamp(good, now=now), lake, schema)
        aside, seen = counted(checked.filter(F.size("_errors") > 0))
        aside.select(batch, "client", F.col("_text").alias("contact"), "_errors").write.mode(
            "append"
        ).parquet(quarantine)
    return JobResult("upload_contacts", "done", rows, seen.get["n"])


# Scores


def sentiment(feedback: DataFrame, score: Callable = lexicon_score) -> DataFrame:
    """Score, label and strength of feedback texts that have none yet."""
    new = feedback.filter(~F.col("sentiment_processed"))
    scored = new.withColumn("sentiment_score", score(F.col("feedback_text")))
    return scored.withColumns({
        "sentiment_label": polarity(F.col("sentiment_score")),
        "sentiment_strength": strength(F.col("sentiment_score")),
    })


def prioritised_leads(scores: DataFrame, moods: DataFrame) -> DataFrame:
    """Leads with their mean sentiment, tier and final priority."""
    mean = moods.groupBy("lead_id").agg(
        F.round(F.avg("sentiment_score"), 6).alias("sentiment_score")
    )
    return prioritised(scores.join(mean, "lead_id", "left"))


def score_leads(
    leads: StateTable | KeyedTable, predictor: Predictor, mode: str = "update",
    features: Sequence[str] = FEATURES,
) -> JobResult:
    """Write scores back to the lead table, into the scored rows or as more rows.

    The scores are made from the table's own rows, so an update needs no join.
    """
    if mode not in ("update", "append"):
        raise ValueError(f"mode must be update or append, not {mode}")
    table = leads.read()
    processed = table.filter(F.col("processed"))
    if processed.isEmpty():
        return JobResult("score_leads", "skipped")
    rows = []

    def scored(df: DataFrame) -> DataFrame:
        made, seen = counted(lead_scores(df, predictor, features).select(*table.columns))
        rows.append(seen)
        return made

    if mode == "append":
        leads.append(scored(table))
    else:
        leads.update(processed, lambda old: scored(old).unionByName(
            old.filter(~F.coalesce(F.col("processed"), F.lit(False)))
        ))
    return JobResult("score_leads", "done", rows[0].get["n"])


def score_sentiment(
    feedback: StateTable | KeyedTable, score: Callable = lexicon_score, model: DataFrame | None = None
) -> JobResult:
    """Write score and label of feedback texts that have none yet into their rows.

    ``sentiment_processed`` is set, so the next run takes new texts only. Texts
    whose flag is null wait, as in ``sentiment``. With a ``model`` (``sentiment_model.train``) it scores.
    """
    table = feedback.read()
    new = table.filter(~F.col("sentiment_processed"))
    if new.isEmpty():
        return JobResult("score_sentiment", "skipped")
    rows = []

    def change(old: DataFrame) -> DataFrame:
        if model is None:
            scored = sentiment(old, score)
        else:
            scored = sentiment_model.with_sentiment(old.filter(~F.col("sentiment_processed")), model)
        made, seen = counted(scored)
        rows.append(seen)
        done = made.withColumn("sentiment_processed", F.lit(True)).select(*table.columns)
        return done.unionByName(old.filter(F.coalesce(F.col("sentiment_processed"), F.lit(True))))

    feedback.update(new, change)
    return JobResult("score_sentiment", "done", rows[0].get["n"])


def train_sentiment(rated: DataFrame, table: str, **options) -> JobResult:
    """Learn a sentiment model from rated texts (``text, positive``) and make it the table's content."""
    rows, seen = counted(sentiment_model.train(rated, **options))
    replace(rows, table)
    return JobResult("train_sentiment", "done", seen.get["n"])


def merge_scores(table: DataFrame, scored: DataFrame, key: str = "lead_id") -> DataFrame:
    """Predictions made elsewhere in place of the table's rows with the same lead."""
    return upsert(table, scored, [key])


# Served results


def publish_profiles(out: str | KeyedTable, *frames, kind: str = "lead", **options) -> JobResult:
    """All profiles as a table; readers filter it by id.

    Give ``hot=profile_hot_keys(..)`` where entities may have very many rows. A ``KeyedTable`` by id is laid
    out for look-ups of a few ids (``of_keys``), and its readers go on with the old profiles until the
    new ones are all there.
    """
    made = profiles(*frames, kind=kind, **options)
    if isinstance(out, KeyedTable):
        return JobResult(f"{kind} profiles", "done", out.replace(made))
    rows, seen = counted(made)
    replace(rows, out)
    return JobResult(f"{kind} profiles", "done", seen.get["n"])


def publish_site_visitors(out: str | KeyedTable, *frames: DataFrame) -> JobResult:
    """The visits of all sites as a table; a ``KeyedTable`` by ``site_id`` can be kept up by ``refresh_site_visitors``."""
    made = site_visitors(*frames)
    if isinstance(out, KeyedTable):
        return JobResult("site_visitors", "done", out.replace(made))
    rows, seen = counted(made)
    replace(rows, out)
    return JobResult("site_visitors", "done", seen.get["n"])


def refresh_site_visitors(
    out: KeyedTable,
    sites: DataFrame,
    visitors: DataFrame,
    users: DataFrame,
    codes: DataFrame,
    new_visits: DataFrame,
    changed_sites: DataFrame | None = None,
    label: str | None = None,
    work: str | None = None,
) -> JobResult:
    """Keep a published table up by what came since: new visits are added, changed sites made anew, as one commit.

    ``changed_sites`` has the ``site_id`` of new sites, of those with another user, and of those whose user or codes
    changed; all their visits are looked up in ``visitors``, which has the new ones too. So are those of sites
    that stood there without any visit until now. All other sites' rows are neither read nor
    written. A refresh that is repeated under its ``label`` does nothing.
    """
    if out.has(label):
        return JobResult("refresh_site_visitors", "skipped")
    empty = F.lit(True)
    for c in VISIT_COLUMNS:
        empty &= F.col(c).isNull()
    first_seen = out.read().filter(empty).select("site_id").join(
        new_visits.select("site_id").distinct(), "site_id", "left_semi"
    )
    anew = first_seen if changed_sites is None else first_seen.unionByName(changed_sites.select("site_id"))
    with scratch(anew.distinct(), "anew", work) as about:
        own_sites = sites.join(about, sites["id"] == about["site_id"], "left_semi")
        rebuilt = site_visitors(own_sites, visitors.join(about, "site_id", "left_semi"), users, codes)
        rest = new_visits.join(about, "site_id", "left_anti")
        added = site_visits(owned_sites(sites, users, codes), rest)
        n = out.change(added=added, put=rebuilt, about=about, label=label)
    return JobResult("refresh_site_visitors", "done", n)

"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The lead tables are written as parquet first, as the jobs find them in use; making
them is not timed. Each figure is the median of three runs in a warm session.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from leadflow.functions.insights import match_scores
from leadflow.operators import joins, sentiment_model
from leadflow.operators.window import time_counts, window_ends
from leadflow.plans import jobs, queries
from leadflow.plans.inputs import base, view
from leadflow.schemas import table_schema
from leadflow.session import local_session, shared_folder
from leadflow.sinks.keyed import KeyedTable
from leadflow.sinks.state import StateTable

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

TABLES = [
    "entities", "lead_entities_lk", "channel", "match_score_raw", "adopt_curve_raw", "persuasion",
    "relationship_fit", "archetypes", "lcv_level", "days_to_first_sale_level",
    "staging_contacts", "sites", "site_visitors_in", "users", "tracking_codes", "lead_features", "rated",
]


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    tables = shared_folder(spark, "bench-tables")
    for name in TABLES:
        view(spark, SF_DIR, name).write.parquet(f"{tables}/{name}")
    t = {name: spark.read.parquet(f"{tables}/{name}") for name in TABLES}
    insights = {n: t[n] for n in joins.INSIGHT_VALUES if n in t}
    for name, shape in {
        "match_score": queries.match_scores, "adopt_curve": queries.adopt_curve,
    }.items():
        shape(t[f"{name}_raw"]).write.parquet(f"{tables}/{name}")
        insights[name] = spark.read.parquet(f"{tables}/{name}")
    changes = queries._change_files(spark, SF_DIR)

    def lead_profiles():
        noop(joins.profiles(t["entities"], t["lead_entities_lk"], insights))

    def site_visitors():
        names = ["sites", "site_visitors_in", "users", "tracking_codes"]
        noop(joins.site_visitors(*[t[n] for n in names]))

    def incremental_export():
        out = shared_folder(spark, "bench-export")
        checkpoints = StateTable(
            spark, f"{out}/state", table_schema("checkpoint"), ["dag_id", "src_table"], 2
        )
        jobs.export_table(t["staging_contacts"], "staging.contacts", checkpoints, f"{out}/files")

    def cdc_to_lake():
        folder = shared_folder(spark, "bench-lake")
        jobs.cdc_to_lake(
            spark, changes, f"{folder}/lake", f"{folder}/checkpoint", queries.KEYS, queries.CHANGE_SCHEMA
        )

    def match_scores_():
        noop(match_scores(t["match_score_raw"]))

    def lead_scores():
        predictor = queries.logistic_predictor(queries.WEIGHTS, queries.INTERCEPT)
        noop(jobs.lead_scores(t["lead_features"], predictor))

    def status_history():
        noop(queries.status_history(spark, SF_DIR))

    def export_windows():
        counts = time_counts({"staging.contacts": t["staging_contacts"]}, "1970-01-01")
        window_ends(counts, 500)

    leads = t["lead_features"]
    kept = KeyedTable(spark, shared_folder(spark, "bench-keyed"), leads.schema, ["lead_id"], share=100.0)
    kept.append(leads)
    kept.compact()
    some = leads.select("lead_id").orderBy("lead_id").limit(100)

    def keyed_update():
        kept.update(some, lambda old: old.withColumn("processed", F.lit(True)))

    def train_sentiment():
        noop(sentiment_model.train(t["rated"].select("text", "positive")))

    work = {
        "lead_profiles": (lead_profiles, t["lead_entities_lk"].count()),
        "site_visitors": (site_visitors, t["site_visitors_in"].count()),
        "incremental_export": (incremental_export, t["staging_contacts"].count()),
        "cdc_to_lake": (cdc_to_lake, base(spark, SF_DIR, "customer").count()),
        "match_scores": (match_scores_, t["match_score_raw"].count()),
        "lead_scores": (lead_scores, t["lead_features"].count()),
        "status_history": (status_history, base(spark, SF_DIR, "orders").count()),
        "export_windows": (export_windows, t["staging_contacts"].count()),
        "keyed_update": (keyed_update, 100),
        "train_sentiment": (train_sentiment, t["rated"].count()),
    }
    seconds, rates = {}, {}
    for name, (run, rows) in work.items():
        run()
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        rates[name] = round(rows / seconds[name])
    print(json.dumps({
        "metric": "headline_jobs_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "rows_per_sec": rates, "sf": SF_DIR.rstrip("/").split("sf")[-1],
        "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

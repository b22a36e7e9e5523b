"""Lead and contact data jobs on Spark: ingest, export, import, score, serve."""

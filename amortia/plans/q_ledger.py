"""Queries: run ledger state."""

from __future__ import annotations

from pyspark.sql import functions as F

from amortia.operators import ledger
from amortia.plans.catalog import register, standin, with_views
from amortia.sources import sinks


@register("ledger_state", with_views(["ledger_events"], "", """
SELECT version, arg_max(status, (event_time, event_id)) AS status, min(event_time) AS opened_at,
       max(event_time) AS last_event_at, count(*) AS n_events,
       strftime(min(event_time), '%Y%m%d_%H%M%S') AS version_name
FROM ledger_events GROUP BY version"""))
def ledger_state(spark, sf_dir):
    ev = standin(spark, sf_dir).ledger_events
    return ledger.with_version_name(ledger.current_state(ev))


RUNS_CTES = """
ev AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'model' ELSE 'retrain' END AS kind, *,
              CASE WHEN event_id % 2 = 0 THEN CASE status WHEN 'completed' THEN 'passed' ELSE status END ELSE status END AS st,
              'drop_' || CAST(event_id AS VARCHAR) || '.zip' AS file_name FROM ledger_events),
model AS (SELECT version, arg_max(st, (event_time, event_id)) AS model_status, min(event_time) AS created_at
          FROM ev WHERE kind = 'model' GROUP BY version),
run AS (SELECT version, arg_max(st, (event_time, event_id)) AS run_status, min(event_time) AS started_at,
               max(CASE WHEN st IN ('completed', 'failed') THEN event_time END) AS finished_at,
               arg_max(file_name, (event_time, event_id)) AS file_name
        FROM ev WHERE kind = 'retrain' GROUP BY version)"""
RUNS_BODY = """
SELECT model.version, model_status, created_at, run_status, started_at, finished_at, file_name
FROM model LEFT JOIN run USING (version)"""


def _events(spark, sf_dir):
    """Events of the stand-in split into model and run events (even / odd id); model events
    read 'completed' as 'passed'."""
    ev = standin(spark, sf_dir).ledger_events
    is_model = F.col("event_id") % 2 == 0
    return ev.select(F.when(is_model, "model").otherwise("retrain").alias("kind"), "version", "event_time",
                     "event_id",
                     F.when(is_model & (F.col("status") == "completed"), "passed").otherwise(F.col("status")).alias("status"),
                     F.concat(F.lit("drop_"), F.col("event_id").cast("string"), F.lit(".zip")).alias("file_name"))


@register("ledger_runs", with_views(["ledger_events"], RUNS_CTES, RUNS_BODY))
def ledger_runs(spark, sf_dir):
    return ledger.runs_view(_events(spark, sf_dir)).select("version", "model_status", "created_at", "run_status", "started_at",
                                                           "finished_at", "file_name")


@register("ledger_store_runs", with_views(["ledger_events"], RUNS_CTES, RUNS_BODY))
def ledger_store_runs(spark, sf_dir):
    """The same out of the ledger's own store: the events are appended, those of the models once more (a write that was
    repeated after a failure), beside a scoring event; then read back."""
    root = sinks.fresh_path(spark, "ledger")
    ev = _events(spark, sf_dir).select("kind", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"), "version", "event_time",
                                       "status", "file_name", F.lit(0).cast("long").alias("admin_id"), F.lit(None).cast("string").alias("detail"))
    ledger.append_events(ev, root)
    ledger.append_events(ev.filter(F.col("kind") == "model"), root)
    ledger.record_scoring(spark, root, 0, "predictions.csv")
    return ledger.runs_view(ledger.read_events(spark, root)).select("version", "model_status", "created_at", "run_status", "started_at",
                                                                    "finished_at", "file_name")

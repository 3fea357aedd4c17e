"""amortia — loan-level performance analytics written as Spark DataFrame jobs.

Layout:
  sources/    text drops, archives, stand-in fixture views, sinks, state tables
  functions/  column expressions (labels, regions, affordability, credit points)
  operators/  cleaning, profiling, association, features, metrics, fairness, ledger
  plans/      end-to-end jobs (prepared table, scoring, retraining) and the query registry
  streaming/  file-stream scoring with stored feature state
"""

from amortia.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

"""Batch scoring job: score a lap table with a saved scoring context and append the history rows.

    spark-submit pitlane/plans/score_job.py --context DIR --laps PATH --history DIR [--format parquet|csv|table]

The same micro-batch function as the streaming job is used, with one batch for
the whole run: running a run id again replaces its own rows. A model that is
missing disables only its own scorer.
"""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from pitlane.plans.persist import load_context
from pitlane.session import ensure_checkpoint_dir


def score_laps(spark: SparkSession, context_dir: str, laps: DataFrame, history: str, run_id: str) -> dict:
    from pitlane.streaming.lap_stream import score_batch

    loaded = load_context(spark, context_dir)
    ran = score_batch(loaded.context, laps, 0, history, run_id)
    return {"run_id": run_id, "scored": ran, "missing": loaded.missing}


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--context", required=True)
    ap.add_argument("--laps", required=True)
    ap.add_argument("--history", required=True)
    ap.add_argument("--run-id", default=None, help="default: a new one; give one to replace its rows")
    ap.add_argument("--format", default="table", choices=["table", "parquet", "csv"])
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("pitlane-score").getOrCreate()
    ensure_checkpoint_dir(spark)
    from pitlane.sources.laps import read_lap_table, read_laps_csv, read_laps_parquet
    readers = {"table": read_lap_table, "parquet": read_laps_parquet, "csv": read_laps_csv}
    laps = readers[a.format](spark, a.laps)
    print(json.dumps(score_laps(spark, a.context, laps, a.history, a.run_id or uuid.uuid4().hex)))


if __name__ == "__main__":
    main()

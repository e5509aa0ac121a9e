"""Streaming queries: each runs its stream over a whole table and returns what it wrote."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.plans.checks import check
from concord.plans.quality_plans import rounded
from concord.sources.tables import fresh_path
from concord.streaming import jobs

GATE_DAY = dt.date(2024, 1, 15)

# Folders of the kept tables; more for larger ones.
STREAM_BUCKETS = 8

DOMAIN = """CASE user_id % 6 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN 'provider' WHEN 2 THEN 'SUPPLIER' WHEN 3 THEN 'Product'
  WHEN 4 THEN 'PATIENT' ELSE 'LOCATION' END"""
SOURCE = """CASE user_id % 7 WHEN 0 THEN 'Epic' WHEN 1 THEN 'CRM' WHEN 2 THEN 'LegacyFlatFile' WHEN 3 THEN 'ERP' ELSE NULL END"""


def _events(spark: SparkSession, sf: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return jobs.table_stream(spark, f"{sf}/events.parquet")


def _feedback(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "stream_feedback")
    rows = _events(spark, sf).selectExpr(
        "concat('exp_', user_id) AS explanation_id", "concat('fb_', event_id) AS feedback_id", "ts AS feedback_at",
        "event_type AS steward_decision")
    jobs.finished(jobs.keep_newest_feedback(rows, f"{path}/data", f"{path}/checkpoint", STREAM_BUCKETS))
    return jobs.kept(spark, f"{path}/data")


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """Runs to the end of the table; days the watermark has not passed yet count with what has come."""
    path = fresh_path(spark, "stream_daily")
    rows = _events(spark, sf).selectExpr(
        "ts AS created_at", f"{DOMAIN} AS domain", "concat('C', event_id) AS record_id", "least(value, 100D) AS record_score")
    jobs.finished(jobs.keep_daily(jobs.daily_scores(rows), f"{path}/data", f"{path}/checkpoint", STREAM_BUCKETS))
    return rounded(jobs.kept(spark, f"{path}/data")).drop("records_sketch", "approx_records")


def _gate(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "stream_gate")
    rows = _events(spark, sf).selectExpr(
        "event_id", f"upper({DOMAIN}) AS domain", f"{SOURCE} AS source_system", "event_type AS first_name",
        "CASE event_id % 9 WHEN 0 THEN NULL ELSE 'Knight' END AS last_name", "date_format(ts, 'yyyy-MM-dd') AS dob",
        "concat(event_type, '@acme.com') AS email", "props AS address")
    jobs.finished(jobs.gate_stream(rows, f"{path}/data", f"{path}/checkpoint", GATE_DAY))
    return spark.read.parquet(f"{path}/data").select(
        "event_id", "domain", F.array_join("issues", "; ").alias("issues"), "stage_gate_status", "governance_risk_score")


def _append(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "stream_log")
    rows = _events(spark, sf).withColumnRenamed("event_id", "feedback_id").withColumn("unknown_field", F.lit("x"))
    jobs.finished(jobs.append_stream(rows, f"{path}/data", f"{path}/checkpoint", ["feedback_id", "ts", "user_id"]))
    return spark.read.parquet(f"{path}/data")


QUERIES = {
    "stream_feedback_latest": _feedback,
    "stream_dq_daily": _daily,
    "stream_stage_gate": _gate,
    "stream_append_log": _append,
}

CHECKS = {
    "stream_feedback_latest": """SELECT 'exp_' || user_id AS explanation_id, 'fb_' || event_id AS feedback_id, ts AS feedback_at, event_type AS steward_decision
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, 'fb_' || event_id DESC) = 1""",
    "stream_dq_daily": f"""SELECT CAST(ts AS DATE) AS metric_date, upper({DOMAIN}) AS domain, count(*) AS total_records, round(avg(least(value, 100)), 6) AS avg_record_score,
      round(min(least(value, 100)), 6) AS min_record_score, round(max(least(value, 100)), 6) AS max_record_score, count(*) FILTER (least(value, 100) < 80) AS records_below_threshold
      FROM events GROUP BY 1, 2""",
    "stream_stage_gate": check([], f"""WITH g AS (SELECT event_id, upper({DOMAIN}) AS domain, coalesce({SOURCE}, 'None') AS src, lower(trim(event_type)) AS fn, event_id % 9 = 0 AS no_last FROM events),
      i AS (SELECT *, list_filter([CASE WHEN no_last THEN 'Missing last_name' END, CASE WHEN src NOT IN ('ERP', 'CRM', 'MDM', 'Epic', 'Cerner') THEN 'Unauthorized source system: ' || src END,
        CASE WHEN fn IN ('test', 'dummy', 'fake', 'unknown', 'na', 'n/a') THEN 'Test or dummy first_name detected' END, 'Underage patient detected',
        CASE WHEN src = 'LegacyFlatFile' THEN 'Restricted source system: LegacyFlatFile' END], lambda x: x IS NOT NULL) AS iss FROM g)
      SELECT event_id, domain, array_to_string(iss, '; ') AS issues, CASE WHEN len(iss) <= 2 THEN 'REVIEW' ELSE 'FAIL' END AS stage_gate_status,
        CAST(least(100, list_sum(list_transform(iss, lambda x: CASE WHEN contains(x, 'Missing') THEN 10 WHEN contains(x, 'Restricted') THEN 30 WHEN contains(x, 'Underage') THEN 40
          WHEN contains(x, 'dummy') THEN 25 ELSE 10 END))) AS INTEGER) AS governance_risk_score FROM i"""),
    "stream_append_log": "SELECT event_id AS feedback_id, ts, user_id FROM events",
}

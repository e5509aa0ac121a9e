"""Governance views over the data-set registry, its certifications and the policy tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.ladders import ratio, yes_no
from concord.functions.text import col_or_null, has_text


def latest_certification(history: DataFrame) -> DataFrame:
    """Newest certification event per data set, prefixed ``lc_``; equal times go by sequence."""
    order = [F.col("event_timestamp").desc()]
    order += [F.col(c).desc() for c in history.columns if c == "event_seq"]
    order += [F.col(c).desc() for c in history.columns if c not in ("dataset_id", "event_timestamp", "event_seq")]
    w = Window.partitionBy("dataset_id").orderBy(*order)
    latest = history.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    text = lambda c: col_or_null(history, c)
    return latest.select(
        "dataset_id",
        F.col("new_lifecycle_stage").alias("lc_lifecycle_stage"),
        F.col("new_certification_status").alias("lc_certification_status"),
        text("new_certification_tier").alias("lc_certification_tier"),
        F.col("new_dq_score").alias("lc_dq_score"),
        F.col("new_pass_fail_status").alias("lc_pass_fail_status"),
        F.col("lineage_complete").alias("lc_lineage_complete"),
        col_or_null(history, "provenance_complete", "boolean").alias("lc_provenance_complete"),
        F.col("certified_for_use").alias("lc_certified_for_use"),
        F.col("approved_by").alias("lc_approved_by"),
        text("pod_owner").alias("lc_pod_owner"),
        F.col("event_timestamp").alias("lc_event_timestamp"),
    )


def check_summary(checks: DataFrame) -> DataFrame:
    status, severity = F.upper("status"), F.upper("severity")
    return checks.groupBy("dataset_id").agg(
        F.count("*").alias("total_checks"),
        F.count_if(status == "PASS").alias("passed_checks"),
        F.count_if(status == "FAIL").alias("failed_checks"),
        F.count_if(severity == "CRITICAL").alias("critical_findings"),
        F.count_if(severity == "HIGH").alias("high_findings"),
        F.max("checked_at").alias("last_checked_at"),
    )


def dataset_detail(fair: DataFrame, history: DataFrame, checks: DataFrame) -> DataFrame:
    """Registry row with FAIR score, newest certification and check counts, with defaults for what is missing.

    ``fair`` is the scored registry: the score is a function of the registry row, so it
    needs no join of its own. All three inputs are partitioned by ``dataset_id`` once.
    """
    joined = fair.join(latest_certification(history), "dataset_id", "left").join(
        check_summary(checks), "dataset_id", "left"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    default = lambda c, value: F.coalesce(F.col(f"lc_{c}"), F.lit(value)).alias(c)
    return joined.select(
        "dataset_id", "dataset_name", "domain", "data_owner", "steward_name",
        col_or_null(fair, "source_system").alias("source_system"),
        default("lifecycle_stage", "PRODUCTION"),
        F.coalesce("lc_certification_status", "certification_status").alias("certification_status"),
        default("certification_tier", "ENTERPRISE_READY"),
        F.coalesce("lc_dq_score", "dq_score").alias("dq_score"),
        default("pass_fail_status", "PASS"),
        default("lineage_complete", True),
        default("provenance_complete", True),
        default("certified_for_use", True),
        default("approved_by", "governance_admin"),
        default("pod_owner", "Governance"),
        F.col("lc_event_timestamp").alias("last_certification_event_at"),
        zero("total_checks"), zero("passed_checks"), zero("failed_checks"), zero("fair_overall_score"),
        F.round(ratio(F.col("passed_checks"), F.col("total_checks")) * 100, 2).alias("certification_readiness_score"),
        zero("critical_findings"), zero("high_findings"), "last_checked_at",
    )


def top_blockers(detail: DataFrame) -> DataFrame:
    failed, critical, high = (F.col(c) > 0 for c in ("failed_checks", "critical_findings", "high_findings"))
    unready, unfair = F.col("certification_readiness_score") < 90, F.col("fair_overall_score") < 80
    reason = (
        F.when(failed, "FAILED_CERTIFICATION_CHECKS").when(critical, "CRITICAL_FINDINGS").when(high, "HIGH_FINDINGS")
        .when(unready, "READINESS_BELOW_THRESHOLD").when(unfair, "FAIR_SCORE_BELOW_THRESHOLD").otherwise("NO_BLOCKER")
    )
    severity = (
        F.when(critical, "CRITICAL").when(failed | high, "HIGH").when(unready, "MEDIUM").when(unfair, "LOW")
        .otherwise("NONE")
    )
    return (
        detail.where(failed | critical | high | unready | unfair)
        .select(reason.alias("blocker_reason"), severity.alias("blocker_severity"))
        .groupBy("blocker_reason", "blocker_severity").agg(F.count("*").alias("blocker_count"))
    )


def kpis(
    readiness: DataFrame, history: DataFrame, checks: DataFrame, policies: DataFrame, changes: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """One row of key figures over the scored registry. The three side summaries are one row each."""
    base = readiness.select(
        "dataset_id", "certification_status", "fair_overall_score", "ready_for_certification", "certification_blocker_reason"
    ).join(latest_certification(history).select("dataset_id", "lc_certification_status"), "dataset_id", "left")
    status = F.upper(F.coalesce("lc_certification_status", "certification_status", F.lit("")))
    ready = F.coalesce("ready_for_certification", F.lit(False))
    main = base.agg(
        F.count("*").alias("total_datasets"),
        F.count_if(status == "CERTIFIED").alias("certified_datasets"),
        F.count_if(ready).alias("ready_for_certification"),
        F.count_if(status.isin("IN_PROGRESS", "PENDING")).alias("in_progress_certifications"),
        F.round(F.avg(F.coalesce("fair_overall_score", F.lit(0.0))), 2).alias("avg_fair_score"),
        F.count_if(~ready & has_text(F.col("certification_blocker_reason"))).alias("open_governance_issues"),
    )
    st = F.upper("status")
    check_row = checks.agg(
        F.count("*").alias("total_checks"), F.count_if(st == "PASS").alias("passed_checks"),
        F.count_if(st == "FAIL").alias("failed_checks"),
    )
    policy_row = policies.agg(F.count_if(yes_no(F.col("active_flag")) == "Y").alias("active_policies"))
    since = F.lit(as_of.date() - dt.timedelta(days=30))
    change_row = changes.where(F.to_date("changed_at") >= since).agg(F.count("*").alias("recent_policy_changes_30d"))
    out = main
    for row in (check_row, policy_row, change_row):
        out = out.crossJoin(F.broadcast(row))
    return out.withColumn(
        "check_pass_rate", F.round(ratio(F.col("passed_checks"), F.col("total_checks")) * 100, 2)
    )


def policy_activity(changes: DataFrame, policies: DataFrame) -> DataFrame:
    names = policies.select("domain", "policy_version", "policy_name")
    return changes.join(names, ["domain", "policy_version"], "left").select(
        "change_id", "domain", "policy_version", "policy_name", "change_type",
        F.col("changed_field").alias("changed_object"), F.col("requested_by").alias("changed_by"), "changed_at",
        F.col("change_status").alias("publish_status"),
    )


def worst_datasets(detail: DataFrame, limit: int = 200) -> DataFrame:
    return detail.orderBy(
        F.coalesce("certification_readiness_score", F.lit(0.0)), F.col("failed_checks").desc(),
        F.coalesce("fair_overall_score", F.lit(0.0)), "dataset_id",
    ).limit(limit)


def first_blockers(blockers: DataFrame, limit: int = 10) -> DataFrame:
    return blockers.orderBy(F.col("blocker_count").desc(), "blocker_reason", "blocker_severity").limit(limit)


def recent_activity(activity: DataFrame, as_of: dt.datetime, days: int = 30, limit: int = 20) -> DataFrame:
    """Newest policy changes of the last days; undated changes stay in and come last."""
    since = F.lit(as_of.date() - dt.timedelta(days=days))
    kept = activity.where((F.to_date("changed_at") >= since) | F.col("changed_at").isNull())
    return kept.orderBy(F.col("changed_at").desc_nulls_last(), "change_id").limit(limit)

"""Reviewer feedback: latest per explanation, new feedback rows and the fold-back into explanations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.ladders import yes_no
from concord.functions.text import col_or_null
from concord.sources.tables import for_schema, upsert

FEEDBACK_COLUMNS = (
    "feedback_id", "decision_id", "request_id", "audit_packet_id", "domain", "policy_version", "explanation_id",
    "steward_user", "steward_decision", "steward_override_flag", "override_reason_code", "override_reason_note",
    "feedback_at", "submitted_at",
)


def feedback_time(df: DataFrame, as_of: dt.datetime | None = None) -> Column:
    """When feedback was given, by whichever column the log has."""
    for name in ("feedback_at", "submitted_at"):
        if name in df.columns:
            return F.col(name).cast("timestamp")
    return F.lit(as_of).cast("timestamp")


def recommended_action(df: DataFrame) -> Column:
    """The final recommendation where the log has one, else the first."""
    if "final_recommended_action" in df.columns:
        return F.coalesce("final_recommended_action", "recommended_action")
    return F.col("recommended_action")


def newest(df: DataFrame, key: str, time: Column) -> DataFrame:
    """Newest row per key, ties by the remaining columns so that reruns agree.

    The rank filter runs on the map side too, so at most one row per key and input
    partition is shuffled, however many rows one key has.
    """
    ties = [F.col(c).desc() for c in df.columns if c != key]
    w = Window.partitionBy(key).orderBy(time.desc(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_feedback(feedback: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    time = feedback_time(feedback)
    if since is not None:
        feedback = feedback.where(time >= F.lit(since))
    return newest(feedback, "explanation_id", time)


def _made_id(prefix: str, *parts: str) -> Column:
    """Stable id: the same input row always gets the same one."""
    key = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(key, 256), 1, 12))


def feedback_events(requests: DataFrame, explanations: DataFrame, log_columns=FEEDBACK_COLUMNS) -> DataFrame:
    """Rows to append to the feedback log.

    A decision that differs from the newest logged recommendation is an override. Requests
    for an unknown explanation, or one without a recommendation, are refused.
    """
    logged = explanations.select("explanation_id", "created_at", recommended_action(explanations).alias("recommended"))
    logged = newest(logged, "explanation_id", F.col("created_at")).where("recommended IS NOT NULL").drop("created_at")
    rows = requests.join(logged, "explanation_id")
    text = lambda c: col_or_null(requests, c).alias(c)
    time = feedback_time(requests)
    agrees = F.col("steward_decision").eqNullSafe(F.col("recommended"))
    named = ("explanation_id", "steward_user", "steward_decision", "_at")
    out = rows.withColumn("_at", time).select(
        _made_id("fb_", *named, *(["feedback_id"] if "feedback_id" in requests.columns else [])).alias("feedback_id"),
        _made_id("dec_", *named).alias("decision_id"),
        text("request_id"), text("audit_packet_id"), text("domain"), text("policy_version"),
        "explanation_id", "steward_user", "steward_decision",
        F.when(agrees, "N").otherwise("Y").alias("steward_override_flag"),
        text("override_reason_code"), text("override_reason_note"),
        F.col("_at").alias("feedback_at"), F.col("_at").alias("submitted_at"),
    )
    return for_schema(out, log_columns)


def apply_feedback(explanations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Explanation rows with the newest feedback folded in; ids already present are kept."""
    changes = latest_feedback(feedback)
    steward = ("steward_decision", "override_reason_code", "override_reason_note", "steward_user", "decision_id")
    kept = ("request_id", "domain", "policy_version", "audit_packet_id")
    target = explanations
    for name in (*steward, "steward_override_flag", *kept):
        if name not in target.columns:
            target = target.withColumn(name, F.lit(None).cast("string"))
    if "feedback_at" not in target.columns:
        target = target.withColumn("feedback_at", F.lit(None).cast("timestamp"))
    flag = yes_no(F.col("steward_override_flag")) if "steward_override_flag" in changes.columns else F.lit(None)
    source = changes.select(
        "explanation_id", *[col_or_null(changes, c).alias(c) for c in (*steward, *kept)],
        flag.alias("steward_override_flag"), feedback_time(changes).alias("feedback_at"),
    )
    update = {c: F.col(f"s.{c}") for c in (*steward, "steward_override_flag", "feedback_at")}
    update |= {c: F.coalesce(f"t.{c}", f"s.{c}") for c in kept}
    return upsert(target, source, ["explanation_id"], update, {})

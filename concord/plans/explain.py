"""The whole path of a pair: policy, past cases, signals, score, confidence, evidence and log row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import VALID_DECISIONS, VALID_RISK_FLAGS
from concord.functions.similarity import sequence_ratio
from concord.functions.text import col_or_null
from concord.operators import address as ad
from concord.operators import confidence as co
from concord.operators import learning as le
from concord.operators import policy as po
from concord.operators.scoring import score_pairs
from concord.operators.signals import pair_signals
from concord.sources.tables import for_schema

ADDRESS_FIELDS = {"PROVIDER": "provider_address", "SUPPLIER": "supplier_address", "PATIENT": "patient_address"}

LOG_COLUMNS = (
    "explanation_id", "request_id", "audit_packet_id", "domain", "policy_version", "record_a_id", "record_b_id",
    "record_a_source_system", "record_b_source_system", "match_score", "triggered_rules", "ai_decision", "ai_confidence",
    "risk_flag", "recommended_action", "final_recommended_action", "automation_readiness_score",
    "automation_readiness_label", "automation_policy_status", "estimated_false_positive_risk", "composite_risk_score",
    "composite_risk_band", "primary_risk_driver", "decision_confidence_score", "automation_tier", "primary_signal",
    "steward_decision", "steward_user", "steward_override_flag", "feedback_at", "created_at", "policy_hash", "requested_by", "context_id",
    "steward_override_reason", "model_provider", "model_version", "prompt_version", "feature_schema_version",
)
# Columns of the log that name the model and the versions of what it was asked with.
MODEL_COLUMNS = ("model_provider", "model_version", "prompt_version", "feature_schema_version")


def _with_addresses(df: DataFrame) -> DataFrame:
    """Both sides' parsed addresses, their comparison and text similarity."""
    for s in ("a", "b"):
        picked = F
        for domain, name in ADDRESS_FIELDS.items():
            picked = picked.when(F.col("domain") == domain, col_or_null(df, f"{s}_{name}"))
        df = df.withColumn(f"{s}_addr_given", picked.otherwise(col_or_null(df, f"{s}_address")))
        df = ad.validate(df, f"{s}_addr_given", f"{s}_addr_")
    df = ad.compare(df, "a_addr_", "b_addr_")
    std = lambda s: F.upper(f"{s}_addr_standardized_address")
    both = std("a").isNotNull() & std("b").isNotNull()
    return df.withColumn("address_similarity_score", F.when(both, sequence_ratio(std("a"), std("b"))).otherwise(0.0))


def match_explain(
    pairs: DataFrame, configs: DataFrame, thresholds: DataFrame, rules: DataFrame, history: DataFrame,
    as_of: dt.datetime, payloads: DataFrame | None = None, trust: dict[str, float] | None = None,
    weights: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """Explained pairs. ``history`` is :func:`learning.decided`.

    ``payloads`` holds checked model answers (:func:`payload.normalize_payload`) by ``pair_id``. An answer's action and risk flag
    count where the policy gives none; a pair without a readable answer falls back to review and medium risk.

    ``trust`` and ``weights`` put a policy's own source trust and signal weights in place of the published ones.

    Pairs meet the logs and policies only through small aggregated tables, so the pairs
    themselves are not shuffled while those stay small.
    """
    df = le.override_counts(pairs, history)
    df = po.with_policy(df, configs, thresholds, as_of)
    df = po.policy_decision(po.rule_summary(po.matched_risk_rules(df, rules, as_of)))
    if payloads is not None:
        said = payloads.select(
            "pair_id", "ai_decision", F.col("confidence").alias("ai_confidence"), "explanation_summary", "rule_analysis",
            F.col("recommended_action").alias("_said_action"), F.col("risk_flag").alias("_said_flag"))
        df = df.join(said, "pair_id", "left")
    else:
        df = df.withColumns({
            "ai_confidence": F.lit(None).cast("double"), **{c: F.lit(None).cast("string") for c in ("ai_decision", "_said_action", "_said_flag")}})
    valid = lambda c, allowed, said, other: F.when(c.isin(*allowed), c).when(F.col(said).isin(*allowed), F.col(said)).otherwise(other)
    df = df.withColumns({
        "override_rate": F.col("override_rate_estimate"),
        "recommended_action": valid(F.upper(F.trim("recommendation")), VALID_DECISIONS, "_said_action", "REVIEW_REQUIRED"),
        "risk_flag": valid(F.upper(F.trim("highest_risk_level")), VALID_RISK_FLAGS, "_said_flag", "MEDIUM"),
        "learning_context": le.learning_context(),
        "threshold_guidance": po.threshold_guidance(df),
        "risk_rule_guidance": po.risk_rule_guidance(),
    })
    df = score_pairs(pair_signals(_with_addresses(df), trust))
    df = co.automation_readiness(co.decision_confidence(df, weights))
    df = co.with_signal_packets(df, weights)
    df = df.withColumn("evidence_timeline", co.evidence_timeline(df))
    df = df.withColumn("entity_resolution_summary", co.entity_summary())
    df = co.add_member_id_rule(df).drop("_said_action", "_said_flag")
    return df.withColumns({
        "explanation_id": F.concat(F.lit("exp_"), F.substring(F.sha2("pair_id", 256), 1, 12)),
        "match_score": F.round("entity_score", 2),
        "record_a_id": F.coalesce(col_or_null(df, "a_member_id"), F.lit("")),
        "record_b_id": F.coalesce(col_or_null(df, "b_member_id"), F.lit("")),
        "record_a_source_system": F.coalesce(col_or_null(df, "a_source_system"), F.lit("")),
        "record_b_source_system": F.coalesce(col_or_null(df, "b_source_system"), F.lit("")),
    })


def explanation_log(
    explained: DataFrame, as_of: dt.datetime, columns=LOG_COLUMNS, model: Mapping[str, str] | None = None,
) -> DataFrame:
    """Log rows of explained pairs, reduced to the columns the log has; review fields start empty.

    ``requested_by`` and ``context_id`` come from the pairs where they have them; ``model`` names what MODEL_COLUMNS say.
    """
    made = lambda prefix: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(prefix), F.col("explanation_id")), 256), 1, 12))
    empty = {c: F.lit(None).cast("string") for c in (
        "steward_decision", "steward_user", "steward_override_flag", "steward_override_reason", "policy_hash")}
    rows = explained.withColumns({
        **empty, "feedback_at": F.lit(None).cast("timestamp"), "created_at": F.lit(as_of),
        "request_id": F.coalesce(F.nullif(col_or_null(explained, "request_id"), F.lit("")), made("req_")),
        "audit_packet_id": made("aud_"),
        **{c: col_or_null(explained, c) for c in ("requested_by", "context_id")},
        **{c: F.lit((model or {}).get(c)).cast("string") for c in MODEL_COLUMNS},
    })
    return for_schema(rows.select(*[c for c in LOG_COLUMNS if c in rows.columns]), columns)

"""Governance tickets for explained pairs that need one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import col_or_null, or_else, titled

# Drivers that always need a ticket.
HIGH_RISK_DRIVERS = (
    "NPI_REUSE_DETECTED", "IDENTIFIER_COLLISION", "CROSS_SYSTEM_IDENTITY_COLLISION", "REGISTRY_TRUST_DEGRADED",
    "DEA_CONFLICT", "POLICY_EXCEPTION", "GOVERNANCE_POLICY_REQUIRED",
)
ACTION_REQUIRED = (
    "Governance Action Required: This workflow was created due to a high-risk or policy-governed condition. It is "
    "independent of the AI confidence score. Please review the AI decision, validate the identity evidence, and confirm "
    "whether this case should be approved, rejected, merged, unmerged, or escalated for policy review."
)
REFUSALS = ("BLOCK_MERGE", "REJECT_MERGE")


def governance_tickets(explained: DataFrame, label: str = "data-governance") -> DataFrame:
    """Summary, description and labels of each pair that is risky, refused or badly automatable."""
    text = lambda c: col_or_null(explained, c)
    flag, decision = (F.upper(F.coalesce(text(c), F.lit(""))) for c in ("risk_flag", "ai_decision"))
    action = or_else(text("final_recommended_action"), text("recommended_action"))
    driver = or_else(text("primary_risk_driver"), text("primary_signal"))
    acted, driven = F.upper(F.coalesce(action, F.lit(""))), F.upper(F.coalesce(driver, F.lit("UNKNOWN")))
    ready = text("automation_readiness_score").try_cast("int")
    needed = (
        flag.isin("HIGH", "SEVERE", "CRITICAL") | acted.isin(*REFUSALS) | decision.isin(*REFUSALS)
        | driven.isin(*HIGH_RISK_DRIVERS) | F.coalesce(ready < 50, F.lit(False))
    )
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), shown(c))
    def record(side: str) -> list[Column]:
        """The fields of one record as JSON, where the pair carries them."""
        fields = [c for c in explained.columns if c.startswith(f"{side}_") and not c.startswith(f"{side}_addr_")]
        named = F.to_json(F.struct(*[F.col(c).alias(c[2:]) for c in fields])) if fields else None
        return [F.concat(F.lit(f"Record {side.upper()}: "), named)] if fields else []

    described = F.concat_ws(
        "\n",
        line("Explanation ID", text("explanation_id")), line("Request ID", text("request_id")), line("Domain", text("domain")),
        line("Policy Version", text("policy_version")), line("AI Decision", text("ai_decision")),
        line("Recommended Action", action), line("Confidence", col_or_null(explained, "ai_confidence", "double")),
        line("Risk Flag", text("risk_flag")), line("Automation Readiness Score", text("automation_readiness_score")),
        line("Primary Risk Driver", driver),
        F.concat(F.lit("Explanation Summary: "), F.coalesce(text("explanation_summary"), F.lit("No summary provided."))),
        *record("a"), *record("b"), F.lit(ACTION_REQUIRED),
    )
    summary = F.concat(
        F.lit("Governance Review Required: "), titled(driven), F.lit(" ("),
        F.coalesce(F.nullif(flag, F.lit("")), F.lit("UNKNOWN")), F.lit(" Risk / "),
        F.coalesce(F.nullif(titled(acted), F.lit("")), F.lit("Review")), F.lit(")"))
    return explained.where(needed).select(
        *[F.col(c) for c in ("pair_id", "explanation_id") if c in explained.columns],
        summary.alias("summary"), described.alias("description"),
        F.array(F.lit(label), F.lit("governance-review"), F.replace(F.lower(driven), F.lit("_"), F.lit("-"))).alias("labels"),
    )

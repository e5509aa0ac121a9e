"""FAIR scores of registered data sets and their readiness for certification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.ladders import ladder
from concord.functions.text import has_text

OPEN_STATES = ("NOT_STARTED", "IN_REVIEW", "RECERT_REQUIRED")


def _points(test: Column, points: int) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def _either(name: str, best: str, points: int, second: str, fewer: int) -> Column:
    v = F.upper(F.coalesce(F.col(name), F.lit("")))
    return F.when(v == best, F.lit(points)).when(v == second, F.lit(fewer)).otherwise(F.lit(0))


def fair_score(registry: DataFrame) -> DataFrame:
    """Four scores of 0 to 100, their mean to one digit and a maturity band."""
    text = lambda c, p: _points(has_text(F.col(c)), p)
    flag = lambda c, p: _points(F.col(c), p)
    parts = {
        "fair_findable_score": text("dataset_name", 25) + text("business_definition", 25)
        + text("glossary_link", 25) + flag("metadata_complete", 25),
        "fair_accessible_score": flag("certified_for_use", 30) + text("data_classification", 20)
        + text("data_owner", 25) + text("steward_name", 25),
        "fair_interoperable_score": _either("cdl_status", "CONFORMANT", 35, "PARTIAL", 15)
        + _either("cdm_status", "CONFORMANT", 35, "PARTIAL", 15) + text("source_table", 15) + text("target_table", 15),
        "fair_reusable_score": _either("certification_status", "CERTIFIED", 25, "IN_REVIEW", 10)
        + flag("lineage_complete", 20) + flag("provenance_complete", 20) + text("evidence_link", 15)
        + text("use_case_context", 10) + text("version_number", 10),
    }
    # The registry keeps an overall score of its own; the computed one replaces it.
    scored = registry.drop("fair_overall_score").withColumns({k: v.cast("bigint") for k, v in parts.items()})
    total = sum((F.col(k) for k in parts), F.lit(0)).cast("double")
    scored = scored.withColumn("fair_overall_score", F.round(total / 4, 1))
    band = ladder(F.col("fair_overall_score"), [(90, "STRONG"), (75, "STABLE"), (60, "MODERATE")], "AT_RISK")
    return scored.withColumn("fair_maturity_band", band)


def latest_summary(summary: DataFrame) -> DataFrame:
    """Newest daily summary per domain."""
    key = F.upper("domain")
    w = Window.partitionBy(key).orderBy(F.col("metric_date").desc(), F.col("created_at").desc())
    return (
        summary.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "created_at")
        .withColumn("domain", key).withColumnRenamed("metric_date", "dq_metric_date")
    )


def certification_readiness(fair: DataFrame, summary: DataFrame) -> DataFrame:
    """FAIR scores beside the newest daily summary, with blocker, band and a score in steps of 20."""
    base = fair.withColumn("domain", F.upper("domain")).withColumnRenamed("dq_score", "registry_dq_score")
    base = base.join(latest_summary(summary), "domain", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    dq_ok = F.coalesce("registry_dq_score", F.lit(0.0)) >= F.coalesce("dq_threshold", F.lit(95.0))
    fair_at = lambda floor: F.coalesce("fair_overall_score", F.lit(0.0)) >= floor
    status = F.upper(F.coalesce("certification_status", F.lit("")))
    sound = yes("metadata_complete") & yes("lineage_complete") & yes("provenance_complete") & dq_ok
    return base.withColumns(
        {
            "ready_for_certification": sound & fair_at(75) & status.isin(*OPEN_STATES),
            "certification_blocker_reason": F.when(~yes("metadata_complete"), "METADATA_INCOMPLETE")
            .when(~yes("lineage_complete"), "LINEAGE_INCOMPLETE")
            .when(~yes("provenance_complete"), "PROVENANCE_INCOMPLETE")
            .when(~dq_ok, "DQ_BELOW_THRESHOLD")
            .when(~fair_at(75), "FAIR_SCORE_TOO_LOW")
            .when(status == "CERTIFIED", "ALREADY_CERTIFIED")
            .when(status == "REJECTED", "CERTIFICATION_REJECTED")
            .when(status == "EXPIRED", "CERTIFICATION_EXPIRED")
            .otherwise("READY"),
            "certification_readiness_band": F.when(sound & fair_at(90), "HIGH").when(sound & fair_at(75), "MEDIUM")
            .otherwise("LOW"),
            "certification_readiness_score": sum(
                (_points(t, 20) for t in (F.col("metadata_complete"), F.col("lineage_complete"),
                                          F.col("provenance_complete"), dq_ok, fair_at(75))),
                F.lit(0),
            ).cast("double"),
        }
    )


def datasets_ready(registry: DataFrame) -> DataFrame:
    """Data sets that meet every certification condition; an unknown value never passes."""
    return registry.where(
        F.col("lifecycle_stage").isin("CURATION", "CERTIFICATION")
        & (F.col("dq_score") >= F.col("dq_threshold"))
        & F.col("lineage_complete") & F.col("provenance_complete") & F.col("metadata_complete")
        & F.col("certification_status").isin(*OPEN_STATES)
    ).select(
        "dataset_id", "dataset_name", "domain", "lifecycle_stage", "dq_score", "dq_threshold", "lineage_complete",
        "provenance_complete", "metadata_complete", "fair_overall_score", "pass_fail_status", "certification_status",
        *(["recertification_due_at"] if "recertification_due_at" in registry.columns else []),
    )

"""Daily data-quality metrics per domain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.ladders import DOMAINS, ratio

DAY_DOMAIN = ("metric_date", "domain")
BELOW = 80

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
CATEGORIES = ("VALIDITY", "COMPLETENESS", "STANDARDIZATION", "UNIQUENESS", "CONSISTENCY")
FINDING_STATES = ("OPEN", "ACCEPTED", "RESOLVED", "WAIVED")
ADVICE_STATES = ("OPEN", "ACCEPTED", "REJECTED", "IMPLEMENTED")
PRIORITIES = ("HIGH", "MEDIUM", "LOW")
COMPONENTS = ("completeness", "validity", "standardization", "consistency", "uniqueness")

# Columns of the daily summary table, in order.
SUMMARY_COLUMNS = (
    "metric_date", "domain", "total_records", "avg_record_score", "records_below_threshold",
    "total_findings", "critical_findings", "high_findings", "medium_findings", "low_findings",
    "total_rules_executed", "failed_rule_count", "duplicate_record_count", "records_flagged_by_ai",
    "ai_recommendations_generated", "steward_actions_taken", "automated_fixes_applied",
    "dq_health_score", "dq_risk_score", "automation_readiness_score",
)


def _keyed(df: DataFrame, days: tuple[dt.date, dt.date] | None, *cols: Column) -> DataFrame:
    """Day and upper-cased domain computed before grouping; an optional day range reaches the scan."""
    if days is not None:
        first, last = days
        start = dt.datetime.combine(first, dt.time())
        end = dt.datetime.combine(last + dt.timedelta(days=1), dt.time())
        df = df.where((F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))
    return df.select(F.to_date("created_at").alias("metric_date"), F.upper("domain").alias("domain"), *cols)


def _is(name: str, value: str) -> Column:
    return F.upper(name) == value


def record_scores(scores: DataFrame, days=None) -> DataFrame:
    s = F.col("record_score")
    base = _keyed(scores, days, s, *[F.col(f"{c}_score") for c in COMPONENTS])
    out = base.groupBy(*DAY_DOMAIN).agg(
        F.count("*").alias("total_records"),
        F.avg(s).alias("avg_record_score"),
        F.count_if(s < BELOW).alias("records_below_threshold"),
        *[F.avg(f"{c}_score").alias(f"avg_{c}_score") for c in COMPONENTS],
        F.min(s).alias("min_record_score"),
        F.max(s).alias("max_record_score"),
        F.count_if(s < 50).alias("very_low_score_count"),
        F.count_if((s >= 50) & (s < 70)).alias("low_score_count"),
        F.count_if((s >= 70) & (s < 90)).alias("medium_score_count"),
        F.count_if(s >= 90).alias("high_score_count"),
    )
    return out.withColumn(
        "records_below_threshold_rate", ratio(F.col("records_below_threshold"), F.col("total_records"))
    ).withColumn("scored_record_count", F.col("total_records"))


def findings(rows: DataFrame, days=None) -> DataFrame:
    """Finding counts with eleven distinct counts and no row expansion.

    The rule counts come from a first pass per rule, which also carries the plain
    counts; distinct records come from a second narrow pass. Both passes combine
    on the map side, so a day and domain that holds most rows stays cheap.
    """
    base = _keyed(
        rows, days, F.col("rule_id"), F.col("rule_weight"),
        F.upper("severity").alias("severity"), F.upper("status").alias("status"),
        F.upper("rule_category").alias("category"), F.upper("rule_type").alias("rule_type"),
    )
    per_rule = base.groupBy(*DAY_DOMAIN, "rule_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("severity") == v).alias(f"sev_{v}") for v in SEVERITIES],
        *[F.count_if(F.col("status") == v).alias(f"st_{v}") for v in FINDING_STATES],
        *[F.count_if(F.col("category") == v).alias(f"cat_{v}") for v in CATEGORIES],
        F.count_if(F.col("rule_type") == "DUPLICATE").alias("dup"),
        F.sum("rule_weight").alias("weight"),
        F.count("rule_weight").alias("weighted"),
    )
    rules_with = lambda c: F.count_if((F.col(c) > 0) & F.col("rule_id").isNotNull())
    counts = per_rule.groupBy(*DAY_DOMAIN).agg(
        F.sum("n").alias("total_findings"),
        *[F.sum(f"sev_{v}").alias(f"{v.lower()}_findings") for v in SEVERITIES],
        *[F.sum(f"st_{v}").alias(f"{v.lower()}_findings_count") for v in FINDING_STATES],
        F.count("rule_id").alias("failed_rule_count"),
        F.sum("dup").alias("duplicate_record_count"),
        *[rules_with(f"sev_{v}").alias(f"configured_{v.lower()}_rules") for v in SEVERITIES],
        *[rules_with(f"cat_{v}").alias(f"{v.lower()}_rule_count") for v in CATEGORIES],
        ratio(F.sum("weight"), F.sum("weighted")).alias("avg_rule_weight"),
    )
    records = (
        _keyed(rows, days, F.col("record_id")).where(F.col("record_id").isNotNull()).distinct()
        .groupBy(*DAY_DOMAIN).agg(F.count("*").alias("records_with_findings"))
    )
    keys = [counts[k].eqNullSafe(records[k]) for k in DAY_DOMAIN]
    joined = counts.join(records, keys, "left").select(
        counts["*"], F.coalesce(records["records_with_findings"], F.lit(0)).alias("records_with_findings")
    )
    same = {f"scored_{v.lower()}_issue_count": F.col(f"{v.lower()}_findings") for v in SEVERITIES}
    same["scored_total_issue_count"] = F.col("total_findings")
    for name in ("total_rules_executed", "rules_triggered", "configured_rule_count", "active_rule_count"):
        same[name] = F.col("failed_rule_count")
    same["inactive_rule_count"] = F.lit(0).cast("bigint")
    return joined.withColumns(same)


def ai_recommendations(rows: DataFrame, days=None) -> DataFrame:
    """Recommendation counts; the two distinct counts come from narrow passes of their own."""
    base = _keyed(rows, days, F.upper("status").alias("status"), F.upper("priority").alias("priority"),
                  F.col("confidence_score"))
    st = lambda *v: F.count_if(F.col("status").isin(*v))
    counts = base.groupBy(*DAY_DOMAIN).agg(
        F.count("*").alias("ai_recommendations_generated"),
        *[st(v).alias(f"{v.lower()}_ai_recommendations") for v in ADVICE_STATES],
        *[F.count_if(F.col("priority") == v).alias(f"{v.lower()}_priority_recommendations") for v in PRIORITIES],
        F.avg("confidence_score").alias("avg_ai_recommendation_confidence"),
        st("ACCEPTED", "IMPLEMENTED", "REJECTED").alias("steward_actions_taken"),
        st("IMPLEMENTED").alias("automated_fixes_applied"),
    )
    for column, alias in (("record_id", "records_flagged_by_ai"), ("rule_id", "ai_rules_flagged_count")):
        seen = (
            _keyed(rows, days, F.col(column)).where(F.col(column).isNotNull()).distinct()
            .groupBy(*[F.col(k).alias(f"{k}_k") for k in DAY_DOMAIN]).agg(F.count("*").alias(alias))
        )
        on = [F.col(k).eqNullSafe(F.col(f"{k}_k")) for k in DAY_DOMAIN]
        counts = (counts.join(seen, on, "left").drop(*[f"{k}_k" for k in DAY_DOMAIN])
                  .withColumn(alias, F.coalesce(alias, F.lit(0))))
    return counts


def day_spine(spark: SparkSession, as_of: dt.date, days: int) -> DataFrame:
    """Every day of the range with every domain: at most 366 x 6 rows."""
    rows = [(as_of - dt.timedelta(days=d), name) for d in range(days + 1) for name in DOMAINS]
    return spark.createDataFrame(rows, "metric_date date, domain string")


def dashboard(
    spark: SparkSession, scores: DataFrame, rows: DataFrame, advice: DataFrame, as_of: dt.date, days: int = 0
) -> DataFrame:
    """One row per domain and day with scores, findings, recommendations and rates."""
    span = (as_of - dt.timedelta(days=days), as_of)
    joined = day_spine(spark, as_of, days)
    for part in (record_scores(scores, span), findings(rows, span), ai_recommendations(advice, span)):
        joined = joined.join(part, list(DAY_DOMAIN), "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    or_one = lambda name: F.coalesce(F.col(name), F.lit(1.0)).alias(name)
    avg = F.coalesce(F.col("avg_record_score"), F.lit(100.0))
    zeroed = joined.select(
        *DAY_DOMAIN,
        zero("total_records"),
        avg.alias("avg_record_score"),
        zero("records_below_threshold"),
        zero("records_below_threshold_rate"),
        F.round(avg, 2).alias("dq_health_score"),
        F.round(F.lit(100.0) - avg, 2).alias("dq_risk_score"),
        F.round(avg * 0.85, 2).alias("automation_readiness_score"),
        *[or_one(f"avg_{c}_score") for c in COMPONENTS],
        zero("total_findings"),
        *[zero(f"{v.lower()}_findings") for v in SEVERITIES],
        *[zero(f"{v.lower()}_findings_count") for v in FINDING_STATES],
        zero("records_with_findings"),
        zero("failed_rule_count"),
        zero("duplicate_record_count"),
        *[zero(f"scored_{v.lower()}_issue_count") for v in SEVERITIES],
        zero("scored_total_issue_count"),
        zero("records_flagged_by_ai"),
        zero("ai_recommendations_generated"),
        *[zero(f"{v.lower()}_ai_recommendations") for v in ADVICE_STATES],
        *[zero(f"{v.lower()}_priority_recommendations") for v in PRIORITIES],
        zero("avg_ai_recommendation_confidence"),
        zero("ai_rules_flagged_count"),
        zero("steward_actions_taken"),
        zero("automated_fixes_applied"),
        zero("scored_record_count"),
        zero("min_record_score"),
        zero("max_record_score"),
        *[zero(f"{b}_score_count") for b in ("very_low", "low", "medium", "high")],
        *[zero(n) for n in ("total_rules_executed", "rules_triggered", "configured_rule_count",
                            "active_rule_count", "inactive_rule_count")],
        *[zero(f"configured_{v.lower()}_rules") for v in SEVERITIES],
        *[zero(f"{v.lower()}_rule_count") for v in CATEGORIES],
        zero("avg_rule_weight"),
    )
    rates = {
        "findings_per_record_rate": ("total_findings", "total_records"),
        "duplicate_rate": ("duplicate_record_count", "total_records"),
        "ai_flagged_record_rate": ("records_flagged_by_ai", "total_records"),
        "automated_fix_rate": ("automated_fixes_applied", "ai_recommendations_generated"),
        "steward_action_rate": ("steward_actions_taken", "ai_recommendations_generated"),
        "findings_resolution_rate": ("resolved_findings_count", "total_findings"),
        "ai_recommendation_acceptance_rate": ("accepted_ai_recommendations", "ai_recommendations_generated"),
        "ai_recommendation_implementation_rate": ("implemented_ai_recommendations", "ai_recommendations_generated"),
        "impacted_record_rate": ("records_with_findings", "total_records"),
    }
    return zeroed.withColumns({k: ratio(F.col(a), F.col(b)) for k, (a, b) in rates.items()}).withColumn(
        "summary_created_at", F.lit(dt.datetime.combine(as_of, dt.time()))
    )


def dashboard_history(
    spark: SparkSession, scores: DataFrame, rows: DataFrame, advice: DataFrame,
    as_of: dt.date, days: int = 30, domain: str | None = None,
) -> DataFrame:
    """The dashboard for each of the last days, newest first; ``is_latest`` marks the first row."""
    out = dashboard(spark, scores, rows, advice, as_of, days)
    if domain is not None:
        out = out.where(F.col("domain") == domain)
    first = domain if domain is not None else min(DOMAINS)
    latest = (F.col("metric_date") == F.lit(as_of)) & (F.col("domain") == first)
    return out.withColumn("is_latest", latest).orderBy(F.col("metric_date").desc(), "domain")


def daily_summary(board: DataFrame) -> DataFrame:
    return board.select(*SUMMARY_COLUMNS, F.col("summary_created_at").alias("created_at"))

"""Data-quality queries and the SQL they are checked against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.operators import quality as q
from concord.plans.checks import check
from concord.sources.shaped import shaped
from concord.sources.tables import fresh_path, write_partitioned

AS_OF = dt.date(2024, 1, 15)
DAYS = 2


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: sums of doubles depend on row order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (shaped(spark, sf, "dq_record_score"), shaped(spark, sf, "dq_findings"),
            shaped(spark, sf, "dq_ai_recommendations"))


def summary_frame(spark: SparkSession, sf: str) -> DataFrame:
    return q.daily_summary(q.dashboard(spark, *inputs(spark, sf), AS_OF))


def _summary_written(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(write_partitioned(summary_frame(spark, sf), fresh_path(spark, "daily_summary"), "metric_date"))


QUERIES = {
    "dq_record_scores": lambda s, d: rounded(q.record_scores(shaped(s, d, "dq_record_score"))),
    "dq_findings": lambda s, d: rounded(q.findings(shaped(s, d, "dq_findings"))),
    "dq_ai_recommendations": lambda s, d: rounded(q.ai_recommendations(shaped(s, d, "dq_ai_recommendations"))),
    "dq_dashboard": lambda s, d: rounded(q.dashboard(s, *inputs(s, d), AS_OF)),
    "dq_dashboard_history": lambda s, d: rounded(q.dashboard_history(s, *inputs(s, d), AS_OF, DAYS)),
    "dq_daily_summary": _summary_written,
}

SCORES = """
SELECT CAST(created_at AS DATE) AS metric_date, upper(domain) AS domain, count(*) AS total_records,
  avg(record_score) AS avg_record_score, count(*) FILTER (record_score < 80) AS records_below_threshold,
  avg(completeness_score) AS avg_completeness_score, avg(validity_score) AS avg_validity_score,
  avg(standardization_score) AS avg_standardization_score, avg(consistency_score) AS avg_consistency_score,
  avg(uniqueness_score) AS avg_uniqueness_score, min(record_score) AS min_record_score, max(record_score) AS max_record_score,
  count(*) FILTER (record_score < 50) AS very_low_score_count,
  count(*) FILTER (record_score >= 50 AND record_score < 70) AS low_score_count,
  count(*) FILTER (record_score >= 70 AND record_score < 90) AS medium_score_count,
  count(*) FILTER (record_score >= 90) AS high_score_count,
  count(*) FILTER (record_score < 80) / count(*) AS records_below_threshold_rate, count(*) AS scored_record_count
FROM dq_record_score GROUP BY ALL"""

FINDINGS = """
SELECT CAST(created_at AS DATE) AS metric_date, upper(domain) AS domain, count(*) AS total_findings,
  count(*) FILTER (upper(severity) = 'CRITICAL') AS critical_findings, count(*) FILTER (upper(severity) = 'HIGH') AS high_findings,
  count(*) FILTER (upper(severity) = 'MEDIUM') AS medium_findings, count(*) FILTER (upper(severity) = 'LOW') AS low_findings,
  count(*) FILTER (upper(status) = 'OPEN') AS open_findings_count, count(*) FILTER (upper(status) = 'ACCEPTED') AS accepted_findings_count,
  count(*) FILTER (upper(status) = 'RESOLVED') AS resolved_findings_count, count(*) FILTER (upper(status) = 'WAIVED') AS waived_findings_count,
  count(DISTINCT record_id) AS records_with_findings, count(DISTINCT rule_id) AS failed_rule_count,
  count(*) FILTER (upper(rule_type) = 'DUPLICATE') AS duplicate_record_count,
  count(*) FILTER (upper(severity) = 'CRITICAL') AS scored_critical_issue_count, count(*) FILTER (upper(severity) = 'HIGH') AS scored_high_issue_count,
  count(*) FILTER (upper(severity) = 'MEDIUM') AS scored_medium_issue_count, count(*) FILTER (upper(severity) = 'LOW') AS scored_low_issue_count,
  count(*) AS scored_total_issue_count, count(DISTINCT rule_id) AS total_rules_executed, count(DISTINCT rule_id) AS rules_triggered,
  count(DISTINCT rule_id) AS configured_rule_count, count(DISTINCT rule_id) AS active_rule_count, CAST(0 AS BIGINT) AS inactive_rule_count,
  count(DISTINCT rule_id) FILTER (upper(severity) = 'CRITICAL') AS configured_critical_rules,
  count(DISTINCT rule_id) FILTER (upper(severity) = 'HIGH') AS configured_high_rules,
  count(DISTINCT rule_id) FILTER (upper(severity) = 'MEDIUM') AS configured_medium_rules,
  count(DISTINCT rule_id) FILTER (upper(severity) = 'LOW') AS configured_low_rules,
  count(DISTINCT rule_id) FILTER (upper(rule_category) = 'VALIDITY') AS validity_rule_count,
  count(DISTINCT rule_id) FILTER (upper(rule_category) = 'COMPLETENESS') AS completeness_rule_count,
  count(DISTINCT rule_id) FILTER (upper(rule_category) = 'STANDARDIZATION') AS standardization_rule_count,
  count(DISTINCT rule_id) FILTER (upper(rule_category) = 'UNIQUENESS') AS uniqueness_rule_count,
  count(DISTINCT rule_id) FILTER (upper(rule_category) = 'CONSISTENCY') AS consistency_rule_count,
  avg(rule_weight) AS avg_rule_weight
FROM dq_findings GROUP BY ALL"""

ADVICE = """
SELECT CAST(created_at AS DATE) AS metric_date, upper(domain) AS domain, count(DISTINCT record_id) AS records_flagged_by_ai,
  count(*) AS ai_recommendations_generated, count(*) FILTER (upper(status) = 'OPEN') AS open_ai_recommendations,
  count(*) FILTER (upper(status) = 'ACCEPTED') AS accepted_ai_recommendations, count(*) FILTER (upper(status) = 'REJECTED') AS rejected_ai_recommendations,
  count(*) FILTER (upper(status) = 'IMPLEMENTED') AS implemented_ai_recommendations,
  count(*) FILTER (upper(priority) = 'HIGH') AS high_priority_recommendations, count(*) FILTER (upper(priority) = 'MEDIUM') AS medium_priority_recommendations,
  count(*) FILTER (upper(priority) = 'LOW') AS low_priority_recommendations, avg(confidence_score) AS avg_ai_recommendation_confidence,
  count(DISTINCT rule_id) AS ai_rules_flagged_count,
  count(*) FILTER (upper(status) IN ('ACCEPTED', 'IMPLEMENTED', 'REJECTED')) AS steward_actions_taken,
  count(*) FILTER (upper(status) = 'IMPLEMENTED') AS automated_fixes_applied
FROM dq_ai_recommendations GROUP BY ALL"""

_ZERO = """total_findings critical_findings high_findings medium_findings low_findings open_findings_count accepted_findings_count
resolved_findings_count waived_findings_count records_with_findings failed_rule_count duplicate_record_count scored_critical_issue_count
scored_high_issue_count scored_medium_issue_count scored_low_issue_count scored_total_issue_count records_flagged_by_ai
ai_recommendations_generated open_ai_recommendations accepted_ai_recommendations rejected_ai_recommendations implemented_ai_recommendations
high_priority_recommendations medium_priority_recommendations low_priority_recommendations ai_rules_flagged_count steward_actions_taken
automated_fixes_applied scored_record_count very_low_score_count low_score_count medium_score_count high_score_count total_rules_executed
rules_triggered configured_rule_count active_rule_count inactive_rule_count configured_critical_rules configured_high_rules
configured_medium_rules configured_low_rules validity_rule_count completeness_rule_count standardization_rule_count uniqueness_rule_count
consistency_rule_count total_records records_below_threshold""".split()
_ZERO_REAL = "avg_ai_recommendation_confidence min_record_score max_record_score avg_rule_weight records_below_threshold_rate".split()
_ONE = [f"avg_{c}_score" for c in ("completeness", "validity", "standardization", "consistency", "uniqueness")]
_RATES = """total_findings/total_records findings_per_record_rate, duplicate_record_count/total_records duplicate_rate,
records_flagged_by_ai/total_records ai_flagged_record_rate, automated_fixes_applied/ai_recommendations_generated automated_fix_rate,
steward_actions_taken/ai_recommendations_generated steward_action_rate, resolved_findings_count/total_findings findings_resolution_rate,
accepted_ai_recommendations/ai_recommendations_generated ai_recommendation_acceptance_rate,
implemented_ai_recommendations/ai_recommendations_generated ai_recommendation_implementation_rate,
records_with_findings/total_records impacted_record_rate"""


def _rate(text: str) -> str:
    expr, alias = text.split()
    a, b = expr.split("/")
    return f"round({a} / nullif({b}, 0), 6) AS {alias}"


BOARD_SHAPES = ["dq_record_score", "dq_findings", "dq_ai_recommendations"]


def board_ctes(days: int) -> dict[str, str]:
    return {
        "rs": SCORES,
        "f": FINDINGS,
        "ar": ADVICE,
        "spine": f"""SELECT CAST(DATE '2024-01-15' - CAST(n AS INTEGER) AS DATE) AS metric_date, domain FROM range({days + 1}) r(n),
          (VALUES ('CUSTOMER'), ('PROVIDER'), ('SUPPLIER'), ('PRODUCT'), ('PATIENT'), ('LOCATION')) d(domain)""",
        "filled": "SELECT metric_date, domain, coalesce(avg_record_score, 100) AS avg_score, "
        + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _ZERO + _ZERO_REAL)
        + ", " + ", ".join(f"coalesce({c}, 1) AS {c}" for c in _ONE)
        + " FROM spine LEFT JOIN rs USING (metric_date, domain) LEFT JOIN f USING (metric_date, domain) LEFT JOIN ar USING (metric_date, domain)",
        "board": "SELECT metric_date, domain, round(avg_score, 6) AS avg_record_score, round(avg_score, 2) AS dq_health_score, "
        "round(100 - avg_score, 2) AS dq_risk_score, round(avg_score * 0.85e0, 2) AS automation_readiness_score, "
        + ", ".join(_ZERO) + ", " + ", ".join(f"round({c}, 6) AS {c}" for c in _ZERO_REAL + _ONE) + ", "
        + ", ".join(_rate(r) for r in _RATES.split(",")) + ", TIMESTAMP '2024-01-15 00:00:00' AS summary_created_at FROM filled",
    }


def _round6(sql: str, reals: list[str]) -> str:
    return "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in reals) + f") FROM ({sql})"


CHECKS = {
    "dq_record_scores": check(["dq_record_score"], _round6(
        SCORES, ["avg_record_score", "min_record_score", "max_record_score", "records_below_threshold_rate", *_ONE])),
    "dq_findings": check(["dq_findings"], _round6(FINDINGS, ["avg_rule_weight"])),
    "dq_ai_recommendations": check(["dq_ai_recommendations"], _round6(ADVICE, ["avg_ai_recommendation_confidence"])),
    "dq_dashboard": check(BOARD_SHAPES, "SELECT * FROM board", board_ctes(0)),
    "dq_dashboard_history": check(
        BOARD_SHAPES, "SELECT *, metric_date = DATE '2024-01-15' AND domain = 'CUSTOMER' AS is_latest FROM board", board_ctes(DAYS)),
    "dq_daily_summary": check(
        BOARD_SHAPES,
        "SELECT " + ", ".join(q.SUMMARY_COLUMNS) + ", summary_created_at AS created_at FROM board", board_ctes(0)),
}

"""Feedback, metrics and learning queries and the SQL they are checked against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from concord.operators import feedback as fb
from concord.operators import learning as le
from concord.operators import metrics as m
from concord.plans.checks import check
from concord.plans.quality_plans import rounded
from concord.sources.shaped import shaped

AS_OF = dt.datetime(2001, 11, 5)
DAYS = 365
CASE_DOMAIN, CASE_RULES, CASE_SCORE, CASE_SOURCES = "CUSTOMER", ["DOB_EXACT", "NAME_FUZZY"], 0.9, ("MDM", "ERP")


def _base(s, d):
    return m.recent(shaped(s, d, "explanations"), AS_OF, DAYS)


def _reviewed(s, d):
    return m.reviewed(shaped(s, d, "explanations"), shaped(s, d, "feedback"), AS_OF, DAYS)


def history(s, d):
    return le.decided(shaped(s, d, "explanations"), shaped(s, d, "feedback"))


def _cases(s, d):
    return le.similar_cases(history(s, d), CASE_DOMAIN, CASE_RULES, CASE_SCORE)


def _overview(s, d):
    """The one-row bundle with its maps and lists as text, so that both sides can be compared."""
    df = rounded(m.overview(shaped(s, d, "explanations"), shaped(s, d, "feedback"), AS_OF, DAYS))
    cols = []
    for c, t in df.dtypes:
        if t.startswith("map"):
            items = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
            cols.append(F.array_join(F.array_sort(items), ";").alias(c))
        elif c.startswith("top_"):
            items = F.transform(F.col(c), lambda e: F.concat_ws("=", e["name"], e["count"].cast("string")))
            cols.append(F.array_join(items, ";").alias(c))
        elif c == "fpfn_by_score_bucket":
            cols.append(F.array_join(F.transform(F.col(c), lambda e: F.concat_ws(
                "=", e["bucket"], e["reviewed"].cast("string"), e["false_positives"].cast("string"),
                e["false_negatives"].cast("string"))), ";").alias(c))
        elif c == "learning_timeline":
            cols.append(F.array_join(F.array_sort(F.transform(F.col(c), lambda e: F.concat_ws(
                "=", e["feedback_at"], e["explanation_id"], e["ai_decision"], e["recommended_action"], e["steward_decision"],
                e["steward_override_flag"], e["override_reason"], e["steward_user"]))), ";").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def _joined(df):
    return df.withColumn("triggered_rules", F.array_join("triggered_rules", ","))


QUERIES = {
    "latest_feedback": lambda s, d: fb.latest_feedback(shaped(s, d, "feedback")),
    "feedback_events": lambda s, d: fb.feedback_events(shaped(s, d, "feedback"), shaped(s, d, "explanations")),
    "apply_feedback": lambda s, d: _joined(fb.apply_feedback(shaped(s, d, "explanations"), shaped(s, d, "feedback"))),
    "metrics_overview": _overview,
    "decision_counts": lambda s, d: m.counts_by(_base(s, d), "ai_decision"),
    "risk_counts": lambda s, d: m.counts_by(_base(s, d), "risk_flag"),
    "action_counts": lambda s, d: m.counts_by(_base(s, d), "effective_action"),
    "score_buckets": lambda s, d: m.counts_by(_base(s, d), "score_bucket"),
    "override_rate": lambda s, d: rounded(m.override_rate(_reviewed(s, d))),
    "feedback_latency": lambda s, d: rounded(m.feedback_latency(_reviewed(s, d))),
    "avg_confidence": lambda s, d: rounded(m.avg_confidence(_base(s, d))),
    "top_rules": lambda s, d: m.top_names(m.rules_of(_base(s, d))),
    "top_override_reasons": lambda s, d: m.top_names(m.reasons_of(_reviewed(s, d))),
    "confusion_matrix": lambda s, d: rounded(m.confusion_matrix(_reviewed(s, d))),
    "top_fp_rules": lambda s, d: m.top_names(m.rules_of(_reviewed(s, d).where(m.false_positive()))),
    "top_fn_rules": lambda s, d: m.top_names(m.rules_of(_reviewed(s, d).where(m.false_negative()))),
    "fpfn_by_bucket": lambda s, d: rounded(m.fpfn_by_bucket(_reviewed(s, d))),
    "learning_timeline": lambda s, d: m.learning_timeline(_reviewed(s, d)),
    "override_learning_summary": lambda s, d: le.override_patterns(_cases(s, d)),
    "override_learning_score_bands": lambda s, d: rounded(le.score_band_patterns(_cases(s, d))),
    "override_learning_source_pairs": lambda s, d: rounded(le.source_pair_patterns(_cases(s, d), *CASE_SOURCES)),
    "override_learning_decisions": lambda s, d: rounded(le.decision_patterns(_cases(s, d))),
    "override_learning_precedents": lambda s, d: _joined(le.precedent_cases(_cases(s, d), CASE_SCORE)),
    "override_counts": lambda s, d: le.override_counts(shaped(s, d, "match_pairs"), history(s, d)).select(
        "pair_id", "override_count", le.learning_context().alias("learning_context")),
}

TIES = "steward_user DESC, override_reason_note DESC NULLS LAST, override_reason_code DESC NULLS LAST"
REASON = "coalesce(nullif(override_reason_code, ''), nullif(override_reason_note, ''), 'UNKNOWN_REASON')"
FLAG = """CASE WHEN steward_override_flag IN ('Y', 'y', 'TRUE', 'true', '1') THEN TRUE WHEN steward_override_flag IN ('N', 'n', 'FALSE', 'false', '0') THEN FALSE
  ELSE try_cast(steward_override_flag AS BOOLEAN) END"""


def _latest(where: str = "") -> str:
    return f"""SELECT * FROM feedback {where} QUALIFY row_number() OVER (PARTITION BY explanation_id ORDER BY feedback_at DESC, feedback_id DESC, {TIES}) = 1"""


def _bucket(c: str, dash: str) -> str:
    return f"""CASE WHEN {c} < 0.80e0 THEN '0.00{dash}0.79' WHEN {c} < 0.90e0 THEN '0.80{dash}0.89' WHEN {c} < 0.95e0 THEN '0.90{dash}0.94'
      WHEN {c} < 0.98e0 THEN '0.95{dash}0.97' ELSE '0.98{dash}1.00' END"""


def _norm(c: str) -> str:
    return f"""CASE WHEN upper({c}) IN ('AUTO_MERGE', 'APPROVE_MERGE', 'MATCH') THEN 'MATCH' WHEN upper({c}) IN ('BLOCK_MERGE', 'REJECT_MERGE', 'NO_MATCH')
      THEN 'NO_MATCH' ELSE 'REVIEW' END"""


SINCE = "TIMESTAMP '2000-11-05 00:00:00'"
BASE = {
    "base": f"""SELECT *, coalesce(final_recommended_action, recommended_action) AS effective_action, {_bucket('match_score', '–')} AS score_bucket
      FROM explanations WHERE created_at >= {SINCE}""",
}
REVIEWED = {
    **BASE,
    "lf": _latest(f"WHERE feedback_at >= {SINCE}"),
    "rv": f"""SELECT b.explanation_id, b.match_score, b.score_bucket, b.ai_decision, b.effective_action, b.created_at, b.triggered_rules, lf.steward_decision,
      lf.steward_user, {REASON} AS override_reason, {FLAG} AS flag, lf.feedback_at AS feedback_ts, {_norm('ai_decision')} AS ai_norm, {_norm('steward_decision')} AS steward_norm
      FROM base b JOIN lf USING (explanation_id)""",
}
HISTORY = {
    "lf": _latest(),
    "history": f"""SELECT e.explanation_id, upper(trim(e.domain)) AS domain, record_a_id, record_b_id, record_a_source_system, record_b_source_system, match_score,
      ai_decision, ai_confidence, risk_flag, coalesce(final_recommended_action, recommended_action) AS recommended_action, triggered_rules, created_at,
      steward_decision, {FLAG} AS steward_override_flag, {REASON} AS override_reason,
      coalesce(record_a_source_system, 'UNKNOWN') || '|' || coalesce(record_b_source_system, 'UNKNOWN') AS source_pair
      FROM explanations e JOIN lf USING (explanation_id)""",
}
CASES = {
    **HISTORY,
    "cases": f"""SELECT *, {_bucket('match_score', '-')} AS score_band FROM history WHERE domain = 'CUSTOMER' AND list_has_any(triggered_rules, ['DOB_EXACT', 'NAME_FUZZY'])
      AND (abs(match_score - 0.9e0) <= 0.05e0 OR {_bucket('match_score', '-')} = '0.90-0.94')""",
}
LOGS = ["explanations", "feedback"]
FP, FN = "ai_norm = 'MATCH' AND steward_norm = 'NO_MATCH'", "ai_norm = 'NO_MATCH' AND steward_norm = 'MATCH'"


def _count_by(c: str) -> str:
    return check(["explanations"], f"SELECT {c} AS k, count(*) AS v FROM base GROUP BY 1", BASE)


def _top(select: str) -> str:
    return f"SELECT name, count(*) AS cnt FROM ({select}) GROUP BY 1 ORDER BY cnt DESC, name LIMIT 10"


TOP_RULES = _top("SELECT unnest(triggered_rules) AS name FROM base")
TOP_REASONS = _top("SELECT trim(lower(override_reason)) AS name FROM rv WHERE override_reason <> ''")
TOP_FP = _top(f"SELECT unnest(triggered_rules) AS name FROM rv WHERE {FP}")
TOP_FN = _top(f"SELECT unnest(triggered_rules) AS name FROM rv WHERE {FN}")
CONFUSION = f"""SELECT *, round(false_positives / nullif(total_reviewed, 0), 6) AS fp_rate, round(false_negatives / nullif(total_reviewed, 0), 6) AS fn_rate,
  round(true_positives / nullif(true_positives + false_positives, 0), 6) AS precision, round(true_positives / nullif(true_positives + false_negatives, 0), 6) AS recall
  FROM (SELECT count(*) AS total_reviewed, count(*) FILTER (ai_norm = 'MATCH' AND steward_norm = 'MATCH') AS true_positives,
    count(*) FILTER (ai_norm = 'NO_MATCH' AND steward_norm = 'NO_MATCH') AS true_negatives, count(*) FILTER ({FP}) AS false_positives,
    count(*) FILTER ({FN}) AS false_negatives, count(*) FILTER (ai_norm = 'REVIEW' OR steward_norm = 'REVIEW') AS review_or_other FROM rv)"""
BUCKETS = f"""SELECT score_bucket AS bucket, count(*) AS reviewed, count(*) FILTER ({FP}) AS false_positives, count(*) FILTER ({FN}) AS false_negatives,
  round(count(*) FILTER ({FP}) / count(*), 6) AS fp_rate, round(count(*) FILTER ({FN}) / count(*), 6) AS fn_rate FROM rv GROUP BY 1"""
TIMELINE = """SELECT explanation_id, coalesce(ai_decision, '') AS ai_decision, coalesce(effective_action, '') AS recommended_action,
  coalesce(steward_decision, '') AS steward_decision, CASE WHEN flag THEN 'True' ELSE '' END AS steward_override_flag, override_reason,
  coalesce(steward_user, '') AS steward_user, strftime(feedback_ts, '%Y-%m-%d %H:%M:%S') || '+00:00' AS feedback_at
  FROM rv ORDER BY feedback_ts DESC, explanation_id LIMIT 7"""
RATE = "round(count(*) FILTER (flag) / nullif(count(*), 0), 6)"
LATENCY = "round(avg(datesub('minute', created_at, feedback_ts)), 6)"


def _text_map(c: str) -> str:
    return f"(SELECT string_agg(kv, ';' ORDER BY kv) FROM (SELECT {c} || '=' || count(*) AS kv FROM base WHERE {c} IS NOT NULL GROUP BY {c}))"


def _text_top(sql: str) -> str:
    return f"(SELECT string_agg(name || '=' || cnt, ';' ORDER BY cnt DESC, name) FROM ({sql}))"


OVERVIEW = f"""SELECT (SELECT count(*) FROM base) AS total_explanations, (SELECT round(avg(ai_confidence), 6) FROM base) AS avg_ai_confidence,
  (SELECT {RATE} FROM rv) AS override_rate, (SELECT {LATENCY} FROM rv) AS avg_time_to_feedback_minutes, c.*,
  {_text_map('ai_decision')} AS decisions, {_text_map('risk_flag')} AS risk_flags, {_text_map('effective_action')} AS recommended_actions,
  {_text_map('score_bucket')} AS score_buckets, {_text_top(TOP_RULES)} AS top_triggered_rules, {_text_top(TOP_REASONS)} AS top_override_reasons,
  {_text_top(TOP_FP)} AS top_fp_rules, {_text_top(TOP_FN)} AS top_fn_rules,
  (SELECT string_agg(bucket || '=' || reviewed || '=' || false_positives || '=' || false_negatives, ';' ORDER BY bucket) FROM ({BUCKETS})) AS fpfn_by_score_bucket,
  (SELECT string_agg(kv, ';' ORDER BY kv) FROM (SELECT concat_ws('=', feedback_at, explanation_id, ai_decision, recommended_action, steward_decision,
    steward_override_flag, override_reason, steward_user) AS kv FROM ({TIMELINE}))) AS learning_timeline
  FROM ({CONFUSION}) c"""

CHECKS = {
    "latest_feedback": check(["feedback"], _latest()),
    "feedback_events": check(LOGS, """SELECT 'fb_' || substr(sha256(key || '|' || feedback_id), 1, 12) AS feedback_id, 'dec_' || substr(sha256(key), 1, 12) AS decision_id,
      CAST(NULL AS VARCHAR) AS request_id, CAST(NULL AS VARCHAR) AS audit_packet_id, CAST(NULL AS VARCHAR) AS domain, CAST(NULL AS VARCHAR) AS policy_version,
      explanation_id, steward_user, steward_decision, CASE WHEN steward_decision IS NOT DISTINCT FROM recommended THEN 'N' ELSE 'Y' END AS steward_override_flag,
      override_reason_code, override_reason_note, feedback_at, feedback_at AS submitted_at
      FROM (SELECT f.*, e.recommended, concat_ws('|', explanation_id, coalesce(steward_user, ''), coalesce(steward_decision, ''), strftime(feedback_at, '%Y-%m-%d %H:%M:%S')) AS key
        FROM feedback f JOIN newest e USING (explanation_id)) WHERE recommended IS NOT NULL""",
        {"newest": """SELECT explanation_id, coalesce(final_recommended_action, recommended_action) AS recommended FROM explanations
          QUALIFY row_number() OVER (PARTITION BY explanation_id ORDER BY created_at DESC, 2 DESC) = 1"""}),
    "apply_feedback": check(LOGS, f"""SELECT e.* REPLACE (array_to_string(triggered_rules, ',') AS triggered_rules), lf.steward_decision, lf.override_reason_code,
      lf.override_reason_note, lf.steward_user, CAST(NULL AS VARCHAR) AS decision_id,
      CASE WHEN upper(trim(lf.steward_override_flag)) IN ('Y', 'YES', 'TRUE', '1') THEN 'Y' WHEN upper(trim(lf.steward_override_flag)) IN ('N', 'NO', 'FALSE', '0') THEN 'N' END AS steward_override_flag,
      CAST(NULL AS VARCHAR) AS audit_packet_id, lf.feedback_at FROM explanations e LEFT JOIN lf USING (explanation_id)""", {"lf": _latest()}),
    "metrics_overview": check(LOGS, OVERVIEW, REVIEWED),
    "decision_counts": _count_by("ai_decision"),
    "risk_counts": _count_by("risk_flag"),
    "action_counts": _count_by("effective_action"),
    "score_buckets": _count_by("score_bucket"),
    "override_rate": check(LOGS, f"SELECT {RATE} AS override_rate FROM rv", REVIEWED),
    "feedback_latency": check(LOGS, f"SELECT {LATENCY} AS avg_time_to_feedback_minutes FROM rv", REVIEWED),
    "avg_confidence": check(["explanations"], "SELECT round(avg(ai_confidence), 6) AS avg_ai_confidence FROM base", BASE),
    "top_rules": check(["explanations"], TOP_RULES, BASE),
    "top_override_reasons": check(LOGS, TOP_REASONS, REVIEWED),
    "confusion_matrix": check(LOGS, CONFUSION, REVIEWED),
    "top_fp_rules": check(LOGS, TOP_FP, REVIEWED),
    "top_fn_rules": check(LOGS, TOP_FN, REVIEWED),
    "fpfn_by_bucket": check(LOGS, BUCKETS, REVIEWED),
    "learning_timeline": check(LOGS, TIMELINE, REVIEWED),
    "override_learning_summary": check(LOGS, """SELECT triggered_rule, override_reason AS override_reason_code, count(*) AS override_count
      FROM (SELECT unnest(triggered_rules) AS triggered_rule, override_reason FROM cases WHERE steward_override_flag) GROUP BY 1, 2
      ORDER BY override_count DESC, triggered_rule, override_reason_code LIMIT 5""", CASES),
    "override_learning_score_bands": check(LOGS, """SELECT score_band, steward_decision, count(*) AS decision_count, round(avg(match_score), 6) AS avg_match_score,
      round(avg(ai_confidence), 6) AS avg_ai_confidence FROM cases GROUP BY 1, 2 ORDER BY decision_count DESC, score_band, steward_decision NULLS FIRST LIMIT 5""", CASES),
    "override_learning_source_pairs": check(LOGS, """SELECT source_pair, steward_decision, count(*) AS decision_count, round(avg(match_score), 6) AS avg_match_score
      FROM cases WHERE source_pair IN ('MDM|ERP', 'ERP|MDM') GROUP BY 1, 2 ORDER BY decision_count DESC, source_pair, steward_decision NULLS FIRST LIMIT 5""", CASES),
    "override_learning_decisions": check(LOGS, """SELECT ai_decision, steward_decision, count(*) AS pattern_count, round(avg(match_score), 6) AS avg_match_score,
      round(avg(ai_confidence), 6) AS avg_ai_confidence FROM cases GROUP BY 1, 2 ORDER BY pattern_count DESC, ai_decision NULLS FIRST, steward_decision NULLS FIRST LIMIT 5""", CASES),
    "override_learning_precedents": check(LOGS, """SELECT explanation_id, record_a_id, record_b_id, record_a_source_system, record_b_source_system, match_score, ai_decision,
      ai_confidence, risk_flag, recommended_action, steward_decision, steward_override_flag, override_reason, array_to_string(triggered_rules, ',') AS triggered_rules, created_at
      FROM cases ORDER BY abs(match_score - 0.9e0) NULLS FIRST, created_at DESC, explanation_id LIMIT 5""", CASES),
    "override_counts": check(["match_pairs", *LOGS], """SELECT pair_id, CAST(coalesce(override_count, 0) AS BIGINT) AS override_count,
      coalesce(lines, 'No significant steward override patterns were found for this domain and rule set.') AS learning_context FROM match_pairs LEFT JOIN (
      SELECT pair_id, sum(n) AS override_count, string_agg('- Rule ' || name || ' was previously overridden ' || n || ' times, most often for reason ' || override_reason || '.',
        chr(10) ORDER BY n DESC, name, override_reason) AS lines FROM (SELECT pair_id, name, override_reason, count(*) AS n FROM hits GROUP BY pair_id, name, override_reason
        QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, name, override_reason) <= 5) GROUP BY 1) USING (pair_id)""",
        {**HISTORY, "hits": f"""SELECT p.pair_id, h.override_reason, unnest(h.triggered_rules) AS name FROM match_pairs p JOIN history h
          ON upper(trim(p.domain)) = h.domain AND list_has_any(p.triggered_rules, h.triggered_rules) AND h.steward_override_flag
          AND (p.match_score IS NULL OR abs(h.match_score - p.match_score) <= 0.05e0 OR {_bucket('h.match_score', '-')} = {_bucket('p.match_score', '-')})"""}),
}

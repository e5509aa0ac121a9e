"""Policy queries and the SQL they are checked against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from concord.operators import policy as p
from concord.plans.checks import check
from concord.sources.shaped import shaped

AS_OF = dt.datetime(2001, 11, 5)
PUBLISH = ("customer ", "v2")


def tables(s, d):
    return shaped(s, d, "policy_config"), shaped(s, d, "policy_thresholds"), shaped(s, d, "policy_risk_rules")


def judged(s, d, pairs):
    """Pairs with policy, matched rules and their summary."""
    configs, limits, rules = tables(s, d)
    pairs = p.with_policy(pairs, configs, limits, AS_OF)
    return p.rule_summary(p.matched_risk_rules(pairs, rules, AS_OF))


def _scored(s, d):
    return judged(s, d, shaped(s, d, "scored_pairs").drop("highest_risk_level"))


def _decision(s, d):
    return p.policy_decision(_scored(s, d)).select(
        "pair_id", "domain", "policy_version", "policy_status", "recommendation", "recommendation_reason", "risk_band",
        "risk_cutoff_out_of_range", "highest_risk_level", F.array_join("recommended_actions_seen", ",").alias("recommended_actions_seen"),
        "steward_learning_override_count", "override_rate_estimate", "composite_risk_score", "composite_risk_band", "primary_risk_driver",
        F.array_join("blockers", ",").alias("blockers"), "min_review_score", "min_approve_merge_score", "min_auto_merge_score",
        "allow_auto_merge", "review_required", "manual_on_conflict")


def _rules(s, d):
    return _scored(s, d).select(
        "pair_id", "policy_version", F.array_join(F.transform("matched_rules", lambda r: r["risk_rule_id"]), ",").alias("matched_rules"),
        "highest_risk_level", F.array_join("recommended_actions_seen", ",").alias("recommended_actions_seen"), "primary_risk_driver")


def _bundle(s, d):
    out = p.policy_bundle(shaped(s, d, "policy_drafts"), *tables(s, d), AS_OF)
    return out.withColumn("risk_rules", F.array_join(F.transform("risk_rules", lambda r: r["risk_rule_id"]), ","))


def _risk(s, d):
    level, rate = F.col("highest_risk_level"), F.col("override_rate")
    score = p.composite_risk(p.safe_rate(F.col("match_score"), 0.0), level, F.col("a_source_system"), F.col("b_source_system"), rate)
    pairs = shaped(s, d, "scored_pairs").select("pair_id", score.alias("composite_risk_score"))
    return pairs.withColumn("composite_risk_band", p.composite_risk_band(F.col("composite_risk_score")))


def _drafted(s, d, i):
    return p.save_draft(shaped(s, d, "policy_drafts"), *tables(s, d), AS_OF)[i]


QUERIES = {
    "active_policy": lambda s, d: p.active_policy(*tables(s, d)[:2], AS_OF),
    "matched_risk_rules": _rules,
    "composite_risk": _risk,
    "override_rate_estimate": lambda s, d: shaped(s, d, "scored_pairs").select(
        "pair_id", p.override_rate_estimate(F.col("override_count")).alias("override_rate_estimate")),
    "policy_decision": _decision,
    "threshold_guidance": lambda s, d: (lambda df: df.select(
        "pair_id", p.threshold_guidance(df).alias("threshold_guidance"), p.risk_rule_guidance().alias("risk_rule_guidance")))(_scored(s, d)),
    "policy_bundle": _bundle,
    "policy_save_draft": lambda s, d: _drafted(s, d, 0),
    "policy_save_draft_thresholds": lambda s, d: _drafted(s, d, 1),
    "policy_publish": lambda s, d: p.publish(*tables(s, d), *PUBLISH, AS_OF).counts,
    "policy_publish_config": lambda s, d: p.publish(*tables(s, d), *PUBLISH, AS_OF).configs,
    "policy_publish_rules": lambda s, d: p.publish(*tables(s, d), *PUBLISH, AS_OF).rules,
    "policy_seed": lambda s, d: p.seeded(shaped(s, d, "policy_config"), p.seed_configs(s, AS_OF)),
    "policy_seed_thresholds": lambda s, d: p.seeded(shaped(s, d, "policy_thresholds"), p.seed_thresholds(s, AS_OF)),
}

NOW = "TIMESTAMP '2001-11-05 00:00:00'"
IN_FORCE = f"active_flag = 'Y' AND (effective_from IS NULL OR effective_from <= {NOW}) AND (effective_to IS NULL OR effective_to >= {NOW})"
LIMITS = ("min_review_score, min_approve_merge_score, min_auto_merge_score, max_auto_merge_override_rate, max_review_override_rate, "
          "high_risk_score_cutoff, medium_risk_score_cutoff, require_exact_dob_flag, require_email_or_address_flag, require_manual_review_on_conflict_flag")
ACTIVE = {
    "ac": f"""SELECT * FROM policy_config WHERE {IN_FORCE} QUALIFY row_number() OVER (PARTITION BY domain ORDER BY effective_from DESC NULLS LAST, policy_id DESC) = 1""",
    "thr": f"""SELECT * FROM policy_thresholds WHERE {IN_FORCE}
      QUALIFY row_number() OVER (PARTITION BY domain, policy_version ORDER BY effective_from DESC NULLS LAST, threshold_id DESC) = 1""",
}
POLICY_SHAPES = ["policy_config", "policy_thresholds", "policy_risk_rules"]
MATCHED = {
    **ACTIVE,
    "pp": f"""SELECT s.* REPLACE (upper(trim(s.domain)) AS domain, coalesce(s.policy_version, ac.policy_version) AS policy_version), ac.policy_id AS cfg, ac.review_required_flag,
      ac.allow_auto_merge_flag FROM scored_pairs s LEFT JOIN ac ON upper(trim(s.domain)) = ac.domain""",
    "pt": f"""SELECT pp.* EXCLUDE (highest_risk_level), thr.threshold_id, {LIMITS},
      CASE WHEN cfg IS NULL THEN 'NO_ACTIVE_CONFIG' WHEN thr.threshold_id IS NULL THEN 'NO_ACTIVE_THRESHOLDS' ELSE 'OK' END AS policy_status
      FROM pp LEFT JOIN thr ON pp.domain = thr.domain AND pp.policy_version = thr.policy_version""",
    "hit": f"""SELECT pt.pair_id, r.*, row_number() OVER (PARTITION BY pt.pair_id ORDER BY risk_weight DESC, triggered_rule, risk_rule_id) AS rn,
        CASE upper(risk_level) WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank
      FROM pt JOIN policy_risk_rules r ON pt.domain = r.domain AND pt.policy_version = r.policy_version AND list_contains(pt.triggered_rules, r.triggered_rule)
      WHERE {IN_FORCE}""",
    "per": """SELECT pair_id, string_agg(risk_rule_id, ',' ORDER BY rn) AS matched_rules, max(rank) AS rank, list_distinct(list(upper(recommended_action))) AS actions,
      max(triggered_rule) FILTER (rn = 1) AS driver, string_agg('- Policy risk rule for ' || triggered_rule || ': risk_level=' || risk_level || ', recommended_action=' || recommended_action
        || ', override_reason_code=' || coalesce(nullif(override_reason_code, ''), 'GENERAL_RISK') || '. Notes: ' || coalesce(notes, 'No additional notes.'), chr(10) ORDER BY rn) FILTER (rn <= 5) AS lines
      FROM hit GROUP BY 1""",
    "rs": """SELECT pt.*, coalesce(per.matched_rules, '') AS matched_rules, CASE coalesce(per.rank, 1) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS highest_risk_level,
      coalesce(list_sort(actions), []) AS actions, driver, lines FROM pt LEFT JOIN per USING (pair_id)""",
}


def _points(c: str) -> str:
    return f"CASE upper(coalesce({c}, '')) WHEN 'MDM' THEN 0 WHEN 'ERP' THEN 5 WHEN 'CRM' THEN 10 WHEN 'SUPPLIER_PORTAL' THEN 15 WHEN 'PLM' THEN 8 WHEN 'PIM' THEN 8 ELSE 20 END"


def _composite(score: str, level: str, rate: str) -> str:
    return f"""CAST(trunc(greatest(0e0, least(100e0, CAST(CASE upper({level}) WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 30 WHEN 'HIGH' THEN 50 WHEN 'CRITICAL' THEN 70 ELSE 30 END AS DOUBLE)
      + (1e0 - {score}) * 30e0 + abs({_points('a_source_system')} - {_points('b_source_system')})
      + CASE WHEN {rate} > 0.30e0 THEN 30 WHEN {rate} > 0.15e0 THEN 20 WHEN {rate} > 0.05e0 THEN 10 ELSE 0 END))) AS INTEGER)"""


def _band(c: str) -> str:
    return f"CASE WHEN {c} >= 76 THEN 'SEVERE' WHEN {c} >= 51 THEN 'ELEVATED' WHEN {c} >= 26 THEN 'MODERATE' ELSE 'LOW' END"


RATE = """CASE WHEN override_count >= 10 THEN 0.30e0 WHEN override_count >= 5 THEN 0.15e0 WHEN override_count >= 2 THEN 0.08e0 WHEN override_count >= 1 THEN 0.03e0 ELSE 0e0 END"""


def _safe(c: str, default: float) -> str:
    return f"greatest(0e0, least(1e0, coalesce({c}, {default}e0)))"


DECISION = {
    **MATCHED,
    "d1": f"""SELECT *, {_safe('match_score', 0)} AS ms, {_safe('min_review_score', 0.9)} AS lo, {_safe('min_approve_merge_score', 0.95)} AS mid, {_safe('min_auto_merge_score', 0.98)} AS hi,
      {_safe('high_risk_score_cutoff', 0.9)} AS hc, {_safe('medium_risk_score_cutoff', 0.95)} AS mc, {RATE} AS rate,
      coalesce(upper(allow_auto_merge_flag) = 'Y', FALSE) AS allow_auto_merge, coalesce(upper(review_required_flag) = 'Y', FALSE) AS review_required,
      coalesce(upper(require_manual_review_on_conflict_flag) = 'Y', FALSE) AS manual_on_conflict FROM rs""",
    "d2": f"SELECT *, {_composite('ms', 'highest_risk_level', 'rate')} AS risk FROM d1",
    "d3": f"""SELECT *, {_band('risk')} AS band, ms < lo AS low, list_has_any(actions, ['BLOCK', 'BLOCK_MERGE']) AS stop,
      manual_on_conflict AND (list_has_any(actions, ['REVIEW', 'REVIEW_REQUIRED']) OR highest_risk_level IN ('HIGH', 'CRITICAL') OR risk >= 51) AS conflict,
      ms >= hi AND allow_auto_merge AND highest_risk_level = 'LOW' AND risk <= 25 AS auto, ms >= mid AND highest_risk_level IN ('LOW', 'MEDIUM') AND risk <= 50 AS appr FROM d2""",
    "d4": """SELECT *, concat_ws(' ; ', CASE WHEN low THEN printf('Match score %.2f is below minimum review threshold %.2f.', ms, lo) END,
        CASE WHEN stop THEN 'At least one active policy risk rule recommends blocking the merge.' END,
        CASE WHEN highest_risk_level IN ('HIGH', 'CRITICAL') THEN 'Highest matched policy risk level is ' || highest_risk_level || '.' END,
        'Primary risk driver is ' || driver || '.',
        CASE WHEN override_count > 0 THEN 'Steward learning context found ' || override_count || ' prior overrides across similar triggered rules.' END,
        'Composite risk score is ' || risk || '/100 (' || band || ').',
        CASE WHEN NOT low AND NOT stop THEN 'Policy conflict handling requires manual review for this risk posture.' END) AS why FROM d3""",
}
DRAFT = {
    **ACTIVE,
    "asked": """SELECT DISTINCT d.domain, d.policy_version, ac.domain IS NOT NULL AS has_active_config FROM policy_drafts d LEFT JOIN ac ON d.domain = ac.domain""",
    "cur_c": "SELECT * FROM policy_config QUALIFY row_number() OVER (PARTITION BY domain, policy_version ORDER BY effective_from DESC NULLS LAST, policy_id DESC) = 1",
    "cur_t": "SELECT * FROM policy_thresholds QUALIFY row_number() OVER (PARTITION BY domain, policy_version ORDER BY effective_from DESC NULLS LAST, threshold_id DESC) = 1",
    "rl": "SELECT domain, policy_version, string_agg(risk_rule_id, ',' ORDER BY risk_weight DESC, triggered_rule, risk_rule_id) AS risk_rules FROM policy_risk_rules GROUP BY 1, 2",
    "ok": "SELECT d.*, substr(sha256(d.domain || '|' || d.policy_version), 1, 12) AS made FROM policy_drafts d JOIN ac ON d.domain = ac.domain",
}


def _default(table: str, c: str, d: str) -> str:
    return f"CASE WHEN {table}.policy_version IS NULL THEN {d} ELSE {table}.{c} END AS {c}"


_TDEF = {"min_review_score": "0.9e0", "min_approve_merge_score": "0.95e0", "min_auto_merge_score": "0.98e0", "max_auto_merge_override_rate": "0.02e0",
         "max_review_override_rate": "0.1e0", "high_risk_score_cutoff": "0.9e0", "medium_risk_score_cutoff": "0.95e0"}
_TFLAG = {"require_exact_dob_flag": "'N'", "require_email_or_address_flag": "'N'", "require_manual_review_on_conflict_flag": "'Y'"}
_CFLAG = {"default_decision_mode": "'REVIEW'", "review_required_flag": "'Y'", "allow_auto_merge_flag": "'N'"}
BUNDLE = f"""SELECT a.domain, a.policy_version, a.has_active_config, c.policy_id, c.policy_name, c.policy_description,
  {', '.join(_default('c', k, v) for k, v in _CFLAG.items())}, CASE WHEN c.policy_version IS NULL THEN 'Y' ELSE c.active_flag END AS config_active_flag,
  c.effective_from AS config_effective_from, c.effective_to AS config_effective_to, t.threshold_id, {', '.join(_default('t', k, v) for k, v in {**_TDEF, **_TFLAG}.items())},
  CASE WHEN t.policy_version IS NULL THEN 'Y' ELSE t.active_flag END AS threshold_active_flag, t.effective_from AS threshold_effective_from,
  t.effective_to AS threshold_effective_to, coalesce(c.policy_version, 'v1') AS config_version, rl.risk_rules
  FROM asked a LEFT JOIN cur_c c USING (domain, policy_version) LEFT JOIN cur_t t USING (domain, policy_version) LEFT JOIN rl USING (domain, policy_version)"""


def _drafted_limit(c: str) -> str:
    given = f"o.{c}, " if c in ("min_review_score", "min_auto_merge_score") else ""
    return f"CASE WHEN o.made IS NULL THEN t.{c} ELSE greatest(0e0, least(1e0, coalesce({given}t.{c}, {_TDEF[c]}))) END AS {c}"


CHECKS = {
    "active_policy": check(POLICY_SHAPES[:2], f"SELECT ac.*, threshold_id, {LIMITS} FROM ac LEFT JOIN thr ON ac.domain = thr.domain AND ac.policy_version = thr.policy_version", ACTIVE),
    "matched_risk_rules": check(["scored_pairs", *POLICY_SHAPES], """SELECT pair_id, policy_version, matched_rules, highest_risk_level, array_to_string(actions, ',') AS recommended_actions_seen,
      driver AS primary_risk_driver FROM rs""", MATCHED),
    "composite_risk": check(["scored_pairs"], f"SELECT *, {_band('composite_risk_score')} AS composite_risk_band FROM (SELECT pair_id, "
                            f"{_composite(_safe('match_score', 0), 'highest_risk_level', 'override_rate')} AS composite_risk_score FROM scored_pairs)"),
    "override_rate_estimate": check(["scored_pairs"], f"SELECT pair_id, {RATE} AS override_rate_estimate FROM scored_pairs"),
    "policy_decision": check(["scored_pairs", *POLICY_SHAPES], """SELECT pair_id, domain, policy_version, policy_status,
      CASE WHEN policy_status <> 'OK' THEN NULL WHEN low OR stop THEN 'BLOCK_MERGE' WHEN conflict THEN 'REVIEW_REQUIRED' WHEN auto THEN 'AUTO_MERGE'
        WHEN appr AND NOT review_required THEN 'APPROVE_MERGE' ELSE 'REVIEW_REQUIRED' END AS recommendation,
      CASE WHEN policy_status <> 'OK' THEN NULL WHEN low OR stop OR conflict THEN why
        WHEN auto THEN printf('Match score %.2f meets auto-merge threshold %.2f', ms, hi) || ', auto-merge is allowed by policy, highest matched risk level is ' || highest_risk_level || ', and composite risk score is ' || risk || '/100.'
        WHEN appr AND review_required THEN printf('Match score %.2f meets approve-merge threshold %.2f', ms, mid) || ', but active policy requires review before merge approval.'
        WHEN appr THEN printf('Match score %.2f meets approve-merge threshold %.2f', ms, mid) || ', highest matched risk level is ' || highest_risk_level || ', and composite risk score is ' || risk || '/100.'
        ELSE printf('Match score %.2f meets review threshold %.2f', ms, lo) || ' but does not qualify for a stronger automated decision. Composite risk score is ' || risk || '/100.' END AS recommendation_reason,
      CASE WHEN ms < hc THEN 'HIGH' WHEN ms < mc THEN 'MEDIUM' ELSE 'LOW' END AS risk_band, coalesce(greatest(high_risk_score_cutoff, medium_risk_score_cutoff) > 1, FALSE) AS risk_cutoff_out_of_range,
      highest_risk_level, array_to_string(actions, ',') AS recommended_actions_seen, override_count AS steward_learning_override_count, rate AS override_rate_estimate,
      risk AS composite_risk_score, band AS composite_risk_band, driver AS primary_risk_driver,
      concat_ws(',', CASE WHEN low THEN 'MATCH_SCORE_BELOW_REVIEW_THRESHOLD' END, CASE WHEN stop THEN 'POLICY_RISK_RULE_BLOCK' END) AS blockers,
      lo AS min_review_score, mid AS min_approve_merge_score, hi AS min_auto_merge_score, allow_auto_merge, review_required, manual_on_conflict FROM d4""", DECISION),
    "threshold_guidance": check(["scored_pairs", *POLICY_SHAPES], f"""SELECT pair_id, concat_ws(' ', printf('Minimum review score: %.2f.', {_safe('min_review_score', 0.9)}),
        printf('Minimum approve-merge score: %.2f.', {_safe('min_approve_merge_score', 0.95)}), printf('Minimum auto-merge score: %.2f.', {_safe('min_auto_merge_score', 0.98)}),
        CASE WHEN coalesce(match_score, 0) >= {_safe('min_auto_merge_score', 0.98)} THEN 'Current score is in the highest threshold range.'
          WHEN coalesce(match_score, 0) >= {_safe('min_approve_merge_score', 0.95)} THEN 'Current score is in the strong approve-merge range.'
          WHEN coalesce(match_score, 0) >= {_safe('min_review_score', 0.9)} THEN 'Current score is in the review threshold range.'
          ELSE 'Current score is below preferred review threshold.' END,
        CASE WHEN require_exact_dob_flag = 'Y' THEN 'Exact DOB is policy-significant when available.' END,
        CASE WHEN require_email_or_address_flag = 'Y' THEN 'Email or address support is preferred for stronger approval decisions.' END,
        CASE WHEN require_manual_review_on_conflict_flag = 'Y' THEN 'Conflicting evidence should bias toward manual review.' END) AS threshold_guidance,
      coalesce(lines, 'No active policy risk rules matched the triggered rules for this case.') AS risk_rule_guidance FROM rs""", MATCHED),
    "policy_bundle": check(["policy_drafts", *POLICY_SHAPES], BUNDLE, DRAFT),
    "policy_save_draft": check(["policy_drafts", *POLICY_SHAPES], """SELECT coalesce(c.policy_id, 'pol_' || made) AS policy_id, domain, policy_version,
      coalesce(o.policy_name, c.policy_name) AS policy_name, c.policy_description, CASE WHEN made IS NULL THEN c.active_flag ELSE 'N' END AS active_flag,
      c.effective_from, c.effective_to, CASE WHEN c.policy_id IS NULL THEN 'REVIEW' ELSE c.default_decision_mode END AS default_decision_mode,
      coalesce(o.review_required_flag, c.review_required_flag, 'Y') AS review_required_flag, coalesce(o.allow_auto_merge_flag, c.allow_auto_merge_flag, 'N') AS allow_auto_merge_flag
      FROM policy_config c FULL JOIN ok o USING (domain, policy_version)""", DRAFT),
    "policy_save_draft_thresholds": check(["policy_drafts", *POLICY_SHAPES], f"""SELECT coalesce(t.threshold_id, 'thr_' || made) AS threshold_id, coalesce(t.policy_id, 'pol_' || made) AS policy_id,
      domain, policy_version, {', '.join(_drafted_limit(c) for c in _TDEF)}, {', '.join(f'coalesce(t.{c}, {v}) AS {c}' for c, v in _TFLAG.items())},
      CASE WHEN made IS NULL THEN t.active_flag ELSE 'N' END AS active_flag, t.effective_from, t.effective_to
      FROM policy_thresholds t FULL JOIN ok o USING (domain, policy_version)""", DRAFT),
    "policy_publish": check(POLICY_SHAPES, """SELECT 'PUBLISHED' AS status, 'CUSTOMER' AS domain, 'v2' AS policy_version,
      (SELECT count(*) FROM policy_config WHERE domain = 'CUSTOMER' AND policy_version = 'v2') AS config_rows_activated,
      (SELECT count(*) FROM policy_thresholds WHERE domain = 'CUSTOMER' AND policy_version = 'v2') AS threshold_rows_activated,
      (SELECT count(*) FROM policy_risk_rules WHERE domain = 'CUSTOMER' AND policy_version = 'v2') AS risk_rule_rows_activated"""),
    "policy_publish_config": check(POLICY_SHAPES, f"""SELECT * REPLACE (CASE WHEN domain <> 'CUSTOMER' THEN active_flag WHEN policy_version = 'v2' THEN 'Y' ELSE 'N' END AS active_flag,
      CASE WHEN domain = 'CUSTOMER' AND policy_version = 'v2' THEN coalesce(effective_from, {NOW}) ELSE effective_from END AS effective_from,
      CASE WHEN domain <> 'CUSTOMER' THEN effective_to WHEN policy_version = 'v2' THEN NULL WHEN active_flag = 'Y' THEN {NOW} ELSE effective_to END AS effective_to) FROM policy_config"""),
    "policy_publish_rules": check(POLICY_SHAPES, f"""SELECT * REPLACE (CASE WHEN domain <> 'CUSTOMER' THEN active_flag WHEN policy_version = 'v2' THEN 'Y' ELSE 'N' END AS active_flag,
      CASE WHEN domain <> 'CUSTOMER' THEN effective_to WHEN policy_version = 'v2' THEN NULL WHEN active_flag = 'Y' THEN {NOW} ELSE effective_to END AS effective_to) FROM policy_risk_rules"""),
    "policy_seed": check(["policy_config"], f"""SELECT * FROM policy_config UNION ALL SELECT 'POL-' || domain || '-V1', domain, 'v1', name, text, 'Y', {NOW}, NULL, 'REVIEW_REQUIRED', 'Y', 'Y' FROM (VALUES
      ('CUSTOMER', 'Customer Identity Policy', 'Identity resolution governance policy for customer records.'),
      ('PATIENT', 'Patient Identity Policy', 'Patient identity resolution and patient safety governance policy.'),
      ('PROVIDER', 'Provider Identity Policy', 'Provider identity resolution governance policy.'),
      ('SUPPLIER', 'Supplier Identity Policy', 'Supplier identity resolution governance policy.'),
      ('PRODUCT', 'Product Identity Policy', 'Product identity resolution governance policy.')) v(domain, name, text)"""),
    "policy_seed_thresholds": check(["policy_thresholds"], f"""SELECT * FROM policy_thresholds UNION ALL SELECT 'THR-' || domain || '-V1', 'POL-' || domain || '-V1', domain, 'v1', 0.7e0, 0.9e0, 0.97e0,
      0.1e0, 0.3e0, 70e0, 35e0, CASE domain WHEN 'PATIENT' THEN 'Y' ELSE 'N' END, 'Y', 'Y', 'Y', {NOW}, NULL FROM (VALUES ('CUSTOMER'), ('PATIENT'), ('PROVIDER'), ('SUPPLIER'), ('PRODUCT')) v(domain)"""),
}

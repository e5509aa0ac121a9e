"""SQL for explained pairs: past cases, policy, signals, score, confidence and readiness of the match pairs, stage by stage."""

from __future__ import annotations

from concord.operators import confidence as co
from concord.plans import decision_plans as dp
from concord.plans import fuzzy_checks as fc
from concord.plans import matching_plans as mp
from concord.plans import policy_plans as pp
from concord.plans.checks import check, half_up
from concord.plans.feedback_plans import HISTORY, LOGS, _bucket
from concord.plans.fuzzy_checks import _compact, _exact, _jw, _mailed, _n, _trust, _two_names, sequence, sequence_cte, weighted_cte
from concord.sources.shaped import checker_sql

SHAPES = ["match_pairs", *pp.POLICY_SHAPES, *LOGS]


def _nested(ctes: dict[str, str], body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in ctes.items()) + f" {body}"


_COUNTS = _nested(
    {**HISTORY, "hits": f"""SELECT p.pair_id, h.override_reason, unnest(h.triggered_rules) AS name FROM match_pairs p JOIN history h
       ON upper(trim(p.domain)) = h.domain AND list_has_any(p.triggered_rules, h.triggered_rules) AND h.steward_override_flag
       AND (p.match_score IS NULL OR abs(h.match_score - p.match_score) <= 0.05e0 OR {_bucket('h.match_score', '-')} = {_bucket('p.match_score', '-')})"""},
    """SELECT pair_id, sum(n)::BIGINT AS override_count FROM (SELECT pair_id, count(*) AS n FROM hits GROUP BY pair_id, name, override_reason
       QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, name, override_reason) <= 5) GROUP BY 1""")

_DECIDED = _nested(pp.DECISION, """SELECT * EXCLUDE (domain), domain AS dom, rate AS override_rate, risk AS composite_risk_score,
    CASE WHEN policy_status <> 'OK' THEN NULL WHEN low OR stop THEN 'BLOCK_MERGE' WHEN conflict THEN 'REVIEW_REQUIRED' WHEN auto THEN 'AUTO_MERGE'
      WHEN appr AND NOT review_required THEN 'APPROVE_MERGE' ELSE 'REVIEW_REQUIRED' END AS recommendation FROM d4""")

_PROVIDER_SCORED = "dom = 'PROVIDER' AND trim(coalesce(a_email, '')) <> '' AND trim(coalesce(b_email, '')) <> ''"


def _first(side: str) -> str:
    return f"CASE WHEN dom = 'PRODUCT' OR scored THEN '' ELSE {_n(f'{side}_first_name')} END"


def _side(side: str) -> str:
    return ", ".join([
        f"{_first(side)} AS {side}_first_", f"{_n(f'{side}_last_name')} AS {side}_last_", f"{_compact(f'{side}_email')} AS {side}_mail_",
        f"CASE WHEN scored THEN {_n(f'{side}_address')} ELSE {mp._addr(f'{side}_address')} END AS {side}_address_",
        f"lower(trim(coalesce({side}_first_name, '') || ' ' || coalesce({side}_last_name, ''))) AS {side}_full_"])


_ZEROS = ("tax_id", "product_id", "gtin", "sku", "lot_date", "attribute", "provider_id", "npi", "specialty", "patient_id")
# Addresses of providers, suppliers and patients stand in fields that these pairs lack.
_ADDRESSES = {
    "both_sides": " UNION ALL ".join(
        f"SELECT pair_id || '{s}' AS record_id, CASE WHEN dom IN ('PROVIDER', 'SUPPLIER', 'PATIENT') THEN NULL ELSE {s}_address END AS address FROM decided" for s in "ab"),
    **mp._parsed("both_sides", "record_id"),
    "cores": f"SELECT *, {mp._CORE} AS core, list_distinct(list_filter(string_split({mp._CORE}, ' '), lambda w: w <> '')) AS words FROM p2",
    "sided": """SELECT d.pair_id, a.std AS a_std, b.std AS b_std, a.core AS a_core, b.core AS b_core, a.words AS aw, b.words AS bw, a.zip AS a_zip, b.zip AS b_zip,
      a.st AS a_st, b.st AS b_st FROM decided d JOIN cores a ON a.record_id = d.pair_id || 'a' JOIN cores b ON b.record_id = d.pair_id || 'b'""",
    "levels": """SELECT *, CASE WHEN coalesce(a_std, '') = '' OR coalesce(b_std, '') = '' THEN 'UNKNOWN' WHEN a_std = b_std OR a_core = b_core THEN 'EXACT'
      WHEN len(aw) = 0 OR len(bw) = 0 THEN 'UNKNOWN' WHEN substr(a_zip, 1, 5) = substr(b_zip, 1, 5) AND a_st = b_st AND len(list_intersect(aw, bw)) / least(len(aw), len(bw)) >= 0.75e0 THEN 'NEAR'
      WHEN len(list_intersect(aw, bw)) / least(len(aw), len(bw)) >= 0.5e0 THEN 'PARTIAL' ELSE 'NONE' END AS lvl FROM sided""",
    "address_asked": "SELECT coalesce(a_std, '') AS a, coalesce(b_std, '') AS b FROM sided",
    "address_ratio": sequence_cte("address_asked"),
    "addressed": f"""SELECT l.pair_id, lvl AS postal_match_level, CASE WHEN coalesce(a_std, '') = '' OR coalesce(b_std, '') = '' THEN 'Address comparison unavailable.'
        WHEN lvl = 'EXACT' THEN 'Addresses normalize to the same standardized location.' WHEN lvl = 'NEAR' THEN 'Addresses appear highly similar after normalization and support the match.'
        WHEN lvl = 'PARTIAL' THEN 'Addresses share partial similarity but contain differences that may require review.'
        WHEN lvl = 'NONE' THEN 'Addresses do not materially support the match after normalization.' ELSE 'Address evidence is incomplete or unavailable.' END AS address_match_insight,
      CASE WHEN a_std IS NULL OR b_std IS NULL THEN 0e0 ELSE {sequence('a_std', 'b_std', 'r.ratio')} END AS address_similarity_score
      FROM levels l LEFT JOIN address_ratio r ON r.a = a_std AND r.b = b_std""",
}

_SIGNALS = {
    "sides": f"SELECT *, {_side('a')}, {_side('b')} FROM (SELECT *, {_PROVIDER_SCORED} AS scored FROM decided)",
    "mail_asked": "SELECT a_mail_ AS a, b_mail_ AS b FROM sides", "mail_ratio": weighted_cte("mail_asked"),
    "full_asked": "SELECT a_full_ AS a, b_full_ AS b FROM sides", "full_ratio": sequence_cte("full_asked"),
    "signals": f"""SELECT s.*, CASE WHEN dom IN ('PRODUCT', 'SUPPLIER') OR scored THEN {_jw('a_first_', 'b_first_')}
        ELSE {_two_names(('a_first_', 'b_first_'), ('a_last_', 'b_last_'))} END AS name_score,
      CASE WHEN dom = 'CUSTOMER' THEN {sequence('a_full_', 'b_full_', 'f.ratio')} END AS name_seq_score, {_jw('a_address_', 'b_address_')} AS address_score,
      {_mailed('a_mail_', 'b_mail_', 'm.ratio', 'a_email', 'b_email')} AS email_score, CASE WHEN scored THEN {_mailed('a_mail_', 'b_mail_', 'm.ratio', 'a_email', 'b_email')} ELSE 0e0 END AS provider_email_score,
      {_exact('a_member_id', 'b_member_id')} AS member_id_score, {_exact('a_member_id', 'b_member_id')} AS supplier_id_score, {_exact('a_dob', 'b_dob')} AS dob_score,
      NULL::DOUBLE AS human_id_score, {_trust('a_source_system', 'b_source_system')} AS source_score, {', '.join(f'0e0 AS {k}_score' for k in _ZEROS)}, {dp.LEARN} AS learning_score
      FROM sides s LEFT JOIN mail_ratio m ON m.a = a_mail_ AND m.b = b_mail_ LEFT JOIN full_ratio f ON f.a = a_full_ AND f.b = b_full_""",
    "summed": f"""SELECT *, CASE dom WHEN 'CUSTOMER' THEN {dp._sum('CUSTOMER')} WHEN 'SUPPLIER' THEN {half_up(dp._sum('SUPPLIER'), 2)} WHEN 'PRODUCT' THEN {half_up(dp._sum('PRODUCT'), 4)}
      WHEN 'PATIENT' THEN {dp._sum('PATIENT')} ELSE CASE WHEN scored THEN {dp._sum('PROVIDER')} ELSE {half_up(dp._sum('OTHER'), 2)} END END AS entity_total FROM signals""",
    "sp": """SELECT * EXCLUDE (match_score, recommendation), recommendation AS given, coalesce(recommendation, 'REVIEW_REQUIRED') AS recommended_action, CASE
      WHEN dom = 'CUSTOMER' AND dob_score = 1 AND address_score >= 0.95e0 AND name_seq_score >= 0.85e0 THEN greatest(entity_total, 0.82e0)
      WHEN dom = 'CUSTOMER' AND dob_score = 1 AND name_seq_score >= 0.9e0 THEN greatest(entity_total, 0.78e0)
      WHEN dom = 'SUPPLIER' AND supplier_id_score = 1 THEN greatest(entity_total, 0.94e0) WHEN dom = 'PATIENT' THEN least(entity_total, 0.92e0)
      WHEN scored THEN least(1e0, entity_total + CASE WHEN provider_email_score >= 1 AND name_score >= 0.85e0 AND address_score >= 0.9e0 THEN 0.15e0
        WHEN name_score >= 0.9e0 AND address_score >= 0.9e0 THEN 0.1e0 WHEN provider_email_score >= 1 AND name_score >= 0.8e0 THEN 0.08e0 ELSE 0e0 END)
      ELSE entity_total END AS match_score FROM summed""",
}
_SHOWN = " ".join(f"WHEN '{d}' THEN {len(names)}" for d, names in co.SHOWN_SIGNALS.items())
_EVENTS = " ".join(f"WHEN '{d}' THEN {len([n for n in names if n != 'email_match'])}" for d, names in co.SHOWN_SIGNALS.items())
_READY = {k: v for k, v in dp.READY.items() if k != "sp"}

EXPLAINED = {
    "oc": _COUNTS,
    "scored_pairs": """SELECT m.*, NULL::VARCHAR AS policy_version, coalesce(override_count, 0) AS override_count, NULL::VARCHAR AS highest_risk_level
      FROM match_pairs m LEFT JOIN oc USING (pair_id)""",
    "decided": _DECIDED, **_ADDRESSES, **_SIGNALS, **_READY,
    "explained": f"""SELECT pair_id, 'exp_' || substr(sha256(pair_id), 1, 12) AS explanation_id, dom AS domain, policy_version, policy_status, given AS recommendation, recommended_action,
      highest_risk_level AS risk_flag, composite_risk_score, band AS composite_risk_band, driver AS primary_risk_driver, override_count, postal_match_level, address_match_insight,
      {half_up('address_similarity_score', 6)} AS address_similarity_score, {half_up('match_score', 2)} AS match_score, raw AS raw_entity_score,
      {half_up(f'greatest(0e0, least(1e0, raw + {dp.ADJ}))', 4)} AS adjusted_entity_score, conf AS decision_confidence_score, automation_tier, automation_readiness_score,
      CASE WHEN automation_readiness_score >= 85 THEN 'HIGH_AUTOMATION_READINESS' WHEN automation_readiness_score >= 60 THEN 'MODERATE_AUTOMATION_READINESS'
        ELSE 'LOW_AUTOMATION_READINESS' END AS automation_readiness_label,
      estimated_false_positive_risk, primary_signal, final_recommended_action, CASE WHEN dom = 'PROVIDER' AND NOT scored THEN 0 ELSE CASE dom {_SHOWN} ELSE 0 END END AS signals,
      1 + CASE WHEN dom = 'PROVIDER' AND NOT scored THEN 0 ELSE CASE dom {_EVENTS} ELSE 0 END END + CASE WHEN len(triggered_rules) > 0 THEN 4 ELSE 0 END AS events,
      CASE WHEN {_n('a_member_id')} <> '' AND {_n('a_member_id')} = {_n('b_member_id')} THEN list_append(coalesce(triggered_rules, []), 'MEMBER_ID_EXACT') ELSE triggered_rules END AS rules,
      coalesce(a_member_id, '') AS record_a_id, coalesce(b_member_id, '') AS record_b_id, coalesce(a_source_system, '') AS record_a_source_system,
      coalesce(b_source_system, '') AS record_b_source_system FROM ready JOIN addressed USING (pair_id)""",
}

_STATUS = """CASE final_recommended_action WHEN 'AUTO_MERGE' THEN 'ELIGIBLE_FOR_AUTO_MERGE' WHEN 'APPROVE_MERGE' THEN 'APPROVAL_READY' WHEN 'BLOCK_MERGE' THEN 'BLOCKED_BY_POLICY'
  WHEN 'REJECT_MERGE' THEN 'BLOCKED_BY_POLICY' ELSE 'MANUAL_REVIEW_REQUIRED' END"""
_MADE = lambda prefix: f"'{prefix}' || substr(sha256('{prefix}' || explanation_id), 1, 12)"
_EMPTY = ("ai_decision", "policy_hash", "requested_by", "context_id", "steward_decision", "steward_override_reason", "steward_user", "steward_override_flag",
          "model_provider", "model_version", "prompt_version", "feature_schema_version")


def _run_check() -> str:
    """The batch run: candidates of the people on one side, their customer scores, and what is explained of those that reach review."""
    people = {k: v.replace("match_pairs", "people") for k, v in mp.CANDIDATE_CTES.items()}
    fields = ("member_id", "first_name", "last_name", "email", "address", "dob", "source_system")
    stages = {
        "people": checker_sql("match_pairs"), **people, "candidates": mp.CANDIDATES,
        "run_pairs": "SELECT c.*, c.a_id || '~' || c.b_id AS pair_id, " + ", ".join(f"{s}.a_{f} AS {s}_{f}" for s in "ab" for f in fields)
        + " FROM candidates c JOIN people a ON a.a_id = c.a_id JOIN people b ON b.a_id = c.b_id",
        **fc.score_ctes("run_pairs", fc._MATCH, {"email": fc._both(lambda s: f"{s}_email")}, full=True), "customer": fc._CUSTOMER,
        "match_pairs": """SELECT r.*, 'CUSTOMER' AS domain, []::VARCHAR[] AS triggered_rules, match_score FROM run_pairs r
          JOIN (SELECT pair_id, match_score FROM customer WHERE match_score >= 0.7e0) USING (pair_id)""",
        **{name: checker_sql(name) for name in SHAPES[1:]}, **EXPLAINED,
    }
    return _nested(stages, """SELECT pair_id, blocks, bound, e.match_score, CASE WHEN e.match_score >= hi THEN 'AUTO_MERGE' WHEN e.match_score >= lo THEN 'REVIEW' ELSE 'NO_MATCH' END AS posture,
      e.policy_version, e.policy_status, recommendation, e.composite_risk_score, decision_confidence_score, e.automation_tier, postal_match_level,
      array_to_string(rules, ',') AS triggered_rules, 'nightly' AS context_id FROM explained e JOIN ready r USING (pair_id)""").replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES: dict = {}
CHECKS = {
    "match_run": _run_check(),
    "match_explain": check(SHAPES, f"""SELECT pair_id, explanation_id, domain, policy_version, policy_status, recommendation, recommended_action, risk_flag, composite_risk_score, composite_risk_band,
      primary_risk_driver, override_count, postal_match_level, address_match_insight, address_similarity_score, match_score, raw_entity_score, adjusted_entity_score, decision_confidence_score,
      automation_tier, automation_readiness_score, automation_readiness_label, {_STATUS} AS automation_policy_status, estimated_false_positive_risk, primary_signal, signals, events,
      array_to_string(rules, ',') AS triggered_rules, 'Raw entity score ' || printf('%.2f', {half_up('raw_entity_score', 2)}) || ', adjusted score ' || printf('%.2f', {half_up('adjusted_entity_score', 2)})
        || ', decision confidence ' || decision_confidence_score || '%, automation tier ' || automation_tier || ', automation readiness ' || automation_readiness_score || '%, final action '
        || final_recommended_action || ', composite risk ' || coalesce(composite_risk_score || '/100', 'unknown') || '.' AS entity_resolution_summary FROM explained""", EXPLAINED),
    "explanation_log": check(SHAPES, f"""SELECT explanation_id, {_MADE('req_')} AS request_id, {_MADE('aud_')} AS audit_packet_id, domain, policy_version, record_a_id, record_b_id,
      record_a_source_system, record_b_source_system, match_score, array_to_string(rules, ',') AS triggered_rules, NULL::DOUBLE AS ai_confidence, risk_flag, recommended_action,
      final_recommended_action, automation_readiness_score, automation_readiness_label, {_STATUS} AS automation_policy_status, estimated_false_positive_risk, composite_risk_score,
      composite_risk_band, primary_risk_driver, decision_confidence_score, automation_tier, primary_signal, NULL::TIMESTAMP AS feedback_at, TIMESTAMP '2001-11-05 00:00:00' AS created_at,
      {', '.join(f'NULL::VARCHAR AS {c}' for c in _EMPTY)} FROM explained""", EXPLAINED),
}

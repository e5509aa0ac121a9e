"""Confidence, evidence, intake, search, ticket and payload queries and the SQL they are checked against."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from concord.operators import confidence as co
from concord.operators import intake, search, tickets
from concord.operators import scoring as sc
from concord.operators.evidence import EVIDENCE, evidence_text
from concord.operators.payload import normalize_payload
from concord.operators.signals import ENTITY_ID_FIELDS
from concord.plans import explain as ex
from concord.plans import match_run as run
from concord.plans.checks import check, half_up
from concord.plans.feedback_plans import AS_OF, history
from concord.plans.matching_plans import MAPPING
from concord.plans.policy_plans import tables
from concord.plans.quality_plans import rounded
from concord.sources.shaped import shaped, spread

GATE_DAY = dt.date(2024, 1, 15)
SEARCH = ("product", "RING brand#2")


def _given(s, d):
    """Pairs with given signals, scored from them."""
    return sc.score_pairs(spread(shaped(s, d, "scored_pairs")))


def _confident(s, d):
    return co.decision_confidence(_given(s, d).withColumn("entity_score", F.coalesce("match_score", F.lit(0.0))))


def _explained(s, d, name="match_pairs"):
    return ex.match_explain(spread(shaped(s, d, name)), *tables(s, d), history(s, d), AS_OF)


def _explain(s, d):
    out = _explained(s, d)
    return rounded(out.select(
        "pair_id", "explanation_id", "domain", "policy_version", "policy_status", "recommendation", "recommended_action", "risk_flag",
        "composite_risk_score", "composite_risk_band", "primary_risk_driver", "override_count", "postal_match_level", "address_match_insight",
        "address_similarity_score", "match_score", "raw_entity_score", "adjusted_entity_score", "decision_confidence_score", "automation_tier",
        "automation_readiness_score", "automation_readiness_label", "automation_policy_status", "estimated_false_positive_risk",
        "primary_signal", F.size("signal_packets").alias("signals"), F.size("evidence_timeline").alias("events"),
        F.array_join("triggered_rules", ",").alias("triggered_rules"), "entity_resolution_summary"))


def _timeline(s, d):
    """Timeline events of the pairs with given signals; their sentences are left out."""
    df = co.with_signal_packets(co.automation_readiness(_confident(s, d)))
    df = df.withColumn("evidence_timeline", co.evidence_timeline(df))
    return rounded(co.one_row_per_entry(df, "evidence_timeline").drop("detail"))


def _events(s, d):
    """Given event lists, one row per event, with what stands for absent fields."""
    df = spread(shaped(s, d, "given_events"))
    return df.select("packet_id", F.posexplode(co.given_events(F.col("events"))).alias("at", "e")).select("packet_id", "at", "e.*")


def _answers(s, d):
    """What the model answers say of the rules of each pair, the member id rule included."""
    said = normalize_payload(shaped(s, d, "pair_payloads"))
    pairs = shaped(s, d, "match_pairs").join(said.select("pair_id", "rule_analysis"), "pair_id", "left")
    items = F.transform("rule_analysis", lambda r: F.concat_ws("/", r["rule"], r["impact"], r["reason"]))
    return co.add_member_id_rule(pairs).select(
        "pair_id", F.array_join("triggered_rules", ",").alias("triggered_rules"), F.array_join(items, ";").alias("rule_analysis"))


def _run(s, d):
    """The batch run over one side of the pairs, under the customer policy."""
    out = run.match_run(shaped(s, d, "match_pairs"), run.RunConfig(MAPPING, context_id="nightly"), *tables(s, d), history(s, d), AS_OF)
    return rounded(out.select(
        "pair_id", "blocks", "bound", "match_score", "posture", "policy_version", "policy_status", "recommendation", "composite_risk_score",
        "decision_confidence_score", "automation_tier", "postal_match_level", F.array_join("triggered_rules", ",").alias("triggered_rules"), "context_id"))


def _log(s, d):
    return ex.explanation_log(_explained(s, d), AS_OF).withColumn("triggered_rules", F.array_join("triggered_rules", ","))


def _payloads(s, d):
    out = normalize_payload(spread(shaped(s, d, "raw_payloads")))
    items = F.transform("rule_analysis", lambda r: F.concat_ws("/", r["rule"], r["impact"], r["reason"]))
    return out.select("payload_id", "parsed", "ai_decision", "confidence", "risk_flag", "recommended_action", "explanation_summary",
                      F.array_join(items, ";").alias("rule_analysis"))


def _gate(s, d):
    return intake.stage_gate(shaped(s, d, "stage_gate_records"), GATE_DAY).select(
        "record_key", "domain", "source_system", F.array_join("issues", "; ").alias("issues"), "stage_gate_status", "recommendation",
        "governance_risk_score", "risk_band", "automation_readiness", "steward_action", "source_trust_score", "deterministic_strength",
        "automation_readiness_score", "automation_decision")


def _evidence(s, d):
    frames = [(lambda p: p.select("pair_id", evidence_text(p).alias("evidence")))(shaped(s, d, n)) for n in
              ("match_pairs", "product_pairs")]
    return frames[0].unionByName(frames[1])


QUERIES = {
    "score_from_signals": lambda s, d: rounded(_given(s, d).select("pair_id", "learning_score", "entity_score")),
    "learning_adjustment": lambda s, d: shaped(s, d, "scored_pairs").select(
        "pair_id", sc.learning_adjustment(F.col("override_rate")).alias("learning_adjustment"),
        sc.learning_score(F.col("override_rate")).alias("learning_score")),
    "decision_confidence": lambda s, d: rounded(_confident(s, d).select(
        "pair_id", "risk_multiplier", "raw_entity_score", "adjusted_entity_score", "decision_confidence_score", "primary_signal")),
    "signal_contributions": lambda s, d: rounded(co.one_row_per_entry(_confident(s, d), "signal_contributions")),
    "signal_packets": lambda s, d: rounded(co.one_row_per_entry(co.with_signal_packets(_given(s, d)), "signal_packets").drop("detail")),
    "automation_readiness": lambda s, d: co.automation_readiness(_confident(s, d)).select(
        "pair_id", "automation_tier", "final_recommended_action", "automation_readiness_score", "automation_readiness_label",
        "automation_policy_status", "estimated_false_positive_risk"),
    "evidence_timeline": _timeline,
    "match_explain": _explain,
    "match_run": _run,
    "given_events": _events,
    "member_id_rule_analysis": _answers,
    "member_id_rule": lambda s, d: co.add_member_id_rule(shaped(s, d, "scored_pairs")).select(
        "pair_id", F.array_join("triggered_rules", ",").alias("triggered_rules")),
    "stage_gate": _gate,
    "record_search": lambda s, d: search.record_search(shaped(s, d, "search_index"), *SEARCH),
    "record_search_batch": lambda s, d: search.search_many(*search.postings(shaped(s, d, "search_index")), shaped(s, d, "search_queries")),
    "governance_tickets": lambda s, d: (lambda t: t.withColumn("labels", F.array_join("labels", ",")))(
        tickets.governance_tickets(shaped(s, d, "explanations"))),
    "normalize_ai_payload": _payloads,
    "evidence_text": _evidence,
    "explanation_log": _log,
}

D = "upper(trim(domain))"
ADJ = """CASE WHEN override_rate IS NULL THEN 0e0 WHEN override_rate >= 0.3e0 THEN -0.1e0 WHEN override_rate >= 0.15e0 THEN -0.06e0
  WHEN override_rate >= 0.05e0 THEN -0.03e0 ELSE 0.02e0 END"""
LEARN = f"greatest(0e0, least(1e0, 1e0 + {ADJ}))"


def _sum(domain: str) -> str:
    out = "0e0"
    for k, w in sc.SCORE_WEIGHTS[domain].items():
        v = "coalesce(human_id_score, 0.5e0)" if k == "human_id" else f"{k}_score"
        out += f" + {v} * {w}e0"
    return f"({out})"


SCORED = {
    "sp": f"SELECT *, {LEARN} AS learning_score, {D} AS dom FROM scored_pairs",
    "sums": f"""SELECT *, CASE dom WHEN 'CUSTOMER' THEN {_sum('CUSTOMER')} WHEN 'SUPPLIER' THEN {half_up(_sum('SUPPLIER'), 2)} WHEN 'PRODUCT' THEN {half_up(_sum('PRODUCT'), 4)}
      WHEN 'PROVIDER' THEN {_sum('PROVIDER')} WHEN 'PATIENT' THEN {_sum('PATIENT')} ELSE {half_up(_sum('OTHER'), 2)} END AS s FROM sp""",
    "scores": """SELECT *, CASE dom
      WHEN 'CUSTOMER' THEN CASE WHEN dob_score = 1 AND address_score >= 0.95e0 AND name_seq_score >= 0.85e0 THEN greatest(s, 0.82e0)
        WHEN dob_score = 1 AND name_seq_score >= 0.9e0 THEN greatest(s, 0.78e0) ELSE s END
      WHEN 'SUPPLIER' THEN CASE WHEN supplier_id_score = 1 AND tax_id_score = 1 THEN greatest(s, 0.98e0) WHEN supplier_id_score = 1 THEN greatest(s, 0.94e0)
        WHEN tax_id_score = 1 THEN greatest(s, 0.9e0) ELSE s END
      WHEN 'PROVIDER' THEN least(1e0, s + CASE WHEN provider_email_score >= 1 AND name_score >= 0.85e0 AND address_score >= 0.9e0 THEN 0.15e0
        WHEN name_score >= 0.9e0 AND address_score >= 0.9e0 THEN 0.1e0 WHEN provider_email_score >= 1 AND name_score >= 0.8e0 THEN 0.08e0 ELSE 0e0 END)
      WHEN 'PATIENT' THEN least(0.92e0, CASE WHEN patient_id_score >= 0.9e0 AND dob_score = 1 AND name_score >= 0.9e0 AND address_score >= 0.95e0 THEN least(greatest(s, 0.9e0), 0.92e0)
        WHEN patient_id_score >= 0.9e0 AND dob_score = 1 AND name_score >= 0.85e0 THEN least(greatest(s, 0.86e0), 0.9e0) ELSE s END)
      ELSE s END AS entity_score FROM sums""",
}


def _of_domain(domain: str) -> str:
    others = "('SUPPLIER', 'PRODUCT', 'PROVIDER', 'PATIENT')"
    return f"dom NOT IN {others}" if domain == "CUSTOMER" else f"dom = '{domain}'"


def _long(make, lists) -> str:
    rows = []
    for domain, names in lists.items():
        for i, name in enumerate(names):
            rows.append(make(domain, i, name))
    return " UNION ALL ".join(rows)


def _contribution(domain: str, i: int, name: str) -> str:
    w = sc.SIGNAL_WEIGHTS[domain][name]
    return f"SELECT pair_id, {i} AS i, '{name}' AS signal_name, greatest(0e0, least(1e0, coalesce({co.SIGNAL_COLUMNS[name]}, 0e0))) AS sc, {w}e0 AS w FROM sp WHERE {_of_domain(domain)}"


CONFIDENT = {
    "sp": SCORED["sp"],
    "long": _long(_contribution, sc.SIGNAL_WEIGHTS),
    "contr": f"""SELECT pair_id, i, signal_name, {half_up('sc', 4)} AS score, w AS weight, {half_up('sc * w', 4)} AS contribution, {half_up('sc * w * 100e0', 2)} AS contribution_pct FROM long""",
    "per": "SELECT pair_id, list_sum(list(contribution ORDER BY i)) AS total, first(signal_name ORDER BY contribution DESC, i) AS primary_signal FROM contr GROUP BY 1",
    "mult": """SELECT *, CASE WHEN composite_risk_score IS NULL THEN 1e0 ELSE round(1e0 - greatest(0e0, least(100e0, CAST(composite_risk_score AS DOUBLE))) / 100e0 * 0.45e0, 4) END AS m,
      coalesce(match_score, 0e0) AS es FROM sp""",
    "conf": f"""SELECT mult.*, primary_signal, {half_up('es * m', 4)} AS raw, CAST(greatest(0, least(100, round_even({half_up("""CASE WHEN dom IN ('SUPPLIER', 'PRODUCT', 'PROVIDER') THEN es * greatest(m, 0.9e0) * 100e0
      WHEN dom = 'PATIENT' THEN es * m * 100e0 ELSE total / 1.0e0 * m * 100e0 END""", 2)}, 0))) AS INTEGER) AS conf FROM mult JOIN per USING (pair_id)""",
}
READY = {
    **CONFIDENT,
    "tier": """SELECT *, CASE WHEN conf >= 95 THEN 'AUTO_MERGE_READY' WHEN conf >= 85 THEN 'SUGGESTED_MERGE' WHEN conf >= 65 THEN 'REVIEW_ADVISED' ELSE 'DO_NOT_AUTOMATE' END AS automation_tier,
      coalesce(upper(trim(recommended_action)), CASE WHEN conf >= 95 THEN 'AUTO_MERGE' WHEN conf >= 85 THEN 'APPROVE_MERGE' WHEN conf >= 65 THEN 'REVIEW_REQUIRED' ELSE 'BLOCK_MERGE' END) AS final_recommended_action,
      greatest(0e0, least(100e0, CAST(coalesce(nullif(composite_risk_score, 0), 50) AS DOUBLE))) AS risk FROM conf""",
    "ready": """SELECT *, CAST(greatest(0, least(100, round_even(conf * 0.55e0 + (100e0 - risk) * 0.35e0 + CASE final_recommended_action WHEN 'AUTO_MERGE' THEN 100 WHEN 'APPROVE_MERGE' THEN 75
      WHEN 'REVIEW_REQUIRED' THEN 45 WHEN 'REVIEW' THEN 45 WHEN 'BLOCK_MERGE' THEN 10 WHEN 'REJECT_MERGE' THEN 10 ELSE 40 END * 0.1e0, 0))) AS INTEGER) AS automation_readiness_score,
      CAST(greatest(0, least(100, round_even(risk * 0.65e0 + (100e0 - conf) * 0.35e0, 0))) AS INTEGER) AS estimated_false_positive_risk FROM tier""",
}


def _tone(name: str, score: str) -> str:
    if name in co.ALL_OR_NOTHING:
        return f"CASE WHEN {score} >= 1 THEN 'positive' ELSE 'warning' END"
    steps = {"contact_email_match": (0.97, 0.7), "source_trust": (0.85, 0.65), "name_similarity": (0.95, 0.7),
             "address_similarity": (0.95, 0.7), "attribute_similarity": (0.95, 0.7)}.get(name)
    return f"CASE WHEN {score} >= {steps[0]}e0 THEN 'positive' WHEN {score} >= {steps[1]}e0 THEN 'neutral' ELSE 'warning' END" if steps else "'neutral'"


def _band(name: str) -> str:
    plain = "CASE WHEN sc >= 0.95e0 THEN 'EXACT' WHEN sc >= 0.7e0 THEN 'SIMILAR' WHEN sc >= 0.5e0 THEN 'FUZZY' ELSE 'DIFFERENT' END"
    if name in co.LEVELLED:
        return "email_level"
    if name in co.ID_BANDED:
        low = "'DIFFERENT'" if name in ("product_id_match", "sku_match") else plain
        return f"CASE WHEN sc >= 0.999e0 THEN 'EXACT' WHEN sc >= 0.85e0 THEN 'SIMILAR' ELSE {low} END"
    return plain


def _packet(domain: str, i: int, name: str) -> str:
    column = "name_seq_score" if (domain, name) == ("CUSTOMER", "name_similarity") else co.SIGNAL_COLUMNS[name]
    w = sc.SIGNAL_WEIGHTS[domain][name]
    return f"""SELECT pair_id, '{name}' AS signal_name, {half_up('sc', 4)} AS signal_score, {w}e0 AS signal_weight, {half_up(f'sc * {w}e0', 4)} AS weighted_score,
      {_band(name)} AS signal_band, {_tone(name, half_up('sc', 4))} AS tone,
      CASE WHEN sc >= 0.95e0 THEN 'HIGH' WHEN sc >= 0.5e0 THEN 'MEDIUM' ELSE 'LOW' END AS signal_impact
      FROM (SELECT *, greatest(0e0, least(1e0, coalesce({column}, 0.5e0))) AS sc FROM sp WHERE dom = '{domain}')"""


def _event_row(domain: str, i: int, name: str) -> str:
    column = "name_seq_score" if (domain, name) == ("CUSTOMER", "name_similarity") else co.SIGNAL_COLUMNS[name]
    steps = {True: (("0.99e0", "Exact Match"), ("0.85e0", "Similar"), ("0", "Not Matched"))}.get(name in co.GRADED_IDS)
    if steps is None:
        steps = ((("1", "Exact Match"), ("0", "Not Matched")) if name in co.DETERMINISTIC
                 else (("0.85e0", "Strong"), ("0.7e0", "Partial"), ("0", "Weak")))
    grade = "CASE " + " ".join(f"WHEN shown >= {floor} THEN '{word}'" for floor, word in steps) + " END"
    return f"""SELECT pair_id, {i} AS ord, 'SIGNAL' AS stage, '{co.SIGNAL_TITLES[name]} ' || grade AS title,
      CASE WHEN grade IN ('Exact Match', 'Strong') THEN 'positive' WHEN grade IN ('Similar', 'Partial') THEN 'neutral' ELSE 'warning' END AS tone, '{name}' AS signal_name,
      shown AS signal_score, NULL AS policy_rule, NULL AS impact FROM (SELECT *, {grade} AS grade FROM (SELECT pair_id, {half_up(f'greatest(0e0, least(1e0, coalesce({column}, 0.5e0)))', 4)} AS shown
      FROM sp WHERE dom = '{domain}'))"""


def _closing(i: int, stage: str, title: str, tone: str, signal: str, score: str, rule: str = "NULL") -> str:
    return f"""SELECT pair_id, {100 + i} AS ord, '{stage}', '{title}', {tone}, {signal}, {score}, {rule}, 'HIGH' FROM ready WHERE len(triggered_rules) > 0"""


TIMELINE = {
    **READY,
    "events_of": " UNION ALL ".join([
        _long(_event_row, {k: [n for n in v if n != "email_match"] for k, v in co.SHOWN_SIGNALS.items()}),
        _closing(0, "POLICY", "Policy Rules Applied", "'neutral'", "NULL", "0e0", "array_to_string(triggered_rules, ',')"),
        _closing(1, "RISK", "Composite Risk Calculated", "'neutral'", "NULL", "coalesce(composite_risk_score, 0) / 100e0"),
        _closing(2, "AUTOMATION", "Automation Readiness Calculated",
                 "CASE WHEN automation_readiness_score >= 85 THEN 'positive' WHEN automation_readiness_score < 60 THEN 'warning' ELSE 'neutral' END",
                 "primary_signal", "automation_readiness_score / 100e0"),
        _closing(3, "DECISION", "Recommended Action Produced",
                 "CASE WHEN final_recommended_action IN ('APPROVE_MERGE', 'AUTO_MERGE') THEN 'positive' WHEN final_recommended_action IN ('REJECT_MERGE', 'BLOCK_MERGE') THEN 'warning' ELSE 'neutral' END",
                 "primary_signal", "conf / 100e0"),
    ]),
}


def _evidence_sql(table: str, have: set[str]) -> str:
    """Evidence lines of one pair table that has the fields ``have``."""
    def field(side: str, names) -> str:
        found = [f"nullif(trim({side}_{n}), '')" for n in names if n in have]
        return f"coalesce({', '.join([*found, chr(39) + 'N/A' + chr(39)])})"

    def block(domain: str, side: str) -> str:
        label, lines = EVIDENCE[domain]
        out = [f"'Record {side.upper()} {label}Evidence:'"]
        for name, fields in lines:
            names = [n for f in fields for n in (ENTITY_ID_FIELDS.get(domain, ("member_id",)) if f == "@id" else (f,))]
            out.append(f"'- {name}: ' || {field(side, names)}")
        return f"concat_ws(chr(10), {', '.join(out)})"

    whole = {k: f"{block(k, 'a')} || chr(10) || chr(10) || {block(k, 'b')}" for k in EVIDENCE}
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in whole.items() if k != "OTHER")
    return f"SELECT pair_id, CASE {D} {cases} ELSE {whole['OTHER']} END AS evidence FROM {table}"


_PERSON = {"member_id", "first_name", "last_name", "dob", "email", "address", "source_system"}

_PLACEHOLDER = "('test', 'dummy', 'fake', 'unknown', 'na', 'n/a')"
GATE = {
    "t": "SELECT *, " + ", ".join(f"trim(coalesce({c}, '')) AS {k}" for c, k in
                                  (("first_name", "fn"), ("last_name", "ln"), ("dob", "bd"), ("email", "em"), ("address", "ad")))
    + ", coalesce(source_system, 'None') AS src FROM stage_gate_records",
    "u": f"""SELECT *, list_filter([CASE WHEN fn = '' THEN 'Missing first_name' END, CASE WHEN ln = '' THEN 'Missing last_name' END, CASE WHEN bd = '' THEN 'Missing dob' END,
      CASE WHEN ad = '' THEN 'Missing address' END, CASE WHEN bd <> '' AND NOT regexp_matches(bd, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'Invalid dob format. Expected YYYY-MM-DD' END,
      CASE WHEN em <> '' AND NOT regexp_matches(em, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN 'Invalid email format' END,
      CASE WHEN src NOT IN ('ERP', 'CRM', 'MDM', 'Epic', 'Cerner') THEN 'Unauthorized source system: ' || src END,
      CASE WHEN lower(fn) IN {_PLACEHOLDER} THEN 'Test or dummy first_name detected' END, CASE WHEN lower(ln) IN {_PLACEHOLDER} THEN 'Test or dummy last_name detected' END,
      CASE WHEN bd <> '' AND 2024 - try_cast(substr(bd, 1, 4) AS INTEGER) < 18 THEN 'Underage patient detected' END,
      CASE WHEN src IN ('LegacyFlatFile', 'UnknownVendor') THEN 'Restricted source system: ' || src END,
      CASE WHEN domain = 'PATIENT' AND em = '' AND ad = '' THEN 'Insufficient patient contact attributes' END], lambda x: x IS NOT NULL) AS iss FROM t""",
    "v": """SELECT *, CAST(least(100, coalesce(list_sum(list_transform(iss, lambda x: CASE WHEN contains(x, 'Missing') THEN 10 WHEN contains(x, 'Invalid') THEN 15
      WHEN contains(x, 'Restricted') THEN 30 WHEN contains(x, 'Underage') THEN 40 WHEN contains(lower(x), 'dummy') THEN 25 ELSE 10 END)), 0)) AS INTEGER) AS risk,
      CASE src WHEN 'Epic' THEN 1e0 WHEN 'Cerner' THEN 0.95e0 WHEN 'MDM' THEN 0.98e0 WHEN 'ERP' THEN 0.9e0 WHEN 'CRM' THEN 0.8e0 ELSE 0.5e0 END AS trust,
      CASE WHEN domain = 'PATIENT' THEN CASE WHEN patient_id <> '' THEN 0.5e0 ELSE 0e0 END + CASE WHEN dob <> '' THEN 0.2e0 ELSE 0e0 END
        WHEN domain = 'PROVIDER' THEN CASE WHEN provider_id <> '' THEN 0.4e0 ELSE 0e0 END + CASE WHEN npi <> '' THEN 0.4e0 ELSE 0e0 END ELSE 0e0 END AS strength FROM u""",
    "w": f"SELECT *, {half_up('(100 - risk) * 0.4e0 + trust * 100 * 0.2e0 + strength * 100 * 0.4e0', 2)} AS ready FROM v",
}


def _text(path: str, default: str) -> str:
    return f"trim(CASE WHEN json_type(j, '{path}') = 'NULL' THEN 'None' ELSE coalesce(json_extract_string(j, '{path}'), '{default}') END)"


def _item(path: str, default: str) -> str:
    return f"coalesce(nullif(trim(coalesce(json_extract_string(x, '{path}'), '{default}')), ''), '{default}')"


_DECISIONS = "('AUTO_MERGE', 'APPROVE_MERGE', 'REVIEW', 'REVIEW_REQUIRED', 'REJECT_MERGE', 'BLOCK_MERGE')"
PAYLOAD = {
    "tx": """SELECT payload_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(coalesce(raw_text, '')), '^(?i)```json\\s*', ''), '^```\\s*', ''), '\\s*```$', '')) AS t FROM raw_payloads""",
    "js": """SELECT payload_id, CASE WHEN suffix(t, '}') AND json_valid(t) THEN CAST(t AS JSON) WHEN json_valid(regexp_extract(t, '\\{(?s:.*)\\}')) AND regexp_extract(t, '\\{(?s:.*)\\}') <> ''
      THEN CAST(regexp_extract(t, '\\{(?s:.*)\\}') AS JSON) END AS j FROM tx""",
    "dec": f"SELECT *, CASE WHEN upper({_text('$.ai_decision', 'REVIEW')}) IN {_DECISIONS} THEN upper({_text('$.ai_decision', 'REVIEW')}) ELSE 'REVIEW' END AS ad FROM js",
}

CHECKS = {
    "score_from_signals": check(["scored_pairs"], "SELECT pair_id, learning_score, round(entity_score, 6) AS entity_score FROM scores", SCORED),
    "learning_adjustment": check(["scored_pairs"], f"SELECT pair_id, {ADJ} AS learning_adjustment, {LEARN} AS learning_score FROM scored_pairs"),
    "decision_confidence": check(["scored_pairs"], f"""SELECT pair_id, m AS risk_multiplier, raw AS raw_entity_score,
      {half_up(f'greatest(0e0, least(1e0, raw + {ADJ}))', 4)} AS adjusted_entity_score, conf AS decision_confidence_score, primary_signal FROM conf""", CONFIDENT),
    "signal_contributions": check(["scored_pairs"], "SELECT pair_id, signal_name, score, weight, contribution, contribution_pct FROM contr", CONFIDENT),
    "signal_packets": check(["scored_pairs"], _long(_packet, co.SHOWN_SIGNALS), {"sp": SCORED["sp"]}),
    "automation_readiness": check(["scored_pairs"], """SELECT pair_id, automation_tier, final_recommended_action, automation_readiness_score,
      CASE WHEN automation_readiness_score >= 85 THEN 'HIGH_AUTOMATION_READINESS' WHEN automation_readiness_score >= 60 THEN 'MODERATE_AUTOMATION_READINESS' ELSE 'LOW_AUTOMATION_READINESS' END AS automation_readiness_label,
      CASE final_recommended_action WHEN 'AUTO_MERGE' THEN 'ELIGIBLE_FOR_AUTO_MERGE' WHEN 'APPROVE_MERGE' THEN 'APPROVAL_READY' WHEN 'BLOCK_MERGE' THEN 'BLOCKED_BY_POLICY'
        WHEN 'REJECT_MERGE' THEN 'BLOCKED_BY_POLICY' ELSE 'MANUAL_REVIEW_REQUIRED' END AS automation_policy_status, estimated_false_positive_risk FROM ready""", READY),
    "evidence_timeline": check(["scored_pairs"], """SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS INTEGER) AS step, stage, title, tone, signal_name,
      round(signal_score, 6) AS signal_score, CAST(policy_rule AS VARCHAR) AS policy_rule, CAST(impact AS VARCHAR) AS impact FROM events_of""", TIMELINE),
    "evidence_text": check(["match_pairs", "product_pairs"], _evidence_sql("match_pairs", _PERSON) + " UNION ALL " + _evidence_sql(
        "product_pairs", {"product_id", "gtin", "sku", "product_name", "product_variant", "pack_size", "effective_lot_date", "source_system"})),
    "member_id_rule": check(["scored_pairs"], """SELECT pair_id, array_to_string(CASE WHEN a_member_id <> '' AND b_member_id <> '' AND lower(trim(a_member_id)) = lower(trim(b_member_id))
      AND NOT list_contains(coalesce(triggered_rules, []), 'MEMBER_ID_EXACT') THEN list_append(coalesce(triggered_rules, []), 'MEMBER_ID_EXACT') ELSE triggered_rules END, ',') AS triggered_rules FROM scored_pairs"""),
    "stage_gate": check(["stage_gate_records"], """SELECT record_key, domain, source_system, array_to_string(iss, '; ') AS issues,
      CASE WHEN len(iss) = 0 THEN 'PASS' WHEN len(iss) <= 2 THEN 'REVIEW' ELSE 'FAIL' END AS stage_gate_status,
      CASE WHEN len(iss) = 0 THEN 'ALLOW_TO_MDM' WHEN len(iss) <= 2 THEN 'ROUTE_TO_STEWARD' ELSE 'BLOCK_FROM_MDM' END AS recommendation, risk AS governance_risk_score,
      CASE WHEN risk <= 20 THEN 'LOW' WHEN risk <= 50 THEN 'MODERATE' WHEN risk <= 75 THEN 'ELEVATED' ELSE 'SEVERE' END AS risk_band, 100 - risk AS automation_readiness,
      CASE WHEN risk >= 75 THEN 'ESCALATE_TO_GOVERNANCE' WHEN risk >= 40 THEN 'ROUTE_TO_STEWARD' ELSE 'AUTO_APPROVE' END AS steward_action, trust AS source_trust_score,
      strength AS deterministic_strength, ready AS automation_readiness_score,
      CASE WHEN ready >= 90 THEN 'AUTO_APPROVE' WHEN ready >= 70 THEN 'REVIEW_REQUIRED' ELSE 'MANUAL_STEWARD_REVIEW' END AS automation_decision FROM w""", GATE),
    "record_search": check(["search_index"], """SELECT * EXCLUDE (search_text) FROM search_index WHERE upper(domain) = 'PRODUCT' AND lower(search_text) LIKE '%ring brand#2%' ORDER BY record_id LIMIT 20"""),
    "record_search_batch": check(["search_index", "search_queries"], """SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY record_id) AS rank, i.* EXCLUDE (search_text)
      FROM search_queries q JOIN search_index i ON upper(i.domain) = upper(q.domain) AND lower(i.search_text) LIKE '%' || lower(q.text) || '%'
      QUALIFY rank <= 20"""),
    "given_events": check(["given_events"], """SELECT packet_id, (i - 1)::INTEGER AS "at", CASE WHEN list_contains(json_keys(e), 'step') THEN CAST(e->>'step' AS INTEGER) ELSE i::INTEGER END AS step,
        CASE WHEN list_contains(json_keys(e), 'stage') THEN e->>'stage' ELSE 'SIGNAL' END AS stage, coalesce(e->>'title', 'Evidence Evaluated') AS title,
        coalesce(e->>'detail', '') AS detail, coalesce(e->>'tone', 'neutral') AS tone, e->>'signal_name' AS signal_name, CAST(e->>'signal_score' AS DOUBLE) AS signal_score,
        e->>'policy_rule' AS policy_rule, e->>'impact' AS impact
      FROM (SELECT packet_id, unnest(list) AS e, generate_subscripts(list, 1) AS i FROM (SELECT packet_id, CAST(events AS JSON[]) AS list
        FROM given_events WHERE starts_with(events, '[')))"""),
    "member_id_rule_analysis": check(["match_pairs", "pair_payloads"], """SELECT pair_id,
        array_to_string(CASE WHEN same THEN list_append(coalesce(triggered_rules, []), 'MEMBER_ID_EXACT') ELSE triggered_rules END, ',') AS triggered_rules,
        CASE WHEN kind = 1 THEN 'MEMBER_ID_EXACT/LOW/given' WHEN kind = 0 AND same THEN said || ';DOB_EXACT/HIGH/same day' WHEN kind = 0 THEN 'DOB_EXACT/HIGH/same day'
          WHEN same THEN said WHEN kind = 4 THEN '' END AS rule_analysis
      FROM (SELECT *, lower(trim(a_member_id)) = lower(trim(b_member_id)) AS same, 'MEMBER_ID_EXACT/HIGH/Exact Member ID match strongly indicates the same member.' AS said,
        CAST(substr(pair_id, 2) AS BIGINT) % 5 AS kind FROM match_pairs JOIN pair_payloads USING (pair_id))"""),
    "governance_tickets": check(["explanations"], f"""SELECT explanation_id, 'Governance Review Required: Unknown (' || coalesce(nullif(upper(risk_flag), ''), 'UNKNOWN') || ' Risk / ' ||
        CASE action WHEN 'AUTO_MERGE' THEN 'Auto Merge' WHEN 'APPROVE_MERGE' THEN 'Approve Merge' WHEN 'BLOCK_MERGE' THEN 'Block Merge' ELSE 'Review Required' END || ')' AS summary,
      concat_ws(chr(10), 'Explanation ID: ' || explanation_id, 'Request ID: ' || coalesce(request_id, 'N/A'), 'Domain: ' || domain, 'Policy Version: ' || policy_version,
        'AI Decision: ' || coalesce(ai_decision, 'N/A'), 'Recommended Action: ' || action, 'Confidence: ' || ai_confidence, 'Risk Flag: ' || risk_flag,
        'Automation Readiness Score: N/A', 'Primary Risk Driver: N/A', 'Explanation Summary: No summary provided.', '{tickets.ACTION_REQUIRED}') AS description, 'data-governance,governance-review,unknown' AS labels
      FROM (SELECT *, coalesce(final_recommended_action, recommended_action) AS action FROM explanations)
      WHERE risk_flag IN ('HIGH', 'CRITICAL') OR action = 'BLOCK_MERGE' OR upper(ai_decision) IN ('BLOCK_MERGE', 'REJECT_MERGE')"""),
    "normalize_ai_payload": check(["raw_payloads"], f"""SELECT payload_id, j IS NOT NULL AS parsed, CASE WHEN j IS NOT NULL THEN ad END AS ai_decision,
      CASE WHEN j IS NOT NULL THEN greatest(0e0, least(1e0, coalesce(try_cast(json_extract_string(j, '$.confidence') AS DOUBLE), 0.5e0))) END AS confidence,
      CASE WHEN j IS NOT NULL THEN CASE WHEN upper({_text('$.risk_flag', 'MEDIUM')}) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper({_text('$.risk_flag', 'MEDIUM')}) ELSE 'MEDIUM' END END AS risk_flag,
      CASE WHEN j IS NOT NULL THEN CASE WHEN upper({_text('$.recommended_action', '')}) IN {_DECISIONS} THEN upper({_text('$.recommended_action', '')}) ELSE ad END END AS recommended_action,
      CASE WHEN j IS NOT NULL THEN coalesce(nullif({_text('$.explanation_summary', 'No explanation returned.')}, ''), 'No explanation returned.') END AS explanation_summary,
      CASE WHEN j IS NOT NULL THEN array_to_string(list_transform(coalesce(CAST(json_extract(j, '$.rule_analysis') AS JSON[]), [])[1:3], lambda x: {_item('$.rule', 'UNKNOWN_RULE')} || '/' ||
        CASE WHEN upper({_item('$.impact', 'MEDIUM')}) IN ('LOW', 'MEDIUM', 'HIGH') THEN upper({_item('$.impact', 'MEDIUM')}) ELSE 'MEDIUM' END || '/' || {_item('$.reason', 'No reason provided.')}), ';') END AS rule_analysis
      FROM dec""", PAYLOAD),
}

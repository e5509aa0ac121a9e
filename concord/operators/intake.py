"""Checks a record has to pass before it enters master data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import ladder, lookup
from concord.functions.text import col_or_null, strip

# Fixed values of the gate.
ALLOWED_SOURCES = ("ERP", "CRM", "MDM", "Epic", "Cerner")
RESTRICTED_SOURCES = ("LegacyFlatFile", "UnknownVendor")
INTAKE_TRUST = {"Epic": 1.0, "Cerner": 0.95, "MDM": 0.98, "ERP": 0.90, "CRM": 0.80}
UNKNOWN_INTAKE_TRUST = 0.50
PLACEHOLDERS = ("test", "dummy", "fake", "unknown", "na", "n/a")
EMAIL_SHAPE = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
DATE_SHAPE = r"(?U)^\d{4}-\d{2}-\d{2}$"
ISSUE_WEIGHTS = (("Missing", 10), ("Invalid", 15), ("Restricted", 30), ("Underage", 40))


def _issue_weight(issue: Column) -> Column:
    out = F
    for word, weight in ISSUE_WEIGHTS:
        out = out.when(F.contains(issue, F.lit(word)), weight)
    return out.when(F.contains(F.lower(issue), F.lit("dummy")), 25).otherwise(10)


def stage_gate(records: DataFrame, as_of: dt.date) -> DataFrame:
    """Adds issues, status, risk, routing and automation readiness. Stateless, so it runs on streams too."""
    text = lambda c: strip(F.coalesce(col_or_null(records, c), F.lit("")))
    given = lambda c: F.coalesce(col_or_null(records, c) != "", F.lit(False))
    first, last, dob, email, address = (text(c) for c in ("first_name", "last_name", "dob", "email", "address"))
    source, domain = col_or_null(records, "source_system"), F.coalesce(F.col("domain"), F.lit(""))
    born = F.substring(dob, 1, 4).try_cast("int")
    underage = F.coalesce(F.lit(as_of.year) - born < 18, F.lit(False))
    named = F.coalesce(source, F.lit("None"))
    placeholder = lambda c: F.lower(c).isin(*PLACEHOLDERS)
    issues = F.array_compact(F.array(
        F.when(first == "", "Missing first_name"),
        F.when(last == "", "Missing last_name"),
        F.when(dob == "", "Missing dob"),
        F.when(address == "", "Missing address"),
        F.when((dob != "") & ~dob.rlike(DATE_SHAPE), "Invalid dob format. Expected YYYY-MM-DD"),
        F.when((email != "") & ~email.rlike(EMAIL_SHAPE), "Invalid email format"),
        F.when(~named.isin(*ALLOWED_SOURCES), F.concat(F.lit("Unauthorized source system: "), named)),
        F.when(placeholder(first), "Test or dummy first_name detected"),
        F.when(placeholder(last), "Test or dummy last_name detected"),
        F.when((dob != "") & underage, "Underage patient detected"),
        F.when(named.isin(*RESTRICTED_SOURCES), F.concat(F.lit("Restricted source system: "), named)),
        F.when((domain == "PATIENT") & (email == "") & (address == ""), "Insufficient patient contact attributes"),
    ))
    df = records.withColumn("issues", issues)
    n = F.size("issues")
    risk = F.least(F.aggregate("issues", F.lit(0), lambda acc, x: acc + _issue_weight(x)), F.lit(100))
    points = lambda test, p: F.when(test, F.lit(p)).otherwise(F.lit(0.0))
    strength = (
        F.when(domain == "PATIENT", points(given("patient_id"), 0.50) + points(given("dob"), 0.20))
        .when(domain == "PROVIDER", points(given("provider_id"), 0.40) + points(given("npi"), 0.40)).otherwise(0.0)
    )
    df = df.withColumns({
        "stage_gate_status": F.when(n == 0, "PASS").when(n <= 2, "REVIEW").otherwise("FAIL"),
        "recommendation": F.when(n == 0, "ALLOW_TO_MDM").when(n <= 2, "ROUTE_TO_STEWARD").otherwise("BLOCK_FROM_MDM"),
        "governance_risk_score": risk,
        "source_trust_score": lookup(named, INTAKE_TRUST, UNKNOWN_INTAKE_TRUST),
        "deterministic_strength": strength,
    })
    score = F.col("governance_risk_score")
    ready = F.round((F.lit(100) - score) * 0.40 + F.col("source_trust_score") * 100 * 0.20 + strength * 100 * 0.40, 2)
    return df.withColumns({
        "risk_band": F.when(score <= 20, "LOW").when(score <= 50, "MODERATE").when(score <= 75, "ELEVATED").otherwise("SEVERE"),
        "automation_readiness": F.greatest(F.lit(100) - score, F.lit(0)),
        "steward_action": ladder(score, [(75, "ESCALATE_TO_GOVERNANCE"), (40, "ROUTE_TO_STEWARD")], "AUTO_APPROVE"),
        "automation_readiness_score": ready,
        "automation_decision": ladder(ready, [(90, "AUTO_APPROVE"), (70, "REVIEW_REQUIRED")], "MANUAL_STEWARD_REVIEW"),
    })

"""Threshold ladders, flags and lookups shared by the jobs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAINS = ("CUSTOMER", "PROVIDER", "SUPPLIER", "PRODUCT", "PATIENT", "LOCATION")

# Decisions that count as a merge, and as a refusal.
MERGE_DECISIONS = ("AUTO_MERGE", "APPROVE_MERGE", "MATCH")
REFUSE_DECISIONS = ("BLOCK_MERGE", "REJECT_MERGE", "NO_MATCH")
VALID_DECISIONS = ("AUTO_MERGE", "APPROVE_MERGE", "REVIEW", "REVIEW_REQUIRED", "REJECT_MERGE", "BLOCK_MERGE")
VALID_RISK_FLAGS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Trust per source system when two records are compared.
SOURCE_TRUST = {
    "MDM": 1.00,
    "ERP": 0.90,
    "CRM": 0.85,
    "PLM": 0.85,
    "PIM": 0.85,
    "SUPPLIER_PORTAL": 0.75,
    "LEGACY": 0.60,
    "BOCA SOUTH": 0.85,
    "BOCA WEST": 0.85,
    "CERNER SOUTH": 0.90,
}
UNKNOWN_SOURCE_TRUST = 0.65

# Risk points per source system in the composite risk.
SOURCE_RISK_POINTS = {"MDM": 0, "ERP": 5, "CRM": 10, "SUPPLIER_PORTAL": 15, "PLM": 8, "PIM": 8, "LEGACY": 20}
UNKNOWN_SOURCE_RISK = 20


def ladder(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose floor the value reaches."""
    out = F
    for floor, label in steps:
        out = out.when(value >= F.lit(floor), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Constant lookup that stays inside code generation."""
    out = F
    for k, v in table.items():
        out = out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def similarity_band(score: Column) -> Column:
    return ladder(score, [(0.95, "EXACT"), (0.70, "SIMILAR"), (0.50, "FUZZY")], "DIFFERENT")


def detail_band(score: Column) -> Column:
    return ladder(score, [(0.95, "EXACT"), (0.80, "STRONG"), (0.60, "FUZZY")], "DIFFERENT")


def email_level(score: Column) -> Column:
    return ladder(score, [(0.99, "EXACT"), (0.90, "SIMILAR"), (0.70, "FUZZY")], "DIFFERENT")


def score_bucket(score: Column, dash: str = "–") -> Column:
    """Score range label. A NULL score falls through to the top range."""
    return (
        F.when(score < 0.80, f"0.00{dash}0.79")
        .when(score < 0.90, f"0.80{dash}0.89")
        .when(score < 0.95, f"0.90{dash}0.94")
        .when(score < 0.98, f"0.95{dash}0.97")
        .otherwise(f"0.98{dash}1.00")
    )


def decision_group(decision: Column) -> Column:
    d = F.upper(decision)
    return F.when(d.isin(*MERGE_DECISIONS), "MATCH").when(d.isin(*REFUSE_DECISIONS), "NO_MATCH").otherwise("REVIEW")


def yes_no(c: Column) -> Column:
    """Any usual spelling of a flag as Y or N, else NULL."""
    t = F.upper(F.trim(c.cast("string")))
    return F.when(t.isin("Y", "YES", "TRUE", "1"), "Y").when(t.isin("N", "NO", "FALSE", "0"), "N")


def flag_is_true(c: Column) -> Column:
    s = c.cast("string")
    return (
        F.when(s.isin("Y", "y", "TRUE", "true", "1"), F.lit(True))
        .when(s.isin("N", "n", "FALSE", "false", "0"), F.lit(False))
        .otherwise(s.try_cast("boolean"))
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL when whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0)))

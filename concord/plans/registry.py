"""All queries and their checks, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "quality_plans", "governance_plans", "feedback_plans", "policy_plans", "matching_plans", "fuzzy_checks", "decision_plans",
    "explain_checks", "stream_plans",
]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(import_module(f"concord.plans.{name}").QUERIES)
    return out


def checks() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"concord.plans.{name}").CHECKS)
    return out

"""Model answers: raw text to a checked structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import VALID_DECISIONS, VALID_RISK_FLAGS, clamp
from concord.functions.text import strip

NO_SUMMARY = "No explanation returned."
MAX_RULES = 3


def _json_text(raw: Column) -> Column:
    """The text without code fences."""
    v = strip(F.coalesce(raw, F.lit("")))
    v = F.regexp_replace(v, r"(?i)^```json\s*", "")
    v = F.regexp_replace(v, r"^```\s*", "")
    return strip(F.regexp_replace(v, r"\s*```$", ""))


def _named(field: str, path: str, default: str) -> Column:
    """A field as text: the default when absent, ``None`` when it is a JSON null, as the checks expect."""
    value = F.expr(f"try_variant_get({field}, '{path}', 'string')")
    is_null = F.expr(f"coalesce(is_variant_null(try_variant_get({field}, '{path}', 'variant')), false)")
    return strip(F.when(is_null, "None").otherwise(F.coalesce(value, F.lit(default))))


def normalize_payload(df: DataFrame, column: str = "raw_text") -> DataFrame:
    """Adds ``parsed`` and the checked fields; a text without readable JSON gets NULLs.

    The whole text is read first; failing that, what lies between its first and last brace.
    """
    df = df.withColumn("_text", _json_text(F.col(column)))
    whole = F.when(F.endswith(F.col("_text"), F.lit("}")), F.try_parse_json("_text"))
    cut = F.try_parse_json(F.regexp_extract(F.col("_text"), r"(?s)\{.*\}", 0))
    df = df.withColumn("_v", F.coalesce(whole, cut))
    df = df.withColumn("parsed", F.coalesce(F.expr("startswith(schema_of_variant(_v), 'OBJECT')"), F.lit(False)))
    upper = lambda path, default: F.upper(_named("_v", path, default))
    one_of = lambda c, allowed, other: F.when(c.isin(*allowed), c).otherwise(other)
    df = df.withColumn("ai_decision", one_of(upper("$.ai_decision", "REVIEW"), VALID_DECISIONS, F.lit("REVIEW")))
    action = F.when(
        F.expr("try_variant_get(_v, '$.recommended_action', 'variant')").isNull(), F.col("ai_decision")
    ).otherwise(upper("$.recommended_action", ""))
    confidence = F.expr("try_variant_get(_v, '$.confidence', 'double')")
    summary = _named("_v", "$.explanation_summary", NO_SUMMARY)
    rules = F.slice(F.coalesce(F.expr("try_variant_get(_v, '$.rule_analysis', 'array<variant>')"), F.array().cast("array<variant>")), 1, MAX_RULES)
    df = df.withColumn("_rules", F.filter(rules, lambda r: F.coalesce(
        F.startswith(F.schema_of_variant(r), F.lit("OBJECT")), F.lit(False))))

    def get(r: Column, path: str, default: str) -> Column:
        value = F.try_variant_get(r, path, "string")
        is_null = F.coalesce(F.is_variant_null(F.try_variant_get(r, path, "variant")), F.lit(False))
        return strip(F.when(is_null, "None").otherwise(F.coalesce(value, F.lit(default))))

    def entry(r: Column) -> Column:
        impact = F.upper(get(r, "$.impact", "MEDIUM"))
        filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
        return F.struct(
            filled(get(r, "$.rule", "UNKNOWN_RULE"), "UNKNOWN_RULE").alias("rule"),
            F.when(impact.isin("LOW", "MEDIUM", "HIGH"), impact).otherwise("MEDIUM").alias("impact"),
            filled(get(r, "$.reason", "No reason provided."), "No reason provided.").alias("reason"))

    fields = {
        "ai_decision": F.col("ai_decision"),
        "confidence": clamp(F.coalesce(confidence, F.lit(0.5)), 0.0, 1.0),
        "risk_flag": one_of(upper("$.risk_flag", "MEDIUM"), VALID_RISK_FLAGS, F.lit("MEDIUM")),
        "recommended_action": one_of(action, VALID_DECISIONS, F.col("ai_decision")),
        "explanation_summary": F.coalesce(F.nullif(summary, F.lit("")), F.lit(NO_SUMMARY)),
        "rule_analysis": F.transform("_rules", entry),
    }
    return df.withColumns({k: F.when(F.col("parsed"), v) for k, v in fields.items()}).drop("_text", "_v", "_rules")

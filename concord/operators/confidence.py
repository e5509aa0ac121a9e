"""From signals and score to confidence, automation readiness and the evidence shown for it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import clamp, detail_band, ladder, lookup, similarity_band
from concord.functions.text import col_or_null, folded
from concord.operators.policy import domain_of
from concord.operators.scoring import SIGNAL_WEIGHTS, learning_adjustment
from concord.operators.signals import Sides, entity_id

# Which signal column feeds which named signal.
SIGNAL_COLUMNS = {
    "member_id_match": "member_id_score", "name_similarity": "name_score", "dob_match": "dob_score",
    "email_match": "email_score", "contact_email_match": "email_score", "address_similarity": "address_score",
    "source_trust": "source_score", "steward_learning": "learning_score", "supplier_id_match": "supplier_id_score",
    "tax_id_match": "tax_id_score", "product_id_match": "product_id_score", "gtin_match": "gtin_score",
    "sku_match": "sku_score", "effective_lot_date_match": "lot_date_score", "attribute_similarity": "attribute_score",
    "provider_id_match": "provider_id_score", "npi_match": "npi_score", "provider_email_match": "provider_email_score",
    "specialty_similarity": "specialty_score", "patient_id_match": "patient_id_score", "human_id_match": "human_id_score",
}

# Signals shown per domain, in the order they are listed.
SHOWN_SIGNALS = {
    "CUSTOMER": ("name_similarity", "member_id_match", "dob_match", "address_similarity", "email_match", "source_trust"),
    "PRODUCT": ("product_id_match", "gtin_match", "sku_match", "name_similarity", "effective_lot_date_match",
                "attribute_similarity", "source_trust"),
    "SUPPLIER": ("supplier_id_match", "name_similarity", "address_similarity", "tax_id_match", "contact_email_match",
                 "source_trust"),
    "PROVIDER": ("provider_id_match", "provider_email_match", "address_similarity", "npi_match", "name_similarity",
                 "source_trust"),
    "PATIENT": ("patient_id_match", "human_id_match", "dob_match", "name_similarity", "email_match", "address_similarity",
                "source_trust"),
}
LEVELLED = ("email_match", "contact_email_match", "provider_email_match")
ID_BANDED = ("product_id_match", "sku_match", "patient_id_match", "provider_id_match")
ALL_OR_NOTHING = (
    "supplier_id_match", "product_id_match", "provider_id_match", "patient_id_match", "member_id_match", "tax_id_match",
    "gtin_match", "npi_match", "human_id_match", "email_match", "dob_match",
)

SIGNAL_TITLES = {
    "supplier_id_match": "Supplier ID", "tax_id_match": "Tax ID", "provider_id_match": "Provider ID",
    "patient_id_match": "Patient ID", "product_id_match": "Product ID", "gtin_match": "GTIN", "npi_match": "NPI",
    "human_id_match": "Human ID", "sku_match": "SKU", "effective_lot_date_match": "Effective / Lot Date",
    "attribute_similarity": "Product Attribute Similarity", "member_id_match": "Member ID", "dob_match": "Date of Birth",
    "contact_email_match": "Contact Email", "provider_email_match": "Provider Email",
    "address_similarity": "Address Similarity", "name_similarity": "Name Similarity",
    "specialty_similarity": "Specialty Similarity", "source_trust": "Source Trust",
}
GRADED_IDS = ("product_id_match", "patient_id_match", "provider_id_match")
DETERMINISTIC = (
    "member_id_match", "patient_id_match", "human_id_match", "provider_id_match", "supplier_id_match", "product_id_match",
    "gtin_match", "sku_match", "effective_lot_date_match", "npi_match", "tax_id_match", "dob_match", "contact_email_match",
    "provider_email_match",
)
SUPPORTING = ("address_similarity", "name_similarity", "specialty_similarity", "source_trust", "attribute_similarity")

ACTION_BONUS = {"AUTO_MERGE": 100, "APPROVE_MERGE": 75, "REVIEW_REQUIRED": 45, "REVIEW": 45, "BLOCK_MERGE": 10, "REJECT_MERGE": 10}
POLICY_STATUS = {
    "AUTO_MERGE": "ELIGIBLE_FOR_AUTO_MERGE", "APPROVE_MERGE": "APPROVAL_READY", "BLOCK_MERGE": "BLOCKED_BY_POLICY",
    "REJECT_MERGE": "BLOCKED_BY_POLICY",
}


def one_row_per_entry(df: DataFrame, column: str, key: str = "pair_id") -> DataFrame:
    """The entries of a list column as rows.

    The outer form is taken on purpose: the plain one adds a filter on the list, which
    copies the expressions behind it down the plan at every step.
    """
    first = df.schema[column].dataType.elementType.names[0]
    return df.select(key, F.inline_outer(column)).where(F.col(first).isNotNull())


def _whole(c: Column) -> Column:
    """Nearest whole number, ties to even, between 0 and 100."""
    return clamp(F.bround(c, 0), 0.0, 100.0).cast("int")


def _present(df: DataFrame, column: str) -> Column:
    return col_or_null(df, column, "double")


def risk_multiplier(risk: Column) -> Column:
    r = clamp(risk.cast("double"), 0.0, 100.0)
    return F.when(risk.isNull(), 1.0).otherwise(F.round(F.lit(1.0) - r / 100.0 * 0.45, 4))


def _by_signal_domain(df: DataFrame, lists: dict[str, Column], otherwise: Column) -> Column:
    """The list of the pair's domain; every other domain gets ``otherwise``."""
    d, out = domain_of(df), F
    for name, value in lists.items():
        out = out.when(d == name, value)
    return out.otherwise(otherwise)


def weights_with(overrides: Mapping[str, Mapping[str, float]] | None) -> dict[str, dict[str, float]]:
    """Published weights with a policy's own values put in, each domain scaled to a sum of 1."""
    out = {}
    for domain, weights in SIGNAL_WEIGHTS.items():
        own = (overrides or {}).get(domain, {})
        merged = {k: max(0.0, min(float(own.get(k, w)), 1.0)) for k, w in weights.items()}
        total = sum(merged.values())
        out[domain] = {k: round(w / total, 6) for k, w in merged.items()} if total > 0 else merged
    return out


def with_contributions(df: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Adds ``signal_contributions``: score, weight and share of every weighted signal of the domain.

    The lists per domain hold plain columns only; what is computed per entry is written once.
    """
    table = weights_with(weights)

    def entry(name: str, weight: float) -> Column:
        return F.struct(F.lit(name).alias("n"), _present(df, SIGNAL_COLUMNS[name]).alias("s"), F.lit(weight).alias("w"))

    lists = {d: F.array(*[entry(n, w) for n, w in per_domain.items()]) for d, per_domain in table.items()}
    picked = _by_signal_domain(df, {d: v for d, v in lists.items() if d != "CUSTOMER"}, lists["CUSTOMER"])

    def weighed(x: Column) -> Column:
        score = clamp(F.coalesce(x["s"], F.lit(0.0)), 0.0, 1.0)
        part = score * x["w"]
        return F.struct(
            x["n"].alias("signal_name"), F.round(score, 4).alias("score"), F.round(x["w"], 4).alias("weight"),
            F.round(part, 4).alias("contribution"), F.round(part * 100.0, 2).alias("contribution_pct"))

    df = df.withColumn("signal_contributions", picked)
    return df.withColumn("signal_contributions", F.transform("signal_contributions", weighed))


def primary_signal(contributions: Column) -> Column:
    """Signal with the largest contribution, the first one among equals."""
    ranked = F.transform(contributions, lambda x, i: F.struct(-x["contribution"], i, x["signal_name"].alias("name")))
    return F.get(F.array_sort(ranked), F.lit(0))["name"]


def decision_confidence(df: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Adds contributions, primary signal, raw and adjusted score and the confidence of 0 to 100.

    Needs the signals, ``entity_score``, ``composite_risk_score`` and ``override_rate``.
    """
    df = with_contributions(df, weights).withColumns({
        "risk_multiplier": risk_multiplier(F.col("composite_risk_score")),
        "learning_adjustment": learning_adjustment(F.col("override_rate")),
    })
    d, match, mult = domain_of(df), F.col("entity_score"), F.col("risk_multiplier")
    weighed = F.aggregate("signal_contributions", F.lit(0.0), lambda acc, x: acc + x["contribution"])
    sums = {k: sum(v.values()) for k, v in weights_with(weights).items()}
    whole = lookup(d, sums, sums["CUSTOMER"])
    confidence = (
        F.when(d.isin("SUPPLIER", "PRODUCT", "PROVIDER"), match * F.greatest(mult, F.lit(0.90)) * 100.0)
        .when(d == "PATIENT", match * mult * 100.0)
        .otherwise(weighed / whole * mult * 100.0)
    )
    raw = F.round(match * mult, 4)
    return df.withColumns({
        "primary_signal": primary_signal(F.col("signal_contributions")),
        "raw_entity_score": raw,
        "adjusted_entity_score": F.round(clamp(raw + F.col("learning_adjustment"), 0.0, 1.0), 4),
        "decision_confidence_score": _whole(F.round(confidence, 2)),
    })


# Floors of the tiers and of the readiness labels.
TIER_FLOORS = {"auto_merge_ready_min": 95, "suggested_merge_min": 85, "review_advised_min": 65}
LABEL_FLOORS = {"high": 85, "moderate": 60}


def automation_readiness(
    df: DataFrame, tiers: Mapping[str, int] | None = None, labels: Mapping[str, int] | None = None
) -> DataFrame:
    """Adds tier, final action, readiness, its label, policy status and false-positive risk.

    A given ``recommended_action`` wins; without one the tier decides. A composite risk of
    0 counts as unknown and weighs 50, like a missing one.
    """
    conf = F.col("decision_confidence_score")
    held = lambda v: max(0, min(int(v), 100))
    auto, suggested, review = (held((tiers or {}).get(k, v)) for k, v in TIER_FLOORS.items())
    high, moderate = (held((labels or {}).get(k, v)) for k, v in LABEL_FLOORS.items())
    tier = ladder(conf, [(auto, "AUTO_MERGE_READY"), (suggested, "SUGGESTED_MERGE"), (review, "REVIEW_ADVISED")],
                  "DO_NOT_AUTOMATE")
    by_tier = lookup(tier, {"AUTO_MERGE_READY": "AUTO_MERGE", "SUGGESTED_MERGE": "APPROVE_MERGE",
                            "REVIEW_ADVISED": "REVIEW_REQUIRED"}, "BLOCK_MERGE")
    given = F.upper(F.trim(F.nullif(col_or_null(df, "recommended_action"), F.lit(""))))
    df = df.withColumns({"automation_tier": tier, "final_recommended_action": F.coalesce(given, by_tier)})
    action, risk = F.col("final_recommended_action"), F.col("composite_risk_score")
    risk = clamp(F.when(risk.isNull() | (risk == 0), 50).otherwise(risk).cast("double"), 0.0, 100.0)
    ready = conf * 0.55 + (F.lit(100.0) - risk) * 0.35 + lookup(action, ACTION_BONUS, 40) * 0.10
    df = df.withColumn("automation_readiness_score", _whole(ready))
    return df.withColumns({
        "automation_readiness_label": ladder(
            F.col("automation_readiness_score"),
            [(high, "HIGH_AUTOMATION_READINESS"), (moderate, "MODERATE_AUTOMATION_READINESS")], "LOW_AUTOMATION_READINESS"),
        "automation_policy_status": lookup(action, POLICY_STATUS, "MANUAL_REVIEW_REQUIRED"),
        "estimated_false_positive_risk": _whole(risk * 0.65 + (F.lit(100.0) - conf) * 0.35),
    })


def signal_tone(name: Column, score: Column) -> Column:
    """How a signal reads: identifiers count only when they agree fully, others by steps."""
    floors = {
        "contact_email_match": (0.97, 0.70), "name_similarity": (0.95, 0.70), "address_similarity": (0.95, 0.70),
        "attribute_similarity": (0.95, 0.70), "source_trust": (0.85, 0.65),
    }
    high, low = (lookup(name, {k: v[i] for k, v in floors.items()}, 0.0) for i in (0, 1))
    return (
        F.when(name.isin(*ALL_OR_NOTHING), F.when(score >= 1.0, "positive").otherwise("warning"))
        .when(name.isin(*floors), F.when(score >= high, "positive").when(score >= low, "neutral").otherwise("warning"))
        .otherwise("neutral")
    )


def signal_band(name: Column, score: Column, level: Column) -> Column:
    """Band of a signal; mailboxes bring their own level, some identifiers have a stricter ladder."""
    plain = similarity_band(score)
    low = F.when(name.isin("product_id_match", "sku_match"), "DIFFERENT").otherwise(plain)
    strict = F.when(score >= 0.999, "EXACT").when(score >= 0.85, "SIMILAR").otherwise(low)
    own = F.when(name.isin(*LEVELLED), level)
    return F.coalesce(own, F.when(name.isin(*ID_BANDED), strict).otherwise(plain))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))


def _lacks(a: Column, b: Column) -> Column:
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return ~(given(a) & given(b))


def _three(a: Column, b: Column, missing: str, same: Column | str, differ: Column | str) -> Column:
    """Text for a comparison in which a side is missing, both agree or both differ."""
    as_col = lambda t: F.lit(t) if isinstance(t, str) else t
    return F.when(_lacks(a, b), missing).when(folded(a) == folded(b), as_col(same)).otherwise(as_col(differ))


# Fields a sentence looks at, by domain where they differ.
TOLD_FIELDS = {
    "dob_match": {"PATIENT": ("patient_dob", "dob"), "": ("dob",)},
    "email_match": {"PATIENT": ("patient_email", "email"), "": ("email",)},
    "provider_email_match": {"": ("provider_email", "email")},
    "contact_email_match": {"": ("contact_email", "email")},
    "gtin_match": {"": ("gtin",)}, "sku_match": {"": ("sku",)}, "npi_match": {"": ("npi",)}, "human_id_match": {"": ("human_id",)},
    "supplier_id_match": {"": ("supplier_id", "member_id")}, "tax_id_match": {"": ("tax_id",)},
    "product_id_match": {"": ("product_id",)}, "provider_id_match": {"": ("provider_id",)},
    "patient_id_match": {"": ("patient_id",)}, "effective_lot_date_match": {"": ("effective_lot_date",)},
    "address_similarity": {"SUPPLIER": ("supplier_address", "address"), "PROVIDER": ("provider_address", "address"),
                           "PATIENT": ("patient_address", "address"), "": ("address",)},
    "first": {"PRODUCT": ("product_name",), "SUPPLIER": ("supplier_name", "first_name"),
              "PROVIDER": ("provider_first_name", "first_name"), "": ("patient_first_name", "first_name")},
    "last": {"PRODUCT": ("product_variant",), "SUPPLIER": (), "PROVIDER": ("provider_last_name", "last_name"),
             "": ("patient_last_name", "last_name")},
}
COMPARED_AS = {
    "supplier_id_match": "Supplier IDs", "tax_id_match": "tax IDs", "product_id_match": "product IDs",
    "provider_id_match": "Provider IDs", "patient_id_match": "Patient IDs", "effective_lot_date_match": "effective / lot dates",
}
# Sentences for a missing side, agreement and difference.
THREE_WAYS = {
    "dob_match": ("dob missing on one or both records.", "dob values match exactly.", "dob values differ."),
    "email_match": ("Email missing on one or both records.", "Email values match exactly.",
                    "Email values partially align or differ."),
    "contact_email_match": ("Supplier contact email missing on one or both records.",
                            "Supplier contact email values match exactly.",
                            "Supplier contact email values partially align or differ."),
    "gtin_match": ("GTIN identifier missing on one or both records.", "GTIN identifiers match exactly.",
                   "GTIN identifiers partially align or differ."),
    "sku_match": ("SKU evidence missing on one or both product records.", "SKU values match exactly.",
                  "SKU values differ across product records."),
}
THREE_WAYS["provider_email_match"] = THREE_WAYS["email_match"]


def _details(df: DataFrame) -> dict[str, Column]:
    """One sentence per signal, for the pair's own domain."""
    f, d = Sides(df), domain_of(df)

    def told(name: str, s: str) -> Column:
        fields = TOLD_FIELDS[name]
        out = F.lit(None).cast("string") if not fields[""] else f.either(s, *fields[""])
        for domain, names in fields.items():
            if domain:
                out = F.when(d == domain, f.either(s, *names) if names else F.lit(None).cast("string")).otherwise(out)
        return out

    pair = lambda name: f.both(lambda s: told(name, s))
    out = {name: _three(*pair(name), *texts) for name, texts in THREE_WAYS.items()}
    for name, what in COMPARED_AS.items():
        a, b = pair(name)
        out[name] = F.concat(F.lit(f"Compared {what} "), _quoted(a), F.lit(" and "), _quoted(b), F.lit("."))
    a, b = f.both(lambda s: entity_id(f, s, d))
    out["member_id_match"] = _three(
        a, b, "Member ID missing on one or both records.",
        F.concat(F.lit("Exact Member ID match detected ("), a, F.lit("). This is a strong deterministic identity signal.")),
        "Member ID values differ.")

    def ended(name: str, what: str, same: str, differ: str, missing: str) -> Column:
        x, y = pair(name)
        start = F.concat(F.lit(f"Compared {what} "), _quoted(x), F.lit(" and "), _quoted(y), F.lit(". "))
        return F.when(_lacks(x, y), missing).otherwise(
            F.concat(start, F.when(folded(x) == folded(y), same).otherwise(differ)))

    out["npi_match"] = ended("npi_match", "provider NPIs", "National Provider Identifier values matched exactly.",
                             "Provider registry identifiers did not align.", "NPI evidence was unavailable for comparison.")
    human = ended("human_id_match", "Immutable human IDs", "Immutable identity anchor matched exactly.",
                  "Immutable identity anchors differed.", "Immutable human ID missing on one record.")
    out["human_id_match"] = F.when(
        F.coalesce(*pair("human_id_match")).isNull(), "Immutable human ID evidence was unavailable for comparison.").otherwise(human)
    out["attribute_similarity"] = F.lit(
        "Compared product descriptors, classifications, and attributes to assess overall product similarity "
        "beyond exact identifier matches.")
    source = lambda s: F.coalesce(F.nullif(f(s, "source_system"), F.lit("")), F.lit("UNKNOWN"))
    out["source_trust"] = F.concat(
        F.lit("Source trust evaluated for "), _quoted(source("a")), F.lit(" and "), _quoted(source("b")), F.lit("."))
    score = clamp(F.coalesce(_present(df, "address_score"), F.lit(0.5)), 0.0, 1.0)
    label = F.when(d == "SUPPLIER", "Supplier addresses").otherwise("Addresses")
    graded = F.concat(label, F.lit(" evaluated using Jaro-Winkler fuzzy matching. Confidence score: "),
                      F.format_string("%.2f", score), F.lit(" ("), detail_band(score), F.lit(")."))
    insight = F.nullif(col_or_null(df, "address_match_insight"), F.lit(""))
    out["address_similarity"] = F.when(
        _lacks(*pair("address_similarity")), "Address or attribute value missing on one or both records."
    ).otherwise(F.coalesce(insight, graded))
    text = lambda name, s: F.coalesce(told(name, s), F.lit(""))
    whole = lambda s: F.concat(F.lit("'"), text("first", s), F.lit(" "), text("last", s), F.lit("'"))
    compared = F.concat(F.lit("Compared name pairs "), whole("a"), F.lit(" and "), whole("b"), F.lit("."))
    close = F.coalesce(_present(df, "name_seq_score"), F.lit(0.5)) >= 0.90
    out["name_similarity"] = F.when(
        d == "CUSTOMER", F.when(close, "Names align closely across records.").otherwise("Names partially align.")
    ).otherwise(compared)
    return out


def with_signal_packets(df: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Adds ``signal_packets``: the shown signals of the pair's domain with weight, band, tone and a sentence.

    Missing evidence scores 0.5 here. Other domains, and providers scored without mailboxes,
    show none. Sentences become columns first and the lists only name columns, which keeps
    the generated code small.
    """
    kept, table = df.columns, weights_with(weights)
    details = _details(df)
    df = df.withColumns({f"_d_{k}": v for k, v in details.items()})

    def entry(domain: str, name: str) -> Column:
        column = "name_seq_score" if (domain, name) == ("CUSTOMER", "name_similarity") else SIGNAL_COLUMNS[name]
        return F.struct(F.lit(name).alias("n"), _present(df, column).alias("s"),
                        F.lit(table[domain][name]).alias("w"), F.col(f"_d_{name}").alias("d"))

    lists = {d: F.array(*[entry(d, n) for n in names]) for d, names in SHOWN_SIGNALS.items()}
    if "provider_scored" in df.columns:
        none = F.filter(lists["PROVIDER"], lambda _: F.lit(False))
        lists["PROVIDER"] = F.when(F.col("provider_scored"), lists["PROVIDER"]).otherwise(none)
    df = df.withColumn("_list", _by_signal_domain(df, lists, F.lit(None)))
    level = col_or_null(df, "email_level")

    def packet(x: Column) -> Column:
        score = clamp(F.coalesce(x["s"], F.lit(0.5)), 0.0, 1.0)
        shown = F.round(score, 4)
        impact = lookup(similarity_band(score), {"EXACT": "HIGH", "SIMILAR": "MEDIUM", "FUZZY": "MEDIUM"}, "LOW")
        return F.struct(
            x["n"].alias("signal_name"), shown.alias("signal_score"), F.round(x["w"], 4).alias("signal_weight"),
            F.round(score * x["w"], 4).alias("weighted_score"), x["d"].alias("detail"),
            signal_band(x["n"], score, level).alias("signal_band"), signal_tone(x["n"], shown).alias("tone"),
            impact.alias("signal_impact"))

    packets = F.transform(F.coalesce("_list", F.array()), packet)
    return df.select(*[c for c in kept if c != "signal_packets"], packets.alias("signal_packets"))


def _event(stage: str, title, detail, tone, signal=None, score=None, rule=None, impact: str | None = None) -> Column:
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    number = score if isinstance(score, Column) else F.lit(score)
    return F.struct(
        text(stage).alias("stage"), text(title).alias("title"), text(detail).alias("detail"), text(tone).alias("tone"),
        text(signal).alias("signal_name"), number.cast("double").alias("signal_score"), text(rule).alias("policy_rule"),
        text(impact).alias("impact"))


def _signal_event(p: Column) -> Column:
    name, score = p["signal_name"], p["signal_score"]
    label = lookup(name, SIGNAL_TITLES, "Signal")
    graded, fixed = name.isin(*GRADED_IDS), name.isin(*DETERMINISTIC)
    grade = (
        F.when(graded, ladder(score, [(0.99, "Exact Match"), (0.85, "Similar")], "Not Matched"))
        .when(fixed, ladder(score, [(1.0, "Exact Match")], "Not Matched"))
        .otherwise(ladder(score, [(0.85, "Strong"), (0.70, "Partial")], "Weak"))
    )
    tone = lookup(grade, {"Exact Match": "positive", "Strong": "positive", "Similar": "neutral", "Partial": "neutral"}, "warning")
    return _event("SIGNAL", F.concat_ws(" ", label, grade), p["detail"], tone, name, score)


def evidence_timeline(df: DataFrame) -> Column:
    """Numbered events: a signal each, the address insight, then policy, risk, automation and decision.

    The last four appear only when rules were triggered.
    """
    shown = F.filter("signal_packets", lambda p: p["signal_name"].isin(*DETERMINISTIC, *SUPPORTING))
    signals = F.transform(shown, _signal_event)
    insight = F.coalesce(col_or_null(df, "address_match_insight"), F.lit(""))
    helps = F.contains(F.lower(insight), F.lit("support")) | F.contains(F.lower(insight), F.lit("highly similar"))
    address = F.array(_event("SIGNAL", "Address Evidence Reviewed", insight, F.when(helps, "positive").otherwise("neutral"),
                             "address_similarity", 0.0, None, "MEDIUM"))
    rules = F.coalesce("triggered_rules", F.array().cast("array<string>"))
    risk, ready, conf = (F.col(c).cast("double") for c in
                         ("composite_risk_score", "automation_readiness_score", "decision_confidence_score"))
    flag = F.coalesce(F.nullif(col_or_null(df, "risk_flag"), F.lit("")), F.lit("UNKNOWN"))
    band, driver = (F.nullif(col_or_null(df, c), F.lit("")) for c in ("composite_risk_band", "primary_risk_driver"))
    action = F.col("final_recommended_action")
    told = F.concat(
        F.lit("Composite risk scored "), F.coalesce(risk.cast("string"), F.lit("0")), F.lit("/100"),
        F.coalesce(F.concat(F.lit(" ("), band, F.lit(")")), F.lit("")), F.lit(" with risk flag "), flag, F.lit("."),
        F.coalesce(F.concat(F.lit(" Primary risk driver: "), driver, F.lit(".")), F.lit("")))
    closing = F.array(
        _event("POLICY", "Policy Rules Applied", F.concat(F.lit("Triggered rules: "), F.array_join(rules, ", "), F.lit(".")),
               "neutral", None, 0.0, F.array_join(rules, ","), "HIGH"),
        _event("RISK", "Composite Risk Calculated", told,
               F.when(F.upper(flag).isin("HIGH", "CRITICAL", "SEVERE", "ELEVATED"), "warning").otherwise("neutral"),
               None, F.coalesce(risk, F.lit(0.0)) / 100.0, None, "HIGH"),
        _event("AUTOMATION", "Automation Readiness Calculated",
               F.concat(F.lit("Automation readiness scored "), ready.cast("string"), F.lit("/100 with status "),
                        F.col("automation_policy_status"), F.lit(".")),
               F.when(ready >= 85, "positive").when(ready < 60, "warning").otherwise("neutral"),
               F.col("primary_signal"), ready / 100.0, None, "HIGH"),
        _event("DECISION", "Recommended Action Produced",
               F.concat(F.lit("The engine selected "), action, F.lit(" with decision confidence "), conf.cast("string"), F.lit("/100.")),
               F.when(action.isin("APPROVE_MERGE", "AUTO_MERGE"), "positive")
               .when(action.isin("REJECT_MERGE", "BLOCK_MERGE"), "warning").otherwise("neutral"),
               F.col("primary_signal"), conf / 100.0, None, "HIGH"),
    )
    empty = F.filter(address, lambda _: F.lit(False))
    events = F.concat(signals, F.when(insight != "", address).otherwise(empty), F.when(F.size(rules) > 0, closing).otherwise(empty))
    fields = ("stage", "title", "detail", "tone", "signal_name", "signal_score", "policy_rule", "impact")
    return F.transform(events, lambda e, i: F.struct((i + 1).alias("step"), *[e[n].alias(n) for n in fields]))


def entity_summary() -> Column:
    """One sentence over scores, tier, readiness, action and risk."""
    risk = F.coalesce(F.concat(F.col("composite_risk_score").cast("string"), F.lit("/100")), F.lit("unknown"))
    return F.concat(
        F.lit("Raw entity score "), F.format_string("%.2f", F.col("raw_entity_score")),
        F.lit(", adjusted score "), F.format_string("%.2f", F.col("adjusted_entity_score")),
        F.lit(", decision confidence "), F.col("decision_confidence_score").cast("string"),
        F.lit("%, automation tier "), F.col("automation_tier"),
        F.lit(", automation readiness "), F.col("automation_readiness_score").cast("string"),
        F.lit("%, final action "), F.col("final_recommended_action"), F.lit(", composite risk "), risk, F.lit("."))


# What is said of pairs whose member ids agree.
MEMBER_ID_RULE = ("MEMBER_ID_EXACT", "HIGH", "Exact Member ID match strongly indicates the same member.")


def add_member_id_rule(df: DataFrame) -> DataFrame:
    """Appends MEMBER_ID_EXACT to the triggered rules when both member ids agree.

    Where the pair carries the ``rule_analysis`` of a model answer, an entry for the rule comes first unless one is there;
    a pair without an answer gets a list of its own.
    """
    a, b = Sides(df).both(lambda s: F.nullif(col_or_null(df, f"{s}_member_id"), F.lit("")))
    same = F.coalesce(a.isNotNull() & b.isNotNull() & (folded(a) == folded(b)), F.lit(False))
    name, impact, reason = MEMBER_ID_RULE
    rules = F.coalesce("triggered_rules", F.array().cast("array<string>"))
    seen = F.coalesce(F.array_contains(rules, name), F.lit(False))
    out = {"triggered_rules": F.when(same & ~seen, F.array_append(rules, name)).otherwise(F.col("triggered_rules"))}
    if "rule_analysis" in df.columns:
        entry = F.struct(F.lit(name).alias("rule"), F.lit(impact).alias("impact"), F.lit(reason).alias("reason"))
        told = F.coalesce("rule_analysis", F.array().cast("array<struct<rule:string,impact:string,reason:string>>"))
        missing = ~F.exists(told, lambda r: F.coalesce(r["rule"] == name, F.lit(False)))
        out["rule_analysis"] = F.when(same & missing, F.concat(F.array(entry), told)).otherwise(F.col("rule_analysis"))
    return df.withColumns(out)


# Fields of given events and signals, their kinds, and what stands for an absent one.
EVENT_FIELDS = {
    "step": ("int", None), "stage": ("string", "SIGNAL"), "title": ("string", "Evidence Evaluated"), "detail": ("string", ""),
    "tone": ("string", "neutral"), "signal_name": ("string", None), "signal_score": ("double", None), "policy_rule": ("string", None),
    "impact": ("string", None),
}
SIGNAL_FIELDS = {
    "signal_name": ("string", None), "signal_score": ("double", None), "signal_weight": ("double", None), "weighted_score": ("double", None),
    "detail": ("string", None), "tone": ("string", None), "signal_band": ("string", None), "signal_rank": ("int", None),
}


def _filled(text: Column, fields: dict[str, tuple[str, str | None]]) -> Column:
    """The objects of a JSON list as structs of ``fields``, read once; what is no list is an empty one.

    An absent field gets its default, one that is null or of another kind stays null; ``step`` counts from 1. Members that are no
    objects are left out.
    """
    given = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(given, lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False)))

    def entry(v: Column, at: Column) -> Column:
        def field(name: str, kind: str, default: str | None) -> Column:
            value = F.try_variant_get(v, f"$.{name}", kind)
            other = (at + 1).cast(kind) if name == "step" else F.lit(default).cast(kind)
            return F.when(F.try_variant_get(v, f"$.{name}", "variant").isNull(), other).otherwise(value).alias(name)
        return F.struct(*[field(n, *f) for n, f in fields.items()])

    return F.transform(objects, entry)


def given_events(text: Column) -> Column:
    """A given timeline, as JSON text, as the events of :func:`evidence_timeline`."""
    return _filled(text, EVENT_FIELDS)


def given_signals(text: Column) -> Column:
    """A given list of signals, as JSON text, with all fields of a signal packet."""
    return _filled(text, SIGNAL_FIELDS)

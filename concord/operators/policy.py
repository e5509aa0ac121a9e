"""Merge policies: which one is active, what it says about a pair, and how it is edited."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.ladders import (
    SOURCE_RISK_POINTS, UNKNOWN_SOURCE_RISK, clamp, ladder, lookup,
)
from concord.functions.text import col_or_null
from concord.sources.tables import update_where, upsert

# Thresholds of a policy that has none.
THRESHOLD_DEFAULTS = {
    "min_review_score": 0.90,
    "min_approve_merge_score": 0.95,
    "min_auto_merge_score": 0.98,
    "max_auto_merge_override_rate": 0.02,
    "max_review_override_rate": 0.10,
    "high_risk_score_cutoff": 0.90,
    "medium_risk_score_cutoff": 0.95,
}
THRESHOLD_FLAGS = {
    "require_exact_dob_flag": "N",
    "require_email_or_address_flag": "N",
    "require_manual_review_on_conflict_flag": "Y",
}
CONFIG_FLAGS = {"default_decision_mode": "REVIEW", "review_required_flag": "Y", "allow_auto_merge_flag": "N"}
DEFAULT_VERSION = "v1"

LEVEL_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
LEVEL_POINTS = {"LOW": 10, "MEDIUM": 30, "HIGH": 50, "CRITICAL": 70}

CONFIG_COLUMNS = (
    "policy_id", "domain", "policy_version", "policy_name", "policy_description", "active_flag", "effective_from",
    "effective_to", "default_decision_mode", "review_required_flag", "allow_auto_merge_flag",
)
THRESHOLD_COLUMNS = (
    "threshold_id", "policy_id", "domain", "policy_version", *THRESHOLD_DEFAULTS, *THRESHOLD_FLAGS, "active_flag",
    "effective_from", "effective_to",
)
RULE_FIELDS = ("triggered_rule", "risk_level", "recommended_action", "override_reason_code", "notes", "risk_weight")

# The seeded policies.
SEED_POLICIES = {
    "CUSTOMER": ("Customer Identity Policy", "Identity resolution governance policy for customer records."),
    "PATIENT": ("Patient Identity Policy", "Patient identity resolution and patient safety governance policy."),
    "PROVIDER": ("Provider Identity Policy", "Provider identity resolution governance policy."),
    "SUPPLIER": ("Supplier Identity Policy", "Supplier identity resolution governance policy."),
    "PRODUCT": ("Product Identity Policy", "Product identity resolution governance policy."),
}
SEED_THRESHOLDS = (0.70, 0.90, 0.97, 0.10, 0.30, 70.0, 35.0)


def domain_of(df: DataFrame) -> Column:
    """Domain as policies spell it; CUSTOMER when a record names none."""
    return F.upper(F.trim(F.coalesce(F.nullif(col_or_null(df, "domain"), F.lit("")), F.lit("CUSTOMER"))))


def in_force(as_of: dt.datetime) -> Column:
    """Active and inside its validity window; an open end never expires."""
    at = F.lit(as_of)
    starts, ends = F.col("effective_from"), F.col("effective_to")
    return (F.col("active_flag") == "Y") & (starts.isNull() | (starts <= at)) & (ends.isNull() | (ends >= at))


def _newest(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("effective_from").desc_nulls_last(), F.col(id_column).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def active_config(configs: DataFrame, as_of: dt.datetime) -> DataFrame:
    return _newest(configs.where(in_force(as_of)), ["domain"], "policy_id")


def active_thresholds(thresholds: DataFrame, as_of: dt.datetime) -> DataFrame:
    return _newest(thresholds.where(in_force(as_of)), ["domain", "policy_version"], "threshold_id")


def active_policy(configs: DataFrame, thresholds: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Newest active config per domain with the active thresholds of its version."""
    limits = active_thresholds(thresholds, as_of).drop("policy_id", "active_flag", "effective_from", "effective_to")
    return active_config(configs, as_of).join(limits, ["domain", "policy_version"], "left")


def with_policy(pairs: DataFrame, configs: DataFrame, thresholds: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Pairs beside their active policy; a pair without one stays and says why in ``policy_status``.

    The policy tables carry no size hint: Spark broadcasts them when they are small and
    otherwise shuffles, splitting a domain that holds too many pairs.
    """
    cfg = active_config(configs, as_of).select(
        F.col("domain").alias("_cd"), F.col("policy_version").alias("_cv"), *CONFIG_FLAGS)
    lim = active_thresholds(thresholds, as_of).select(
        F.col("domain").alias("_td"), F.col("policy_version").alias("_tv"), *THRESHOLD_DEFAULTS, *THRESHOLD_FLAGS)
    asked = F.nullif(F.trim(col_or_null(pairs, "policy_version")), F.lit(""))
    base = pairs.withColumns({"domain": domain_of(pairs), "_asked": asked}).drop("policy_version")
    joined = base.join(cfg, F.col("domain") == F.col("_cd"), "left").withColumn(
        "policy_version", F.coalesce("_asked", F.trim("_cv")))
    joined = joined.join(lim, (F.col("domain") == F.col("_td")) & (F.col("policy_version") == F.col("_tv")), "left")
    status = F.when(F.col("_cd").isNull(), "NO_ACTIVE_CONFIG").when(F.col("_td").isNull(), "NO_ACTIVE_THRESHOLDS").otherwise("OK")
    return joined.withColumn("policy_status", status).drop("_cd", "_cv", "_td", "_tv", "_asked")


def _rule_rows(rules: DataFrame) -> Column:
    """One rule as a struct that sorts by weight, heaviest first, then by name and id."""
    order = F.coalesce(-F.col("risk_weight"), F.lit(float("inf")))
    return F.struct(order.alias("o"), *[F.col(c) for c in (RULE_FIELDS[0], "risk_rule_id", *RULE_FIELDS[1:])])


def matched_risk_rules(pairs: DataFrame, rules: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Pairs with ``matched_rules``: the active rules of their policy version that they triggered.

    ``pairs`` needs ``domain``, ``policy_version`` and ``triggered_rules``; ids play no part. Many pairs trigger the same rules:
    each distinct set of a policy version meets its own rules once, by (domain, version, rule), and pairs take the result
    by their set. So neither a policy of many rules nor many pairs of one set make the work of a pair grow.
    """
    names = ["domain", "policy_version"]
    asked = F.array_sort(F.array_distinct(F.array_compact("triggered_rules")))
    told = pairs.withColumn("_set", F.when(F.size(asked) > 0, asked))
    sets = told.where("_set is not null").select(*[F.col(c).alias(f"_{c}") for c in names], "_set").distinct()
    active = rules.where(in_force(as_of)).where("triggered_rule is not null")
    of_rule = [F.col(c) == F.col(f"_{c}") for c in names] + [F.col("triggered_rule") == F.col("_rule")]
    met = sets.withColumn("_rule", F.explode("_set")).join(active, of_rule)
    found = met.groupBy(*[f"_{c}" for c in names], "_set").agg(F.array_sort(F.collect_list(_rule_rows(active))).alias("matched_rules"))
    found = found.withColumnRenamed("_set", "_found")
    joined = told.join(found, [F.col(c) == F.col(f"_{c}") for c in names] + [F.col("_set") == F.col("_found")], "left")
    empty = F.array().cast(found.schema["matched_rules"].dataType)
    return joined.withColumn("matched_rules", F.coalesce("matched_rules", empty)).drop("_set", "_found", *[f"_{c}" for c in names])


def rule_summary(df: DataFrame) -> DataFrame:
    """Highest level, distinct sorted actions and the heaviest rule of ``matched_rules``."""
    rank = lambda r: lookup(F.upper(r["risk_level"]), LEVEL_RANK, 1)
    top = F.array_max(F.concat(F.array(F.lit(1)), F.transform("matched_rules", rank)))
    level = F.element_at(F.array(*[F.lit(k) for k in LEVEL_RANK]), top)
    action = lambda r: F.upper(F.coalesce(r["recommended_action"], F.lit("NONE")))
    return df.withColumns(
        {
            "highest_risk_level": level,
            "recommended_actions_seen": F.array_sort(F.array_distinct(F.transform("matched_rules", action))),
            "primary_risk_driver": F.get("matched_rules", F.lit(0))["triggered_rule"],
        }
    )


def override_rate_estimate(count: Column) -> Column:
    """Rate assumed from the number of past overrides."""
    return (
        F.when(count <= 0, 0.0).when(count >= 10, 0.30).when(count >= 5, 0.15).when(count >= 2, 0.08)
        .when(count >= 1, 0.03).otherwise(0.0)
    )


def safe_rate(c: Column, default: float, low: float = 0.0, high: float = 1.0) -> Column:
    return clamp(F.coalesce(c.try_cast("double"), F.lit(default)), low, high)


def composite_risk(score: Column, level: Column, source_a: Column, source_b: Column, rate: Column) -> Column:
    """0 to 100: rule level, distance from a full match, difference of sources and past overrides."""
    points = lambda s: lookup(F.upper(F.coalesce(s, F.lit(""))), SOURCE_RISK_POINTS, UNKNOWN_SOURCE_RISK)
    overrides = F.when(rate > 0.30, 30).when(rate > 0.15, 20).when(rate > 0.05, 10).otherwise(0)
    total = (
        lookup(F.upper(level), LEVEL_POINTS, 30).cast("double") + (F.lit(1.0) - score) * 30.0
        + F.abs(points(source_a) - points(source_b)) + overrides
    )
    return clamp(total, 0.0, 100.0).cast("int")


def composite_risk_band(score: Column) -> Column:
    return ladder(score, [(76, "SEVERE"), (51, "ELEVATED"), (26, "MODERATE")], "LOW")


def _is_yes(name: str) -> Column:
    return F.coalesce(F.upper(F.col(name)) == "Y", F.lit(False))


def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def policy_decision(pairs: DataFrame) -> DataFrame:
    """Recommendation, reason and risk per pair.

    Takes pairs after :func:`with_policy`, :func:`matched_risk_rules` and :func:`rule_summary`,
    with ``override_count`` from past cases. A pair without policy gets no recommendation.
    """
    limits = {c: safe_rate(F.col(c), d) for c, d in THRESHOLD_DEFAULTS.items()
              if c.startswith("min_") or c.endswith("_cutoff")}
    over = F.greatest("high_risk_score_cutoff", "medium_risk_score_cutoff") > 1
    df = pairs.withColumns(
        {
            **limits,
            "risk_cutoff_out_of_range": F.coalesce(over, F.lit(False)),
            "decision_score": safe_rate(F.col("match_score"), 0.0),
            "allow_auto_merge": _is_yes("allow_auto_merge_flag"),
            "review_required": _is_yes("review_required_flag"),
            "manual_on_conflict": _is_yes("require_manual_review_on_conflict_flag"),
            "override_rate_estimate": override_rate_estimate(F.col("override_count")),
            "steward_learning_override_count": F.col("override_count"),
        }
    )
    score, level = F.col("decision_score"), F.col("highest_risk_level")
    df = df.withColumn("composite_risk_score", composite_risk(
        score, level, F.col("a_source_system"), F.col("b_source_system"), F.col("override_rate_estimate")))
    risk, actions = F.col("composite_risk_score"), F.col("recommended_actions_seen")
    seen = lambda *names: F.arrays_overlap(actions, F.array(*[F.lit(n) for n in names]))
    below, blocking = score < F.col("min_review_score"), seen("BLOCK", "BLOCK_MERGE")
    df = df.withColumns(
        {
            "composite_risk_band": composite_risk_band(risk),
            "risk_band": F.when(score < F.col("high_risk_score_cutoff"), "HIGH")
            .when(score < F.col("medium_risk_score_cutoff"), "MEDIUM").otherwise("LOW"),
            "blockers": F.array_compact(F.array(
                F.when(below, "MATCH_SCORE_BELOW_REVIEW_THRESHOLD"), F.when(blocking, "POLICY_RISK_RULE_BLOCK"))),
        }
    )
    severe = level.isin("HIGH", "CRITICAL")
    blocked = F.size("blockers") > 0
    conflict = F.col("manual_on_conflict") & (seen("REVIEW", "REVIEW_REQUIRED") | severe | (risk >= 51))
    auto = (score >= F.col("min_auto_merge_score")) & F.col("allow_auto_merge") & (level == "LOW") & (risk <= 25)
    approve = (score >= F.col("min_approve_merge_score")) & level.isin("LOW", "MEDIUM") & (risk <= 50)
    s, out_of = _two(score), F.concat(risk.cast("string"), F.lit("/100"))
    rationale = F.array_compact(F.array(
        F.when(below, F.concat(F.lit("Match score "), s, F.lit(" is below minimum review threshold "),
                               _two(F.col("min_review_score")), F.lit("."))),
        F.when(blocking, "At least one active policy risk rule recommends blocking the merge."),
        F.when(severe, F.concat(F.lit("Highest matched policy risk level is "), level, F.lit("."))),
        F.when(F.col("primary_risk_driver").isNotNull(),
               F.concat(F.lit("Primary risk driver is "), F.col("primary_risk_driver"), F.lit("."))),
        F.when(F.col("override_count") > 0, F.concat(
            F.lit("Steward learning context found "), F.col("override_count").cast("string"),
            F.lit(" prior overrides across similar triggered rules."))),
        F.concat(F.lit("Composite risk score is "), out_of, F.lit(" ("), F.col("composite_risk_band"), F.lit(").")),
        F.when(~blocked, "Policy conflict handling requires manual review for this risk posture."),
    ))
    meets = lambda name, kind: F.concat(F.lit("Match score "), s, F.lit(f" meets {kind} threshold "), _two(F.col(name)))
    reason = (
        F.when(blocked | conflict, F.array_join(rationale, " ; "))
        .when(auto, F.concat(meets("min_auto_merge_score", "auto-merge"),
                             F.lit(", auto-merge is allowed by policy, highest matched risk level is "), level,
                             F.lit(", and composite risk score is "), out_of, F.lit(".")))
        .when(approve & F.col("review_required"), F.concat(
            meets("min_approve_merge_score", "approve-merge"),
            F.lit(", but active policy requires review before merge approval.")))
        .when(approve, F.concat(meets("min_approve_merge_score", "approve-merge"), F.lit(", highest matched risk level is "),
                                level, F.lit(", and composite risk score is "), out_of, F.lit(".")))
        .otherwise(F.concat(meets("min_review_score", "review"),
                            F.lit(" but does not qualify for a stronger automated decision. Composite risk score is "),
                            out_of, F.lit(".")))
    )
    choice = (
        F.when(blocked, "BLOCK_MERGE").when(conflict, "REVIEW_REQUIRED").when(auto, "AUTO_MERGE")
        .when(approve & ~F.col("review_required"), "APPROVE_MERGE").otherwise("REVIEW_REQUIRED")
    )
    known = F.col("policy_status") == "OK"
    return df.withColumns({"recommendation": F.when(known, choice), "recommendation_reason": F.when(known, reason)})


def threshold_guidance(df: DataFrame) -> Column:
    """Where the score stands among the thresholds, as text."""
    score = F.coalesce("match_score", F.lit(0.0))
    review, approve, auto = (safe_rate(F.col(c), THRESHOLD_DEFAULTS[c]) for c in
                             ("min_review_score", "min_approve_merge_score", "min_auto_merge_score"))
    place = (
        F.when(score >= auto, "Current score is in the highest threshold range.")
        .when(score >= approve, "Current score is in the strong approve-merge range.")
        .when(score >= review, "Current score is in the review threshold range.")
        .otherwise("Current score is below preferred review threshold.")
    )
    return F.concat_ws(
        " ",
        F.format_string("Minimum review score: %.2f.", review),
        F.format_string("Minimum approve-merge score: %.2f.", approve),
        F.format_string("Minimum auto-merge score: %.2f.", auto),
        place,
        F.when(_is_yes("require_exact_dob_flag"), "Exact DOB is policy-significant when available."),
        F.when(_is_yes("require_email_or_address_flag"),
               "Email or address support is preferred for stronger approval decisions."),
        F.when(_is_yes("require_manual_review_on_conflict_flag"), "Conflicting evidence should bias toward manual review."),
    )


def risk_rule_guidance(limit: int = 5) -> Column:
    """One line per matched rule, heaviest first."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    filled = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    line = lambda r: F.concat(
        F.lit("- Policy risk rule for "), none(r["triggered_rule"]), F.lit(": risk_level="), none(r["risk_level"]),
        F.lit(", recommended_action="), none(r["recommended_action"]), F.lit(", override_reason_code="),
        filled(r["override_reason_code"], "GENERAL_RISK"), F.lit(". Notes: "), filled(r["notes"], "No additional notes."),
    )
    lines = F.array_join(F.transform(F.slice("matched_rules", 1, limit), line), "\n")
    return F.when(F.size("matched_rules") > 0, lines).otherwise(
        "No active policy risk rules matched the triggered rules for this case.")


def policy_bundle(
    asked: DataFrame, configs: DataFrame, thresholds: DataFrame, rules: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Config, thresholds and rules of each asked (domain, version), active or not, with defaults.

    A request without version means the domain's active one. ``has_active_config`` is false
    for a domain without active policy.
    """
    active = active_config(configs, as_of).select(F.col("domain").alias("_ad"), F.col("policy_version").alias("_av"))
    base = asked.select(domain_of(asked).alias("domain"), F.trim(col_or_null(asked, "policy_version")).alias("_v"))
    base = base.join(active, F.col("domain") == F.col("_ad"), "left").select(
        "domain", F.coalesce(F.nullif("_v", F.lit("")), F.trim("_av")).alias("policy_version"),
        F.col("_ad").isNotNull().alias("has_active_config")).distinct()
    keys = ["domain", "policy_version"]
    cfg = _newest(configs, keys, "policy_id").withColumn("_c", F.lit(True)).select(
        *keys, "_c", "policy_id", "policy_name", "policy_description", *CONFIG_FLAGS,
        F.col("active_flag").alias("config_active_flag"), F.col("effective_from").alias("config_effective_from"),
        F.col("effective_to").alias("config_effective_to"))
    lim = _newest(thresholds, keys, "threshold_id").withColumn("_t", F.lit(True)).select(
        *keys, "_t", "threshold_id", *THRESHOLD_DEFAULTS, *THRESHOLD_FLAGS,
        F.col("active_flag").alias("threshold_active_flag"), F.col("effective_from").alias("threshold_effective_from"),
        F.col("effective_to").alias("threshold_effective_to"))
    lists = rules.groupBy(*keys).agg(F.array_sort(F.collect_list(_rule_rows(rules))).alias("risk_rules"))
    out = base.join(cfg, keys, "left").join(lim, keys, "left").join(lists, keys, "left")
    missing = lambda mark, c, d: F.when(F.col(mark).isNull(), F.lit(d)).otherwise(F.col(c))
    defaults = {c: missing("_c", c, d) for c, d in CONFIG_FLAGS.items()}
    defaults |= {c: missing("_t", c, d) for c, d in {**THRESHOLD_DEFAULTS, **THRESHOLD_FLAGS}.items()}
    defaults |= {"config_active_flag": missing("_c", "config_active_flag", "Y"),
                 "threshold_active_flag": missing("_t", "threshold_active_flag", "Y"),
                 "config_version": F.when(F.col("_c").isNull(), F.lit(DEFAULT_VERSION)).otherwise(F.col("policy_version"))}
    return out.withColumns(defaults).drop("_c", "_t")


def _draft_rows(drafts: DataFrame, bundle: DataFrame) -> DataFrame:
    """Draft edits over the current values; a field the edit leaves out keeps its current value."""
    given = drafts.select(
        domain_of(drafts).alias("domain"), F.trim("policy_version").alias("policy_version"),
        *[F.col(c).alias(f"new_{c}") for c in drafts.columns if c not in ("domain", "policy_version")])
    base = given.join(bundle.where("has_active_config"), ["domain", "policy_version"])
    new = lambda c, t="string": col_or_null(base, f"new_{c}", t)
    made = lambda prefix: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", "domain", "policy_version"), 256), 1, 12))
    filled = lambda c: F.nullif(new(c), F.lit(""))
    rates = {c: safe_rate(F.coalesce(new(c, "double"), F.col(c)), d) for c, d in THRESHOLD_DEFAULTS.items()}
    flags = {c: F.coalesce(new(c), F.col(c), F.lit(d)) for c, d in {**CONFIG_FLAGS, **THRESHOLD_FLAGS}.items()}
    times = {f"{part}_{c}": F.coalesce(new(c, "timestamp"), F.col(f"{part}_{c}"))
             for part in ("config", "threshold") for c in ("effective_from", "effective_to")}
    names = {c: F.coalesce(new(c), F.col(c)) for c in ("policy_name", "policy_description")}
    ids = {"policy_id": F.coalesce(filled("policy_id"), F.col("policy_id"), made("pol_")),
           "threshold_id": F.coalesce(filled("threshold_id"), F.col("threshold_id"), made("thr_"))}
    return base.withColumns({**rates, **flags, **times, **names, **ids, "active_flag": F.lit("N")})


def save_draft(
    drafts: DataFrame, configs: DataFrame, thresholds: DataFrame, rules: DataFrame, as_of: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """New states of the config and threshold tables after saving drafts, one per (domain, version).

    A draft never stays active. Drafts of a domain without active policy are refused.
    """
    rows = _draft_rows(drafts, policy_bundle(drafts, configs, thresholds, rules, as_of))
    out = []
    for table, part, own_id in ((configs, "config", "policy_id"), (thresholds, "threshold", "threshold_id")):
        source = rows.withColumns({c: F.col(f"{part}_{c}") for c in ("effective_from", "effective_to")})
        source = source.select(*table.columns)
        values = {c: F.col(f"s.{c}") for c in table.columns}
        update = {c: v for c, v in values.items() if c not in (own_id, "policy_id", "domain", "policy_version")}
        out.append(upsert(table, source, ["domain", "policy_version"], update, values))
    return out[0], out[1]


@dataclass
class Published:
    """New table states after a publication and how many rows each activation touched."""

    configs: DataFrame
    thresholds: DataFrame
    rules: DataFrame
    counts: DataFrame


def publish(
    configs: DataFrame, thresholds: DataFrame, rules: DataFrame, domain: str, policy_version: str, as_of: dt.datetime
) -> Published:
    """Make one version the only active one of its domain.

    The version is looked up first: publishing one that does not exist changes nothing.
    """
    name, version, now = domain.strip().upper(), policy_version.strip(), F.lit(as_of)
    target = (F.col("domain") == name) & (F.col("policy_version") == version)
    tables = (configs, thresholds, rules)
    if not any(t.where(target).limit(1).count() for t in tables):
        raise ValueError(f"No draft policy found for domain={name}, policy_version={version}")
    off = (F.col("domain") == name) & (F.col("active_flag") == "Y")
    scopes = (off, off, off & (F.col("policy_version") != version))
    states = []
    for table, scope in zip(tables, scopes):
        stopped = update_where(table, scope, {"active_flag": F.lit("N"), "effective_to": now})
        states.append(update_where(stopped, target, {
            "active_flag": F.lit("Y"), "effective_from": F.coalesce("effective_from", now),
            "effective_to": F.lit(None).cast("timestamp")}))
    labels = ("config_rows_activated", "threshold_rows_activated", "risk_rule_rows_activated")
    rows = [t.agg(F.count_if(target).alias(label)) for t, label in zip(tables, labels)]
    counts = rows[0].crossJoin(F.broadcast(rows[1])).crossJoin(F.broadcast(rows[2])).select(
        F.lit("PUBLISHED").alias("status"), F.lit(name).alias("domain"), F.lit(version).alias("policy_version"), *labels)
    return Published(*states, counts)


def seed_configs(spark: SparkSession, as_of: dt.datetime) -> DataFrame:
    rows = [(f"POL-{d}-V1", d, "v1", name, text, "Y", as_of, None, "REVIEW_REQUIRED", "Y", "Y")
            for d, (name, text) in SEED_POLICIES.items()]
    kinds = {"effective_from": "timestamp", "effective_to": "timestamp"}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in CONFIG_COLUMNS))


def seed_thresholds(spark: SparkSession, as_of: dt.datetime) -> DataFrame:
    rows = [(f"THR-{d}-V1", f"POL-{d}-V1", d, "v1", *SEED_THRESHOLDS, "Y" if d == "PATIENT" else "N", "Y", "Y", "Y", as_of, None)
            for d in SEED_POLICIES]
    kinds = {"effective_from": "timestamp", "effective_to": "timestamp", **{c: "double" for c in THRESHOLD_DEFAULTS}}
    return spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in THRESHOLD_COLUMNS))


def seeded(table: DataFrame, seeds: DataFrame) -> DataFrame:
    """The table with the seed rows inserted."""
    return table.unionByName(seeds.select(*table.columns))

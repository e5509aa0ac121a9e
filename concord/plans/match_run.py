"""The batch match run: candidate pairs of a source table, scored and explained under a policy."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import policy as po
from concord.operators.candidates import LEAST, ColumnMapping, paired_records
from concord.operators.scoring import score_pairs
from concord.operators.signals import pair_signals
from concord.plans.explain import match_explain
from concord.sources.tables import stored


@dataclass(frozen=True)
class RunConfig:
    """What a run reads, under which policy, and who asked for it.

    Thresholds that are given stand in place of the policy's. ``records`` are the source object's rows.
    """

    mapping: ColumnMapping
    domain: str = "CUSTOMER"
    policy_version: str | None = None
    auto_merge_threshold: float | None = None
    review_threshold: float | None = None
    block_threshold: float | None = None
    requested_by: str | None = None
    request_id: str | None = None
    context_id: str | None = None

    def __post_init__(self) -> None:
        given = [self.block_threshold, self.review_threshold, self.auto_merge_threshold]
        known = [x for x in given if x is not None]
        if any(not 0 <= x <= 1 for x in known) or known != sorted(known):
            raise ValueError("thresholds lie between 0 and 1, block below review below auto merge")


def lowest_review(config: RunConfig, thresholds: DataFrame, as_of: dt.datetime) -> float:
    """The run's review threshold, or the lowest one in force for its domain; one number reaches the driver."""
    if config.review_threshold is not None:
        return config.review_threshold
    mine = po.active_thresholds(thresholds, as_of).where(F.col("domain") == config.domain.strip().upper())
    if config.policy_version:
        mine = mine.where(F.col("policy_version") == config.policy_version)
    found = mine.agg(F.min(po.safe_rate(F.col("min_review_score"), po.THRESHOLD_DEFAULTS["min_review_score"]))).first()[0]
    return LEAST if found is None else found


def _posture(config: RunConfig, score: str):
    limit = lambda given, column: F.lit(given) if given is not None else F.col(column)
    out = F.when(F.col(score) >= limit(config.auto_merge_threshold, "min_auto_merge_score"), "AUTO_MERGE").when(
        F.col(score) >= limit(config.review_threshold, "min_review_score"), "REVIEW")
    if config.block_threshold is not None:
        out = out.when(F.col(score) < config.block_threshold, "BLOCK")
    return out.otherwise("NO_MATCH")


def scored_run(records: DataFrame, config: RunConfig, least: float) -> DataFrame:
    """Pairs of the run as :func:`match_explain` takes them: fields of both sides, domain, version and request."""
    pairs = paired_records(records, config.mapping, config.domain, least)
    text = lambda v: F.lit(v).cast("string")
    return pairs.withColumns({
        "pair_id": F.concat_ws("~", "a_id", "b_id"), "policy_version": text(config.policy_version), "requested_by": text(config.requested_by),
        "request_id": text(config.request_id), "context_id": text(config.context_id),
        "triggered_rules": F.array().cast("array<string>"), "match_score": F.lit(None).cast("double"),
    })


def match_run(
    records: DataFrame, config: RunConfig, configs: DataFrame, thresholds: DataFrame, rules: DataFrame, history: DataFrame,
    as_of: dt.datetime,
) -> DataFrame:
    """Explained pairs that reach the lowest review threshold, each with its ``posture``.

    The score is computed first and stands in for the match score that a request would bring, so that policy, past cases and
    confidence go by it.
    """
    least = lowest_review(config, thresholds, as_of)
    pairs = scored_run(records, config, least)
    kept = score_pairs(pair_signals(pairs)).select(*[F.col(f"`{c}`") for c in pairs.columns if c != "match_score"], F.round("entity_score", 2).alias("match_score"))
    # Written once: the pairs that stay are few, and what explains them is a plan of its own, of one constant domain.
    kept = stored(kept.where(F.col("match_score") >= least).drop("domain"), "match-run").withColumn("domain", F.lit(config.domain.strip().upper()))
    out = match_explain(kept, configs, thresholds, rules, history, as_of)
    limits = {c: po.safe_rate(F.col(c), po.THRESHOLD_DEFAULTS[c]) for c in ("min_auto_merge_score", "min_review_score")}
    return out.withColumns(limits).withColumn("posture", _posture(config, "match_score"))

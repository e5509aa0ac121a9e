"""What past overrides say about a kind of pair: patterns and precedents."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.ladders import score_bucket
from concord.operators.feedback import latest_feedback, recommended_action
from concord.operators.metrics import override_flag, override_reason
from concord.sources.tables import stored

NEAR = 0.05
# Where the score bands begin.
BAND_EDGES = (0.80, 0.90, 0.95, 0.98)
# Ranges of scores that are ranked side by side.
CELLS = 1024


def _domain() -> Column:
    return F.upper(F.trim("domain"))


def _band(score: Column) -> Column:
    return score_bucket(score, "-")


def decided(explanations: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every explanation with feedback, with its effective action, override and source pair."""
    latest = latest_feedback(feedback)
    latest = latest.select(
        "explanation_id", "steward_decision", override_flag(latest).alias("steward_override_flag"),
        override_reason(latest).alias("override_reason"),
    )
    unknown = lambda c: F.coalesce(F.col(c), F.lit("UNKNOWN"))
    base = explanations.select(
        "explanation_id", _domain().alias("domain"), "record_a_id", "record_b_id", "record_a_source_system",
        "record_b_source_system", "match_score", "ai_decision", "ai_confidence", "risk_flag",
        recommended_action(explanations).alias("recommended_action"), "triggered_rules", "created_at",
        F.concat_ws("|", unknown("record_a_source_system"), unknown("record_b_source_system")).alias("source_pair"),
    )
    return base.join(latest, "explanation_id")


def similar_cases(history: DataFrame, domain: str, rules: list[str], match_score: float | None = None) -> DataFrame:
    """Decided cases of the domain that share a rule and lie near the score or in its band."""
    shared = F.coalesce(F.arrays_overlap("triggered_rules", F.array(*[F.lit(r) for r in rules])), F.lit(False))
    kept = history.where((F.col("domain") == domain.strip().upper()) & shared)
    band = _band(F.col("match_score"))
    if match_score is not None:
        near = F.coalesce(F.abs(F.col("match_score") - match_score) <= NEAR, F.lit(False))
        kept = kept.where(near | (band == _band(F.lit(match_score))))
    return kept.withColumn("score_band", band)


def override_patterns(cases: DataFrame, limit: int = 5) -> DataFrame:
    return (
        cases.where(F.col("steward_override_flag"))
        .select(F.explode("triggered_rules").alias("triggered_rule"), F.col("override_reason").alias("override_reason_code"))
        .groupBy("triggered_rule", "override_reason_code").agg(F.count("*").alias("override_count"))
        .orderBy(F.col("override_count").desc(), "triggered_rule", "override_reason_code").limit(limit)
    )


def _patterns(cases: DataFrame, keys: list[str], count: str, *extra: Column, limit: int) -> DataFrame:
    return (
        cases.groupBy(*keys).agg(F.count("*").alias(count), F.avg("match_score").alias("avg_match_score"), *extra)
        .orderBy(F.col(count).desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(limit)
    )


def score_band_patterns(cases: DataFrame, limit: int = 5) -> DataFrame:
    return _patterns(cases, ["score_band", "steward_decision"], "decision_count",
                     F.avg("ai_confidence").alias("avg_ai_confidence"), limit=limit)


def source_pair_patterns(cases: DataFrame, source_a: str | None, source_b: str | None, limit: int = 5) -> DataFrame:
    if source_a and source_b:
        cases = cases.where(F.col("source_pair").isin(f"{source_a}|{source_b}", f"{source_b}|{source_a}"))
    return _patterns(cases, ["source_pair", "steward_decision"], "decision_count", limit=limit)


def decision_patterns(cases: DataFrame, limit: int = 5) -> DataFrame:
    return _patterns(cases, ["ai_decision", "steward_decision"], "pattern_count",
                     F.avg("ai_confidence").alias("avg_ai_confidence"), limit=limit)


def precedent_cases(cases: DataFrame, match_score: float | None = None, limit: int = 5) -> DataFrame:
    """Nearest cases by score, then newest."""
    target = F.lit(match_score).cast("double") if match_score is not None else F.col("match_score")
    return cases.orderBy(
        F.abs(F.col("match_score") - target).asc_nulls_first(), F.col("created_at").desc(), "explanation_id"
    ).limit(limit).select(
        "explanation_id", "record_a_id", "record_b_id", "record_a_source_system", "record_b_source_system", "match_score",
        "ai_decision", "ai_confidence", "risk_flag", "recommended_action", "steward_decision", "steward_override_flag",
        "override_reason", "triggered_rules", "created_at",
    )


def _edge(target: Column, side: int) -> Column:
    """The outermost double on one side of ``target`` whose distance to it, as doubles subtract, is at most NEAR."""
    start, step = target + side * NEAR, F.greatest(F.abs(target), F.lit(1.0)) * 2.0**-54
    tried = F.filter(
        F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda k: start + k * step), lambda x: (target - x) * -side <= NEAR)
    return (F.array_max if side > 0 else F.array_min)(tried)


def _limits(score: Column) -> tuple[Column, Column]:
    """Lower end of a score's band, and where the next band begins; infinite at the ends."""
    edges = (-math.inf, *BAND_EDGES, math.inf)
    low, high = F, F
    for a, b in zip(edges, edges[1:]):
        low, high = low.when(score < b, F.lit(a)), high.when(score < b, F.lit(b))
    return low.otherwise(F.lit(BAND_EDGES[-1])), high.otherwise(F.lit(math.inf))


def _ranked(scores: DataFrame) -> tuple[DataFrame, list[int]]:
    """(score, cell, place) of the distinct logged scores, place from 0 inside a cell, and how many stand before each cell.

    Cells are fixed ranges of scores, so scores are ranked side by side; CELLS + 2 numbers at most reach the driver, and the
    last of those returned is how many scores there are.
    """
    known = scores.where("score is not null").distinct().withColumn("cell", _cell(F.col("score")))
    placed = stored(known.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("score")) - 1), "logged-scores")
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    return placed, list(accumulate((sizes.get(c, 0) for c in range(-1, CELLS + 1)), initial=0))


def _base(before: list[int]) -> Column:
    """How many logged scores stand in the cells before ``cell``."""
    return F.get(F.lit(before).cast("array<bigint>"), F.col("cell") + 1)


def _cell(score: Column) -> Column:
    return F.greatest(F.lit(-1), F.least(F.lit(CELLS), F.floor(F.nanvl(score, F.lit(math.inf)) * CELLS))).cast("int")


def _intervals(asked: DataFrame, placed: DataFrame, before: list[int]) -> DataFrame:
    """(score, first, stop) of each asked score: ranks of the logged scores near it or in its band.

    Edges and logged scores of a cell are sorted together; how many logged ones stand before an edge is its rank. The
    rank after all scores is that of a missing one, which counts in the highest band and for an asked score that is missing.
    """
    score, total = F.col("score"), before[-1]
    low, high = _limits(score)
    edges = F.array(
        F.struct(F.lit("first").alias("end"), F.least(_edge(score, -1), low).alias("at"), F.lit(0).alias("turn")),
        F.struct(F.lit("near").alias("end"), _edge(score, 1).alias("at"), F.lit(2).alias("turn")),
        F.struct(F.lit("band").alias("end"), high.alias("at"), F.lit(0).alias("turn")),
    )
    known = asked.where("score is not null").distinct()
    probes = known.select("score", F.explode(edges).alias("e")).select("score", "e.*").withColumn("cell", _cell(F.col("at")))
    logged = placed.select(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("end"), F.col("score").alias("at"), F.lit(1).alias("turn"), "cell")
    so_far = Window.partitionBy("cell").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = probes.unionByName(logged).withColumn("before", F.sum(F.when(F.col("end").isNull(), 1).otherwise(0)).over(so_far))
    ranks = counted.where("end is not null").withColumn("rank", _base(before) + F.col("before"))
    of = lambda *ends: F.max(F.when(F.col("end").isin(*ends), F.col("rank")))
    found = ranks.groupBy("score").agg(of("first").alias("first"), of("near", "band").alias("stop"))
    top = F.col("score") >= BAND_EDGES[-1]
    found = found.withColumn("stop", F.when(top, F.lit(total + 1)).otherwise(F.col("stop")))
    missing = asked.where("score is null").distinct().select("score", F.lit(0).alias("first"), F.lit(total + 1).alias("stop"))
    return found.unionByName(missing)


def _nodes(first: Column, stop: Column, levels: int) -> Column:
    """Numbers of the fewest binary stretches (level, number) that make up the ranks from ``first`` to before ``stop``."""
    def at(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k)
        a, b = F.ceil(first / width).cast("long"), F.floor(stop / width).cast("long")
        return F.array_compact(F.array(
            F.when((a < b) & (a % 2 == 1), F.struct(k.alias("level"), a.alias("number"))),
            F.when((a < b) & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("number")))))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def override_counts(pairs: DataFrame, history: DataFrame, limit: int = 5) -> DataFrame:
    """Pairs with ``learning_patterns``, the top override patterns of their similar cases, and their ``override_count``.

    A pair's answer depends only on its domain, rules and score, and a case counts only through its domain, rules, score and
    reason. The distinct logged scores get ranks; the scores that count for an asked one (near it or in its band) are one
    interval of ranks, so pairs reduce to (domain, rules, interval) however many digits their scores have. An interval is
    made up of a few binary stretches, and cases are added up for each stretch before they meet pairs, by equal domain, rule
    and stretch. A combination of rules meets another one once, at their smallest common rule.
    """
    rules = F.array_sort(F.array_distinct(F.array_compact("triggered_rules")))
    asked = pairs.withColumns({"_domain": _domain(), "_rules": F.coalesce(rules, F.array().cast("array<string>"))})
    score = F.col("match_score").cast("double")
    past = history.where(F.col("steward_override_flag") & F.col("triggered_rules").isNotNull())
    cases = past.groupBy("domain", "triggered_rules", score.alias("score"), "override_reason").agg(F.count("*").alias("n"))
    cases = stored(cases, "override-cases")
    placed, before = _ranked(cases.select("score"))
    total = before[-1]
    levels = (total + 1).bit_length()

    scores = _intervals(asked.select(score.alias("score")), placed, before)
    asked = asked.alias("a").join(scores.alias("s"), score.eqNullSafe(F.col("s.score")), "left").select(
        "a.*", F.struct("s.first", "s.stop").alias("_interval"))
    keys = ["_domain", "_rules", "_interval"]
    wanted = asked.where((F.size("_rules") > 0) & F.col("_domain").isNotNull()).select(*keys).distinct()
    left = wanted.withColumn("node", F.explode(_nodes(F.col("_interval.first"), F.col("_interval.stop"), levels))).withColumn("rule", F.explode("_rules"))

    ranks = placed.select("score", (_base(before) + F.col("place")).alias("rank"))
    cases = cases.join(ranks, "score", "left").withColumn("rank", F.coalesce("rank", F.lit(total)))
    stretch = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(F.col("rank") / F.pow(F.lit(2.0), k)).cast("long").alias("number")))
    right = cases.withColumn("node", F.explode(stretch)).groupBy("domain", "triggered_rules", "override_reason", "node").agg(F.sum("n").alias("n"))
    right = right.withColumn("rule", F.explode(F.array_distinct("triggered_rules")))

    met = left.join(right, (left["rule"] == right["rule"]) & (F.col("_domain") == F.col("domain")) & (left["node"] == right["node"])).where(
        left["rule"] == F.array_min(F.array_intersect("_rules", "triggered_rules"))
    )
    found = met.select(*keys, F.explode("triggered_rules").alias("name"), "override_reason", "n")
    found = found.groupBy(*keys, "name", "override_reason").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "name", "override_reason")
    top = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    counts = top.groupBy(*keys).agg(
        F.sum("n").alias("override_count"),
        F.array_sort(F.collect_list(F.struct("rn", "name", "override_reason", "n"))).alias("learning_patterns"))
    joined = asked.alias("a").join(counts.alias("t"), [F.col(f"a.{k}") == F.col(f"t.{k}") for k in keys], "left")
    return joined.select(
        *[F.col(f"a.{c}") for c in pairs.columns if c not in ("override_count", "learning_patterns")],
        F.coalesce("t.override_count", F.lit(0)).alias("override_count"), "t.learning_patterns",
    )


def learning_context() -> Column:
    """One line per pattern of :func:`override_counts`."""
    line = lambda p: F.concat(
        F.lit("- Rule "), p["name"], F.lit(" was previously overridden "), p["n"].cast("string"),
        F.lit(" times, most often for reason "), p["override_reason"], F.lit("."))
    return F.when(F.size("learning_patterns") > 0, F.array_join(F.transform("learning_patterns", line), "\n")).otherwise(
        "No significant steward override patterns were found for this domain and rule set.")

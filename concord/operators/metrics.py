"""Match metrics over the explanation log and the reviewers' latest decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.ladders import decision_group, flag_is_true, ratio, score_bucket
from concord.operators.feedback import feedback_time, latest_feedback, recommended_action
from concord.sources.tables import stored

UNKNOWN_REASON = "UNKNOWN_REASON"
REASON_COLUMNS = ("override_reason_code", "override_reason_note", "override_reason", "steward_override_reason")


def override_reason(df: DataFrame) -> Column:
    """First non-empty reason among the columns this log has."""
    found = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in REASON_COLUMNS if c in df.columns]
    return F.coalesce(*found, F.lit(UNKNOWN_REASON))


def override_flag(df: DataFrame) -> Column:
    return flag_is_true(F.col("steward_override_flag")) if "steward_override_flag" in df.columns else F.lit(False)


def recent(explanations: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Explanations of the last days with their effective action and score range."""
    since = as_of - dt.timedelta(days=days)
    return explanations.where(F.col("created_at") >= F.lit(since)).withColumns(
        {"effective_action": recommended_action(explanations), "score_bucket": score_bucket(F.col("match_score"))}
    )


def reviewed(explanations: DataFrame, feedback: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Recent explanations that have recent feedback, with both decisions in three groups."""
    base = recent(explanations, as_of, days)
    latest = latest_feedback(feedback, as_of - dt.timedelta(days=days))
    latest = latest.select(
        "explanation_id", "steward_decision", "steward_user",
        override_reason(latest).alias("override_reason"), override_flag(latest).alias("steward_override_flag"),
        feedback_time(latest).alias("feedback_ts"),
    )
    base = base.select("explanation_id", "match_score", "score_bucket", "ai_decision", "effective_action", "created_at",
                       "triggered_rules")
    return base.join(latest, "explanation_id").withColumns(
        {"ai_norm": decision_group(F.col("ai_decision")), "steward_norm": decision_group(F.col("steward_decision"))}
    )


def counts_by(base: DataFrame, column: str) -> DataFrame:
    return base.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("v"))


def top_names(names: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent values of ``name``, ties by name."""
    return names.groupBy("name").agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "name").limit(limit)


def rules_of(base: DataFrame) -> DataFrame:
    return base.select(F.explode("triggered_rules").alias("name"))


def reasons_of(rows: DataFrame) -> DataFrame:
    given = F.nullif(F.col("override_reason"), F.lit(""))
    return rows.where(given.isNotNull()).select(F.trim(F.lower(given)).alias("name"))


def false_positive() -> Column:
    return (F.col("ai_norm") == "MATCH") & (F.col("steward_norm") == "NO_MATCH")


def false_negative() -> Column:
    return (F.col("ai_norm") == "NO_MATCH") & (F.col("steward_norm") == "MATCH")


def _minutes() -> Column:
    """Whole elapsed minutes from explanation to feedback, negative when feedback came first."""
    return F.expr("timestampdiff(MINUTE, created_at, feedback_ts)")


def _override_rate() -> Column:
    return ratio(F.sum(F.when(F.col("steward_override_flag"), 1).otherwise(0)), F.count("*"))


def override_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(_override_rate().alias("override_rate"))


def feedback_latency(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(_minutes()).alias("avg_time_to_feedback_minutes"))


def avg_confidence(base: DataFrame) -> DataFrame:
    return base.agg(F.avg("ai_confidence").alias("avg_ai_confidence"))


def _confusion() -> list[Column]:
    ai, st = F.col("ai_norm"), F.col("steward_norm")
    return [
        F.count("*").alias("total_reviewed"),
        F.count_if((ai == "MATCH") & (st == "MATCH")).alias("true_positives"),
        F.count_if((ai == "NO_MATCH") & (st == "NO_MATCH")).alias("true_negatives"),
        F.count_if(false_positive()).alias("false_positives"),
        F.count_if(false_negative()).alias("false_negatives"),
        F.count_if((ai == "REVIEW") | (st == "REVIEW")).alias("review_or_other"),
    ]


def _with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, n = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives", "total_reviewed"))
    return df.withColumns(
        {"fp_rate": ratio(fp, n), "fn_rate": ratio(fn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)}
    )


def confusion_matrix(rows: DataFrame) -> DataFrame:
    return _with_rates(rows.agg(*_confusion()))


def fpfn_by_bucket(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(F.col("score_bucket").alias("bucket")).agg(
        F.count("*").alias("reviewed"),
        F.count_if(false_positive()).alias("false_positives"),
        F.count_if(false_negative()).alias("false_negatives"),
    )
    return out.withColumns(
        {"fp_rate": ratio(F.col("false_positives"), F.col("reviewed")),
         "fn_rate": ratio(F.col("false_negatives"), F.col("reviewed"))}
    )


def learning_timeline(rows: DataFrame, limit: int = 7) -> DataFrame:
    """Newest reviewed decisions as text; an override flag that is not set prints as empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    newest = rows.orderBy(F.col("feedback_ts").desc(), "explanation_id").limit(limit)
    return newest.select(
        "explanation_id", text("ai_decision").alias("ai_decision"), text("effective_action").alias("recommended_action"),
        text("steward_decision").alias("steward_decision"),
        F.when(F.col("steward_override_flag"), "True").otherwise("").alias("steward_override_flag"),
        text("override_reason").alias("override_reason"), text("steward_user").alias("steward_user"),
        F.concat(F.date_format("feedback_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00")).alias("feedback_at"),
    )


def _tally(df: DataFrame, kinds: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """Counts for several groupings in one pass: a row per (kind, value), combined on the map side."""
    singles = [F.array(F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key"))) for k, v in kinds.items()]

    def entries(kind: str, values: Column) -> Column:
        filled = F.coalesce(values, F.array().cast("array<string>"))
        return F.transform(filled, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    many = [entries(k, v) for k, v in lists.items()]
    return df.select(F.explode(F.concat(*singles, *many)).alias("t")).groupBy("t.kind", "t.key").agg(F.count("*").alias("n"))


def _as_map(kind: str) -> Column:
    rows = F.expr(f"collect_list(struct(key, n)) FILTER (WHERE kind = '{kind}' AND key IS NOT NULL)")
    return F.map_from_entries(F.array_sort(rows))


def _as_top(kind: str) -> Column:
    rows = F.expr(f"collect_list(struct(-n AS o, key AS name, n AS count)) FILTER (WHERE kind = '{kind}')")
    return F.transform(F.array_sort(rows), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count")))


def _best(tally: DataFrame, ranked: list[str], limit: int) -> DataFrame:
    """Keep all rows of the map kinds and the top rows of the ranked kinds."""
    is_ranked = F.col("kind").isin(*ranked)
    w = Window.partitionBy("kind").orderBy(F.col("n").desc(), "key")
    top = tally.where(is_ranked & F.col("key").isNotNull()).withColumn("rn", F.row_number().over(w))
    return tally.where(~is_ranked).unionByName(top.where(F.col("rn") <= limit).drop("rn"))


def _reviewed_tally(rows: DataFrame) -> DataFrame:
    """Reviewed rows counted in one pass: by cell (both decisions, override flag, score bucket), by reason and by wrong rules.

    A row counts in its cell, under its reason, and under each rule where the engine was wrong; ``minutes`` and ``timed`` add up
    the cells' times to feedback. The table is as small as the distinct values.
    """
    none = F.array().cast("array<string>")
    reason = F.trim(F.lower(F.nullif(F.col("override_reason"), F.lit(""))))
    rules = F.coalesce("triggered_rules", none)
    wrong = lambda kind, test: F.transform(F.when(test, rules).otherwise(none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    single = lambda kind, key: F.array(F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")))
    entries = F.concat(
        single("cell", F.lit(None)), single("reason", reason), wrong("fp", F.coalesce(false_positive(), F.lit(False))),
        wrong("fn", F.coalesce(false_negative(), F.lit(False))))
    cell = ["ai_norm", "steward_norm", "steward_override_flag", "score_bucket"]
    told = rows.select(*cell, _minutes().alias("minutes"), F.explode(entries).alias("e"))
    in_cell = F.col("e.kind") == "cell"
    told = told.select("e.kind", "e.key", *[F.when(in_cell, F.col(c)).alias(c) for c in (*cell, "minutes")])
    return told.groupBy("kind", "key", *cell).agg(
        F.count("*").alias("n"), F.sum("minutes").alias("minutes"), F.count("minutes").alias("timed"))


def _confusion_of(cells: DataFrame) -> list[Column]:
    """The counts of :func:`_confusion` from counted cells."""
    ai, st = F.col("ai_norm"), F.col("steward_norm")
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint"))
    return [
        of(F.lit(True)).alias("total_reviewed"), of((ai == "MATCH") & (st == "MATCH")).alias("true_positives"),
        of((ai == "NO_MATCH") & (st == "NO_MATCH")).alias("true_negatives"), of(false_positive()).alias("false_positives"),
        of(false_negative()).alias("false_negatives"), of((ai == "REVIEW") | (st == "REVIEW")).alias("review_or_other"),
    ]


def overview(explanations: DataFrame, feedback: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Everything above as one row of scalars, maps and lists.

    Reviewed rows are read twice, for one tally and for the newest decisions; scores, confusion, buckets and lists come from the
    tally, which is stored. Each log is aggregated to a few rows in one pass before anything is collected into the row; no
    count map or top list sees raw rows.
    """
    base = recent(explanations, as_of, days)
    rows = reviewed(explanations, feedback, as_of, days)
    logged = _best(
        _tally(base, {"decision": F.col("ai_decision"), "risk": F.col("risk_flag"), "action": F.col("effective_action"),
                      "bucket": F.col("score_bucket")}, {"rule": F.col("triggered_rules")}),
        ["rule"], 10,
    ).agg(
        _as_map("decision").alias("decisions"), _as_map("risk").alias("risk_flags"),
        _as_map("action").alias("recommended_actions"), _as_map("bucket").alias("score_buckets"),
        _as_top("rule").alias("top_triggered_rules"),
    )
    totals = base.agg(F.count("*").alias("total_explanations"), F.avg("ai_confidence").alias("avg_ai_confidence"))

    tally = stored(_reviewed_tally(rows), "reviewed-tally")
    cells = tally.where("kind = 'cell'")
    seen = _best(tally.where("kind <> 'cell'").select("kind", "key", "n"), ["reason", "fp", "fn"], 10).agg(
        _as_top("reason").alias("top_override_reasons"), _as_top("fp").alias("top_fp_rules"), _as_top("fn").alias("top_fn_rules"))
    overridden = F.coalesce(F.sum(F.when(F.col("steward_override_flag"), F.col("n"))), F.lit(0))
    scores = _with_rates(cells.agg(
        ratio(overridden, F.sum("n")).alias("override_rate"),
        F.try_divide(F.sum("minutes").cast("double"), F.sum("timed")).alias("avg_time_to_feedback_minutes"), *_confusion_of(cells)))
    counted = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("bigint"))
    bucketed = cells.groupBy(F.col("score_bucket").alias("bucket")).agg(
        F.sum("n").alias("reviewed"), counted(false_positive()).alias("false_positives"), counted(false_negative()).alias("false_negatives"))
    for k in ("fp", "fn"):
        name = {"fp": "false_positives", "fn": "false_negatives"}[k]
        bucketed = bucketed.withColumn(f"{k}_rate", ratio(F.col(name), F.col("reviewed")))
    by_bucket = bucketed.agg(F.array_sort(F.collect_list(F.struct(
        "bucket", "reviewed", "false_positives", "false_negatives", "fp_rate", "fn_rate"))).alias("fpfn_by_score_bucket"))
    line = learning_timeline(rows).agg(F.expr(
        "reverse(array_sort(collect_list(struct(feedback_at, explanation_id, ai_decision, recommended_action, "
        "steward_decision, steward_override_flag, override_reason, steward_user))))").alias("learning_timeline"))
    out = totals
    for one_row in (scores, logged, seen, by_bucket, line):
        out = out.crossJoin(F.broadcast(one_row))
    return out

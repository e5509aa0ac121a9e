"""Past cases, changes by key, keyed streams and searches by posting table against plain versions."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from concord.functions.ladders import score_bucket
from concord.operators import confidence as co
from concord.operators import learning as le
from concord.operators import search
from concord.plans import explain as ex
from concord.plans import feedback_plans, policy_plans
from concord.operators.payload import normalize_payload
from concord.sources import tables
from concord.sources.shaped import shaped
from concord.streaming import jobs

DATA = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2001, 11, 5)


def band(score):
    return sum(score >= e for e in le.BAND_EDGES) if score is not None and not math.isnan(score) else 4


def test_override_counts_by_brute_force(spark):
    """Scores of many digits, on the edges of bands and of nearness, missing and NaN ones; free-text reasons."""
    rng = random.Random(5)
    edges = [0.0, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98, 1.0, -0.3, 1.4, 0.8 - 1e-16, 0.9000000000000001]
    scores = lambda: rng.choice([None, math.nan, rng.choice(edges), rng.choice(edges) + 0.05, rng.choice(edges) - 0.05, rng.random(), round(rng.random(), 2)])
    names = ["A", "B", "C", "D", None]
    rules = lambda: rng.choice([None, [], [rng.choice(names) for _ in range(rng.randint(1, 4))]])
    past = [(rng.choice(["X", "Y"]), rules(), scores(), rng.choice(["r1", "r2", f"free {k}"]), rng.random() < 0.8) for k in range(260)]
    pairs = [(k, rng.choice([" x", "Y", None]), rules(), scores(), 7) for k in range(120)]
    history = spark.createDataFrame(past, "domain string, triggered_rules array<string>, match_score double, override_reason string, steward_override_flag boolean")
    asked = spark.createDataFrame(pairs, "pair_id int, domain string, triggered_rules array<string>, match_score double, override_count int")
    got = {r.pair_id: r for r in le.override_counts(asked, history).collect()}
    assert len(got) == len(pairs)
    for k, domain, mine, score, _ in pairs:
        counts = Counter()
        for d, theirs, s, reason, flag in past:
            shared = set(filter(None, mine or [])) & set(filter(None, theirs or []))
            close = score is None or (s is not None and abs(s - score) <= le.NEAR) or band(s) == band(score)
            if flag and shared and close and domain and d == domain.strip().upper():
                counts.update((name, reason) for name in theirs)
        best = sorted(counts.items(), key=lambda x: (-x[1], x[0][0] is not None, x[0][0] or "", x[0][1]))[:5]
        assert [(p["name"], p.override_reason, p.n) for p in got[k].learning_patterns or []] == [(*key, n) for key, n in best]
        assert got[k].override_count == sum(n for _, n in best)


def test_band_edges_are_those_of_the_buckets(spark):
    tried = [x for e in le.BAND_EDGES for x in (e, math.nextafter(e, 0), e - 0.01)] + [None, math.nan, 2.0, -1.0]
    rows = spark.createDataFrame([(x,) for x in tried], "s double").select("s", score_bucket(F.col("s")).alias("b")).collect()
    of = {r.b: band(r.s) for r in rows}
    assert len(of) == 5 and all(of[r.b] == band(r.s) for r in rows)


def test_override_counts_join_has_no_score_condition(spark):
    plan = le.override_counts(shaped(spark, DATA, "match_pairs"), feedback_plans.history(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any(re.search(r"score#\d+.*(<=|>=|<|>) ", line.split("Join")[1]) for line in joins)


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}


def test_upsert_rewrites_changed_folders_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(400).select("id", F.col("id").alias("v"), F.lit("a").alias("w")).unionByName(
        spark.createDataFrame([(None, 0, "a")], "id long, v long, w string"))
    every = {c: F.col(f"s.{c}") for c in ("id", "v", "w")}
    tables.upsert_table(path, rows, ["id"], ["id", "v", "w"], {}, every, buckets=16)
    before = files_of(path)
    assert len({os.path.dirname(f) for f in before}) == 16
    change = spark.createDataFrame([(7, 70, "z", 1), (1000, 5, "n", 1)], "id long, v long, w string, extra int")
    for _ in range(2):  # again, as after a lost driver
        tables.upsert_table(path, change, ["id"], ["id", "v", "w"], {"v": F.col("s.v")}, every, buckets=16)
    after = files_of(path)
    touched = {r.b for r in change.select(tables.bucket_of(["id"], 16).alias("b")).collect()}
    same = lambda f: int(re.search(r"bucket=(\d+)", f)[1]) not in touched
    assert {f: t for f, t in before.items() if same(f)} == {f: t for f, t in after.items() if same(f)}
    assert not any(f in after for f in before if not same(f))
    got = {(r.id, r.v, r.w) for r in spark.read.parquet(path).drop("bucket").collect()}
    assert got == {(i, 70 if i == 7 else i, "a") for i in range(400)} | {(None, 0, "a"), (1000, 5, "n")}
    tables.upsert_table(path, change.limit(0), ["id"], ["id", "v", "w"], {}, every, buckets=16)
    assert files_of(path) == after


def batches(spark, tmp_path, name, schema, parts):
    """A stream of one micro-batch for each list of rows."""
    folder = f"{tmp_path}/{name}"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        os.utime(sorted(glob.glob(f"{folder}/*.parquet"), key=os.path.getctime)[-1], (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_newest_feedback_stays_in_its_folders(spark, tmp_path):
    kind = "explanation_id string, feedback_id string, feedback_at timestamp, steward_decision string"
    at = lambda d: dt.datetime(2024, 1, d)
    parts = [
        [("e1", "f1", at(1), "a"), ("e2", "f2", at(5), "b")], [("e1", "f3", at(3), "c"), ("e2", "f4", at(2), "late")],
        [("e1", "f3", at(3), "c"), ("e3", "f5", at(1), "d")], [("e1", "f3", at(3), "c"), ("e2", "f4", at(2), "late")],
    ]
    path = f"{tmp_path}/kept"
    jobs.finished(jobs.keep_newest_feedback(batches(spark, tmp_path, "in", kind, parts), path, f"{tmp_path}/check", buckets=4))
    got = {(r.explanation_id, r.feedback_id, r.steward_decision) for r in jobs.kept(spark, path).collect()}
    assert got == {("e1", "f3", "c"), ("e2", "f2", "b"), ("e3", "f5", "d")}
    assert len(glob.glob(f"{path}/bucket=*")) <= 4 and not glob.glob(f"{path}/batch=*")


def test_daily_rows_and_sketches(spark, tmp_path):
    kind = "created_at timestamp, domain string, record_id string, record_score double"
    rng = random.Random(3)
    parts = [[(dt.datetime(2024, 1, 1 + rng.randint(0, 2), rng.randint(0, 23)), rng.choice(["a", "B"]), f"r{rng.randint(0, 3000)}", float(rng.randint(0, 100)))
              for _ in range(4000)] for _ in range(3)]
    path = f"{tmp_path}/daily"
    jobs.finished(jobs.keep_daily(jobs.daily_scores(batches(spark, tmp_path, "in", kind, parts), "9 days"), path, f"{tmp_path}/check", buckets=4))
    rows = [r for part in parts for r in part]
    kept = jobs.kept(spark, path)
    got = {(r.metric_date, r.domain): r for r in kept.collect()}
    key = lambda r: (r[0].date(), r[1].upper())
    assert set(got) == set(map(key, rows)) and len(glob.glob(f"{path}/bucket=*")) <= 4
    near = lambda sketch, exact: abs(sketch - exact) <= 4 * 1.04 / math.sqrt(2**jobs.SKETCH_BITS) * exact
    for k, r in got.items():
        mine = [x for x in rows if key(x) == k]
        assert r.total_records == len(mine) and r.max_record_score == max(x[3] for x in mine)
        assert near(r.approx_records, len({x[2] for x in mine}))
    for r in jobs.records_over(kept, "domain").collect():
        assert near(r.approx_records, len({x[2] for x in rows if x[1].upper() == r.domain}))


def test_search_by_postings_is_the_full_scan(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcAB %_1") for _ in range(n))
    rows = [(f"R{k:04d}", rng.choice(["x", "X", "Y", None]), rng.choice([word(rng.randint(0, 14)), None])) for k in range(150)]
    index = spark.createDataFrame(rows, "record_id string, domain string, search_text string")
    texts = [word(rng.randint(0, 5)) for _ in range(985)] + ["", "%", "_", "__", None, "a%b", "a_b", "\\%", "\\_a", "%%%", "abc", "ABC", "é", "zzz", "b\\%a"]
    asked = [(k, rng.choice(["x", "Y", "none", None]), t) for k, t in enumerate(texts)]
    queries = spark.createDataFrame(asked, "query_id int, domain string, text string")
    got = {}
    for r in sorted(search.search_many(*search.postings(index), queries, limit=7).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.record_id)

    def fits(pattern, text):
        out, k = "", 0
        while k < len(pattern):
            c = pattern[k]
            if c == "\\":
                k += 1
                out += re.escape(pattern[k])
            else:
                out += {"%": ".*", "_": "."}.get(c, re.escape(c))
            k += 1
        return re.fullmatch(out, text, re.S)

    for k, domain, text in asked:
        want = [] if domain is None or text is None else sorted(
            i for i, d, t in rows if d and t is not None and d.upper() == domain.upper() and fits(f"%{text.lower()}%", t.lower()))[:7]
        assert got.get(k, []) == want, (domain, text)
    one = search.record_search(index, "x", "ab", 7).collect()
    assert one == search.search_many(*search.postings(index), spark.createDataFrame([(1, "X", "AB")], queries.schema), 7).orderBy("rank").drop("query_id", "rank").collect()


def test_given_lists_get_their_defaults(spark):
    texts = ['[{}]', '[1, "x", null, {"step": null, "title": null, "signal_score": "high"}]', '[{"signal_score": 2, "detail": 5}]', "{}", "[", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(map(tuple, r.e)) for r in df.select(co.given_events(F.col("t")).alias("e")).collect()]
    default = (1, "SIGNAL", "Evidence Evaluated", "", "neutral", None, None, None, None)
    assert got[0] == (default,)
    assert got[1] == ((None, "SIGNAL", None, "", "neutral", None, None, None, None),)
    assert got[2] == ((1, "SIGNAL", "Evidence Evaluated", "5", "neutral", None, 2.0, None, None),)
    assert got[3:] == [(), (), (), ()]
    signals = df.select(co.given_signals(F.col("t")).alias("e")).first().e
    assert tuple(signals[0]) == (None,) * 8


def test_explained_pairs_take_the_models_answers(spark):
    """Where the policy says nothing, action and flag of the answer count; else they do not. Log rows have all columns."""
    pairs = shaped(spark, DATA, "match_pairs").withColumns({"requested_by": F.lit("me"), "context_id": F.lit("c")}).limit(40)
    said = normalize_payload(shaped(spark, DATA, "pair_payloads"))
    nothing = [t.limit(0) for t in policy_plans.tables(spark, DATA)]
    history = feedback_plans.history(spark, DATA)
    out = tables.stored(ex.match_explain(pairs, *nothing, history, AS_OF, payloads=said), "explained")
    answers = {r.pair_id: r for r in said.collect()}
    rows = out.collect()
    assert len(rows) == 40
    for r in rows:
        a = answers[r.pair_id]
        assert (r.recommended_action, r.ai_decision) == (a.recommended_action or "REVIEW_REQUIRED", a.ai_decision)
        assert r.ai_confidence == a.confidence
        same = (r.a_member_id or "").strip().lower() == (r.b_member_id or "").strip().lower() != ""
        given = [x.rule for x in a.rule_analysis or []]
        assert [x.rule for x in r.rule_analysis or []] == (["MEMBER_ID_EXACT"] if same and "MEMBER_ID_EXACT" not in given else []) + given
    assert {r.recommended_action for r in rows} > {"REVIEW_REQUIRED"}
    log = ex.explanation_log(out, AS_OF, model={"model_provider": "p", "model_version": "1"}).first()
    assert (log.requested_by, log.context_id, log.model_provider, log.model_version, log.prompt_version) == ("me", "c", "p", "1", None)
    assert list(log.asDict()) == [c for c in ex.LOG_COLUMNS if c in log.asDict()] and {"policy_hash", "steward_override_reason"} <= set(log.asDict())


@pytest.mark.parametrize("many", [False, True])
def test_rules_are_those_of_the_pairs_own_set(spark, many):
    from concord.operators import policy as po
    n = 20_000 if many else 50
    rules = spark.range(n).select(
        F.concat(F.lit("R"), F.col("id").cast("string")).alias("triggered_rule"), F.col("id").cast("string").alias("risk_rule_id"), F.lit("D").alias("domain"),
        F.lit("v1").alias("policy_version"), F.lit("LOW").alias("risk_level"), F.lit("x").alias("recommended_action"), F.lit("y").alias("override_reason_code"),
        F.lit("z").alias("notes"), (F.col("id") % 7).cast("double").alias("risk_weight"), F.lit("Y").alias("active_flag"),
        F.lit(None).cast("timestamp").alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"))
    pairs = [(1, "D", "v1", ["R3", "R1", "R3", None, "none"]), (2, "D", "v1", ["R1", "R3", "none"]), (3, "D", "v2", ["R1"]), (4, None, "v1", ["R1"]), (5, "D", "v1", None), (1, "D", "v1", [])]
    df = spark.createDataFrame(pairs, "pair_id int, domain string, policy_version string, triggered_rules array<string>")
    got = sorted((r.pair_id, [x.triggered_rule for x in r.matched_rules]) for r in po.matched_risk_rules(df, rules, AS_OF).collect())
    assert got == [(1, []), (1, ["R3", "R1"]), (2, ["R3", "R1"]), (3, []), (4, []), (5, [])]

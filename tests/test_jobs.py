"""Single jobs on small inputs: the paths a whole-table check does not reach."""

import datetime as dt
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from concord.functions import text as tx
from concord.operators import address as ad
from concord.operators import candidates as ca
from concord.operators import confidence as co
from concord.operators import names as na
from concord.operators import policy as po
from concord.operators import scoring as sc
from concord.operators import signals as si
from concord.operators.evidence import evidence_text
from concord.operators.feedback import latest_feedback
from concord.plans import feedback_plans, policy_plans, stream_plans
from concord.plans import match_run as mr
from concord.plans.matching_plans import MAPPING
from concord.sources import tables
from concord.sources.shaped import shaped, spread
from concord.streaming import jobs
from tests.plain_similarity import jaro_winkler_pair

DATA = "/root/testdata/sf0.001"
AS_OF = dt.datetime(2001, 11, 5)


def one(spark, row, schema):
    return spark.createDataFrame([row], schema)


def test_email_normalisation(spark):
    cases = {"A.b+x@Gmail.com": "ab@gmail.com", "a.b+x@acme.com": "a.b+x@acme.com", " plain ": "plain", None: "", "x@y@z": "x@y@z"}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    got = {r.e: r.n for r in df.select("e", tx.comparable_email(F.col("e")).alias("n")).collect()}
    assert got == cases


def test_email_trust_uses_the_second_piece(spark):
    cases = {"a@acme.com": 1.10, "a@uni.edu": 1.05, "a@gmail.com": 0.95, "plain": 1.0, "a@gmail.com@acme.com": 0.95, None: 1.0}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r.e: r.t for r in df.select("e", tx.email_trust(F.col("e")).alias("t")).collect()} == cases


def test_strip_removes_unicode_space(spark):
    assert one(spark, ("  x\t ",), "c string").select(tx.strip(F.col("c"))).first()[0] == "x"


def test_customer_scores_by_hand(spark):
    rows = shaped(spark, DATA, "match_pairs").withColumn("domain", F.lit("CUSTOMER"))
    got = sc.score_pairs(si.pair_signals(rows)).collect()
    for r in got:
        text = lambda v: (v or "").strip().lower()
        jw = lambda a, b: round(jaro_winkler_pair(text(a), text(b)), 4)
        full = lambda s: f"{r[s + '_first_name'] or ''} {r[s + '_last_name'] or ''}".strip().lower()
        name = SequenceMatcher(None, full("a"), full("b")).ratio() if full("a") != full("b") else 1.0
        dob = 1.0 if text(r.a_dob) and text(r.a_dob) == text(r.b_dob) else 0.0
        member = 1.0 if text(r.a_member_id) == text(r.b_member_id) else 0.0
        score = name * 0.25 + r.email_score * 0.15 + r.address_score * 0.20 + dob * 0.25 + member * 0.10 + r.source_score * 0.05
        if dob and r.address_score >= 0.95 and name >= 0.85:
            score = max(score, 0.82)
        elif dob and name >= 0.90:
            score = max(score, 0.78)
        assert r.entity_score == pytest.approx(score, abs=1e-9)
        assert r.name_score == pytest.approx(
            0.4 * jw(r.a_first_name, r.b_first_name) + 0.6 * jw(r.a_last_name, r.b_last_name), abs=1e-4)


def test_provider_without_mailbox_is_scored_like_any_record(spark):
    schema = "pair_id string, domain string, a_provider_id string, b_provider_id string, a_provider_email string, b_provider_email string, a_first_name string, b_first_name string"
    df = spark.createDataFrame([
        ("1", "provider", "P1", "P1", "d@hospital.org", "d@hospital.org", "Ann", "Ann"),
        ("2", "provider", "P1", "P1", None, "d@hospital.org", "Ann", "Ann")], schema)
    out = {r.pair_id: r for r in co.with_signal_packets(sc.score_pairs(si.pair_signals(df))).collect()}
    assert out["1"].provider_scored and len(out["1"].signal_packets) == 6
    assert not out["2"].provider_scored and out["2"].signal_packets == []
    # Half of the name score (the first name) and the member id, which falls back to the provider id.
    assert out["2"].entity_score == pytest.approx(round(0.4 * 0.30 + 0.10, 2))


def test_patient_score_is_held_between_bounds(spark):
    schema = ", ".join(f"{s}_{c} string" for s in "ab" for c in ("patient_id", "dob", "first_name", "last_name", "address", "email", "source_system"))
    row = ("PT1-A", "1980-01-01", "Ann", "Lee", "1 Oak St", "a@acme.com", "MDM")
    df = one(spark, ("1", "PATIENT", *row, "PT1-B", *row[1:]), f"pair_id string, domain string, {schema}")
    got = sc.score_pairs(si.pair_signals(df)).first()
    assert got.patient_id_score == 0.90 and got.entity_score == 0.92 and got.human_id_score is None


def test_missing_human_id_counts_differently_in_score_packet_and_contribution(spark):
    df = shaped(spark, DATA, "scored_pairs").where("upper(domain) = 'PATIENT' AND human_id_score IS NULL")
    r = co.with_contributions(co.with_signal_packets(sc.score_pairs(df))).first()
    assert next(p for p in r.signal_packets if p.signal_name == "human_id_match").signal_score == 0.5
    assert next(c for c in r.signal_contributions if c.signal_name == "human_id_match").contribution == 0.0


def test_primary_signal_is_the_first_of_equals(spark):
    df = one(spark, ("CUSTOMER", 1.0, 1.0), "domain string, member_id_score double, dob_score double")
    assert co.with_contributions(df).select(co.primary_signal(F.col("signal_contributions"))).first()[0] == "member_id_match"


def test_timeline_has_closing_events_only_with_rules(spark):
    base = co.decision_confidence(sc.score_pairs(shaped(spark, DATA, "scored_pairs")).withColumn("entity_score", F.coalesce("match_score", F.lit(0.0))))
    df = co.with_signal_packets(co.automation_readiness(base))
    for r in df.withColumn("t", co.evidence_timeline(df)).limit(200).collect():
        stages = [e.stage for e in r.t]
        assert [e.step for e in r.t] == list(range(1, len(r.t) + 1))
        assert stages[-4:] == ["POLICY", "RISK", "AUTOMATION", "DECISION"] if r.triggered_rules else "POLICY" not in stages
        # A plain mailbox is no event of its own; supplier and provider mailboxes are.
        assert stages.count("SIGNAL") == sum(p.signal_name != "email_match" for p in r.signal_packets)


def test_names(spark):
    cases = [("Mike", "Michael", "SIMILAR"), ("Stephen", "Steven", "SIMILAR"), ("Kate", "kate ", "EXACT"), (None, "Kate", "UNKNOWN"), ("Bob", "Zed", "DIFFERENT")]
    df = spark.createDataFrame([c[:2] for c in cases], "a string, b string")
    got = [r.match_level for r in na.compare_names(df, "a", "b").collect()]
    assert got == [c[2] for c in cases]


def test_phonetic_keys(spark):
    cases = {"Knight": "nt", "Night": "nt", "Philip": "flp", "Schwartz": "schwrt", "gh": "", "123": None}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.k for r in df.select("n", na.phonetic_key(F.col("n")).alias("k")).collect()} == cases


def test_address_words_need_blanks_on_both_sides(spark):
    df = one(spark, ("1 Main Street, Miami, FL 33101",), "address string")
    r = ad.validate(df).first()
    assert r.standardized_address == "1 MAIN ST, MIAMI, FL 33101"
    assert (r.validation_status, r.address_confidence, r.city, r.state, r.postal_code) == ("PARTIAL", 0.8, "MIAMI", "FL", "33101")


def test_candidates_are_the_same_by_broadcast_and_by_shuffle(spark):
    records = shaped(spark, DATA, "match_pairs")
    rows = lambda hot: sorted(map(tuple, ca.candidate_pairs(records, MAPPING, hot_block=hot).collect()))
    assert rows(1_000_000) == rows(3) == rows(0)


def test_one_hot_block_gives_one_pair_per_record(spark):
    df = spark.range(2000).select(F.format_string("r%05d", "id").alias("a_id"), F.lit("same").alias("m"))
    pairs = ca.paired_records(df, ca.ColumnMapping("a_id", identifier="m"), least=0.0, hot_block=100)
    assert pairs.count() == 1999 and pairs.select("a_id").distinct().count() == 1
    assert si.identifier_signals(pairs).where("member_id_score = 1").count() == 1999
    assert ca.candidate_pairs(df, ca.ColumnMapping("a_id", identifier="m")).count() == 0  # an identifier alone scores too little


def test_copies_that_differ_from_the_first_of_their_block_meet(spark):
    kind = "id string, m string, first string, last string, email string"
    rows = [("1", "M", "Ann", "Knight", None), ("2", "M", "Bob", "Night", None), ("3", "M", "Bob", "Night", None),
            ("4", "M", "Bob", "Nite", "b@x.org"), ("5", "N", "Bo", "Night", "b@x.org"), ("6", None, "Bob", "Night", None), ("7", None, "Bob", "Night", None),
            (None, "M", "Bob", "Night", None)]
    mapping = ca.ColumnMapping("id", identifier="m", first_name="first", last_name="last", email="email")
    for hot in (1_000_000, 0):
        got = {(r.a_id, r.b_id): r.blocks for r in ca.candidate_pairs(spark.createDataFrame(rows, kind), mapping, least=0.0, hot_block=hot).collect()}
        # 3 equals 2, which stands for it against 1 and 4; 6 and 7 have no key.
        assert got == {("1", "2"): "identifier", ("2", "3"): "identifier", ("1", "4"): "identifier", ("2", "4"): "identifier", ("4", "5"): "email"}


def people(spark, n, seed):
    """Records of few names and addresses that share blocks, with birth dates and identifiers that are often alike."""
    import random
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((
            f"r{i:05d}", rng.choice([f"M{rng.randint(0, 30)}", None, ""]), rng.choice(["Ann", "Anne", "Bob", None, ""]),
            rng.choice(["Knight", "Night", "Nite", "Kant", None]), rng.choice([f"a.{rng.randint(0, 9)}@gmail.com", f"b{rng.randint(0, 9)}@acme.com", "x@uni.edu", None]),
            rng.choice(["1 Main Street, Miami, FL 33101", "12 Main St Miami FL 33101", "9 Oak Ave, Tampa, FL 33602", None]),
            rng.choice(["1980-01-01", "1981-02-02", "1982-03-03", " 1980-01-01", None]), rng.choice(["MDM", "CRM", None])))
    kind = "id string, m string, first string, last string, email string, addr string, born string, sys string"
    mapping = ca.ColumnMapping("id", identifier="m", first_name="first", last_name="last", email="email", address="addr", dob="born", source_system="sys",
                               additional=("tax_id", "human_id"))
    extra = [(*r, rng.choice([f"T{rng.randint(0, 9)}", None]), rng.choice([f"H{rng.randint(0, 3)}", None])) for r in rows]
    return spark.createDataFrame(extra, kind + ", tax_id string, human_id string"), mapping


@pytest.mark.parametrize(("domain", "least"), [
    ("CUSTOMER", 0.70), ("SUPPLIER", 0.90), ("PATIENT", 0.55), ("LOCATION", 0.80)])
def test_no_match_is_lost(spark, domain, least):
    """Every two different records of a block are scored; all that reach the threshold are candidates, and no bound is too low."""
    records, mapping = people(spark, 120, 3)
    found = {(r.a_id, r.b_id): r for r in ca.candidate_pairs(records, mapping, domain, least).collect()}
    fields = mapping.fields()
    blocked = records.withColumn("blocks", ca._blocks(records, mapping))
    side = lambda s: blocked.select(F.col("id").alias(f"{s}_id"), F.col("blocks").alias(f"{s}_blocks"), *[F.col(c).alias(f"{s}_{k}") for k, c in fields.items()])
    every = side("a").join(side("b"), (F.col("a_id") < F.col("b_id")) & F.arrays_overlap("a_blocks", "b_blocks"))
    scored = sc.score_pairs(si.pair_signals(every.withColumn("domain", F.lit(domain)))).collect()
    content = lambda r, s: tuple(r[f"{s}_{k}"] for k in fields)
    first = {}
    for r in scored:
        for s in ("a", "b"):
            first[content(r, s)] = min(first.get(content(r, s), "~"), r[f"{s}_id"])
    matches = 0
    for r in scored:
        pair = tuple(sorted((first[content(r, "a")], first[content(r, "b")]))) if content(r, "a") != content(r, "b") else (first[content(r, "a")], r.b_id)
        if r.entity_score >= least:
            matches += 1
            assert pair in found
        if pair == (r.a_id, r.b_id) and pair in found:
            assert found[pair].bound >= r.entity_score - ca.ROUNDING
    assert matches or least > 0.8


def test_candidates_grow_with_the_records(spark):
    """One block of records that differ in birth date and identifier makes no pairs but those of equal dates."""
    def count(n):
        df = spark.range(n).select(
            F.format_string("r%06d", "id").alias("id"), F.concat(F.lit("M"), F.col("id").cast("string")).alias("m"), F.lit("Ann").alias("first"),
            F.lit("Knight").alias("last"), F.concat(F.lit("a"), F.col("id").cast("string"), F.lit("@acme.com")).alias("email"),
            F.concat((F.col("id") % 89 + 10).cast("string"), F.lit(" Main St, Miami, FL 33101")).alias("addr"),
            F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") / 2).cast("int")).cast("string").alias("born"))
        mapping = ca.ColumnMapping("id", identifier="m", first_name="first", last_name="last", email="email", address="addr", dob="born")
        return ca.candidate_pairs(df, mapping).count()

    small, large = count(4000), count(8000)
    assert small == 2000 and large == 4000


def test_fields_that_a_match_must_share():
    assert ca.needed("CUSTOMER", 0.70) == ["dob", "member_id"] and ca.needed("CUSTOMER", 0.90) == ["dob"]
    assert ca.needed("CUSTOMER", 0.50) is None and ca.needed("LOCATION", 0.80) == ["dob", "member_id"]
    assert ca.needed("SUPPLIER", 0.95) == ["supplier_id", "tax_id"]


def test_match_run(spark):
    records, mapping = people(spark, 60, 5)
    config = mr.RunConfig(mapping, requested_by="me", context_id="job", review_threshold=0.72, auto_merge_threshold=0.93, block_threshold=0.1)
    configs, thresholds, rules = policy_plans.tables(spark, DATA)
    out = mr.match_run(records, config, configs, thresholds, rules, feedback_plans.history(spark, DATA), AS_OF).collect()
    pairs = mr.scored_run(records, config, 0.0)
    want = {r.pair_id: round(r.entity_score + 1e-9, 2) for r in sc.score_pairs(si.pair_signals(pairs)).collect() if round(r.entity_score + 1e-9, 2) >= 0.72}
    assert {r.pair_id: r.match_score for r in out} == want and want
    assert {r.posture for r in out} <= {"REVIEW", "AUTO_MERGE"} and {r.requested_by for r in out} == {"me"}
    assert all((r.posture == "AUTO_MERGE") == (r.match_score >= 0.93) for r in out)
    with pytest.raises(ValueError):
        mr.RunConfig(mapping, review_threshold=0.9, auto_merge_threshold=0.8)


def test_rules_match_without_ids(spark):
    """Duplicate and NULL ids, and a policy of 5,000 rules, give each pair its own rules."""
    rules = [(f"id{i}", "CUSTOMER", "v1", f"R{i % 2500}", float(i % 7), "HIGH", "Y") for i in range(5000)] + [
        ("idn", "CUSTOMER", "v1", None, 1.0, "HIGH", "Y"), ("idv", "CUSTOMER", "v2", "R1", 1.0, "HIGH", "Y")]
    kind = "risk_rule_id string, domain string, policy_version string, triggered_rule string, risk_weight double, risk_level string, active_flag string"
    table = spark.createDataFrame(rules, kind).selectExpr(
        "*", "'x' as recommended_action", "'y' as override_reason_code", "'z' as notes",
        "cast(null as timestamp) as effective_from", "cast(null as timestamp) as effective_to")
    asked = [("X", ["R1"]), ("X", ["R2", "R2", None]), (None, ["R1", "R2499"]), (None, None), ("Y", []), ("Z", ["none"])]
    pairs = spark.createDataFrame([(i, "CUSTOMER", "v1", t) for i, t in asked], "pair_id string, domain string, policy_version string, triggered_rules array<string>")
    got = po.matched_risk_rules(pairs, table, AS_OF).collect()

    def want(names):
        hit = [r for r in rules if r[3] in (names or []) and r[3] is not None and r[2] == "v1"]
        return tuple(r[0] for r in sorted(hit, key=lambda r: (-r[4], r[3], r[0])))

    found = sorted((r.pair_id or "", tuple(x.risk_rule_id for x in r.matched_rules)) for r in got)
    assert found == sorted((i or "", want(t)) for i, t in asked)


def test_pair_without_policy_stays_with_a_reason(spark):
    configs, limits, rules = policy_plans.tables(spark, DATA)
    pairs = shaped(spark, DATA, "scored_pairs")
    out = po.with_policy(pairs, configs, limits, AS_OF)
    assert out.count() == pairs.count()
    assert {r.policy_status for r in out.where("domain = 'LOCATION'").select("policy_status").distinct().collect()} == {"NO_ACTIVE_CONFIG"}


def test_publishing_an_unknown_version_changes_nothing(spark):
    with pytest.raises(ValueError):
        po.publish(*policy_plans.tables(spark, DATA), "CUSTOMER", "v999", AS_OF)


def test_guidance_counts_only_the_first_rules(spark):
    assert po.risk_rule_guidance(5) is not None
    df = po.rule_summary(po.matched_risk_rules(
        po.with_policy(shaped(spark, DATA, "scored_pairs").drop("highest_risk_level"), *policy_plans.tables(spark, DATA)[:2], AS_OF),
        policy_plans.tables(spark, DATA)[2], AS_OF))
    for r in df.select(po.risk_rule_guidance(1).alias("g"), F.size("matched_rules").alias("n")).limit(300).collect():
        assert r.g.count("\n") == 0


def test_latest_feedback_of_a_hot_explanation(spark):
    start = dt.datetime(2001, 1, 1)
    rows = [("hot", f"f{i:05d}", start + dt.timedelta(minutes=i % 700)) for i in range(3000)] + [("cold", "f", start)]
    df = spark.createDataFrame(rows, "explanation_id string, feedback_id string, feedback_at timestamp").repartition(8)
    got = {r.explanation_id: r.feedback_id for r in latest_feedback(df).collect()}
    assert got == {"hot": "f02799", "cold": "f"}


def test_appended_rows_lose_unknown_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "y")], "a int, b string, c string")
    tables.append_events(df, str(tmp_path / "log"), ["a", "b"])
    tables.append_events(df, str(tmp_path / "log"), ["a", "b"])
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.columns == ["a", "b"] and back.count() == 2


def test_upsert_updates_and_inserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, keep string")
    new = spark.createDataFrame([("b", 20, "n"), ("c", 30, "n")], "k string, v int, keep string")
    values = {c: F.col(f"s.{c}") for c in old.columns}
    got = tables.upsert(old, new, ["k"], {"v": F.col("s.v")}, values)
    assert sorted(map(tuple, got.collect())) == [("a", 1, "x"), ("b", 20, "y"), ("c", 30, "n")]


def test_evidence_falls_back_and_fills(spark):
    df = one(spark, ("SUPPLIER", None, "T1", "  ", "Initech"), "domain string, a_supplier_id string, a_tax_id string, a_supplier_name string, a_first_name string")
    text = df.select(evidence_text(df)).first()[0]
    assert "Record A Supplier Evidence:\n- supplier_id: T1\n- tax_id: T1\n- supplier_name: Initech\n- contact_email: N/A" in text


def test_spread_leaves_enough_partitions_alone(spark):
    wide = spark.range(100, numPartitions=64)
    assert spread(wide) is wide
    assert spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_no_query_collects_in_a_python_row_function(spark):
    plan = policy_plans.QUERIES["policy_decision"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_policy_overrides_of_trust_weights_and_floors(spark):
    df = one(spark, ("1", "CUSTOMER", "mdm", "crm"), "pair_id string, domain string, a_source_system string, b_source_system string")
    assert si.identifier_signals(df, {"CRM": 1.0}).first().source_score == 1.0
    weights = co.weights_with({"CUSTOMER": {"dob_match": 0.75}})["CUSTOMER"]
    assert weights["dob_match"] == 0.5 and sum(weights.values()) == pytest.approx(1.0)
    assert co.weights_with(None) == sc.SIGNAL_WEIGHTS
    ready = one(spark, (70, 30), "decision_confidence_score int, composite_risk_score int")
    assert co.automation_readiness(ready).first().automation_tier == "REVIEW_ADVISED"
    assert co.automation_readiness(ready, {"auto_merge_ready_min": 70}).first().automation_tier == "AUTO_MERGE_READY"


def test_ticket_of_an_npi_reuse(spark):
    from concord.operators.tickets import governance_tickets

    row = ("exp_1", "PROVIDER", "REVIEW_REQUIRED", "REVIEW_REQUIRED", "HIGH", "44", "NPI_REUSE_DETECTED", "1887004555", "1887004555")
    df = one(spark, row, "explanation_id string, domain string, ai_decision string, recommended_action string, risk_flag string, "
                         "automation_readiness_score string, primary_risk_driver string, a_npi string, b_npi string")
    t = governance_tickets(df).first()
    assert t.summary == "Governance Review Required: Npi Reuse Detected (HIGH Risk / Review Required)"
    assert t.labels[-1] == "npi-reuse-detected" and 'Record A: {"npi":"1887004555"}' in t.description


def test_daily_scores_keep_open_days(spark, tmp_path):
    """Three micro-batches, a run without new rows and a late fourth batch: every event of every day counts once."""
    kind = "created_at timestamp, domain string, record_id string, record_score double"
    start = dt.datetime(2024, 1, 1)
    seen = []

    def arrive(k, hours):
        new = [(start + dt.timedelta(hours=h), "ab"[h % 2], f"r{h}", float(h * 7 % 100)) for h in hours]
        seen.extend(new)
        spark.createDataFrame(new, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run():
        rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        jobs.finished(jobs.keep_daily(jobs.daily_scores(rows), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
        got = {(r.metric_date, r.domain): r for r in jobs.kept(spark, f"{tmp_path}/out").collect()}
        want, ids = {}, {}
        for at, domain, record, score in seen:
            want.setdefault((at.date(), domain.upper()), []).append(score)
            ids.setdefault((at.date(), domain.upper()), set()).add(record)
        assert {k: (r.total_records, r.min_record_score, r.max_record_score) for k, r in got.items()} == {
            k: (len(v), min(v), max(v)) for k, v in want.items()}
        assert all(abs(r.avg_record_score - sum(want[k]) / len(want[k])) < 1e-9 for k, r in got.items())
        assert all(abs(r.approx_records - len(ids[k])) <= 0.15 * len(ids[k]) for k, r in got.items())

    for k, hours in enumerate([range(0, 30), range(20, 60), range(50, 90)]):
        arrive(k, hours)
    run()
    run()
    arrive(3, range(80, 100))
    run()


def test_stream_dq_daily_counts_every_event(spark):
    got = stream_plans.QUERIES["stream_dq_daily"](spark, DATA).agg(F.sum("total_records")).first()[0]
    assert got == spark.read.parquet(f"{DATA}/events.parquet").count()

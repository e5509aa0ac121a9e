"""Pairing, signal, address and name queries and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions.ladders import SOURCE_TRUST
from concord.functions.text import BUSINESS_HOSTS, PUBLIC_HOSTS, SPACED_SUFFIXES
from concord.operators import address as ad
from concord.operators import candidates as ca
from concord.operators import names as na
from concord.operators import scoring as sc
from concord.operators import signals as si
from concord.plans.checks import check, half_up
from concord.plans.quality_plans import rounded
from concord.sources.shaped import shaped, spread

MAPPING = ca.ColumnMapping("a_id", identifier="a_member_id", first_name="a_first_name", last_name="a_last_name",
                           email="a_email", address="a_address", dob="a_dob", source_system="a_source_system")


def as_domain(df, domain):
    return df.withColumn("domain", F.lit(domain))


def _score(name, domain):
    def run(s, d):
        out = sc.score_pairs(si.pair_signals(as_domain(spread(shaped(s, d, name)), domain)))
        return rounded(out.select("pair_id", F.col("entity_score").alias("entity_score"), F.round("entity_score", 2).alias("match_score"),
                                  "name_score", "address_score", "email_score", "source_score"))
    return run


def _product(s, d):
    out = sc.score_pairs(si.pair_signals(spread(shaped(s, d, "product_pairs"))))
    return rounded(out.select("pair_id", "product_id_score", "gtin_score", "sku_score", "name_score", "lot_date_score",
                              "attribute_score", "source_score", F.col("entity_score").alias("match_score")))


def _signals(name, *columns):
    """The signals of one domain that need no mailbox comparison."""
    def run(s, d):
        return si.pair_signals(spread(shaped(s, d, name))).select("pair_id", *columns)
    return run


def _identifiers(s, d):
    names = ["member_id_score", "supplier_id_score", "tax_id_score", "gtin_score", "provider_id_score", "npi_score",
             "lot_date_score", "dob_score"]
    frames = [si.identifier_signals(shaped(s, d, n)).select("pair_id", "domain", *names) for n in
              ("match_pairs", "product_pairs", "supplier_pairs", "provider_pairs", "patient_pairs")]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _names(s, d):
    p = shaped(s, d, "match_pairs")
    return p.select("pair_id", si.name_similarity((F.col("a_first_name"), F.col("b_first_name")),
                                                  (F.col("a_last_name"), F.col("b_last_name"))).alias("name_similarity"))


def _email(s, d):
    p = shaped(s, d, "match_pairs").withColumn("sim", si.email_similarity(F.col("a_email"), F.col("b_email")))
    score = si.email_score(F.col("a_email"), F.col("b_email"), F.col("sim"))
    out = p.withColumn("email_score", F.round(score, 4)).withColumn("email_match_level", si.email_level(score))
    return out.select("pair_id", "email_score", "email_match_level")


def _sides(s, d):
    p = spread(shaped(s, d, "match_pairs"))
    return ad.validate(ad.validate(p, "a_address", "a_"), "b_address", "b_")


def _validated(s, d):
    p = spread(shaped(s, d, "match_pairs"))
    both = p.select(F.concat("pair_id", F.lit("a")).alias("record_id"), F.col("a_address").alias("address")).unionByName(
        p.select(F.concat("pair_id", F.lit("b")).alias("record_id"), F.col("b_address").alias("address")))
    return ad.validate(both).select("record_id", *ad.PARTS).withColumn("findings", F.array_join("findings", "; "))


def _compared_names(s, d):
    out = na.compare_names(spread(shaped(s, d, "match_pairs")), "a_first_name", "b_first_name")
    return out.select("pair_id", "normalized_a", "normalized_b", "similarity_score", "match_level", "phonetic_key_a", "phonetic_key_b",
                      "nickname_match", F.array_join("findings", "; ").alias("findings"), "insight")


QUERIES = {
    "candidate_pairs": lambda s, d: ca.candidate_pairs(shaped(s, d, "match_pairs"), MAPPING),
    "supplier_signals": _signals("supplier_pairs", "supplier_id_score", "tax_id_score", "name_score", "address_score", "source_score"),
    "provider_signals": _signals("provider_pairs", "provider_scored", "provider_id_score", "npi_score", "name_score", "address_score",
                                 "specialty_score", "source_score"),
    "patient_signals": _signals("patient_pairs", "patient_id_score", "human_id_score", "dob_score", "name_score", "address_score", "source_score"),
    "score_customer": _score("match_pairs", "CUSTOMER"),
    "score_product": _product,
    "score_supplier": _score("supplier_pairs", "SUPPLIER"),
    "score_provider": _score("provider_pairs", "PROVIDER"),
    "score_patient": _score("patient_pairs", "PATIENT"),
    "score_generic": _score("match_pairs", "LOCATION"),
    "identifier_match": _identifiers,
    "name_similarity": _names,
    "email_score": _email,
    "address_similarity": lambda s, d: shaped(s, d, "match_pairs").select(
        "pair_id", si.address_similarity(F.col("a_address"), F.col("b_address")).alias("address_similarity")),
    "source_trust": lambda s, d: rounded(shaped(s, d, "match_pairs").select(
        "pair_id", si.source_trust(F.col("a_source_system"), F.col("b_source_system")).alias("source_trust"))),
    "address_validate": _validated,
    "address_compare": lambda s, d: ad.compare(_sides(s, d)).select("pair_id", "postal_match_level", "address_match_insight"),
    "name_compare": _compared_names,
    "name_phonetic_key": lambda s, d: shaped(s, d, "match_pairs").select(
        "pair_id", na.phonetic_key(F.col("a_last_name")).alias("key_a"), na.phonetic_key(F.col("b_first_name")).alias("key_b")),
    "name_key_groups": lambda s, d: na.names_by_key(shaped(s, d, "match_pairs"), "a_last_name"),
}


def _n(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


def _exact(a: str, b: str) -> str:
    return f"CASE WHEN {_n(a)} <> '' AND {_n(a)} = {_n(b)} THEN 1e0 ELSE 0e0 END"


def _jw(a: str, b: str) -> str:
    """Similarity of two normalised texts."""
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE round(jaro_winkler_similarity({a}, {b}), 4) END"


def _trust(a: str, b: str) -> str:
    one = lambda c: f"CASE upper(coalesce({c}, '')) " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in SOURCE_TRUST.items()) + " ELSE 0.65e0 END"
    return f"round((({one(a)}) + ({one(b)})) / 2e0 - abs(({one(a)}) - ({one(b)})) * 0.25e0, 4)"


def _host_trust(c: str) -> str:
    host = f"trim(split_part({_n(c)}, '@', 2))"
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    return (f"CASE WHEN {host} IN ({listed(BUSINESS_HOSTS)}) THEN 1.1e0 WHEN ends_with({host}, '.edu') THEN 1.05e0 "
            f"WHEN {host} IN ({listed(PUBLIC_HOSTS)}) THEN 0.95e0 ELSE 1e0 END")


def _addr(c: str) -> str:
    v = _n(c)
    for word, short in SPACED_SUFFIXES.items():
        v = f"replace({v}, '{word}', '{short}')"
    return f"regexp_replace({v}, '[^a-z0-9 ]', '', 'g')"


def _standard(c: str) -> str:
    v = f"trim(regexp_replace(regexp_replace(upper(trim({c})), '[^\\w\\s#\\-/,]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for word, short in {**ad.SUFFIX_WORDS, **ad.DIRECTION_WORDS}.items():
        v = f"regexp_replace({v}, '\\b{word}\\b', '{short}', 'g')"
    return f"trim(trim(regexp_replace(regexp_replace({v}, '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g')), ' ,')"


# The phonetic key names its argument many times, so each step is a CTE of its own.
def _phonetic_ctes(source: str, columns: dict[str, str], carry: str) -> dict[str, str]:
    steps = {"ph0": f"SELECT {carry}, " + ", ".join(f"nullif(regexp_replace(lower({c}), '[^a-z]', '', 'g'), '') AS {k}" for k, c in columns.items()) + f" FROM {source}"}

    def swapped(k: str) -> str:
        v = k
        for group, sound in na.SOUND_GROUPS:
            v = f"replace({v}, '{group}', '{sound}')"
        return v

    def collapsed(k: str) -> str:
        v = k
        for letter in "abcdefghijklmnopqrstuvwxyz":
            v = f"regexp_replace({v}, '{letter}+', '{letter}', 'g')"
        return v

    steps["ph1"] = "SELECT * REPLACE (" + ", ".join(f"{swapped(k)} AS {k}" for k in columns) + ") FROM ph0"
    steps["ph2"] = "SELECT * REPLACE (" + ", ".join(
        f"substr({k}, 1, 1) || regexp_replace(substr({k}, 2), '[aeiouy]', '', 'g') AS {k}" for k in columns) + ") FROM ph1"
    steps["ph3"] = "SELECT * REPLACE (" + ", ".join(f"substr({collapsed(k)}, 1, 6) AS {k}" for k in columns) + ") FROM ph2"
    return steps


def _mail(c: str) -> str:
    v = _n(c)
    local, host = f"split_part({v}, '@', 1)", f"substr({v}, strpos({v}, '@') + 1)"
    return f"""CASE WHEN strpos({v}, '@') = 0 THEN {v} WHEN {host} IN ('gmail.com', 'googlemail.com')
      THEN split_part(replace({local}, '.', ''), '+', 1) || '@' || {host} ELSE {v} END"""


def _parsed(source: str, id_column: str) -> dict[str, str]:
    """Address parts of ``address`` in ``source``."""
    states = ", ".join(f"'{s}'" for s in ad.STATES)
    street = " OR ".join(f"contains(' ' || std || ' ', ' {w} ')" for w in ad.STREET_WORDS)
    return {
        "p0": f"SELECT {id_column}, address, trim(coalesce(address, '')) = '' AS missing, CASE WHEN trim(coalesce(address, '')) <> '' THEN {_standard('address')} END AS std FROM {source}",
        "p1": f"""SELECT *, nullif(regexp_extract(std, '\\b(\\d{{5}})(?:-\\d{{4}})?\\b'), '') AS zip,
          list_filter(regexp_extract_all(std, '\\b([A-Z]{{2}})\\b', 1), lambda x: list_contains([{states}], x))[-1] AS st,
          CASE WHEN regexp_matches(std, '\\b(APT|STE|UNIT|#)\\s*([A-Z0-9\\-]+)\\b') THEN regexp_extract(std, '\\b(APT|STE|UNIT|#)\\s*([A-Z0-9\\-]+)\\b', 1) || ' ' ||
            regexp_extract(std, '\\b(APT|STE|UNIT|#)\\s*([A-Z0-9\\-]+)\\b', 2) END AS unit,
          list_filter(list_transform(string_split(std, ','), lambda x: trim(x)), lambda x: x <> '') AS seg FROM p0""",
        "p2": f"""SELECT *, round(CASE WHEN std <> '' THEN 0.25e0 ELSE 0e0 END + CASE WHEN regexp_matches(std, '\\b\\d+\\b') THEN 0.2e0 ELSE 0e0 END
          + CASE WHEN {street} THEN 0.2e0 ELSE 0e0 END + CASE WHEN st IS NOT NULL THEN 0.15e0 ELSE 0e0 END + CASE WHEN zip IS NOT NULL THEN 0.2e0 ELSE 0e0 END, 2) AS conf FROM p1""",
    }


_CORE = "trim(regexp_replace(regexp_replace(regexp_replace(std, '\\b(\\d{5})(?:-\\d{4})?\\b', '', 'g'), '\\b(APT|STE|UNIT|#)\\s*([A-Z0-9\\-]+)\\b', '', 'g'), '\\s+', ' ', 'g'))"
_BOTH = "SELECT pair_id || 'a' AS record_id, a_address AS address FROM match_pairs UNION ALL SELECT pair_id || 'b', b_address FROM match_pairs"


def _ids(name: str, member: str, **fields: str) -> str:
    """Exact signals of one pair table; a field not given does not exist there."""
    pick = lambda f: fields.get(f, "NULL")
    two = lambda e: (e.replace("@", "a_"), e.replace("@", "b_"))
    cols = {"supplier_id_score": pick("supplier"), "tax_id_score": pick("tax"), "gtin_score": pick("gtin"), "provider_id_score": pick("provider"),
            "npi_score": pick("npi"), "lot_date_score": pick("lot"), "dob_score": pick("dob")}
    return f"SELECT pair_id, domain, {_exact(*two(member))} AS member_id_score, " + ", ".join(f"{_exact(*two(e))} AS {k}" for k, e in cols.items()) + f" FROM {name}"


PRODUCT = {
    "n": "SELECT pair_id, a_source_system, b_source_system, a_gtin, b_gtin, a_effective_lot_date, b_effective_lot_date, "
    + ", ".join(f"{_n(f'{s}_{c}')} AS {s}_{k}" for s in "ab" for k, c in
                (("id", "product_id"), ("sku", "sku"), ("name", "product_name"), ("var", "product_variant"), ("pack", "pack_size"))) + " FROM product_pairs",
    "g": f"""SELECT pair_id, {_jw('a_id', 'b_id')} AS product_id_score, {_exact('a_gtin', 'b_gtin')} AS gtin_score, {_jw('a_sku', 'b_sku')} AS sku_score,
      {_jw('a_name', 'b_name')} AS name_score, {_exact('a_effective_lot_date', 'b_effective_lot_date')} AS lot_date_score, {_jw('a_var', 'b_var')} AS var,
      {_jw('a_pack', 'b_pack')} AS pack, {_trust('a_source_system', 'b_source_system')} AS source_score FROM n""",
    "h": "SELECT *, list_filter([name_score, var, pack, sku_score], lambda x: x > 0) AS parts FROM g",
}

CANDIDATES = f"""SELECT a_id, b_id, blocks, {half_up("""CASE WHEN dob = 1 AND address >= 0.95e0 AND name >= 0.85e0 THEN greatest(total, 0.82e0)
        WHEN dob = 1 AND name >= 0.9e0 THEN greatest(total, 0.78e0) ELSE total END""", 6)} AS bound
      FROM (SELECT *, name * 0.25e0 + email * 0.15e0 + address * 0.2e0 + dob * 0.25e0 + member * 0.1e0 + source * 0.05e0 AS total FROM bounds)
      WHERE bound >= 0.695e0"""
CANDIDATE_CTES = {**_phonetic_ctes("match_pairs", {"sound": "a_last_name"}, "* EXCLUDE (pair_id)"),
         "zipped": f"SELECT *, regexp_extract({_standard('a_address')}, '\\b(\\d{{5}})(?:-\\d{{4}})?\\b', 1) AS zip FROM ph3",
         "keyed": f"""SELECT a_id AS id, 'identifier' AS kind, {_n('a_member_id')} AS key FROM zipped WHERE {_n('a_member_id')} <> ''
           UNION ALL SELECT a_id, 'email', {_mail('a_email')} FROM zipped WHERE {_n('a_email')} <> ''
           UNION ALL SELECT a_id, 'name_zip', sound || '|' || zip FROM zipped WHERE zip <> '' AND sound <> ''""",
         "told": f"""SELECT a_id AS id, min(a_id) OVER (PARTITION BY a_member_id, a_first_name, a_last_name, a_email, a_address, a_dob, a_source_system) AS first_id,
           a_source_system AS sys, {_n('a_member_id')} AS member, {_n('a_dob')} AS dob, lower(trim(coalesce(a_first_name, '') || ' ' || coalesce(a_last_name, ''))) AS name,
           {_addr('a_address')} AS address, regexp_replace({_mail('a_email')}, '[^a-z0-9@ ]+', '', 'g') AS mail, {_host_trust('a_email')} AS mail_trust FROM match_pairs""",
         "met": """SELECT a.id AS a_id, b.id AS b_id, string_agg(DISTINCT a.kind, ',' ORDER BY a.kind) AS blocks FROM keyed a JOIN keyed b USING (kind, key)
           JOIN told ta ON ta.id = a.id JOIN told tb ON tb.id = b.id
           WHERE a.id < b.id AND (ta.first_id = b.id OR tb.first_id = a.id OR ta.first_id = a.id AND tb.first_id = b.id) GROUP BY 1, 2""",
         "bounds": f"""SELECT a_id, b_id, blocks, CASE WHEN a.dob <> '' AND a.dob = b.dob THEN 1 ELSE 0 END AS dob, CASE WHEN a.member <> '' AND a.member = b.member THEN 1 ELSE 0 END AS member,
           CASE WHEN len(a.name) + len(b.name) = 0 THEN 1e0 ELSE 1e0 - levenshtein(a.name, b.name) / (len(a.name) + len(b.name)) END AS name,
           CASE WHEN a.mail <> '' AND b.mail <> '' THEN least(1e0, a.mail_trust, b.mail_trust) ELSE 0e0 END AS email,
           CASE WHEN a.address = '' OR b.address = '' THEN 0e0 WHEN a.address = b.address THEN 1e0 ELSE 0.6e0 * (2 + least(len(a.address), len(b.address)) / greatest(len(a.address), len(b.address))) / 3 + 0.4e0 END AS address,
           {_trust('a.sys', 'b.sys')} AS source FROM met JOIN told a ON a.id = a_id JOIN told b ON b.id = b_id"""}

CHECKS = {
    "candidate_pairs": check(["match_pairs"], CANDIDATES, CANDIDATE_CTES),
    "score_product": check(["product_pairs"], f"""SELECT pair_id, product_id_score, gtin_score, sku_score, name_score, lot_date_score, source_score,
      coalesce(attribute, 0e0) AS attribute_score, {half_up("""product_id_score * 0.2e0 + gtin_score * 0.25e0 + sku_score * 0.15e0 + name_score * 0.1e0 + lot_date_score * 0.1e0
        + coalesce(attribute, 0e0) * 0.1e0 + source_score * 0.05e0 + 0.05e0""", 4)} AS match_score
      FROM (SELECT *, {half_up("list_sum(parts) / nullif(len(parts), 0)", 4)} AS attribute FROM h)""", PRODUCT),
    "supplier_signals": check(["supplier_pairs"], f"""SELECT pair_id, {_exact("coalesce(nullif(a_supplier_id, ''), a_member_id)", "coalesce(nullif(b_supplier_id, ''), b_member_id)")} AS supplier_id_score,
      {_exact('a_tax_id', 'b_tax_id')} AS tax_id_score, {_jw('an', 'bn')} AS name_score, {_jw('aa', 'ba')} AS address_score, {_trust('a_source_system', 'b_source_system')} AS source_score
      FROM (SELECT *, {_n('a_supplier_name')} AS an, {_n("coalesce(nullif(b_supplier_name, ''), b_first_name)")} AS bn, {_addr('a_supplier_address')} AS aa,
        {_addr('b_supplier_address')} AS ba FROM supplier_pairs)"""),
    "provider_signals": check(["provider_pairs"], f"""SELECT pair_id, scored AS provider_scored, {_exact('a_provider_id', 'b_provider_id')} AS provider_id_score, {_exact('a_npi', 'b_npi')} AS npi_score,
      CASE WHEN scored THEN {_jw('an', 'bn')} ELSE round({_jw('af', 'bf')} * 0.4e0 + {_jw('al', 'bl')} * 0.6e0, 4) END AS name_score,
      CASE WHEN scored THEN {_jw('ar', 'br')} ELSE {_jw('aa', 'ba')} END AS address_score, {_jw('asp', 'bsp')} AS specialty_score, {_trust('a_source_system', 'b_source_system')} AS source_score
      FROM (SELECT *, {_n("coalesce(nullif(a_provider_email, ''), a_email)")} <> '' AND {_n("coalesce(nullif(b_provider_email, ''), b_email)")} <> '' AS scored, """
      + ", ".join(f"""lower(trim(coalesce({x}_provider_first_name, '') || ' ' || coalesce({x}_provider_last_name, ''))) AS {x}n, {_n(f'{x}_first_name')} AS {x}f, {_n(f'{x}_last_name')} AS {x}l,
        {_n(f"coalesce(nullif({x}_provider_address, ''), {x}_address)")} AS {x}r, {_addr(f'{x}_address')} AS {x}a, {_n(f'{x}_specialty')} AS {x}sp""" for x in "ab") + " FROM provider_pairs)"),
    "patient_signals": check(["patient_pairs"], f"""SELECT pair_id, CASE WHEN ai <> '' AND ai = bi THEN 1e0 WHEN split_part(ai, '-', 1) <> '' AND split_part(ai, '-', 1) = split_part(bi, '-', 1) THEN 0.9e0
        ELSE {_jw('ai', 'bi')} END AS patient_id_score, CASE WHEN {_n('a_human_id')} = '' OR {_n('b_human_id')} = '' THEN NULL WHEN {_n('a_human_id')} = {_n('b_human_id')} THEN 1e0 ELSE 0e0 END AS human_id_score,
      {_exact("coalesce(nullif(a_patient_dob, ''), a_dob)", 'b_dob')} AS dob_score, round({_jw('af', 'bf')} * 0.4e0 + {_jw('al', 'bl')} * 0.6e0, 4) AS name_score,
      {_jw('aa', 'ba')} AS address_score, {_trust('a_source_system', 'b_source_system')} AS source_score
      FROM (SELECT *, {_n('a_patient_id')} AS ai, {_n('b_patient_id')} AS bi, {_n("coalesce(nullif(a_patient_first_name, ''), a_first_name)")} AS af, {_n('b_first_name')} AS bf,
        {_n("coalesce(nullif(a_patient_last_name, ''), a_last_name)")} AS al, {_n('b_last_name')} AS bl, {_addr('a_address')} AS aa, {_addr('b_patient_address')} AS ba FROM patient_pairs)"""),
    "identifier_match": check(
        ["match_pairs", "product_pairs", "supplier_pairs", "provider_pairs", "patient_pairs"],
        " UNION ALL ".join([
            _ids("match_pairs", "@member_id", supplier="@member_id", dob="@dob"),
            _ids("product_pairs", "coalesce(nullif(trim(@product_id), ''), nullif(trim(@gtin), ''), nullif(trim(@sku), ''))", gtin="@gtin", lot="@effective_lot_date"),
            _ids("supplier_pairs", "coalesce(nullif(trim(@supplier_id), ''), nullif(trim(@tax_id), ''), nullif(trim(@member_id), ''))",
                 supplier="coalesce(nullif(@supplier_id, ''), @member_id)", tax="@tax_id"),
            _ids("provider_pairs", "coalesce(nullif(trim(@provider_id), ''), nullif(trim(@npi), ''))", provider="@provider_id", npi="@npi"),
            _ids("patient_pairs", "@patient_id", dob="@dob").replace("b_dob", "b_dob").replace(
                "lower(trim(coalesce(a_dob, '')))", "lower(trim(coalesce(nullif(a_patient_dob, ''), a_dob, '')))"),
        ])),
    "name_similarity": check(["match_pairs"], f"""SELECT pair_id, round({_jw(_n('a_first_name'), _n('b_first_name'))} * 0.4e0
      + {_jw(_n('a_last_name'), _n('b_last_name'))} * 0.6e0, 4) AS name_similarity FROM match_pairs"""),
    "address_similarity": check(["match_pairs"], f"SELECT pair_id, {_jw('a', 'b')} AS address_similarity FROM (SELECT pair_id, {_addr('a_address')} AS a, {_addr('b_address')} AS b FROM match_pairs)"),
    "source_trust": check(["match_pairs"], f"SELECT pair_id, {_trust('a_source_system', 'b_source_system')} AS source_trust FROM match_pairs"),
    "address_validate": check(["match_pairs"], """SELECT record_id, CASE WHEN missing THEN address ELSE trim(address) END AS raw_address, std AS standardized_address,
      coalesce(seg[1], std) AS address_line_1, unit AS address_line_2, seg[2] AS city, st AS state, zip AS postal_code, 'US' AS country,
      CASE WHEN missing THEN 'MISSING' WHEN conf >= 0.85e0 THEN 'VALID' WHEN conf >= 0.5e0 THEN 'PARTIAL' ELSE 'INVALID' END AS validation_status,
      CASE WHEN missing THEN NULL WHEN conf >= 0.85e0 THEN TRUE WHEN conf >= 0.5e0 THEN NULL ELSE FALSE END AS deliverable_flag, conf AS address_confidence,
      CASE WHEN missing THEN 'Address missing' ELSE concat_ws('; ', CASE WHEN std <> upper(trim(address)) THEN 'Address formatting normalized' END,
        CASE WHEN zip IS NOT NULL AND NOT regexp_matches(std, '\\b\\d{5}-\\d{4}\\b') THEN 'Postal code present without ZIP+4' END,
        CASE WHEN regexp_matches(std, '\\bP\\s*O\\s*BOX\\b|\\bPO BOX\\b') THEN 'PO Box detected' END,
        CASE WHEN conf >= 0.5e0 AND conf < 0.85e0 THEN 'Address may be incomplete or partially structured' END,
        CASE WHEN conf < 0.5e0 THEN 'Address structure appears insufficient for reliable verification' END,
        CASE WHEN st IS NULL THEN 'State missing or not recognized' END, CASE WHEN zip IS NULL THEN 'Postal code missing' END) END AS findings FROM p2""",
        {"both_sides": _BOTH, **_parsed("both_sides", "record_id")}),
    "address_compare": check(["match_pairs"], """SELECT pair_id, lvl AS postal_match_level, CASE WHEN coalesce(a_std, '') = '' OR coalesce(b_std, '') = '' THEN 'Address comparison unavailable.'
        WHEN lvl = 'EXACT' THEN 'Addresses normalize to the same standardized location.'
        WHEN lvl = 'NEAR' THEN 'Addresses appear highly similar after normalization and support the match.'
        WHEN lvl = 'PARTIAL' THEN 'Addresses share partial similarity but contain differences that may require review.'
        WHEN lvl = 'NONE' THEN 'Addresses do not materially support the match after normalization.' ELSE 'Address evidence is incomplete or unavailable.' END AS address_match_insight
      FROM (SELECT *, CASE WHEN coalesce(a_std, '') = '' OR coalesce(b_std, '') = '' THEN 'UNKNOWN' WHEN a_std = b_std OR a_core = b_core THEN 'EXACT'
        WHEN len(aw) = 0 OR len(bw) = 0 THEN 'UNKNOWN' WHEN substr(a_zip, 1, 5) = substr(b_zip, 1, 5) AND a_st = b_st AND len(list_intersect(aw, bw)) / least(len(aw), len(bw)) >= 0.75e0 THEN 'NEAR'
        WHEN len(list_intersect(aw, bw)) / least(len(aw), len(bw)) >= 0.5e0 THEN 'PARTIAL' ELSE 'NONE' END AS lvl FROM sided)""",
        {"both_sides": _BOTH, **_parsed("both_sides", "record_id"),
         "cores": f"SELECT *, {_CORE} AS core, list_distinct(list_filter(string_split({_CORE}, ' '), lambda w: w <> '')) AS words FROM p2",
         "sided": """SELECT m.pair_id, a.std AS a_std, b.std AS b_std, a.core AS a_core, b.core AS b_core, a.words AS aw, b.words AS bw, a.zip AS a_zip, b.zip AS b_zip,
           a.st AS a_st, b.st AS b_st FROM match_pairs m JOIN cores a ON a.record_id = m.pair_id || 'a' JOIN cores b ON b.record_id = m.pair_id || 'b'"""}),
    "name_phonetic_key": check(["match_pairs"], "SELECT * FROM ph3", _phonetic_ctes("match_pairs", {"key_a": "a_last_name", "key_b": "b_first_name"}, "pair_id")),
    "name_key_groups": check(["match_pairs"], """SELECT key AS phonetic_key, count(*) AS records, count(DISTINCT lower(trim(name))) AS spellings,
      min(lower(trim(name))) AS first_spelling FROM ph3 WHERE key IS NOT NULL GROUP BY 1""", _phonetic_ctes("match_pairs", {"key": "a_last_name"}, "a_last_name AS name")),
}

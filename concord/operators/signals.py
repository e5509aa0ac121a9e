"""Match signals of a record pair: what agrees, and how closely.

Pairs carry one column per record field and side: ``a_email``, ``b_email`` and so on. Any
field may be absent. The domain decides which fields a signal looks at.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import SOURCE_TRUST, UNKNOWN_SOURCE_TRUST, clamp, email_level, lookup
from concord.functions.similarity import jaro_winkler, sequence_ratio, weighted_ratio
from concord.functions.text import (
    col_or_null, comparable_address, comparable_email, compact, email_trust, first_with_text, folded, or_else, strip,
)
from concord.operators.policy import domain_of

# Fields that name a record, best first.
ENTITY_ID_FIELDS = {
    "CUSTOMER": ("member_id",),
    "PATIENT": ("patient_id", "member_id"),
    "PROVIDER": ("provider_id", "npi", "member_id"),
    "SUPPLIER": ("supplier_id", "vendor_id", "tax_id", "member_id"),
    "PRODUCT": ("product_id", "gtin", "sku", "upc", "member_id"),
}


class Sides:
    """Column access for the two records of a pair."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __call__(self, side: str, field: str) -> Column:
        return col_or_null(self.df, f"{side}_{field}")

    def either(self, side: str, *fields: str) -> Column:
        return or_else(*[self(side, f) for f in fields])

    def both(self, make) -> tuple[Column, Column]:
        return make("a"), make("b")


def by_domain(domain: Column, choices: Mapping[str, Column], otherwise: Column) -> Column:
    out = F
    for name, value in choices.items():
        out = out.when(domain == name, value)
    return out.otherwise(otherwise) if choices else otherwise


def entity_id(f: Sides, side: str, domain: Column) -> Column:
    first = lambda names: first_with_text(*[f(side, n) for n in names])
    return by_domain(domain, {d: first(names) for d, names in ENTITY_ID_FIELDS.items()}, first(("member_id",)))


def exact(a: Column, b: Column) -> Column:
    """1.0 when both texts say the same and say something, else 0.0."""
    x, y = folded(a), folded(b)
    return F.when((x != "") & (x == y), 1.0).otherwise(0.0)


def source_trust(a: Column, b: Column, overrides: Mapping[str, float] | None = None) -> Column:
    """Mean trust of the two source systems, less a quarter of their difference."""
    table = {**SOURCE_TRUST, **{k.upper(): max(0.0, min(float(v), 1.0)) for k, v in (overrides or {}).items()}}
    trust = lambda s: lookup(F.upper(F.coalesce(s, F.lit(""))), table, UNKNOWN_SOURCE_TRUST)
    x, y = trust(a), trust(b)
    return F.round(clamp((x + y) / 2.0 - F.abs(x - y) * 0.25, 0.0, 1.0), 4)


def name_similarity(first: tuple[Column, Column], last: tuple[Column, Column]) -> Column:
    return F.round(jaro_winkler(*map(folded, first)) * 0.4 + jaro_winkler(*map(folded, last)) * 0.6, 4)


def address_similarity(a: Column, b: Column) -> Column:
    return jaro_winkler(comparable_address(a), comparable_address(b))


def email_similarity(a: Column, b: Column) -> Column:
    return weighted_ratio(compact(comparable_email(a)), compact(comparable_email(b)))


def email_score(a: Column, b: Column, similarity: Column | None = None) -> Column:
    """Similarity of two mailboxes times the lower trust of their hosts, at most 1."""
    near = similarity if similarity is not None else email_similarity(a, b)
    return F.least(near * F.least(email_trust(a), email_trust(b)), F.lit(1.0))


def human_id_score(a: Column, b: Column) -> Column:
    """1 or 0 when both are known, NULL when the evidence is incomplete."""
    x, y = folded(a), folded(b)
    return F.when((x == "") | (y == ""), F.lit(None).cast("double")).when(x == y, 1.0).otherwise(0.0)


def identifier_signals(pairs: DataFrame, trust: Mapping[str, float] | None = None) -> DataFrame:
    """The signals that need no fuzzy comparison. ``trust`` overrides the trust of source systems."""
    f, dom = Sides(pairs), domain_of(pairs)
    same = lambda *fields: exact(*f.both(lambda s: f.either(s, *fields)))
    dob = by_domain(dom, {"PATIENT": same("patient_dob", "dob")}, same("dob"))
    return pairs.withColumns({
        "member_id_score": exact(entity_id(f, "a", dom), entity_id(f, "b", dom)),
        "supplier_id_score": same("supplier_id", "member_id"),
        "tax_id_score": same("tax_id"),
        "gtin_score": same("gtin"),
        "provider_id_score": same("provider_id"),
        "npi_score": same("npi"),
        "lot_date_score": same("effective_lot_date"),
        "dob_score": dob,
        "human_id_score": human_id_score(f("a", "human_id"), f("b", "human_id")),
        "source_score": source_trust(f("a", "source_system"), f("b", "source_system"), trust),
    })


def compared_texts(f: Sides, dom: Column, scored: Column, s: str) -> dict[str, Column]:
    """The texts one side brings to the fuzzy comparisons; NULL where its domain compares none."""
    joined = lambda *names: strip(F.concat_ws(" ", *[F.coalesce(f(s, n), F.lit("")) for n in names]))
    only = lambda d, c: F.when(dom == d, folded(c))
    provider_name = F.when(scored, joined("provider_first_name", "provider_last_name")).otherwise(f(s, "first_name"))
    first = by_domain(dom, {
        "PRODUCT": f(s, "product_name"), "SUPPLIER": f.either(s, "supplier_name", "first_name"),
        "PROVIDER": provider_name, "PATIENT": f.either(s, "patient_first_name", "first_name"),
    }, f(s, "first_name"))
    last = F.when(dom == "PATIENT", f.either(s, "patient_last_name", "last_name")).when(
        ~dom.isin("PRODUCT", "SUPPLIER") & ~scored, f(s, "last_name"))
    address = by_domain(dom, {
        "SUPPLIER": f.either(s, "supplier_address", "address"), "PATIENT": f.either(s, "patient_address", "address"),
    }, f(s, "address"))
    email = by_domain(dom, {
        "SUPPLIER": f.either(s, "contact_email", "email"), "PATIENT": f.either(s, "patient_email", "email"),
    }, f(s, "email"))
    return {
        "first": folded(first),
        "last": F.when(last.isNotNull(), folded(last)),
        "full": F.when(dom == "CUSTOMER", F.lower(joined("first_name", "last_name"))),
        "address": F.when(scored, folded(f.either(s, "provider_address", "address"))).otherwise(comparable_address(address)),
        "email": email,
        "provider_email": F.when(scored, f.either(s, "provider_email", "email")),
        "id": F.when(dom == "PRODUCT", folded(f(s, "product_id"))).when(dom == "PATIENT", folded(f(s, "patient_id"))),
        "sku": only("PRODUCT", f(s, "sku")),
        "variant": only("PRODUCT", f(s, "product_variant")),
        "pack": only("PRODUCT", f(s, "pack_size")),
        "specialty": only("PROVIDER", f(s, "specialty")),
    }


def pair_signals(pairs: DataFrame, trust: Mapping[str, float] | None = None) -> DataFrame:
    """All signals of a pair, each looking at the fields its domain compares.

    Every fuzzy comparison runs once per pair, on the text picked for its domain, and all of
    them share one pass through Python. A provider pair in which a side has no mailbox is
    scored like any other record: ``provider_scored`` tells.
    """
    df = identifier_signals(pairs, trust)
    f, dom = Sides(df), F.col("_dom")
    df = df.withColumn("_dom", domain_of(pairs))
    mail = lambda s: folded(f.either(s, "provider_email", "email"))
    df = df.withColumn("provider_scored", (dom == "PROVIDER") & (mail("a") != "") & (mail("b") != ""))
    scored = F.col("provider_scored")
    f = Sides(df)
    texts = {s: compared_texts(f, dom, scored, s) for s in ("a", "b")}
    # The picked texts get columns of their own, so that each is computed once.
    df = df.withColumns({f"_{s}_{k}": v for s in ("a", "b") for k, v in texts[s].items()})
    t = lambda k: (F.col(f"_a_{k}"), F.col(f"_b_{k}"))
    df = df.withColumns({
        **{f"_{k}": jaro_winkler(*t(k)) for k in ("first", "last", "address", "id", "sku", "variant", "pack", "specialty")},
        "_full": sequence_ratio(*t("full")),
        "_email": email_similarity(*t("email")),
        "_provider_email": email_similarity(*t("provider_email")),
    })
    one_name = dom.isin("PRODUCT", "SUPPLIER") | scored
    name = F.when(one_name, F.col("_first")).otherwise(F.round(F.col("_first") * 0.4 + F.col("_last") * 0.6, 4))
    attributes = F.filter(F.array("_first", "_variant", "_pack", "_sku"), lambda x: x > 0)
    mean = F.aggregate(attributes, F.lit(0.0), lambda acc, x: acc + x) / F.size(attributes)
    base = lambda s: F.split(F.col(f"_{s}_id"), "-")[0]
    patient = (
        F.when((F.col("_a_id") != "") & (F.col("_a_id") == F.col("_b_id")), 1.0)
        .when((base("a") != "") & (base("a") == base("b")), 0.90).otherwise(F.col("_id"))
    )
    only = lambda d, c: F.when(dom == d, c).otherwise(F.lit(0.0))
    df = df.withColumns({
        "name_score": name,
        "name_seq_score": F.when(dom == "CUSTOMER", F.col("_full")),
        "address_score": F.col("_address"),
        "email_score": email_score(*t("email"), F.col("_email")),
        "email_trust": F.least(*map(email_trust, t("email"))),
        "provider_email_score": F.when(scored, email_score(*t("provider_email"), F.col("_provider_email"))).otherwise(0.0),
        "product_id_score": only("PRODUCT", F.col("_id")),
        "patient_id_score": only("PATIENT", patient),
        "sku_score": F.col("_sku"),
        "attribute_score": only("PRODUCT", F.when(F.size(attributes) > 0, F.round(mean, 4)).otherwise(0.0)),
        "specialty_score": F.col("_specialty"),
    })
    df = df.withColumn(
        "email_level", email_level(F.when(dom == "PROVIDER", F.col("provider_email_score")).otherwise(F.col("email_score"))))
    return df.drop(*[c for c in df.columns if c.startswith("_")])

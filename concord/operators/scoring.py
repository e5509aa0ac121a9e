"""Match score of a pair from its signals, by domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.ladders import clamp
from concord.operators.policy import domain_of

# Published signal weights per domain, in the order contributions are listed.
SIGNAL_WEIGHTS = {
    "CUSTOMER": {
        "member_id_match": 0.25, "name_similarity": 0.10, "dob_match": 0.25, "email_match": 0.20,
        "address_similarity": 0.10, "source_trust": 0.05, "steward_learning": 0.05,
    },
    "SUPPLIER": {
        "supplier_id_match": 0.45, "tax_id_match": 0.25, "name_similarity": 0.10, "contact_email_match": 0.05,
        "address_similarity": 0.05, "source_trust": 0.05, "steward_learning": 0.05,
    },
    "PRODUCT": {
        "product_id_match": 0.20, "gtin_match": 0.25, "name_similarity": 0.10, "sku_match": 0.15,
        "effective_lot_date_match": 0.10, "attribute_similarity": 0.10, "source_trust": 0.05, "steward_learning": 0.05,
    },
    "PROVIDER": {
        "provider_id_match": 0.25, "npi_match": 0.25, "name_similarity": 0.10, "address_similarity": 0.20,
        "source_trust": 0.03, "steward_learning": 0.02, "provider_email_match": 0.10, "specialty_similarity": 0.05,
    },
    "PATIENT": {
        "patient_id_match": 0.25, "human_id_match": 0.05, "name_similarity": 0.20, "dob_match": 0.20, "email_match": 0.10,
        "address_similarity": 0.15, "source_trust": 0.05, "steward_learning": 0.00,
    },
}

# Weights of the match score itself where they differ from the published ones.
SCORE_WEIGHTS = {
    "CUSTOMER": {"name_seq": 0.25, "email": 0.15, "address": 0.20, "dob": 0.25, "member_id": 0.10, "source": 0.05},
    "SUPPLIER": {"supplier_id": 0.40, "tax_id": 0.25, "name": 0.10, "email": 0.15, "address": 0.05, "source": 0.05},
    "PROVIDER": {"provider_id": 0.25, "npi": 0.25, "name": 0.10, "provider_email": 0.10, "address": 0.20,
                 "specialty": 0.05, "source": 0.03, "learning": 0.02},
    "PATIENT": {"patient_id": 0.30, "human_id": 0.05, "dob": 0.20, "name": 0.20, "address": 0.15, "email": 0.10, "source": 0.10},
    "PRODUCT": {"product_id": 0.20, "gtin": 0.25, "sku": 0.15, "name": 0.10, "lot_date": 0.10, "attribute": 0.10,
                "source": 0.05, "learning": 0.05},
    "OTHER": {"name": 0.30, "email": 0.25, "address": 0.20, "dob": 0.15, "member_id": 0.10},
}


def learning_adjustment(rate: Column) -> Column:
    """How much past overrides lower or raise trust in the score; 0 when the rate is unknown."""
    r = clamp(rate, 0.0, 1.0)
    return F.when(rate.isNull(), 0.0).when(r >= 0.30, -0.10).when(r >= 0.15, -0.06).when(r >= 0.05, -0.03).otherwise(0.02)


def learning_score(rate: Column) -> Column:
    return clamp(F.lit(1.0) + learning_adjustment(rate), 0.0, 1.0)


def _sum(domain: str) -> Column:
    total = F.lit(0.0)
    for signal, weight in SCORE_WEIGHTS[domain].items():
        value = F.col(f"{signal}_score")
        if signal == "human_id":
            value = F.coalesce(value, F.lit(0.5))
        total = total + value * weight
    return total


def _customer() -> Column:
    s, name = _sum("CUSTOMER"), F.col("name_seq_score")
    born = F.col("dob_score") == 1.0
    return (
        F.when(born & (F.col("address_score") >= 0.95) & (name >= 0.85), F.greatest(s, F.lit(0.82)))
        .when(born & (name >= 0.90), F.greatest(s, F.lit(0.78))).otherwise(s)
    )


def _supplier() -> Column:
    s = F.round(_sum("SUPPLIER"), 2)
    same_id, same_tax = F.col("supplier_id_score") == 1.0, F.col("tax_id_score") == 1.0
    floor = lambda n: F.greatest(s, F.lit(n))
    return F.when(same_id & same_tax, floor(0.98)).when(same_id, floor(0.94)).when(same_tax, floor(0.90)).otherwise(s)


def _provider() -> Column:
    s, name, address = _sum("PROVIDER"), F.col("name_score"), F.col("address_score")
    mailed = F.col("provider_email_score") >= 1.0
    boost = (
        F.when(mailed & (name >= 0.85) & (address >= 0.90), 0.15)
        .when((name >= 0.90) & (address >= 0.90), 0.10)
        .when(mailed & (name >= 0.80), 0.08).otherwise(0.0)
    )
    return F.least(s + boost, F.lit(1.0))


def _patient() -> Column:
    s, name = _sum("PATIENT"), F.col("name_score")
    anchored = (F.col("patient_id_score") >= 0.90) & (F.col("dob_score") == 1.0)
    held = (
        F.when(anchored & (name >= 0.90) & (F.col("address_score") >= 0.95), clamp(s, 0.90, 0.92))
        .when(anchored & (name >= 0.85), clamp(s, 0.86, 0.90)).otherwise(s)
    )
    return F.least(held, F.lit(0.92))


def score_pairs(signals: DataFrame) -> DataFrame:
    """Adds ``learning_score`` and ``entity_score``; ``override_rate`` is optional."""
    rate = F.col("override_rate") if "override_rate" in signals.columns else F.lit(None).cast("double")
    df = signals.withColumn("learning_score", learning_score(rate))
    d = domain_of(df)
    scored = F.col("provider_scored") if "provider_scored" in df.columns else F.lit(True)
    return df.withColumn(
        "entity_score",
        F.when(d == "CUSTOMER", _customer()).when(d == "SUPPLIER", _supplier())
        .when(d == "PRODUCT", F.round(_sum("PRODUCT"), 4)).when((d == "PROVIDER") & scored, _provider())
        .when(d == "PATIENT", _patient()).otherwise(F.round(_sum("OTHER"), 2)),
    )

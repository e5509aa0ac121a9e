"""Readable evidence block of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.text import first_with_text
from concord.operators.policy import domain_of
from concord.operators.signals import Sides, entity_id

# Lines per domain: label and the fields that can fill it, best first. ``@id`` is the resolved entity id.
EVIDENCE = {
    "PROVIDER": ("Provider ", (
        ("provider_id", ("provider_id",)), ("npi", ("npi",)),
        ("provider_first_name", ("provider_first_name", "first_name")),
        ("provider_last_name", ("provider_last_name", "last_name")),
        ("provider_email", ("provider_email", "email")), ("specialty", ("specialty",)),
        ("practice_address", ("provider_address", "address")), ("source_system", ("source_system",)))),
    "PRODUCT": ("Product ", tuple((c, (c,)) for c in (
        "product_id", "product_name", "product_variant", "pack_size", "effective_lot_date", "gtin", "sku", "source_system"))),
    "SUPPLIER": ("Supplier ", (
        ("supplier_id", ("supplier_id", "@id")), ("tax_id", ("tax_id",)), ("supplier_name", ("supplier_name", "first_name")),
        ("contact_email", ("contact_email", "email")), ("supplier_address", ("supplier_address", "address")),
        ("source_system", ("source_system",)))),
    "PATIENT": ("Patient ", (
        ("patient_id", ("patient_id",)), ("first_name", ("patient_first_name", "first_name")),
        ("last_name", ("patient_last_name", "last_name")), ("dob", ("patient_dob", "dob")),
        ("email", ("patient_email", "email")), ("address", ("patient_address", "address")), ("source_system", ("source_system",)))),
    "OTHER": ("", (
        ("entity_id", ("@id",)), *((c, (c,)) for c in ("first_name", "last_name", "dob", "email", "address", "source_system")))),
}


def evidence_text(pairs: DataFrame) -> Column:
    """Both records as labelled lines of their domain; a field without text reads N/A."""
    f, d = Sides(pairs), domain_of(pairs)

    def block(domain: str, side: str) -> Column:
        label, lines = EVIDENCE[domain]
        out = [F.lit(f"Record {side.upper()} {label}Evidence:")]
        for name, fields in lines:
            sources = [entity_id(f, side, d) if c == "@id" else f(side, c) for c in fields]
            filled = F.coalesce(F.nullif(first_with_text(*sources), F.lit("")), F.lit("N/A"))
            out.append(F.concat(F.lit(f"- {name}: "), filled))
        return F.concat_ws("\n", *out)

    whole = {k: F.concat_ws("\n\n", block(k, "a"), block(k, "b")) for k in EVIDENCE}
    return (
        F.when(d == "PROVIDER", whole["PROVIDER"]).when(d == "PRODUCT", whole["PRODUCT"]).when(d == "SUPPLIER", whole["SUPPLIER"])
        .when(d == "PATIENT", whole["PATIENT"]).otherwise(whole["OTHER"])
    )

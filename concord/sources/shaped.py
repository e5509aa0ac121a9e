"""Input tables in the engine's own shapes, derived from the star-schema parquet files.

Each derivation is one SQL projection over a whole table. The text is written so
that Spark and the SQL checker build the same rows; the few spellings that differ
between the two dialects are replaced by :func:`spark_sql` and :func:`checker_sql`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _domain(key: str) -> str:
    return (
        f"CASE {key} % 6 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN 'provider' WHEN 2 THEN 'SUPPLIER' "
        f"WHEN 3 THEN 'Product' WHEN 4 THEN 'PATIENT' ELSE 'LOCATION' END"
    )


def _day(key: str) -> str:
    return (
        f"CASE {key} % 3 WHEN 0 THEN TIMESTAMP '2024-01-15 06:00:00' "
        f"WHEN 1 THEN TIMESTAMP '2024-01-14 18:30:00' ELSE TIMESTAMP '2024-01-13 00:00:00' END"
    )


def _holes(key: str, n: int, value: str) -> str:
    return f"CASE WHEN {key} % {n} = 0 THEN NULL WHEN {key} % {n} = 1 THEN '  ' ELSE {value} END"


def _person(side: str, key: str, members: int) -> str:
    return f"""
  '{side.upper()}' || c_custkey AS {side}_id, 'M' || (c_custkey % {members}) AS {side}_member_id,
  CASE {key} % 8 WHEN 0 THEN 'Michael' WHEN 1 THEN 'Mike' WHEN 2 THEN 'Katherine' WHEN 3 THEN 'Kate'
    WHEN 4 THEN 'Stephen' WHEN 5 THEN 'Steven' WHEN 6 THEN 'Philip' ELSE NULL END AS {side}_first_name,
  CASE {key} % 5 WHEN 0 THEN 'Knight' WHEN 1 THEN 'Night' WHEN 2 THEN 'Schwartz' WHEN 3 THEN 'Swartz'
    ELSE 'O''Neil-Hart' END AS {side}_last_name,
  CASE {key} % 4 WHEN 0 THEN '1980-02-03' WHEN 1 THEN '1980-02-03 ' WHEN 2 THEN '2015-07-09' ELSE NULL END AS {side}_dob,
  CASE {key} % 5 WHEN 0 THEN 'a.b' || (c_custkey % 40) || '+x@gmail.com' WHEN 1 THEN 'ab' || (c_custkey % 40) || '@GMAIL.com'
    WHEN 2 THEN 'ab' || (c_custkey % 40) || '@acme.com' WHEN 3 THEN 'ab' || (c_custkey % 40) || '@uni.edu' ELSE NULL END AS {side}_email,
  CASE {key} % 5 WHEN 0 THEN (100 + c_custkey % 50) || ' North Main Street, Miami, FL 33101'
    WHEN 1 THEN (100 + c_custkey % 50) || ' N. Main St., Miami, fl 33101-1234'
    WHEN 2 THEN 'P.O. Box ' || (c_custkey % 90) || ', Austin, TX'
    WHEN 3 THEN (100 + c_custkey % 50) || ' Oak Avenue Apt 4B, Boca Raton, FL 33432' ELSE '   ' END AS {side}_address,
  CASE {key} % 5 WHEN 0 THEN 'MDM' WHEN 1 THEN 'crm' WHEN 2 THEN 'Cerner South' WHEN 3 THEN 'LEGACY' ELSE NULL END AS {side}_source_system"""


_PAIR_TAIL = """
  CASE {k} % 4 WHEN 0 THEN SPLIT_CSV('DOB_EXACT,NAME_FUZZY') WHEN 1 THEN SPLIT_CSV('EMAIL_EXACT') WHEN 2 THEN NULL
    ELSE SPLIT_CSV('NAME_FUZZY') END AS triggered_rules,
  CASE WHEN {k} % 37 = 0 THEN NULL ELSE CAST(60 + {k} * 13 % 41 AS DOUBLE) / 100 END AS match_score"""

_POLICY_DOMAIN = (
    "CASE {k} % 6 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN 'PROVIDER' WHEN 2 THEN 'SUPPLIER' "
    "WHEN 3 THEN 'PRODUCT' WHEN 4 THEN 'PATIENT' ELSE 'LOCATION' END"
)

SHAPES: dict[str, str] = {
    "dq_record_score": f"""
SELECT {_day('(c_custkey DIV 7)')} AS created_at, {_domain('c_custkey')} AS domain, 'C' || c_custkey AS record_id,
  CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 101 AS DOUBLE) END AS record_score,
  CAST(c_custkey % 11 AS DOUBLE) / 10 AS completeness_score, CAST(c_custkey % 7 AS DOUBLE) / 6 AS validity_score,
  CAST(c_custkey % 5 AS DOUBLE) / 4 AS standardization_score, CAST(c_custkey % 3 AS DOUBLE) / 2 AS consistency_score,
  CAST(c_custkey % 2 AS DOUBLE) AS uniqueness_score
FROM {{customer}}""",
    "dq_findings": f"""
SELECT {_day('l_partkey')} AS created_at, {_domain('l_suppkey')} AS domain,
  'C' || (l_orderkey % 500) AS record_id, 'R' || (l_partkey % 40) AS rule_id,
  CASE l_partkey % 6 WHEN 0 THEN 'VALIDITY' WHEN 1 THEN 'COMPLETENESS' WHEN 2 THEN 'Standardization' WHEN 3 THEN 'UNIQUENESS'
    WHEN 4 THEN 'CONSISTENCY' ELSE NULL END AS rule_category,
  CASE WHEN l_partkey % 9 = 0 THEN 'duplicate' ELSE 'FORMAT' END AS rule_type,
  CASE l_linenumber % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'high' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'INFO' END AS severity,
  CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' WHEN 'R' THEN 'RESOLVED'
    ELSE CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'WAIVED' END END AS status,
  l_discount * 10 AS rule_weight
FROM {{lineitem}}""",
    "dq_ai_recommendations": f"""
SELECT {_day('o_orderkey')} AS created_at, {_domain('o_custkey')} AS domain,
  'C' || o_custkey AS record_id, 'R' || (o_orderkey % 40) AS rule_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE o_orderkey % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'Rejected' ELSE 'IMPLEMENTED' END AS status,
  CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence_score
FROM {{orders}}""",
    "dataset_registry": f"""
SELECT 'DS' || p_partkey AS dataset_id, {_holes('p_partkey', 19, 'p_name')} AS dataset_name, {_domain('p_partkey')} AS domain, p_type AS subdomain,
  CASE p_size % 4 WHEN 0 THEN 'CURATION' WHEN 1 THEN 'CERTIFICATION' WHEN 2 THEN 'PRODUCTION' ELSE 'INTAKE' END AS lifecycle_stage,
  {_holes('p_partkey', 17, "'owner' || (p_partkey % 12)")} AS data_owner,
  {_holes('p_partkey', 23, "'steward' || (p_partkey % 9)")} AS steward_name,
  'src_' || p_brand AS source_table, {_holes('p_partkey', 13, "'tgt_' || p_brand")} AS target_table,
  {_holes('p_partkey', 11, 'p_name')} AS business_definition, {_holes('p_partkey', 7, 'p_type')} AS use_case_context,
  {_holes('p_partkey', 29, "'INTERNAL'")} AS data_classification,
  CASE p_partkey % 3 WHEN 0 THEN 'CONFORMANT' WHEN 1 THEN 'partial' ELSE NULL END AS cdl_status,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'PARTIAL' ELSE 'Conformant' END AS cdm_status,
  CASE p_partkey % 10 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS metadata_complete,
  CASE p_partkey % 12 WHEN 0 THEN NULL WHEN 5 THEN FALSE ELSE TRUE END AS lineage_complete,
  CASE p_partkey % 14 WHEN 0 THEN NULL WHEN 3 THEN FALSE ELSE TRUE END AS provenance_complete,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 4 THEN FALSE ELSE TRUE END AS certified_for_use,
  CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(70 + p_partkey % 31 AS DOUBLE) END AS dq_score,
  CASE WHEN p_partkey % 21 = 0 THEN NULL ELSE CAST(80 + p_partkey % 16 AS DOUBLE) END AS dq_threshold,
  CASE p_partkey % 7 WHEN 0 THEN 'NOT_STARTED' WHEN 1 THEN 'IN_REVIEW' WHEN 2 THEN 'RECERT_REQUIRED' WHEN 3 THEN 'certified'
    WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'EXPIRED' ELSE NULL END AS certification_status,
  {_holes('p_partkey', 8, "'http://e/' || p_partkey")} AS evidence_link,
  {_holes('p_partkey', 6, "'http://g/' || p_partkey")} AS glossary_link,
  {_holes('p_partkey', 15, "'1.0'")} AS version_number,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 100 AS DOUBLE) END AS fair_overall_score,
  CASE WHEN p_partkey % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS pass_fail_status
FROM {{part}}""",
    # Every line becomes an event; doubling the key leaves half of the data sets without one.
    "certification_history": """
SELECT 'DS' || (l_partkey * 2) AS dataset_id, l_shipdate AS event_timestamp,
  l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS event_seq,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'PRODUCTION' ELSE 'CURATION' END AS new_lifecycle_stage,
  CASE l_linenumber % 4 WHEN 0 THEN 'CERTIFIED' WHEN 1 THEN 'PENDING' WHEN 2 THEN 'IN_PROGRESS' ELSE NULL END AS new_certification_status,
  CAST(l_quantity AS DOUBLE) AS new_dq_score, CASE WHEN l_tax > 0.04 THEN 'PASS' ELSE 'FAIL' END AS new_pass_fail_status,
  l_linestatus = 'O' AS lineage_complete, l_returnflag = 'A' AS certified_for_use, 'user' || (l_suppkey % 10) AS approved_by
FROM {lineitem}""",
    # The key shift leaves the first data sets without any check.
    "certification_checks": """
SELECT 'DS' || (l_partkey + 60) AS dataset_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'fail' WHEN 1 THEN 'PASS' ELSE 'SKIPPED' END AS status,
  CASE l_suppkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity, l_shipdate AS checked_at
FROM {lineitem}""",
    "explanations": f"""
SELECT 'exp_' || o_orderkey AS explanation_id, {_domain('o_custkey')} AS domain, 'v1' AS policy_version,
  'A' || o_custkey AS record_a_id, 'B' || o_orderkey AS record_b_id,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'MDM' WHEN 2 THEN 'ERP' WHEN 3 THEN 'CRM' ELSE 'LEGACY' END AS record_a_source_system,
  CASE o_orderkey % 4 WHEN 0 THEN 'MDM' WHEN 1 THEN 'ERP' WHEN 2 THEN NULL ELSE 'CRM' END AS record_b_source_system,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(50 + o_orderkey * 19 % 51 AS DOUBLE) / 100 END AS match_score,
  CASE o_orderkey % 5 WHEN 0 THEN SPLIT_CSV('DOB_EXACT') WHEN 1 THEN SPLIT_CSV('EMAIL_EXACT,DOB_EXACT')
    WHEN 2 THEN SPLIT_CSV('NAME_FUZZY') WHEN 3 THEN SPLIT_CSV('NAME_FUZZY,ADDRESS_NEAR,DOB_EXACT') ELSE NULL END AS triggered_rules,
  CASE o_custkey % 6 WHEN 0 THEN 'AUTO_MERGE' WHEN 1 THEN 'APPROVE_MERGE' WHEN 2 THEN 'REVIEW_REQUIRED' WHEN 3 THEN 'BLOCK_MERGE'
    WHEN 4 THEN 'reject_merge' ELSE NULL END AS ai_decision,
  CAST(o_custkey % 90 AS DOUBLE) / 100 AS ai_confidence,
  CASE o_orderkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_flag,
  CASE o_orderkey % 3 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'APPROVE_MERGE' ELSE 'BLOCK_MERGE' END AS recommended_action,
  CASE WHEN o_orderkey % 6 = 0 THEN 'AUTO_MERGE' ELSE NULL END AS final_recommended_action,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'req_' || o_orderkey END AS request_id, o_orderdate AS created_at
FROM {{orders}}""",
    # The key shift leaves the first explanations without feedback and makes some latencies negative.
    "feedback": """
SELECT 'fb_' || l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS feedback_id,
  'exp_' || (l_orderkey + 300) AS explanation_id,
  CASE l_suppkey % 6 WHEN 0 THEN 'AUTO_MERGE' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'REJECT_MERGE' WHEN 3 THEN 'BLOCK_MERGE'
    WHEN 4 THEN 'REVIEW' ELSE NULL END AS steward_decision,
  CASE l_partkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN 'true' WHEN 3 THEN '0' ELSE NULL END AS steward_override_flag,
  CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Data_Quality' WHEN 2 THEN ' POLICY ' ELSE NULL END AS override_reason_code,
  CASE l_suppkey % 3 WHEN 0 THEN 'note ' || (l_suppkey % 4) ELSE NULL END AS override_reason_note,
  'steward' || (l_suppkey % 8) AS steward_user, l_shipdate AS feedback_at
FROM {lineitem}""",
    "match_pairs": f"""
SELECT 'P' || c_custkey AS pair_id, {_domain('c_custkey')} AS domain, {_person('a', 'c_custkey', 30)}, {_person('b', '(c_custkey + c_nationkey)', 31)},
  {_PAIR_TAIL.format(k='c_custkey')}
FROM {{customer}}""",
    "product_pairs": f"""
SELECT 'PP' || p_partkey AS pair_id, 'PRODUCT' AS domain,
  'SKU-' || (p_partkey % 700) AS a_product_id, CASE p_partkey % 6 WHEN 0 THEN 'sku-' || (p_partkey % 700) WHEN 1 THEN 'SKU-' || (p_partkey % 690)
    WHEN 2 THEN NULL ELSE 'ITEM' || p_size END AS b_product_id,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE '00' || (p_partkey % 300) END AS a_gtin, CASE WHEN p_partkey % 4 = 0 THEN '  ' ELSE '00' || (p_partkey % 290) END AS b_gtin,
  p_brand || '-' || p_size AS a_sku, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) || '-' || p_size ELSE p_brand END AS b_sku,
  p_name AS a_product_name, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'large ' || p_name WHEN 2 THEN p_type ELSE NULL END AS b_product_name,
  p_type AS a_product_variant, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN 'STANDARD' ELSE '' END AS b_product_variant,
  p_size || ' ct' AS a_pack_size, CASE p_partkey % 2 WHEN 0 THEN p_size || 'ct' ELSE NULL END AS b_pack_size,
  '2024-01-0' || (p_partkey % 5 + 1) AS a_effective_lot_date, '2024-01-0' || (p_partkey % 3 + 1) || ' ' AS b_effective_lot_date,
  CASE p_partkey % 4 WHEN 0 THEN 'PIM' WHEN 1 THEN 'plm' WHEN 2 THEN 'ERP' ELSE NULL END AS a_source_system,
  CASE p_partkey % 3 WHEN 0 THEN 'MDM' WHEN 1 THEN 'SUPPLIER_PORTAL' ELSE 'OTHER' END AS b_source_system,
  {_PAIR_TAIL.format(k='p_partkey')}
FROM {{part}}""",
    "supplier_pairs": f"""
SELECT 'SP' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS pair_id, 'SUPPLIER' AS domain,
  CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE 'SUP' || l_suppkey END AS a_supplier_id,
  CASE l_partkey % 4 WHEN 0 THEN 'sup' || l_suppkey WHEN 1 THEN 'SUP' || l_partkey ELSE NULL END AS b_supplier_id,
  'M' || (l_suppkey % 40) AS a_member_id, 'M' || (l_partkey % 40) AS b_member_id,
  '98-' || (l_suppkey % 50) AS a_tax_id, CASE l_linenumber % 3 WHEN 0 THEN '98-' || (l_suppkey % 50) WHEN 1 THEN NULL ELSE '97-' || (l_partkey % 50) END AS b_tax_id,
  'Acme Trading ' || (l_suppkey % 20) AS a_supplier_name, CASE l_linenumber % 4 WHEN 0 THEN 'ACME Trading Co ' || (l_suppkey % 20) WHEN 1 THEN 'Globex ' || (l_partkey % 9) WHEN 2 THEN NULL ELSE '' END AS b_supplier_name,
  'Initech' AS b_first_name,
  'sales' || (l_suppkey % 12) || '@acme.com' AS a_contact_email, CASE l_linenumber % 3 WHEN 0 THEN 'Sales' || (l_suppkey % 12) || '@acme.com' WHEN 1 THEN 'info@yahoo.com' ELSE NULL END AS b_contact_email,
  'backup' || (l_partkey % 7) || '@uni.edu' AS b_email,
  (l_suppkey % 60) || ' Harbor Road, Tampa, FL 33602' AS a_supplier_address, CASE l_linenumber % 2 WHEN 0 THEN (l_suppkey % 60) || ' Harbor Rd Tampa FL 33602' ELSE '9 Pier Drive , Ocala' END AS b_supplier_address,
  CASE l_suppkey % 3 WHEN 0 THEN 'ERP' WHEN 1 THEN 'supplier_portal' ELSE 'MDM' END AS a_source_system,
  CASE l_linenumber % 3 WHEN 0 THEN 'ERP' WHEN 1 THEN 'LEGACY' ELSE NULL END AS b_source_system,
  {_PAIR_TAIL.format(k='l_partkey')}
FROM {{lineitem}}""",
    "provider_pairs": f"""
SELECT 'VP' || c_custkey AS pair_id, 'PROVIDER' AS domain,
  'MDM' || (1000 + c_custkey) AS a_provider_id, CASE c_custkey % 3 WHEN 0 THEN 'mdm' || (1000 + c_custkey) WHEN 1 THEN 'MDM' || c_custkey ELSE NULL END AS b_provider_id,
  '18870' || (10000 + c_custkey % 60) AS a_npi, CASE c_custkey % 4 WHEN 0 THEN '18870' || (10000 + c_custkey % 60) WHEN 1 THEN '' ELSE '18870' || (10000 + c_nationkey) END AS b_npi,
  'Dana' AS a_provider_first_name, CASE c_custkey % 3 WHEN 0 THEN 'dana' WHEN 1 THEN 'Daniel' ELSE NULL END AS b_provider_first_name,
  CASE c_nationkey % 3 WHEN 0 THEN 'Rivera' WHEN 1 THEN 'Reeves' ELSE 'Okafor' END AS a_provider_last_name, CASE c_custkey % 2 WHEN 0 THEN 'Rivera' ELSE 'Okafor' END AS b_provider_last_name,
  'Dana' AS a_first_name, 'Diana' AS b_first_name, 'Rivera' AS a_last_name, 'Rivers' AS b_last_name,
  CASE c_custkey % 5 WHEN 0 THEN NULL ELSE 'dr' || (c_custkey % 30) || '@hospital.org' END AS a_provider_email,
  CASE c_custkey % 4 WHEN 0 THEN 'dr' || (c_custkey % 30) || '@hospital.org' WHEN 1 THEN '' ELSE 'd.r' || (c_nationkey) || '+w@gmail.com' END AS b_provider_email,
  CASE c_custkey % 10 WHEN 0 THEN 'office' || c_nationkey || '@acme.com' ELSE NULL END AS a_email, CASE c_custkey % 8 WHEN 1 THEN 'office@acme.com' ELSE NULL END AS b_email,
  'Cardiology' AS a_specialty, CASE c_nationkey % 4 WHEN 0 THEN 'cardiology' WHEN 1 THEN 'Cardiac Surgery' WHEN 2 THEN 'Oncology' ELSE NULL END AS b_specialty,
  (c_custkey % 40) || ' Clinic Drive, Naples, FL 34102' AS a_provider_address, CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 40) || ' CLINIC Drive, Naples, FL 34102' WHEN 1 THEN NULL ELSE 'PO BOX 9, Ocala, FL' END AS b_provider_address,
  (c_custkey % 40) || ' Clinic Dr, Naples, FL 34102' AS b_address, '12 Bay Road , Naples' AS a_address,
  CASE c_custkey % 4 WHEN 0 THEN 'MDM' WHEN 1 THEN 'BOCA SOUTH' WHEN 2 THEN 'Cerner South' ELSE NULL END AS a_source_system,
  CASE c_nationkey % 3 WHEN 0 THEN 'MDM' WHEN 1 THEN 'boca west' ELSE 'LEGACY' END AS b_source_system,
  {_PAIR_TAIL.format(k='c_custkey')}
FROM {{customer}}""",
    "patient_pairs": f"""
SELECT 'TP' || c_custkey AS pair_id, 'PATIENT' AS domain,
  'PT' || (c_custkey % 80) || '-A' AS a_patient_id, CASE c_custkey % 5 WHEN 0 THEN 'PT' || (c_custkey % 80) || '-A' WHEN 1 THEN 'pt' || (c_custkey % 80) || '-B' WHEN 2 THEN 'PT' || (c_custkey % 77) WHEN 3 THEN NULL ELSE 'QX' || c_nationkey END AS b_patient_id,
  CASE c_custkey % 3 WHEN 0 THEN 'H' || (c_custkey % 20) ELSE NULL END AS a_human_id, CASE c_custkey % 2 WHEN 0 THEN 'h' || (c_custkey % 20) ELSE 'H0' END AS b_human_id,
  CASE c_custkey % 4 WHEN 0 THEN 'Maria' ELSE NULL END AS a_patient_first_name, CASE c_custkey % 7 WHEN 0 THEN NULL ELSE 'Lopez' END AS a_patient_last_name,
  'Mariah' AS a_first_name, 'Maria' AS b_first_name, 'Lopes' AS a_last_name, CASE c_nationkey % 2 WHEN 0 THEN 'Lopez' ELSE 'Garcia' END AS b_last_name,
  '1980-02-03' AS a_dob, CASE c_custkey % 3 WHEN 0 THEN '1980-02-03 ' WHEN 1 THEN '1980-03-02' ELSE '1980-02-03' END AS b_dob,
  CASE c_custkey % 6 WHEN 0 THEN '1980-03-02' ELSE NULL END AS a_patient_dob,
  'maria.l' || (c_custkey % 25) || '@gmail.com' AS a_email, CASE c_nationkey % 3 WHEN 0 THEN 'marial' || (c_custkey % 25) || '@gmail.com' WHEN 1 THEN 'ml@uni.edu' ELSE NULL END AS b_patient_email,
  (c_custkey % 70) || ' Palm Street , Boca Raton, FL 33432' AS a_address, CASE c_custkey % 2 WHEN 0 THEN (c_custkey % 70) || ' palm street , Boca Raton FL 33432' ELSE '5 Elm Road , Delray' END AS b_patient_address,
  CASE c_custkey % 4 WHEN 0 THEN 'Cerner South' WHEN 1 THEN 'BOCA SOUTH' WHEN 2 THEN 'MDM' ELSE 'LEGACY' END AS a_source_system,
  CASE c_nationkey % 3 WHEN 0 THEN 'MDM' WHEN 1 THEN 'boca west' ELSE NULL END AS b_source_system,
  {_PAIR_TAIL.format(k='c_custkey')}
FROM {{customer}}""",
    # Pairs whose signals are given, so what follows scoring can be checked without the fuzzy functions.
    "scored_pairs": f"""
SELECT 'P' || o_orderkey AS pair_id, {_domain('o_custkey')} AS domain,
  CASE o_orderkey % 17 WHEN 0 THEN 'v1' WHEN 1 THEN 'v6' ELSE NULL END AS policy_version,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 103 AS DOUBLE) / 103 END AS match_score,
  'M' || (o_orderkey % 9) AS a_member_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'm' || (o_orderkey % 4) || ' ' END AS b_member_id,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'MDM' WHEN 2 THEN 'erp' WHEN 3 THEN 'CRM' ELSE 'LEGACY' END AS a_source_system,
  CASE o_orderkey % 4 WHEN 0 THEN 'MDM' WHEN 1 THEN 'SUPPLIER_PORTAL' WHEN 2 THEN NULL ELSE 'PIM' END AS b_source_system,
  CAST(o_orderkey % 2 AS DOUBLE) AS member_id_score, CAST(o_orderkey * 3 % 101 AS DOUBLE) / 101 AS name_score,
  CAST(o_orderkey * 5 % 89 AS DOUBLE) / 89 AS name_seq_score, CAST(o_custkey % 2 AS DOUBLE) AS dob_score,
  CAST(o_orderkey * 11 % 97 AS DOUBLE) / 97 AS email_score, CAST(o_orderkey * 13 % 107 AS DOUBLE) / 107 AS address_score,
  CAST(o_orderkey * 17 % 109 AS DOUBLE) / 109 AS source_score, CAST(o_orderkey * 19 % 113 AS DOUBLE) / 113 AS product_id_score,
  CAST(o_custkey % 3 % 2 AS DOUBLE) AS gtin_score, CAST(o_orderkey * 23 % 127 AS DOUBLE) / 127 AS sku_score,
  CAST(o_custkey % 4 % 2 AS DOUBLE) AS lot_date_score, CAST(o_orderkey * 29 % 131 AS DOUBLE) / 131 AS attribute_score,
  CAST(o_orderkey % 3 % 2 AS DOUBLE) AS supplier_id_score, CAST(o_orderkey % 5 % 2 AS DOUBLE) AS tax_id_score,
  CAST(o_orderkey % 7 % 2 AS DOUBLE) AS provider_id_score, CAST(o_orderkey % 11 % 2 AS DOUBLE) AS npi_score,
  CASE o_orderkey % 3 WHEN 0 THEN 1.0E0 WHEN 1 THEN 0.9E0 ELSE CAST(o_orderkey * 31 % 137 AS DOUBLE) / 137 END AS patient_id_score,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.0E0 ELSE 0.0E0 END AS human_id_score,
  CAST(o_orderkey * 37 % 139 AS DOUBLE) / 139 AS provider_email_score, CAST(o_orderkey * 41 % 149 AS DOUBLE) / 149 AS specialty_score,
  CASE o_orderkey % 5 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'SIMILAR' WHEN 2 THEN 'FUZZY' ELSE 'DIFFERENT' END AS email_level,
  CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 0 ELSE o_orderkey % 131 - 8 END AS INT) AS composite_risk_score,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0.0E0 WHEN 2 THEN 0.03E0 WHEN 3 THEN 0.08E0 WHEN 4 THEN 0.15E0 WHEN 5 THEN 0.30E0 ELSE 0.45E0 END AS override_rate,
  o_orderkey % 13 AS override_count,
  CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'AUTO_MERGE' WHEN 2 THEN 'approve_merge' WHEN 3 THEN 'REVIEW' WHEN 4 THEN 'BLOCK_MERGE' ELSE 'ESCALATE' END AS recommended_action,
  CASE o_custkey % 5 WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'CRITICAL' ELSE 'ODD' END AS highest_risk_level,
  CASE o_orderkey % 5 WHEN 0 THEN SPLIT_CSV('DOB_EXACT') WHEN 1 THEN SPLIT_CSV('EMAIL_EXACT,DOB_EXACT') WHEN 2 THEN SPLIT_CSV('MEMBER_ID_EXACT')
    WHEN 3 THEN SPLIT_CSV('NPI_REUSE_DETECTED,NAME_FUZZY') ELSE NULL END AS triggered_rules
FROM {{orders}}""",
    "policy_change_log": f"""
SELECT 'chg_' || o_orderkey AS change_id, upper({_domain('o_custkey')}) AS domain,
  CASE o_orderkey % 3 WHEN 0 THEN 'v2' ELSE 'v1' END AS policy_version,
  CASE o_orderkey % 2 WHEN 0 THEN 'DRAFT' ELSE 'PUBLISH' END AS change_type,
  CASE o_orderkey % 2 WHEN 0 THEN 'min_review_score' ELSE 'active_flag' END AS changed_field,
  'user' || (o_custkey % 6) AS requested_by, CASE WHEN o_orderkey % 45 = 0 THEN NULL ELSE o_orderdate END AS changed_at,
  CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' ELSE 'PENDING' END AS change_status
FROM {{orders}}""",
    "search_index": """
SELECT 'S' || s_suppkey AS record_id, 'MDM' || (s_suppkey DIV 2) AS mdm_id, 'Supplier' AS domain, s_name AS display_name,
  'ERP' AS source_system, s_suppkey % 2 = 0 AS golden_record_flag, s_name || ' ' || s_nationkey AS search_text FROM {supplier}
UNION ALL SELECT 'P' || p_partkey, 'MDM' || (p_partkey DIV 2), 'PRODUCT', p_name, 'PIM', p_partkey % 2 = 0, upper(p_name) || ' ' || p_brand FROM {part}""",
    "search_queries": """
SELECT 'Q' || p_partkey AS query_id, CASE p_partkey % 5 WHEN 0 THEN 'supplier' WHEN 1 THEN NULL WHEN 2 THEN 'Product' ELSE 'PRODUCT' END AS domain,
  CASE p_partkey % 9 WHEN 0 THEN substr(p_name, 2, 7) WHEN 1 THEN p_brand WHEN 2 THEN substr(p_name, 1, 2) WHEN 3 THEN (p_partkey % 10) || '%'
    WHEN 4 THEN upper(p_name) || '_' || 'Brand' WHEN 5 THEN 'Supplier#' || (p_partkey % 97) WHEN 6 THEN NULL WHEN 7 THEN '' ELSE 'qqq' || p_partkey END AS text
FROM {part}""",
    # One policy version per supplier: inactive, expired, future and undated ones included.
    "policy_config": f"""
SELECT 'POL-' || {_POLICY_DOMAIN.format(k='s_suppkey')} || '-V' || (s_suppkey DIV 6 + 1) AS policy_id,
  {_POLICY_DOMAIN.format(k='s_suppkey')} AS domain, 'v' || (s_suppkey DIV 6 + 1) AS policy_version,
  {_POLICY_DOMAIN.format(k='s_suppkey')} || ' Identity Policy' AS policy_name, CAST(NULL AS STRING) AS policy_description,
  CASE WHEN s_suppkey % 6 = 5 THEN 'N' WHEN s_suppkey DIV 6 = 0 THEN 'Y' WHEN s_suppkey DIV 6 % 5 = 3 THEN 'N' ELSE 'Y' END AS active_flag,
  CASE s_suppkey DIV 6 % 4 WHEN 0 THEN TIMESTAMP '1995-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2030-01-01 00:00:00'
    WHEN 2 THEN NULL ELSE TIMESTAMP '1999-06-01 00:00:00' END AS effective_from,
  CASE s_suppkey DIV 6 % 3 WHEN 2 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE NULL END AS effective_to,
  'REVIEW_REQUIRED' AS default_decision_mode, CASE s_suppkey % 4 WHEN 1 THEN 'N' WHEN 2 THEN 'n' ELSE 'Y' END AS review_required_flag,
  CASE s_suppkey % 3 WHEN 2 THEN 'N' ELSE 'y' END AS allow_auto_merge_flag
FROM {{supplier}}""",
    "policy_thresholds": f"""
SELECT 'THR-' || {_POLICY_DOMAIN.format(k='s_suppkey')} || '-V' || (s_suppkey DIV 6 + 1) AS threshold_id,
  'POL-' || {_POLICY_DOMAIN.format(k='s_suppkey')} || '-V' || (s_suppkey DIV 6 + 1) AS policy_id,
  {_POLICY_DOMAIN.format(k='s_suppkey')} AS domain, 'v' || (s_suppkey DIV 6 + 1) AS policy_version,
  CASE s_suppkey DIV 6 % 4 WHEN 2 THEN NULL ELSE 0.70E0 END AS min_review_score, CASE s_suppkey DIV 6 % 6 WHEN 5 THEN 1.5E0 ELSE 0.90E0 END AS min_approve_merge_score,
  0.97E0 AS min_auto_merge_score, 0.10E0 AS max_auto_merge_override_rate, 0.30E0 AS max_review_override_rate,
  CASE s_suppkey % 2 WHEN 0 THEN 70.0E0 ELSE 0.85E0 END AS high_risk_score_cutoff, CASE s_suppkey % 2 WHEN 0 THEN 35.0E0 ELSE 0.95E0 END AS medium_risk_score_cutoff,
  CASE s_suppkey % 6 WHEN 4 THEN 'Y' ELSE 'N' END AS require_exact_dob_flag, 'Y' AS require_email_or_address_flag,
  CASE s_suppkey % 5 WHEN 1 THEN 'N' ELSE 'Y' END AS require_manual_review_on_conflict_flag,
  CASE WHEN s_suppkey % 6 = 5 THEN 'N' WHEN s_suppkey DIV 6 = 0 THEN 'Y' WHEN s_suppkey DIV 6 % 7 = 5 THEN 'N' ELSE 'Y' END AS active_flag,
  CASE s_suppkey DIV 6 % 4 WHEN 0 THEN TIMESTAMP '1995-01-01 00:00:00' WHEN 1 THEN TIMESTAMP '2030-01-01 00:00:00'
    WHEN 2 THEN NULL ELSE TIMESTAMP '1999-06-01 00:00:00' END AS effective_from,
  CASE s_suppkey DIV 6 % 3 WHEN 2 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE NULL END AS effective_to
FROM {{supplier}}""",
    "policy_risk_rules": f"""
SELECT 'RR-' || p_partkey AS risk_rule_id, 'POL-' || {_POLICY_DOMAIN.format(k='p_partkey DIV 6')} || '-V' || (p_partkey DIV 36 + 1) AS policy_id,
  {_POLICY_DOMAIN.format(k='p_partkey DIV 6')} AS domain, 'v' || (p_partkey DIV 36 + 1) AS policy_version,
  CASE p_partkey % 6 WHEN 0 THEN 'NAME_FUZZY' WHEN 1 THEN 'ADDRESS_NEAR' WHEN 2 THEN 'DOB_EXACT' WHEN 3 THEN 'EMAIL_EXACT' WHEN 4 THEN 'NPI_REUSE_DETECTED' ELSE 'MEMBER_ID_EXACT' END AS triggered_rule,
  CASE p_partkey % 4 WHEN 0 THEN 'NAME_VARIANCE' WHEN 1 THEN '' ELSE NULL END AS override_reason_code,
  CASE p_partkey % 6 WHEN 0 THEN 0.6E0 WHEN 1 THEN 0.3E0 WHEN 2 THEN 0.2E0 WHEN 3 THEN 0.4E0 WHEN 4 THEN 0.9E0 ELSE 0.1E0 END AS risk_weight,
  CASE p_partkey % 6 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 2 THEN 'low' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'ODD' END AS risk_level,
  CASE p_partkey % 6 WHEN 0 THEN 'review' WHEN 1 THEN 'APPROVE_MERGE' WHEN 2 THEN 'AUTO_MERGE' WHEN 3 THEN 'REVIEW_REQUIRED' WHEN 4 THEN 'BLOCK_MERGE' ELSE 'AUTO_MERGE' END AS recommended_action,
  'Y' AS steward_learning_enabled_flag, CASE WHEN p_partkey % 11 = 10 THEN 'N' ELSE 'Y' END AS active_flag,
  TIMESTAMP '1995-01-01 00:00:00' AS effective_from, CASE WHEN p_partkey % 17 = 16 THEN TIMESTAMP '1999-01-01 00:00:00' ELSE NULL END AS effective_to,
  CASE WHEN p_partkey % 5 = 0 THEN 'Check the evidence' ELSE NULL END AS notes
FROM {{part}}""",
    # Draft edits: some touch an existing version, some create one, some leave fields out.
    "policy_drafts": f"""
SELECT {_POLICY_DOMAIN.format(k='s_suppkey')} AS domain, 'v' || (s_suppkey DIV 6 + 3) AS policy_version,
  CASE s_suppkey % 4 WHEN 0 THEN NULL ELSE 'Draft ' || s_name END AS policy_name, CAST(NULL AS STRING) AS policy_id, CAST(NULL AS STRING) AS threshold_id,
  CASE s_suppkey % 3 WHEN 0 THEN 'N' ELSE NULL END AS review_required_flag, CASE s_suppkey % 5 WHEN 0 THEN 'Y' ELSE NULL END AS allow_auto_merge_flag,
  CASE s_suppkey % 3 WHEN 1 THEN 0.75E0 ELSE NULL END AS min_review_score, CASE s_suppkey % 7 WHEN 2 THEN 1.75E0 ELSE NULL END AS min_auto_merge_score
FROM {{supplier}}""",
    "raw_payloads": """
SELECT 'RP' || o_orderkey AS payload_id,
  CASE o_orderkey % 9
    WHEN 0 THEN '{"ai_decision": "AUTO_MERGE", "confidence": ' || (CAST(o_custkey % 100 AS DOUBLE) / 100) || ', "risk_flag": "low", "recommended_action": "approve_merge", "explanation_summary": " Order ' || o_orderkey || ' agrees. ", "rule_analysis": [{"rule": "DOB_EXACT", "impact": "high", "reason": "same day"}]}'
    WHEN 1 THEN '```json
{"ai_decision": "review_required", "confidence": "0.' || (o_custkey % 10) || '", "risk_flag": "SEVERE", "rule_analysis": []}
```'
    WHEN 2 THEN 'Here you are: {"ai_decision": "BLOCK_MERGE", "confidence": 1.7, "recommended_action": "nothing", "explanation_summary": ""} as asked for ' || o_orderstatus
    WHEN 3 THEN '{"ai_decision": "AUTO_MERGE", "confidence": 0.9, "rule_analysis": [{"rule": "A' || o_custkey || '"'
    WHEN 4 THEN '{"ai_decision": "MERGE_NOW", "confidence": "high", "risk_flag": null, "explanation_summary": "Customer ' || o_custkey || '"}'
    WHEN 5 THEN '{"ai_decision": "REJECT_MERGE", "confidence": -0.5, "rule_analysis": [{"rule": "R1", "impact": "LOW", "reason": "one"}, {"rule": "  ", "impact": "EXTREME", "reason": ""}, {"impact": "MEDIUM"}, {"rule": "R4", "impact": "HIGH", "reason": "four"}]}'
    WHEN 6 THEN NULL
    WHEN 7 THEN '   '
    ELSE '{}' END AS raw_text
FROM {orders}""",
    # Model answers for the match pairs, and event lists as callers give them.
    "pair_payloads": """
SELECT 'P' || c_custkey AS pair_id,
  CASE c_custkey % 5
    WHEN 0 THEN '{"ai_decision": "AUTO_MERGE", "confidence": 0.' || (c_custkey % 90 + 10) || ', "risk_flag": "low", "recommended_action": "approve_merge", "rule_analysis": [{"rule": "DOB_EXACT", "impact": "high", "reason": "same day"}]}'
    WHEN 1 THEN '{"ai_decision": "BLOCK_MERGE", "confidence": 0.2, "risk_flag": "CRITICAL", "rule_analysis": [{"rule": "MEMBER_ID_EXACT", "impact": "LOW", "reason": "given"}]}'
    WHEN 2 THEN 'no answer' WHEN 3 THEN NULL
    ELSE '{"ai_decision": "REVIEW_REQUIRED", "explanation_summary": "Customer ' || c_custkey || '"}' END AS raw_text
FROM {customer}""",
    "given_events": """
SELECT 'EV' || o_orderkey AS packet_id,
  CASE o_orderkey % 7
    WHEN 0 THEN '[{"step": 7, "stage": "RISK", "title": "Order ' || o_orderkey || '", "signal_score": 0.5, "impact": "HIGH"}, {}]'
    WHEN 1 THEN '[{"detail": "of customer ' || o_custkey || '", "tone": "positive", "signal_name": "dob_match"}, {"stage": null, "policy_rule": "R' || (o_custkey % 9) || '"}, {"title": ""}]'
    WHEN 2 THEN '[]' WHEN 3 THEN NULL WHEN 4 THEN 'not a list' WHEN 5 THEN '{"stage": "RISK"}'
    ELSE '[{"signal_score": 1, "extra": [1, 2]}, {"step": 1, "tone": "warning", "impact": null}]' END AS events
FROM {orders}""",
    "stage_gate_records": """
SELECT 'G' || c_custkey AS record_key, CASE c_custkey % 4 WHEN 0 THEN 'PATIENT' WHEN 1 THEN 'PROVIDER' WHEN 2 THEN 'CUSTOMER' ELSE 'patient' END AS domain,
  CASE c_custkey % 9 WHEN 0 THEN 'Epic' WHEN 1 THEN 'Cerner' WHEN 2 THEN 'MDM' WHEN 3 THEN 'ERP' WHEN 4 THEN 'CRM' WHEN 5 THEN 'LegacyFlatFile'
    WHEN 6 THEN 'UnknownVendor' WHEN 7 THEN 'crm' ELSE NULL END AS source_system,
  CASE c_nationkey % 6 WHEN 0 THEN ' Test ' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE 'Kate' END AS first_name,
  CASE c_custkey % 7 WHEN 0 THEN 'N/A' WHEN 1 THEN '' ELSE 'Knight' END AS last_name,
  CASE c_custkey % 5 WHEN 0 THEN '1980-02-03' WHEN 1 THEN '2015-07-09' WHEN 2 THEN '02/03/1980' WHEN 3 THEN NULL ELSE '2007-1-1' END AS dob,
  CASE c_nationkey % 4 WHEN 0 THEN 'ab' || c_custkey || '@acme.com' WHEN 1 THEN 'not-an-email' WHEN 2 THEN NULL ELSE 'a@b.c' END AS email,
  CASE c_custkey % 3 WHEN 0 THEN NULL ELSE (100 + c_custkey % 50) || ' Main St' END AS address,
  CASE c_custkey % 2 WHEN 0 THEN 'PT' || c_custkey ELSE NULL END AS patient_id,
  CASE c_custkey % 8 WHEN 1 THEN 'PR' || c_custkey ELSE '' END AS provider_id, CASE c_nationkey % 2 WHEN 0 THEN '18' || c_custkey ELSE NULL END AS npi
FROM {customer}""",
}

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _inputs(text: str) -> list[str]:
    return [t for t in BASE_TABLES if "{" + t + "}" in text]


def spark_sql(name: str) -> str:
    return re.sub(r"SPLIT_CSV\((.*?)\)", r"split(\1, ',')", SHAPES[name])


def checker_sql(name: str) -> str:
    text = SHAPES[name].replace(" DIV ", " // ")
    text = re.sub(r"SPLIT_CSV\((.*?)\)", r"string_split(\1, ',')", text)
    for t in _inputs(text):
        text = text.replace("{" + t + "}", t)
    return text.strip()


def shaped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One shaped input over the whole of its base tables."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = spark_sql(name)
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _inputs(text)}
    # Literal braces of the text stay out of the way of the table placeholders.
    for t in frames:
        text = text.replace("{" + t + "}", f"<<{t}>>")
    text = text.replace("{", "{{").replace("}", "}}")
    for t in frames:
        text = text.replace(f"<<{t}>>", "{" + t + "}")
    return spark.sql(text, **frames)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over at least as many partitions as there are cores.

    Before work that is heavy per row: a table in a few unsplittable files would keep most
    cores idle. A table with enough splits is left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

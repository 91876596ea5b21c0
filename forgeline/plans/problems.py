"""Queries of the general data problems (4, 6 and 7) over the material tables, and their SQL."""

from __future__ import annotations

from forgeline.operators import drift, snapshots, units
from forgeline.session import read


def p4_found(spark, d):
    return units.foreign_units(read(spark, d, "materials"))


def p4_values(spark, d):
    return units.canonical_values(read(spark, d, "materials"))


def p6_found(spark, d):
    return snapshots.material_changes(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def p7_found(spark, d):
    return drift.schema_changes(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def p7_unified(spark, d):
    return drift.unified_table(read(spark, d, "materials"), read(spark, d, "material_uploads"))


QUERIES = {"p4_found": p4_found, "p4_values": p4_values, "p6_found": p6_found, "p7_found": p7_found, "p7_unified": p7_unified}

P6_SQL = r"""
WITH u AS (
  SELECT id AS upload_id, upper(trim(source_system)) AS src,
         row_number() OVER (PARTITION BY upper(trim(source_system)) ORDER BY created_at NULLS FIRST, id) AS seq
  FROM material_uploads),
r AS (
  SELECT u.src, u.seq, ltrim(upper(trim(coalesce(m.sap_no, ''))), '0') AS sap_no, trim(coalesce(m.plant, '')) AS plant,
         trim(regexp_replace(upper(coalesce(m.short_description, '')), '\s+', ' ', 'g')) AS c
  FROM materials m JOIN u USING (upload_id)),
k AS (SELECT src, seq, sap_no, plant, min(c) AS lo, max(c) AS hi FROM r WHERE sap_no <> '' GROUP BY ALL),
j AS (
  SELECT coalesce(n.src, o.src) AS src, coalesce(n.seq, o.seq + 1) AS seq, coalesce(n.sap_no, o.sap_no) AS sap_no, coalesce(n.plant, o.plant) AS plant,
         CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' WHEN n.lo <> o.lo OR n.hi <> o.hi THEN 'changed' END AS change_kind
  FROM k n FULL JOIN k o ON n.src = o.src AND n.seq = o.seq + 1 AND n.sap_no = o.sap_no AND n.plant = o.plant)
SELECT u.upload_id, j.sap_no, j.plant, j.change_kind FROM j JOIN u ON u.src = j.src AND u.seq = j.seq
WHERE j.seq > 1 AND j.change_kind IS NOT NULL
"""

SQL = {"p6_found": P6_SQL}

"""DuckDB SQL of the queries in ``queries.py``."""

P1_SQL = r"""
WITH c AS (SELECT id FROM material_uploads QUALIFY row_number() OVER (PARTITION BY upper(trim(source_system)) ORDER BY created_at DESC NULLS LAST, id DESC) = 1),
r AS (
  SELECT ltrim(upper(trim(coalesce(m.sap_no, ''))), '0') AS sap_no, m.id, trim(coalesce(m.plant, '')) AS plant, m.updated_at, upper(trim(coalesce(m.status, ''))) AS s
  FROM materials m JOIN c ON c.id = m.upload_id),
o AS (
  SELECT *, row_number() OVER (PARTITION BY sap_no ORDER BY
      CASE WHEN s LIKE '%DELETED%' OR s LIKE '%RFD STAGED%' OR s LIKE '%RFUD STAGED%' THEN 4 WHEN s LIKE '%BLOCKED%' THEN 3
           WHEN s = 'B2-ERP ACCEPTED' THEN 0 WHEN s LIKE 'C2-RFC%' THEN 1 ELSE 2 END, updated_at DESC NULLS LAST, id) AS pos
  FROM r WHERE sap_no <> '')
SELECT sap_no, arg_min(id, pos) AS id, coalesce(arg_min(plant, pos) FILTER (plant <> ''), '') AS plant
FROM o GROUP BY sap_no HAVING count(*) > 1
"""

_P2 = r"""
WITH m AS (
  SELECT query_id, material_id, max(CASE WHEN isnan(lexical_score) THEN NULL ELSE lexical_score END) AS a, max(CASE WHEN isnan(fuzzy_score) THEN NULL ELSE fuzzy_score END) AS b
  FROM material_candidates WHERE query_id IS NOT NULL AND material_id IS NOT NULL GROUP BY ALL),
p AS (
  SELECT query_id, material_id,
         CASE WHEN a IS NULL THEN 0.0 ELSE percent_rank() OVER (PARTITION BY query_id ORDER BY a NULLS FIRST) END::DOUBLE AS pa,
         CASE WHEN b IS NULL THEN 0.0 ELSE percent_rank() OVER (PARTITION BY query_id ORDER BY b NULLS FIRST) END::DOUBLE AS pb
  FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(pa, pb) DESC, greatest(pa, pb) DESC, material_id) AS rank FROM p)
"""

#: Hazards of every length against the three on either side; Chernoff's bound; Benjamini and Hochberg at 0.01.
P5_LIMITS = r"""
WITH t AS (
  SELECT coalesce(upper(trim(u.source_system)), '') AS source, m.short_description, m.long_description FROM materials m LEFT JOIN material_uploads u ON u.id = m.upload_id),
d AS (
  SELECT DISTINCT source, 'short_description' AS field, short_description AS x FROM t WHERE short_description <> ''
  UNION ALL SELECT DISTINCT source, 'long_description', long_description FROM t WHERE long_description <> ''),
c AS (SELECT source, field, length(x) AS n, count(*) AS c FROM d GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY source, field ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM c),
h AS (
  SELECT *, sum(c) OVER w - c AS oc, sum(risk) OVER w - risk AS orisk FROM r
  WINDOW w AS (PARTITION BY source, field ORDER BY n RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
p AS (SELECT *, c::DOUBLE / risk AS p1, (oc + 1)::DOUBLE / (orisk + 2) AS p0 FROM h WHERE c >= 20),
l AS (SELECT *, CASE WHEN p1 > p0 AND p0 < 1 THEN -risk * (p1 * ln(p1 / p0) + CASE WHEN p1 < 1 THEN (1 - p1) * ln((1 - p1) / (1 - p0)) ELSE 0 END) ELSE 0 END AS logp FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY logp, source, field, n) AS k, count(*) OVER () AS m FROM l)
SELECT source, field, n FROM k WHERE k <= (SELECT max(k) FROM k WHERE logp <= ln(k * 0.01 / m))
"""

SQL = {
    "p5_limits": P5_LIMITS,
    "p1_found": P1_SQL,
    "p2_found": _P2 + "SELECT query_id, material_id FROM k WHERE rank = 1",
    "p2_ranking": _P2 + "SELECT query_id, material_id, pa AS pct_lexical_score, pb AS pct_fuzzy_score, rank FROM k",
}

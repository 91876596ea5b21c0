"""DuckDB SQL of the catalog queries in ``reference.py``."""

from __future__ import annotations

from forgeline.functions import vocab
from forgeline.operators.analytics import CLASS_COVERAGE, METRICS, READINESS

ACTIVE = "NOT coalesce(regexp_matches(upper(regexp_replace({s}, '\\s+', ' ', 'g')), 'DELETED|RFD STAGED|RFUD STAGED'), false)"
RANK = "CASE WHEN upper(coalesce({s}, '')) LIKE '%BLOCKED%' THEN 3 WHEN trim(coalesce({s}, '')) = 'B2-ERP ACCEPTED' THEN 0 WHEN trim(coalesce({s}, '')) LIKE 'C2-RFC%' THEN 1 ELSE 2 END"
CURRENT = "SELECT id FROM material_uploads QUALIFY row_number() OVER (PARTITION BY upper(trim(source_system)) ORDER BY created_at DESC NULLS LAST, id DESC) = 1"

_js = lambda f: f"json_extract_string(attributes, '$.{f}')"
_has = lambda f: f"coalesce({_js(f)} <> '', false)"
_list = lambda f: f"coalesce(json_array_length(attributes, '$.{f}') > 0, false)"
_FLAGS = {
    "description": "coalesce(long_description <> '', false)", "item_type": _has("itemType"), "subtype": _has("subtype"), "size": _has("sizeMm"),
    "pressure": f"({_has('pressureClass')} OR {_has('pressureBar')})", "connection": _has("connection"), "materials": _list("materials"),
    "standards": _list("standards"), "face_to_face": _has("faceToFaceMm"), "actuation": _has("actuation"),
}
P = f"""
WITH f AS (
  SELECT coalesce(corporate_no, '') AS corporate_no, coalesce(sap_no, '') AS sap_no, coalesce(plant, '') AS plant, coalesce(class_name, '') AS class_name,
         coalesce(material_type, '') AS material_type, coalesce(status, '') AS status, {ACTIVE.format(s='status')} AS active, embedding IS NOT NULL AS embedded,
         coalesce(long_description, '') AS long_description,
         coalesce(json_extract_string(raw_data, '$."Created Date"'), json_extract_string(raw_data, '$."Created On"'), json_extract_string(raw_data, '$.ERSDA')) AS created,
         {', '.join(f'{v} AS {k}' for k, v in _FLAGS.items())}
  FROM materials WHERE upload_id IN ({CURRENT})),
p AS (SELECT *, {' + '.join(f'(CASE WHEN {k} THEN {v} ELSE 0 END)' for k, v in READINESS.items())} AS readiness FROM f)
"""
_DATED = "regexp_full_match(created, '[0-9]{2}-[0-9]{2}-[0-9]{4}')"


def _ratio(n: str, total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 0.0::DOUBLE ELSE floor({n}::DOUBLE / {total} * 1000 + 0.5) / 10 END"


def _dist(column: str, limit: int | None = None, coverage: list[str] | None = None) -> str:
    cov = "".join(f", count(*) FILTER (active AND {c}) AS {c}_count" for c in coverage or [])
    return (
        P
        + f"""SELECT CASE WHEN {column} = '' THEN 'UNSPECIFIED' ELSE {column} END AS label, count(*) AS n, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS inactive,
  floor(coalesce(avg(readiness) FILTER (active), 0) * 10 + 0.5) / 10 AS readiness{cov}, {_ratio('count(*)', '(SELECT count(*) FROM p)')} AS percentage
FROM p GROUP BY 1 ORDER BY n DESC, label{f' LIMIT {limit}' if limit else ''}"""
    )


_SUMMARY = (
    P
    + f""", s AS (SELECT count(*) AS total, count(*) FILTER (active) AS active, count(DISTINCT (corporate_no, sap_no)) AS unique_materials,
  count(DISTINCT nullif(plant, '')) AS plants, count(DISTINCT nullif(class_name, '')) AS classes, count(*) FILTER (active AND embedded) AS embedded,
  count(*) FILTER (regexp_full_match(sap_no, '[0-9]+')) AS numeric_sap, count(*) FILTER (upper(sap_no) LIKE 'NIR-%') AS provisional_sap,
  count(*) FILTER (sap_no = '') AS missing_sap, count(*) FILTER (upper(trim(class_name)) IN ('', 'MATERIAL', 'GENERIC')) AS generic_class,
  count(*) FILTER ({_DATED}) AS dated, round(coalesce(avg(length(long_description)) FILTER (active), 0), 6) AS avg_len,
  round(coalesce(avg(readiness) FILTER (active), 0), 6) AS readiness FROM p)
"""
)


def _repeated(source: str, column: str) -> str:
    return f"""g AS (SELECT lower(trim({column})) AS t, count(*) AS n FROM {source} WHERE length(trim({column})) >= 10 GROUP BY 1 HAVING count(*) > 1)
SELECT count(*) AS dup_groups, coalesce(sum(n - 1), 0)::BIGINT AS dup_rows FROM g"""


_q = lambda s: "'" + s.replace("'", "''") + "'"
_MAP = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in vocab.ABBREVIATIONS.items()) + "}"
_UNESCAPE = "regexp_replace(regexp_replace({x}, '<\\(>(.)<\\)>', '\\1', 'g'), '<\\(>|<\\)>', '', 'g')"


def _expand(x: str) -> str:
    up = _UNESCAPE.format(x=f"upper(coalesce({x}, ''))")
    return f"array_to_string(list_transform(regexp_extract_all({up}, '[A-Z]+|[^A-Z]+'), lambda w: coalesce(m.t[w], w)), '')"


def _distinct(x: str) -> str:
    """Distinct elements in order of first appearance."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def _type(x: str) -> str:
    for t in vocab.ITEM_TYPES:
        if " " in t:
            x = f"regexp_replace({x}, '(^|[^A-Z]){t}($|[^A-Z])', '\\1{t.replace(' ', '_')}\\2', 'g')"
    words = f"regexp_extract_all({x}, '[A-Z_]+')"
    pick = lambda types: f"list_filter({words}, lambda w: list_contains([{', '.join(_q(t.replace(' ', '_')) for t in types)}], w))[1]"
    return f"replace(coalesce({pick(vocab.SPECIFIC_TYPES)}, {pick(vocab.GENERIC_TYPES)}), '_', ' ')"


_WITH_MAP = f"WITH m AS (SELECT {_MAP} AS t)"
_STOP = ", ".join(_q(w) for w in vocab.stopword_list())
_BASE = f"SELECT * FROM materials WHERE upload_id IN ({CURRENT})"
_KEYS = ["corporate_no", "sap_no", "plant", "short_description", "long_description"]

SQL = {
    "dash_status": _dist("status"),
    "dash_summary": _SUMMARY
    + f"""SELECT *, total - active AS excluded, total - unique_materials AS duplicate_rows, greatest(0, total - numeric_sap - provisional_sap - missing_sap) AS other_sap,
  {_ratio('active', 'total')} AS searchable_rate, {_ratio('embedded', 'active')} AS embedding_coverage FROM s""",
    "dash_class_quality": _dist("class_name", 15, CLASS_COVERAGE),
    "dash_plant_health": _dist("plant", 20),
    "dash_class_coverage": f"WITH d AS ({_dist('class_name', 15, CLASS_COVERAGE)}) SELECT label, n, active, readiness, {', '.join(f'{_ratio(c + chr(95) + 'count', 'active')} AS {c}_coverage' for c in CLASS_COVERAGE)} FROM d",
    "dash_plant_rates": f"WITH d AS ({_dist('plant', 20)}) SELECT label, n, active AS searchable, inactive AS excluded, {_ratio('active', 'n')} AS searchable_rate, readiness FROM d",
    "dash_shares": P + f""", a AS (SELECT *, length(long_description) AS len, concat_ws(', ', CASE WHEN NOT size THEN 'Size' END, CASE WHEN NOT pressure THEN 'Pressure' END, CASE WHEN NOT connection THEN 'Connection' END, CASE WHEN NOT materials THEN 'Materials' END, CASE WHEN NOT standards THEN 'Standards' END) AS l FROM p WHERE active),
c AS (SELECT count(*) AS live, (SELECT count(*) FROM p WHERE {_DATED}) AS dated FROM a),
k AS (SELECT 'readiness' AS kind, CASE WHEN readiness >= 70 THEN 'Strong' WHEN readiness >= 40 THEN 'Partial' ELSE 'Sparse' END AS label, count(*) AS n FROM a GROUP BY 2
  UNION ALL SELECT 'length', CASE WHEN len < 40 THEN 'Under 40 chars' WHEN len < 100 THEN '40-99 chars' WHEN len < 200 THEN '100-199 chars' ELSE '200+ chars' END, count(*) FROM a GROUP BY 2
  UNION ALL SELECT 'year', right(created, 4), count(*) FROM p WHERE {_DATED} GROUP BY 2
  UNION ALL (SELECT 'gap', CASE WHEN l = '' THEN 'No critical gaps' ELSE l END AS g, count(*) AS m FROM a GROUP BY 2 ORDER BY m DESC, g LIMIT 8))
SELECT kind, label, n, {_ratio('n', "(CASE WHEN kind = 'year' THEN dated ELSE live END)")} AS percentage FROM k, c""",
    "dash_type": _dist("material_type", 10),
    "dash_coverage": P + f"SELECT count(*) AS searchable, {', '.join(f'count(*) FILTER ({k}) AS {k}' for k, _, _ in METRICS)} FROM p WHERE active",
    "dash_quality": P + " UNION ALL ".join(f"SELECT {_q(k)} AS key, {_q(n)} AS label, {str(c).lower()} AS critical, count(*) FILTER ({k}) AS n, {_ratio(f'count(*) FILTER ({k})', 'count(*)')} AS percentage FROM p WHERE active" for k, n, c in METRICS),
    "dash_readiness_tiers": P + "SELECT CASE WHEN readiness >= 70 THEN 'Strong' WHEN readiness >= 40 THEN 'Partial' ELSE 'Sparse' END AS label, count(*) AS n, min(readiness) AS lowest FROM p WHERE active GROUP BY 1",
    "dup_descriptions": P + ", a AS (SELECT * FROM p WHERE active), " + _repeated("a", "long_description"),
    "dup_documents": "WITH " + _repeated("documents", "text"),
    "len_buckets": P + "SELECT CASE WHEN length(long_description) < 40 THEN 'Under 40 chars' WHEN length(long_description) < 100 THEN '40-99 chars' WHEN length(long_description) < 200 THEN '100-199 chars' ELSE '200+ chars' END AS label, count(*) AS n, min(length(long_description)) AS shortest FROM p WHERE active GROUP BY 1",
    "created_year": P + f"SELECT right(created, 4) AS label, count(*) AS n FROM p WHERE {_DATED} GROUP BY 1",
    "gap_patterns": P + ", g AS (SELECT concat_ws(', ', CASE WHEN NOT size THEN 'Size' END, CASE WHEN NOT pressure THEN 'Pressure' END, CASE WHEN NOT connection THEN 'Connection' END, CASE WHEN NOT materials THEN 'Materials' END, CASE WHEN NOT standards THEN 'Standards' END) AS l FROM p WHERE active) SELECT CASE WHEN l = '' THEN 'No critical gaps' ELSE l END AS label, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, label LIMIT 8",
    "sap_maturity": _SUMMARY + ", o AS (SELECT *, greatest(0, total - numeric_sap - provisional_sap - missing_sap) AS other_sap FROM s) SELECT label, n, " + _ratio("n", "total") + " AS percentage FROM (" + " UNION ALL ".join(f"SELECT {_q(a)} AS label, {b} AS n, total FROM o" for a, b in [("ERP numeric code", "numeric_sap"), ("Provisional NIR", "provisional_sap"), ("Other format", "other_sap"), ("Missing", "missing_sap")]) + ") WHERE n > 0",
    "stats": f"SELECT (SELECT count(*) FROM ({_BASE})) AS total, (SELECT count(*) FROM ({_BASE}) WHERE {ACTIVE.format(s='status')}) AS active, count(*) AS uploads, max(created_at) AS last_upload FROM material_uploads",
    "expand_abbrev": f"{_WITH_MAP} SELECT id, {_expand('short_description')} AS expanded FROM materials, m",
    "search_text": f"{_WITH_MAP}, o AS (SELECT id, {_UNESCAPE.format(x='''upper(concat_ws(' ', nullif(short_description, ''), nullif(class_name, '')))''')} AS x FROM materials), e AS (SELECT id, regexp_extract_all(x || ' ' || {_expand('x')}, '[A-Z0-9/.\"''\\-]+') AS w FROM o, m) SELECT id, array_to_string({_distinct('w')}, ' ') AS tokens FROM e",
    "item_type": f"{_WITH_MAP}, e AS (SELECT id, {_expand('short_description')} AS s, {_expand('class_name')} AS c, {_expand('long_description')} AS l FROM materials, m) SELECT id, coalesce({_type('s')}, {_type('c')}, {_type('l')}) AS derived FROM e",
    "vocab_df": f"""{_WITH_MAP}, d AS (SELECT concat_ws(' ', coalesce(short_description, ''), coalesce(class_name, '')) AS x FROM ({_BASE}) WHERE {ACTIVE.format(s='status')}),
k AS (SELECT x FROM d WHERE trim(x) <> ''), w AS (SELECT unnest(list_distinct(regexp_extract_all({_expand('x')}, '[A-Z]+'))) AS token FROM k, m)
SELECT token, count(*) AS documents FROM w WHERE length(token) BETWEEN 3 AND 14 AND token NOT IN ({_STOP}) GROUP BY token
HAVING count(*) >= 5 AND count(*) <= greatest(5.0, (SELECT count(*) FROM k) * 0.25)""",
    "class_rule": f"""{_WITH_MAP}, r AS (SELECT *, coalesce(nullif(class_name, ''), nullif(item_type_source, '')) AS src FROM materials),
e AS (SELECT id, src, {_expand('short_description')} AS s, {_expand('class_name')} AS c, {_expand('long_description')} AS l FROM r, m)
SELECT id, coalesce(CASE WHEN (SELECT count(DISTINCT src) FROM r) > 1 THEN src END, {_type('s')}, {_type('c')}, {_type('l')}, src, 'UNCLASSIFIED') AS chosen_class FROM e""",
    "import_dedupe": "SELECT upload_id, coalesce(corporate_no, '') AS corporate_no, coalesce(sap_no, '') AS sap_no, coalesce(plant, '') AS plant, id, short_description FROM materials QUALIFY row_number() OVER (PARTITION BY upload_id, coalesce(corporate_no, ''), coalesce(sap_no, ''), coalesce(plant, '') ORDER BY id DESC) = 1",
    "embedding_carryover": "WITH v AS (SELECT DISTINCT " + ", ".join(f"coalesce({k}, '') AS {k}" for k in _KEYS) + " FROM materials WHERE embedding IS NOT NULL) SELECT m.upload_id, count(*) AS rows, count(*) FILTER (m.embedding IS NOT NULL OR v.sap_no IS NOT NULL) AS with_vector FROM materials m LEFT JOIN v ON " + " AND ".join(f"coalesce(m.{k}, '') = v.{k}" for k in _KEYS) + " GROUP BY 1",
    "procurement_rank": f"SELECT id, {RANK.format(s='status')} AS procurement_rank, {ACTIVE.format(s='status')} AS is_active, upper(coalesce(status, '')) LIKE '%BLOCKED%' AS is_blocked FROM materials",
    "plants_per_material": f"SELECT coalesce(corporate_no, '') AS corporate_no, trim(coalesce(sap_no, '')) AS sap_no, coalesce(array_to_string(list_sort(list_distinct(list(trim(plant)) FILTER (trim(plant) <> ''))), ','), '') AS plants FROM ({_BASE}) GROUP BY 1, 2",
    "material_dedupe": f"SELECT coalesce(corporate_no, '') AS corporate_no, trim(coalesce(sap_no, '')) AS sap_no, id, {RANK.format(s='status')} AS procurement_rank FROM ({_BASE}) QUALIFY row_number() OVER (PARTITION BY coalesce(corporate_no, ''), trim(coalesce(sap_no, '')) ORDER BY {RANK.format(s='status')}, updated_at DESC NULLS LAST, id) = 1",
    "cosine_topk": "WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS sim FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 10",
    "event_props": "SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k_sum, max(json_extract_string(props, '$.k')::BIGINT) AS k_max FROM events GROUP BY 1",
    "search_items": "SELECT DISTINCT query_id, item FROM (SELECT query_id, trim(unnest(regexp_split_to_array(coalesce(query_text, ''), '[\\r\\n]+'))) AS item FROM search_queries) WHERE length(item) >= 3",
    "current_version": "SELECT id AS upload_id, upper(trim(source_system)) AS source_system, row_number() OVER (PARTITION BY upper(trim(source_system)) ORDER BY created_at NULLS FIRST, id) AS seq, row_number() OVER (PARTITION BY upper(trim(source_system)) ORDER BY created_at DESC NULLS LAST, id DESC) = 1 AS is_current FROM material_uploads",
}

"""DuckDB SQL of the retrieval and search queries in ``reference.py``, from texts and given attribute records."""

from __future__ import annotations

from forgeline.functions import vocab
from forgeline.functions.parse import ATTRIBUTES, LABELS, STANDARDS
from forgeline.functions.scoring import PENALTIES, SPARE, WEIGHTS
from forgeline.plans.reference_sql import ACTIVE, CURRENT, RANK, _distinct, _expand, _q, _type, _UNESCAPE, _WITH_MAP


def _terms(x: str) -> str:
    """Lexemes of a text that is already in upper case and unescaped."""
    tokens = f"""regexp_extract_all({x} || ' ' || {_expand(x)}, '[A-Z0-9/."''\\-]+')"""
    return f"list_distinct(list_filter(flatten(list_transform({tokens}, lambda t: regexp_extract_all(t, '[0-9]+/[0-9]+|[A-Z0-9]+'))), lambda p: length(p) > 1))"


def _grams(x: str) -> str:
    """Trigrams of a text in order."""
    return f"flatten(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substring('  ' || w || ' ', i, 3))))"


def _tokens(x: str) -> str:
    return _distinct(f"""regexp_extract_all({x} || ' ' || {_expand(x)}, '[A-Z0-9/."''\\-]+')""")


_up = lambda *c: _UNESCAPE.format(x=f"upper(concat_ws(' ', {', '.join(f'nullif({x}, {chr(39) * 2})' for x in c)}))")
_CODE = "regexp_replace(upper({t}), '\\s+', '', 'g')"
_code = lambda t: f"CASE WHEN regexp_full_match({_CODE.format(t=t)}, '([0-9]{{4,}}|[A-Z][0-9]{{6,}}|NIR-.*)') THEN {_CODE.format(t=t)} ELSE '' END"


def _json(field: str, kind: str) -> str:
    """A field of the record as Spark reads it: numbers only from numbers, lists only from lists, texts from anything."""
    path = f"attributes, '$.{field}'"
    if kind == "double":
        return f"CASE WHEN json_valid(attributes) AND json_type({path}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN json_extract({path})::DOUBLE END"
    if kind == "string":
        return f"CASE WHEN json_valid(attributes) THEN json_extract_string({path}) END"
    return f"CASE WHEN json_valid(attributes) AND json_type({path}) = 'ARRAY' THEN json_extract_string(attributes, '$.{field}[*]') END"


_FIELDS = {f.name: f.dataType.simpleString() for f in ATTRIBUTES.fields}
_RECORD = ", ".join(f'{_json(n, k)} AS "{n}"' for n, k in _FIELDS.items())

BASE = f"""{_WITH_MAP}, b0 AS (
  SELECT id, coalesce(corporate_no, '') AS corporate_no, trim(coalesce(sap_no, '')) AS sap_no, trim(coalesce(plant, '')) AS plant, coalesce(class_name, '') AS class_name,
         coalesce(short_description, '') AS short_description, coalesce(long_description, '') AS long_description, coalesce(status, '') AS status, coalesce(item_type, '') AS item_type,
         {RANK.format(s='status')} AS procurement_rank, updated_at, {ACTIVE.format(s='status')} AS active, {_RECORD}
  FROM materials WHERE upload_id IN ({CURRENT})),
b1 AS (SELECT *, {_up('short_description')} AS us, {_up('short_description', 'long_description', 'class_name')} AS uw FROM b0 WHERE active),
b2 AS (SELECT *, {_terms('us')} AS short_terms, {_terms('uw')} AS all_terms, lower(array_to_string({_tokens('uw')}, ' ')) AS search_doc FROM b1, m),
b AS (SELECT * EXCLUDE (us, uw, t), {_grams('search_doc')} AS seq FROM b2)"""
_QUERY = f"SELECT *, {_code('query_text')} AS code, {_terms('uq')} AS terms, list_distinct({_grams('query_text')}) AS grams FROM q0, m"
TEXTS = f", q0 AS (SELECT query_id, coalesce(query_text, '') AS query_text, {_UNESCAPE.format(x=chr(117) + 'pper(coalesce(query_text, ' + chr(39) * 2 + '))')} AS uq FROM search_queries WHERE query_id IS NOT NULL), q AS ({_QUERY})"
_GIVEN = ", ".join(f'"{n}" AS "q_{n}"' for n in _FIELDS)
RECORDS = f", q0 AS (SELECT substring(id, 2)::BIGINT AS query_id, trim(short_description) AS query_text, {_up('trim(short_description)')} AS uq, {_GIVEN} FROM b0 WHERE active AND substring(id, 2)::BIGINT % 20 = 0 AND length(trim(short_description)) BETWEEN 3 AND 2000), q AS ({_QUERY})"

_RAW = "round(1.0 * len(list_intersect(q.terms, b.short_terms)) + 0.4 * len(list_intersect(q.terms, b.all_terms)), 6)"
_top = lambda n, order: f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}id) <= {n}"
LEXICAL = f"SELECT q.query_id, b.id, {_RAW} AS raw_lexical FROM q JOIN b ON list_has_any(q.terms, b.all_terms)"
_EXTENT = "len(list_intersect(seq[s:e], grams)) / (len(grams) + len(list_distinct(seq[s:e])) - len(list_intersect(seq[s:e], grams)))"
#: hits: positions in seq of trigrams of the query; the best run begins and ends at one.
_SIMILAR = f"coalesce(list_max(list_transform(hits, lambda s: list_max(list_transform(list_filter(hits, lambda e: e >= s), lambda e: {_EXTENT})))), 0.0)"
_HITS = "list_filter(generate_series(1, len(seq)), lambda i: list_contains(grams, seq[i]))"
TRIGRAM = f"""SELECT query_id, id, {_SIMILAR} AS fuzzy_score FROM (SELECT query_id, id, seq, grams, {_HITS} AS hits FROM (
  SELECT q.query_id, b.id, b.seq, q.grams FROM q JOIN b ON len(list_intersect(b.seq, q.grams)) >= 0.6 * len(q.grams) - 1e-9 WHERE len(q.grams) > 0)) WHERE fuzzy_score >= 0.6"""
CODE = "SELECT q.query_id, b.id FROM q JOIN b ON contains(b.sap_no, q.code) OR contains(upper(b.corporate_no), q.code) WHERE q.code <> ''"
ATTRIBUTE = 'SELECT q.query_id, b.id FROM q JOIN b ON b.item_type = q."q_itemType" AND (q."q_sizeMm" IS NULL OR abs(b."sizeMm" - q."q_sizeMm") <= 1)'

POOL = f"""{BASE}{RECORDS}, c_arm AS ({CODE} {_top(100, '')}), l_arm AS (SELECT query_id, id FROM ({LEXICAL}) {_top(360, 'raw_lexical DESC, ')}),
t_arm AS (SELECT query_id, id FROM ({TRIGRAM}) {_top(360, 'fuzzy_score DESC, ')}), a_arm AS ({ATTRIBUTE} {_top(360, '')}),
arms AS (SELECT query_id, id, max(c) AS code_arm, max(l) AS lexical_arm, max(t) AS trigram_arm, max(a) AS attribute_arm FROM (
  SELECT *, 1 AS c, 0 AS l, 0 AS t, 0 AS a FROM c_arm UNION ALL SELECT *, 0, 1, 0, 0 FROM l_arm UNION ALL SELECT *, 0, 0, 1, 0 FROM t_arm UNION ALL SELECT *, 0, 0, 0, 1 FROM a_arm) GROUP BY 1, 2)"""

_ENG = """(CASE WHEN coalesce("q_itemType", '') = '' THEN 0.12e0 WHEN item_type = "q_itemType" THEN 0.30e0 ELSE 0.0e0 END
  + CASE WHEN coalesce(list_has_any("q_subtypes", "subtypes"), false) THEN 0.22e0 ELSE 0.0e0 END + CASE WHEN coalesce(abs("sizeMm" - "q_sizeMm") <= 1, false) THEN 0.28e0 ELSE 0.0e0 END
  + CASE WHEN coalesce("q_connection", '') <> '' AND coalesce(upper("connection") = "q_connection", false) THEN 0.10e0 ELSE 0.0e0 END
  + CASE WHEN coalesce("q_pressureClass", '') <> '' AND coalesce(upper("pressureClass") = "q_pressureClass", false) THEN 0.10e0 ELSE 0.0e0 END)"""
CANDIDATES = f"""{POOL}, j AS (
  SELECT q.*, b.* EXCLUDE (t_), {_RAW} AS raw FROM arms JOIN q USING (query_id) JOIN (SELECT *, 0 AS t_ FROM b) b USING (id)),
k AS (SELECT *, raw / (1 + raw) AS lexical_score, (code <> '' AND (sap_no = code OR upper(corporate_no) = code)) OR lower(short_description) = lower(query_text) AS exact_match, {_ENG} AS eng,
        coalesce(len(list_intersect(seq, grams)) / nullif(len(grams), 0), 0.0) AS most FROM j
      QUALIFY row_number() OVER (PARTITION BY query_id, corporate_no, sap_no ORDER BY procurement_rank, updated_at DESC NULLS LAST, id) = 1),
n AS (SELECT *, CASE WHEN exact_match THEN 10.0 ELSE 0.45 * eng + 0.30 * lexical_score END AS low FROM k),
bar AS (SELECT query_id, low AS bar FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY low DESC) = 120),
able AS (SELECT n.*, {_HITS} AS hits FROM n LEFT JOIN bar USING (query_id) WHERE bar IS NULL OR low + 0.25 * most + 1e-9 >= bar),
f AS (SELECT *, {_SIMILAR} AS fuzzy_score FROM able),
g AS (SELECT *, CASE WHEN exact_match THEN 10.0 ELSE low + 0.25 * fuzzy_score END AS final_score FROM f),
cand AS (SELECT * FROM g {_top(120, 'final_score DESC, procurement_rank, ')}),
plants AS (SELECT corporate_no, sap_no, coalesce(array_to_string(list_sort(list_distinct(list(plant) FILTER (plant <> ''))), ','), '') AS plants FROM b GROUP BY 1, 2)"""


# ---- attribute scores, as scoring.py has them ----

_e = lambda c: f"nullif(upper(trim({c})), '')"
_want, _have = (lambda f: f'"q_{f}"'), (lambda f: f'"{f}"')
_agree = lambda a, b: f"coalesce(contains({a}, {b}) OR contains({b}, {a}), false)"
_yes = lambda c: f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END"
_text_score = lambda f: _yes(_agree(_e(_want(f)), _e(_have(f))))
_clean = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: upper(trim(x))), lambda x: x IS NOT NULL AND x <> '')"


def _numeric(f: str, tolerance: float) -> str:
    d = f"abs({_want(f)} - {_have(f)})"
    return f"CASE WHEN {d} IS NULL THEN 0e0 WHEN {d} <= {tolerance} THEN 1e0 WHEN {d} / greatest({_want(f)}, 1e0) <= 0.05e0 THEN 0.7e0 ELSE 0e0 END"


def _share(a: str, b: str, agree: str = "contains(x, y) OR contains(y, x)") -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: {agree})) > 0))::DOUBLE / len({a}) ELSE 0e0 END"


def _kinds(side) -> str:
    one = _e(side("subtype"))
    return f"list_transform(CASE WHEN len({_clean(side('subtypes'))}) > 0 THEN {_clean(side('subtypes'))} ELSE list_filter([{one}], lambda x: x IS NOT NULL) END, lambda x: CASE WHEN x = 'NON RETURN' THEN 'CHECK' ELSE x END)"


def _related(a: str, b: str) -> str:
    groups = " OR ".join(f"({a} IN ({g}) AND {b} IN ({g}))" for g in (", ".join(map(_q, g)) for g in vocab.RELATED_TYPES))
    return f"coalesce({a} = {b} OR {groups}, true)"


def _as_text(side) -> dict[str, str]:
    n = lambda f: f"nullif({side(f)}, '')"
    num = lambda f, u: f"(CASE WHEN {side(f)} = floor({side(f)}) THEN {side(f)}::BIGINT::VARCHAR ELSE {side(f)}::VARCHAR END || {_q(u)})"
    many = lambda f: f"nullif(array_to_string(coalesce({side(f)}, []), ', '), '')"
    plain = {k: n(k) for k in ("itemType", "schedule", "connection", "bodyMaterial", "discMaterial", "stemMaterial", "seatMaterial", "make", "actuation")}
    return plain | {
        "subtype": f"coalesce({many('subtypes')}, {n('subtype')})", "size": f"coalesce({n('sizeDisplay')}, {num('sizeMm', 'MM')})", "size2": num("sizeMm2", "MM"),
        "pressure": f"coalesce({n('pressureClass')}, {num('pressureBar', ' BAR')})", "angle": num("angleDeg", "°"), "wallThickness": num("wallThicknessMm", "MM"),
        "materials": many("materials"), "faceToFace": num("faceToFaceMm", "MM"), "standards": many("standards"),
    }


_bar = f"abs({_want('pressureBar')} - {_have('pressureBar')})"
_SCORES = {
    "itemType": _yes(_related(_e(_want("itemType")), _e(_have("itemType")))),
    "subtype": f"CASE WHEN len({_kinds(_want)}) = 0 THEN 0e0 WHEN len({_kinds(_have)}) = 0 THEN 0.6e0 ELSE {_share(_kinds(_want), _kinds(_have))} END",
    "size": _numeric("sizeMm", 1), "size2": _numeric("sizeMm2", 1), "schedule": _text_score("schedule"), "connection": _text_score("connection"),
    "pressure": f"CASE WHEN coalesce({_e(_want('pressureClass'))} = {_e(_have('pressureClass'))}, false) THEN 1e0 WHEN {_bar} IS NULL THEN 0e0 WHEN {_bar} <= 0.5e0 THEN 1e0 WHEN {_bar} / greatest({_want('pressureBar')}, 1e0) <= 0.1e0 THEN 0.75e0 ELSE 0e0 END",
    "angle": _numeric("angleDeg", 0), "wallThickness": _numeric("wallThicknessMm", 0.2), "materials": _share(_clean(_want("materials")), _clean(_have("materials"))),
    **{k: _text_score(k) for k in ("bodyMaterial", "discMaterial", "stemMaterial", "seatMaterial")}, "faceToFace": _numeric("faceToFaceMm", 1), "make": _text_score("make"),
    "standards": _share(_clean(_want("standards")), _clean(_have("standards")), "x = y"), "actuation": _text_score("actuation"),
}
_asked, _offered = _as_text(_want), _as_text(_have)
_family = f"coalesce({_e(_have('itemType'))}, {_e('class_name')})"
_FAMILY = f"CASE WHEN {_e(_want('itemType'))} IS NULL OR {_family} IS NULL OR {_e(_want('itemType'))} = {_family} THEN 1e0 WHEN {_related(_e(_want('itemType')), _family)} THEN 0.85e0 ELSE 0.15e0 END"
_off = lambda k: f"(w_{k} IS NOT NULL AND s_{k} = 'mismatch')"
_plus = lambda f: " + ".join(f"(CASE WHEN w_{k} IS NOT NULL THEN {f(k, float(w))} ELSE 0e0 END)" for k, (w, _) in WEIGHTS.items())
_stated = " OR ".join(f"w_{k} IS NOT NULL" for k in WEIGHTS)
_spare = SPARE.replace("'", "''")
SHORTLIST = f"""{CANDIDATES}, v0 AS (
  SELECT *, {', '.join(f'{_asked[k]} AS w_{k}, {_offered[k]} AS h_{k}, {_SCORES[k]} AS p_{k}' for k in WEIGHTS)}, {_FAMILY} AS family FROM cand
  WHERE regexp_matches(upper(coalesce("q_subtype", '')), '{_spare}') OR regexp_matches(upper(coalesce("q_itemType", '')), '{_spare}') OR NOT regexp_matches(upper(class_name || ' ' || short_description), '{_spare}')),
v1 AS (SELECT *, {', '.join(f"CASE WHEN h_{k} IS NULL THEN 'missing' WHEN p_{k} >= 0.99 THEN 'exact' WHEN p_{k} >= 0.65 THEN 'compatible' ELSE 'mismatch' END AS s_{k}" for k in WEIGHTS)} FROM v0),
v2 AS (SELECT *, CASE WHEN {_stated} THEN ({_plus(lambda k, w: f"{w}e0 * p_{k}")}) / ({_plus(lambda k, w: f"{w}e0")}) ELSE greatest(lexical_score, fuzzy_score) END AS parametric,
  family * {' * '.join(f'(CASE WHEN {_off(k)} THEN {f}e0 ELSE 1e0 END)' for k, f in PENALTIES.items())} AS penalty FROM v1),
v3 AS (SELECT *, (0.85e0 * parametric + 0.15e0 * greatest(lexical_score, fuzzy_score)) * penalty + exact_match::INT AS shortlist_score FROM v2),
short AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shortlist_score DESC, final_score DESC, id) AS position FROM v3 QUALIFY position <= 10)"""
_pct = lambda c: f"floor({c} * 1000 + 0.5) / 10"
RANKED = f"""{SHORTLIST}, x0 AS (SELECT *, least(1e0, 0.65e0 * fuzzy_score + 0.35e0 * lexical_score) AS semantic, upper(status) LIKE '%BLOCKED%' AS blocked FROM short),
x1 AS (SELECT *, {_pct("CASE WHEN exact_match THEN 1e0 ELSE (0.7e0 * parametric + 0.3e0 * semantic) * penalty END")} AS confidence FROM x0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY exact_match DESC, blocked, confidence DESC, position) AS rank, id, confidence, {_pct('parametric')} AS parametric_score,
  {_pct('semantic')} AS semantic_score, {_pct('greatest(lexical_score, fuzzy_score)')} AS lexical_score, exact_match, blocked,
  concat_ws(' | ', {', '.join(f"CASE WHEN w_{k} IS NOT NULL AND s_{k} IN ('mismatch', 'missing') THEN {_q(label + ': requested ')} || w_{k} || '; candidate ' || coalesce(h_{k}, 'Not specified') END" for k, (_, label) in WEIGHTS.items())}) AS differences
FROM x1 QUALIFY rank <= 5"""


# ---- the parser's rules ----

_LABEL_RE = "|".join(x.replace(" ", "\\s*") for x in sorted(LABELS, key=len, reverse=True))
_N = r"[0-9]+(?:\s*-\s*[0-9]+\s*/\s*[0-9]+|\s*/\s*[0-9]+|\.[0-9]+)?"
_U = r'MM|INCHES\b|INCH\b|IN\b|"'
_S = rf"(?:DN|NB|NPS)?\s*({_N})\s*({_U})?"
_PAIR = rf'(?:DN|NB|NPS)?\s*({_N})\s*(MM|INCHES|INCH|IN|")?\s*[X×]\s*{_S}'
_SIZES = [
    (rf"(?:NOMINAL PIPE SIZE|NOMINAL SIZE|CONNECTION SIZE|OUTSIDE DIAMETER|\bSIZE|\bOD|\bDIA(?:METER)?)\s*:?\s*{_S}", "MM"),
    (rf"\b(?:DN|NB|NPS)\s*[-:]?\s*({_N})\s*({_U})?", "MM"),
    (rf"(?:^|[^0-9.])({_N})\s*()NB\b", "MM"),
    (rf'(?:^|[^0-9.])({_N})\s*(INCHES\b|INCH\b|IN\b|")', "IN"),
    (rf"(?:^|[^0-9.])({_N})\s*(MM)\b", "MM"),
]
_x = lambda p, i: f"regexp_extract(x, {_q(p)}, {i})"
_flat = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"
_none = lambda n: f"(regexp_full_match({n}, '[0.]*') OR regexp_full_match({n}, '.*/0+') OR regexp_full_match({n}, '0*/.*'))"


def _shown(n: str, u: str) -> str:
    return f"CASE WHEN {n} <> '' AND NOT {_none(_flat(n))} THEN {_flat(n)} || {u} END"


def _unit(u: str, fallback: str) -> str:
    return f"CASE WHEN {u} = '' THEN {_q(fallback)} WHEN {u} = 'MM' THEN 'MM' ELSE 'IN' END"


_pair_units = f"coalesce(nullif({_x(_PAIR, 2)}, ''), {_x(_PAIR, 4)})"
_SIZE = "coalesce(" + ", ".join([f"CASE WHEN {_shown(_x(_PAIR, 3), _q(''))} IS NOT NULL THEN {_shown(_x(_PAIR, 1), _unit(_pair_units, 'MM'))} END", *[_shown(_x(p, 1), _unit(_x(p, 2), u)) for p, u in _SIZES]]) + ")"
_SCH = r"\bSCH(?:EDULE)?(?:\s*RATING)?\s*[-:]?\s*(XXS\b|XS\b|STD\b|[0-9]{1,3}(?:\s*S)?\b)"
_ANGLE = r"(?:^|[^0-9.])([0-9]{1,3}(?:\.[0-9]+)?)\s*(?:DEG(?:REE)?S?|°)"
_FACE = r"(?:FACE[ -]?TO[ -]?FACE|\bFF)\s*[:=-]?\s*([0-9]+(?:\.[0-9]+)?)\s*MM\b"
_PN, _BAR, _PSI = r"\bPN\s*[-:]?\s*([0-9]+(?:\.[0-9]+)?)\b", r"([0-9]+(?:\.[0-9]+)?)\s*BAR\b", r"\b([0-9]+(?:\.[0-9]+)?)\s*PSI\b"
_CL = r"(?:\b(?:CLASS|CL)\s*[-:]?\s*([0-9]+)\b|(?:^|[^0-9.])(?:[0-9]+\s*/\s*)?([0-9]+)\s*(?:LBS?\b|#))"
_num = lambda c: f"regexp_replace(regexp_replace({c}, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"
_STD = r"\b(?:" + "|".join(f"(?:{'|'.join(n)}){r}" for n, r in STANDARDS.items()) + r")\b"
_class_value = f"coalesce(nullif({_x(_CL, 1)}, ''), {_x(_CL, 2)})"
_PRESSURE = f"""CASE WHEN {_x(_PN, 1)} <> '' AND {_x(_PN, 1)}::DOUBLE <= 2500 THEN 'PN' || {_num(_x(_PN, 1))} WHEN {_class_value} <> '' AND {_class_value}::BIGINT <= 2500 THEN 'CLASS ' || {_class_value}::BIGINT
  WHEN {_x(_BAR, 1)} <> '' THEN {_num(_x(_BAR, 1))} || ' BAR' WHEN {_x(_PSI, 1)} <> '' THEN {_num(_x(_PSI, 1))} || ' PSI' END"""


def _has(term: str) -> str:
    return f"list_contains(words, {_q(term)})" if term.isalnum() else f"regexp_matches(y, {_q('(?:^|[^A-Z0-9])' + '[ -]*'.join(term.split()) + '(?:$|[^A-Z0-9])')})"


_first = lambda terms: "CASE " + " ".join(f"WHEN {_has(t)} THEN {_q(t)}" for t in terms) + " END"
_all = lambda terms: "list_filter([" + ", ".join(f"CASE WHEN {_has(t)} THEN {_q(t)} END" for t in terms) + "], lambda e: e IS NOT NULL)"
_CLEAN = _UNESCAPE.format(x="upper(coalesce(class_name, '') || ' ' || concat_ws(chr(10), short_description, long_description))")
for _sign, _written in vocab.FRACTIONS.items():
    _CLEAN = f"replace(regexp_replace({_CLEAN}, '([0-9]){_sign}', '\\1-{_written}', 'g'), '{_sign}', '{_written}')"
PARSE = f"""{_WITH_MAP}, r0 AS (SELECT id, class_name, concat_ws(chr(10), short_description, long_description) AS v, trim(regexp_replace(replace(replace(replace({_CLEAN}, chr(160), ' '), '–', '-'), '—', '-'), '\\s+', ' ', 'g')) AS x FROM materials),
r1 AS (SELECT id, class_name, v, trim(regexp_replace(x, ' ?([,;:]) ?', '\\1 ', 'g')) AS x FROM r0),
r2 AS (SELECT id, class_name, v, regexp_replace(regexp_replace(x, '([A-Z0-9])({_LABEL_RE})(\\s*:)', '\\1 \\2\\3', 'g'), '(^| )FACE ?TO ?FACE(\\s*:)', '\\1FACE TO FACE\\2', 'g') AS x FROM r1),
r3 AS (SELECT id, class_name, v, regexp_replace(regexp_replace(regexp_replace(x, '([0-9])\\s*MM([A-Z])', '\\1MM \\2', 'g'), '([0-9])\\s*IN(OD|ID)', '\\1IN \\2', 'g'), '([0-9])\\s*(BAR|PSI)([A-Z])', '\\1\\2 \\3', 'g') AS x FROM r2),
r4 AS (SELECT r3.*, m.t, {_expand('v')} AS ev, {_expand('class_name')} AS ec, x || ' ' || {_expand('x')} AS y FROM r3, m),
r AS (SELECT *, regexp_extract_all(y, '[A-Z0-9]+') AS words FROM r4)
SELECT id, coalesce({_type('ev')}, {_type('ec')}) AS "itemType", array_to_string({_all(sorted(vocab.FALLBACK_SUBTYPES, key=len, reverse=True))}[1:8], ',') AS subtypes, {_SIZE} AS "sizeDisplay",
  CASE WHEN {_x(_SCH, 1)} <> '' THEN 'SCH ' || {_flat(_x(_SCH, 1))} END AS schedule, CASE WHEN {_x(_ANGLE, 1)} <> '' AND {_x(_ANGLE, 1)}::DOUBLE BETWEEN 1e-9 AND 360 THEN {_x(_ANGLE, 1)}::DOUBLE END AS "angleDeg",
  {_PRESSURE} AS "pressureClass", {_first(vocab.CONNECTIONS)} AS connection, nullif({_x(_FACE, 1)}, '')::DOUBLE AS "faceToFaceMm",
  array_to_string({_distinct(f"list_transform(regexp_extract_all(x, {_q(_STD)}), lambda w: regexp_replace(w, '\\s+', ' ', 'g'))")}, ',') AS standards, {_first(vocab.ACTUATIONS)} AS actuation FROM r"""

_six = lambda c: f"floor({c} * 1e6 + 0.5001) / 1e6"
_ASKED = f"numbers AS (SELECT unnest([sap_no, corporate_no]) AS query_text FROM b0), asked AS (SELECT query_text FROM numbers UNION SELECT right(query_text, 4) FROM numbers), q AS (SELECT query_text, {_code('query_text')} AS code FROM asked)"
SQL = {
    "code_lookup": f"WITH b0 AS (SELECT id, trim(coalesce(sap_no, '')) AS sap_no, coalesce(corporate_no, '') AS corporate_no FROM materials WHERE upload_id IN ({CURRENT})), {_ASKED} SELECT query_text, id FROM q JOIN b0 b ON contains(b.sap_no, q.code) OR contains(upper(b.corporate_no), q.code) WHERE q.code <> '' QUALIFY row_number() OVER (PARTITION BY query_text ORDER BY id) <= 100",
    "attr_lookup": f"{BASE}{RECORDS} {ATTRIBUTE} {_top(360, '')}",
    "lexical_topk": f"{BASE}{TEXTS} {LEXICAL} {_top(20, 'raw_lexical DESC, ')}",
    "trigram_topk": f"{BASE}{TEXTS} {TRIGRAM} {_top(20, 'fuzzy_score DESC, ')}",
    "arm_union": f"{POOL} SELECT * FROM arms",
    "candidates_top": f"{CANDIDATES} SELECT query_id, id, {_six('final_score')} AS final_score, exact_match, plants FROM cand JOIN plants USING (corporate_no, sap_no)",
    "engineering_score": f"{CANDIDATES} SELECT query_id, id, {_six('eng')} AS score FROM cand",
    "shortlist": f"{SHORTLIST} SELECT query_id, id, position, {_six('shortlist_score')} AS shortlist_score FROM short",
    "search_records": RANKED,
    "parse_rules": PARSE,
}

"""Controlled vocabularies and the text functions built on them, as Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations of the catalog dialect and what they stand for.
ABBREVIATIONS = {
    "ELBW": "ELBOW", "ELB": "ELBOW", "FLNG": "FLANGE", "FLG": "FLANGE", "REDCR": "REDUCER", "RDCR": "REDUCER",
    "NPLE": "NIPPLE", "NPPL": "NIPPLE", "NIPL": "NIPPLE", "CLMP": "CLAMP", "SCKT": "SOCKET", "SKT": "SOCKET",
    "CPLG": "COUPLING", "CPLR": "COUPLER", "ADPTR": "ADAPTOR", "ADPTER": "ADAPTOR", "ADAPTER": "ADAPTOR",
    "FTNG": "FITTING", "FTG": "FITTING", "GSKT": "GASKET", "FRRL": "FERRULE", "NOZL": "NOZZLE", "NZL": "NOZZLE",
    "STRNR": "STRAINER", "VLV": "VALVE", "TBE": "TUBE", "RNG": "RING", "JNT": "JOINT", "BLW": "BELLOW",
    "CONECTOR": "CONNECTOR", "CONNECTO": "CONNECTOR", "CONNECT": "CONNECTOR", "STUBEND": "STUB END",
    "WELDOLET": "WELDOLET", "SDLE": "SADDLE", "PLG": "PLUG", "BSH": "BUSH", "CPL": "COUPLING",
    "BTRFLY": "BUTTERFLY", "CNCNTRC": "CONCENTRIC", "CONC": "CONCENTRIC", "ECCNTRC": "ECCENTRIC",
    "ECC": "ECCENTRIC", "EQL": "EQUAL", "UNEQL": "UNEQUAL", "RDCNG": "REDUCING", "STRGHT": "STRAIGHT",
    "STRT": "STRAIGHT", "HEX": "HEXAGON", "HEXA": "HEXAGON", "SLP": "SLIP", "RSD": "RAISED", "BLND": "BLIND",
    "SPRL": "SPIRAL", "WND": "WOUND", "BVL": "BEVEL", "INSULTNG": "INSULATING", "INSLTD": "INSULATED",
    "HVY": "HEAVY", "LNG": "LONG", "LG": "LONG", "SHRT": "SHORT", "FEM": "FEMALE", "ML": "MALE",
    "HD": "HEAVY DUTY", "LR": "LONG RADIUS", "SR": "SHORT RADIUS", "MITER": "MITRE",
    "BW": "BUTT WELD", "SW": "SOCKET WELD", "WLD": "WELD", "WLDD": "WELDED", "THRD": "THREADED",
    "THRDD": "THREADED", "THD": "THREADED", "SORF": "SLIP ON RAISED FACE", "WNRF": "WELD NECK RAISED FACE",
    "SOFF": "SLIP ON FLAT FACE", "WN": "WELD NECK", "FBSP": "FEMALE BSP", "MBSP": "MALE BSP",
    "FNPT": "FEMALE NPT", "MNPT": "MALE NPT", "FBSPP": "FEMALE BSPP", "MBSPP": "MALE BSPP",
    "CS": "CARBON STEEL", "SS": "STAINLESS STEEL", "MS": "MILD STEEL", "STL": "STEEL", "GI": "GALVANISED IRON",
    "CU": "COPPER", "AL": "ALUMINIUM", "PP": "POLYPROPYLENE", "PE": "POLYETHYLENE", "BRS": "BRASS",
    "MTLC": "METALLIC", "NONMTLC": "NONMETALLIC", "DI": "DUCTILE IRON", "CI": "CAST IRON",
    "SMLS": "SEAMLESS", "SML": "SEAMLESS", "SEMLS": "SEAMLESS", "SEAMLE": "SEAMLESS", "STD": "STANDARD",
    "DEG": "DEGREE", "DIA": "DIAMETER", "THK": "THICKNESS", "DRG": "DRAWING", "PERDRG": "PER DRAWING",
    "HYD": "HYDRAULIC", "PNMTC": "PNEUMATIC", "OD": "OUTSIDE DIAMETER", "ID": "INSIDE DIAMETER",
}
# Item types; the specific ones go before the generic ones.
SPECIFIC_TYPES = [
    "EXPANSION JOINT", "FLEXIBLE JOINT", "SIGHT GLASS", "STUB END", "ELBOW", "FLANGE", "REDUCER", "NIPPLE", "CLAMP", "SOCKET",
    "COUPLING", "COUPLER", "TEE", "UNION", "ADAPTOR", "CONNECTOR", "CAP", "PLUG", "BUSH", "BEND", "CROSS", "VALVE", "GASKET",
    "BOLT", "STUD", "NUT", "WASHER", "STRAINER", "HOSE", "NOZZLE", "SLEEVE", "SPOOL", "OLET", "WELDOLET", "FERRULE", "SPACER",
    "SADDLE", "BELLOW", "RING", "PLATE", "SEAL", "FILTER", "SPRINKLER", "SPRAY", "DUCT", "GEARBOX", "DAMPER", "CABLE", "BEARING",
    "MOTOR", "PUMP", "ACTUATOR", "TRANSFORMER", "UNIT",
]
GENERIC_TYPES = ["JOINT", "PIPE", "TUBE", "FITTING"]
ITEM_TYPES = SPECIFIC_TYPES + GENERIC_TYPES
# Item types that answer for each other (not transitive across groups).
RELATED_TYPES = [
    ["ELBOW", "BEND"],
    ["ADAPTOR", "CONNECTOR", "COUPLER", "COUPLING"],
    ["REDUCER", "BUSH"],
    ["SOCKET", "COUPLING"],
    ["NIPPLE", "PLUG"],
    ["PIPE", "TUBE"],
    ["FITTING", "PIPE", "TUBE"],
    ["GASKET", "SEAL", "RING"],
    ["STUB END", "SPOOL"],
    ["EXPANSION JOINT", "FLEXIBLE JOINT", "BELLOW"],
]
# End connections, drives and materials, in order of precedence.
CONNECTIONS = ["DOUBLE FLANGED", "FLANGED", "FLANGE", "WAFER", "LUG", "THREADED", "SCREWED", "SOCKET WELD", "BUTT WELD", "SLIP ON", "WELD NECK", "BSPP", "BSPT", "BSP", "NPT", "RTJ", "RF"]
ACTUATIONS = ["ELECTRIC", "PNEUMATIC", "HYDRAULIC", "MANUAL", "LEVER", "GEAR OPERATED", "GEARBOX", "AUTOMATIC", "PILOT OPERATED"]
MATERIALS = [
    "CF8M", "CF8", "SS 316L", "SS316L", "SS 316", "SS316", "SS 304", "SS304", "STAINLESS STEEL", "SS", "CARBON STEEL", "MILD STEEL",
    "DUCTILE IRON", "NODULAR CI", "CAST IRON", "GALVANISED IRON", "COPPER", "ALUMINIUM", "POLYPROPYLENE", "POLYETHYLENE", "HDPE",
    "GRP", "CI", "DI", "EPDM", "NBR", "PTFE", "PFA", "VITON", "FKM", "BRONZE", "BRASS", "WCB", "WC6", "WPB", "CS", "PVC", "CPVC",
]
# Subtypes that hold without a corpus.
FALLBACK_SUBTYPES = [
    "BUTTERFLY", "SOLENOID", "CHECK", "CONTROL", "RELIEF", "BALL", "GATE", "GLOBE", "NEEDLE", "PLUG", "DIAPHRAGM", "KNIFE GATE",
    "NON RETURN", "REDUCING", "CONCENTRIC", "ECCENTRIC", "EQUAL", "UNEQUAL", "SLIP ON", "WELD NECK", "BLIND", "SEAMLESS",
    "HEXAGON", "LONG RADIUS", "SHORT RADIUS", "MALE", "FEMALE", "STRAIGHT", "MITRE", "HEAVY DUTY",
]
# Words that are never a subtype, besides all words of the lists above.
STOPWORDS = [
    "AND", "FOR", "TYPE", "WITH", "PER", "THE", "NOS", "NOT", "USE", "SET", "ASS", "GEN", "MISC", "MISCELLANEOUS", "OTHER", "OTHERS", "GENERIC",
    "MATERIAL", "MATERIALS", "ITEM", "STANDARD", "DRAWING", "MAKE", "SIZE", "CLASS", "GRADE", "LENGTH", "DEGREE", "DIAMETER", "THICKNESS", "OUTSIDE",
    "INSIDE", "WALL", "SCHEDULE", "RATING", "SPARE", "SPARES", "REPAIR", "KIT", "KITS", "ASSEMBLY", "ASSEMBLIES", "INFORMATION", "ADDITIONAL",
    "SPECIFICATION", "PROCESS", "MANUFACTURING", "SURFACE", "TREATMENT", "CONNECTION", "PRESSURE", "NOMINAL", "MM", "CM", "IN", "INCH", "INCHES",
    "DN", "NB", "NPS", "OD", "ID", "SCH", "DEG", "THK", "BAR", "PSI", "LB", "LBS", "CL", "PN", "KG", "MTR", "MTRS", "METER", "METRE", "NUMBER",
]

# Fractions that are one character.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}

TERM_LENGTHS = (3, 14)


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def related(item_type: str) -> list[str]:
    return sorted({t for g in RELATED_TYPES if item_type in g for t in g} | {item_type})


def unescape(c: Column) -> Column:
    """The catalog writes a character that it cannot store as <(>x<)>."""
    return F.regexp_replace(F.regexp_replace(c, r"<\(>(.)<\)>", "$1"), r"<\(>|<\)>", "")


def expand(c: Column) -> Column:
    """Upper case, every whole run of letters that is an abbreviation replaced; null becomes empty text."""
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    parts = F.regexp_extract_all(unescape(F.upper(F.coalesce(c, F.lit("")))), F.lit("[A-Z]+|[^A-Z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), "")


def search_tokens(*texts: Column) -> Column:
    """Distinct tokens of the texts as written and as expanded, in order."""
    original = unescape(F.upper(F.concat_ws(" ", *[F.nullif(t, F.lit("")) for t in texts])))
    both = F.concat(original, F.lit(" "), expand(original))
    return F.array_distinct(F.regexp_extract_all(both, F.lit("[A-Z0-9/.\"'\\-]+"), F.lit(0)))


def lexemes(tokens: Column) -> Column:
    """Tokens cut at punctuation (fractions stay whole), two characters or more; the same for queries and rows."""
    parts = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit("[0-9]+/[0-9]+|[A-Z0-9]+"), F.lit(0))))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1))


_TWO_WORDS = [t for t in ITEM_TYPES if " " in t]


def item_type_of(expanded: Column) -> Column:
    """The first specific type among the words of an expanded text, else the first generic one, else null."""
    joined = expanded
    for t in _TWO_WORDS:
        joined = F.regexp_replace(joined, rf"(?<![A-Z]){t}(?![A-Z])", t.replace(" ", "_"))
    words = F.regexp_extract_all(joined, F.lit("[A-Z_]+"), F.lit(0))

    def first(types: list[str]) -> Column:
        wanted = strings([t.replace(" ", "_") for t in types])
        return F.get(F.filter(words, lambda w: F.array_contains(wanted, w)), F.lit(0))

    return F.replace(F.coalesce(first(SPECIFIC_TYPES), first(GENERIC_TYPES)), F.lit("_"), F.lit(" "))


def derive_item_type(short: Column, long: Column | None = None, class_name: Column | None = None) -> Column:
    """From the short description, else the class, else the long description."""
    return F.coalesce(*[item_type_of(expand(c)) for c in (short, class_name, long) if c is not None])


def stopword_list() -> list[str]:
    listed = [*CONNECTIONS, *ACTUATIONS, *MATERIALS, *ITEM_TYPES]
    split = [w for t in (*CONNECTIONS, *MATERIALS) for w in t.split(" ")]
    return sorted({*STOPWORDS, *listed, *split})


def term_frequencies(descriptions: Column, df: DataFrame, least: int = 5, share: float = 0.25) -> DataFrame:
    """token, documents: terms in at least ``least`` descriptions and in no more than ``share`` of them (or ``least``).

    Blank descriptions do not count. The counts combine on the map side; what is left is the vocabulary.
    """
    docs = df.select(descriptions.alias("d")).where("trim(d) <> ''")
    words = F.array_distinct(F.regexp_extract_all(expand(F.col("d")), F.lit("[A-Z]+"), F.lit(0)))
    low, high = TERM_LENGTHS
    terms = docs.select(F.explode(words).alias("token")).where((F.length("token") >= low) & (F.length("token") <= high) & ~F.col("token").isin(stopword_list()))
    counts = terms.groupBy("token").agg(F.count(F.lit(1)).alias("documents"))
    total = docs.agg(F.count(F.lit(1))).scalar()
    return counts.where((F.col("documents") >= least) & (F.col("documents") <= F.greatest(F.lit(float(least)), total * share)))


def subtype_vocabulary(descriptions: Column, df: DataFrame, most: int = 20_000, **kw) -> list[str]:
    """Fallback subtypes and mined terms; a ValueError beyond ``most`` terms, since they go into every parse task."""
    rows = term_frequencies(descriptions, df, **kw).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} subtype terms")
    return list(dict.fromkeys([*FALLBACK_SUBTYPES, *sorted(r.token for r in rows)]))


def unescape_py(text: str) -> str:
    return re.sub(r"<\(>|<\)>", "", re.sub(r"<\(>(.)<\)>", r"\1", text)) if "<" in text else text


def expand_py(text: str) -> str:
    """``expand`` for one string, where a Python parser needs it."""
    return re.sub("[A-Z]+", lambda m: ABBREVIATIONS.get(m[0], m[0]), unescape_py(text.upper()))


_TYPE = re.compile(rf"(?<![A-Z])(?:{'|'.join(sorted(ITEM_TYPES, key=len, reverse=True))})(?![A-Z])")


def item_type_py(text: str) -> str | None:
    """``item_type_of`` for one string."""
    found = [m[0] for m in _TYPE.finditer(text)]
    return next((t for t in found if t not in GENERIC_TYPES), found[0] if found else None)


def canonical_item_type(value: str | None) -> str | None:
    """The item type that a value is or begins with; null for null, empty text and values without one."""
    return item_type_py(expand_py(value).strip()) if value else None


def is_generic_item_type(value: str | None) -> bool:
    """Whether the value is one of the types that only stand in for a specific one."""
    return (value or "").upper() in GENERIC_TYPES

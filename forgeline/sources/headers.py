"""Header resolution: which column of a delivered file is which field."""

from __future__ import annotations

import re

# Logical fields and the headers under which they come.
FIELDS = {
    "corporate_no": ["CORPORATE NO", "CORPORATE NUMBER", "CORP NO", "CORPORATE CODE"],
    "sap_no": ["SAP NO", "SAP NUMBER", "SAP CODE", "MATERIAL NUMBER", "MATERIAL NO", "MATERIAL CODE", "MATNR"],
    "plant": ["PLANT", "PLANT CODE", "WERKS"],
    "class_name": ["CLASS", "CLASS NAME", "ITEM CLASS", "ITEM CATEGORY"],
    "short_description": ["SHORT DESCRIPTION", "MATERIAL DESCRIPTION", "SHORT TEXT", "MATERIAL SHORT TEXT", "MAKTX"],
    "long_description": ["LONG DESCRIPTION", "MATERIAL TEXT", "LONG TEXT", "PO TEXT", "BASIC DATA TEXT", "ITEM TEXT"],
    "uom": ["UOM", "UNIT OF MEASUREMENT", "UNIT OF MEASURE", "BASE UNIT OF MEASURE", "MEINS"],
    "material_type": ["MATERIAL TYPE", "MTART"],
    "material_group": ["MATERIAL GROUP", "MATL GROUP", "MATKL"],
    "material_group_description": ["MATERIAL GROUP DESCRIPTION", "MATERIAL GROUP DESC", "GROUP DESCRIPTION", "COMMODITY GROUP"],
    "unspsc": ["UNSPSC", "UNSPSC CODE"],
    "status": ["STATUS", "MATERIAL STATUS", "PLANT SPECIFIC MATERIAL STATUS", "CROSS PLANT STATUS", "MSTAE"],
    "status_description": ["STATUS DESCRIPTION", "STATUS DESC"],
    "item_type_source": ["ITEM TYPE", "ITEM TYPE SOURCE"],
}
# Headers that mean the first of these fields that no other header has taken.
AMBIGUOUS = {"DESCRIPTION": ["short_description", "material_group_description"], "TEXT": ["long_description"]}
# Words of the header of a list of searches, in order of preference.
SEARCH_HEADERS = ["specification", "spec", "description", "query", "item", "material"]


def clean(header: str) -> str:
    return re.sub(r"\s+", " ", (header or "").lstrip("﻿")).strip()


def key(header: str) -> str:
    return " ".join(re.sub(r"[^A-Z0-9 ]", "", re.sub(r"[._\-\s]+", " ", clean(header).upper())).split())


def resolve(headers: list[str]) -> dict[str, str]:
    """Field -> header as written; the first header of a field wins, ambiguous ones come after all others."""
    by_key = {key(a): f for f, names in FIELDS.items() for a in names}
    out: dict[str, str] = {}
    for h in headers:
        if f := by_key.get(key(h)):
            out.setdefault(f, clean(h))
    for h in headers:
        free = [f for f in AMBIGUOUS.get(key(h), []) if f not in out]
        if free:
            out[free[0]] = clean(h)
    return out


# Of each group a file needs one column; what to call the group, and an example of a header.
NEEDED = {"code": (["sap_no", "corporate_no"], "Material Number"), "description": (["short_description", "long_description"], "Short Description")}


def validated(headers: list[str]) -> tuple[dict[str, str], list[str]]:
    """The resolved columns and warnings; a ValueError names every group of which no column was found."""
    found = resolve(headers)
    lacking = [f"no material {what} column, e.g. {example!r}" for what, (fields, example) in NEEDED.items() if not any(f in found for f in fields)]
    if lacking:
        raise ValueError("; ".join([*lacking, f"found: {', '.join(filter(None, headers)) or 'nothing'}"]))
    return found, [] if "corporate_no" in found else ["rows have no corporate number"]


def search_column(headers: list[str]) -> str | None:
    return next((h for w in SEARCH_HEADERS for h in headers if w in h.lower()), None)

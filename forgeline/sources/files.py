"""Spreadsheet and CSV files as records: row number and a map of header to cell text."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forgeline.sources import headers as H

MAX_ROWS = 100_000
MAX_ITEMS = 200
RECORDS = T.StructType([T.StructField("row_no", T.LongType()), T.StructField("raw_data", T.MapType(T.StringType(), T.StringType()))])
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_MAIN = "{%s}" % _NS["m"]


def cell_text(value: str, squeeze: bool = True) -> str:
    """Escapes of the source system undone; runs of blanks squeezed (line breaks stay, they part labels)."""
    v = re.sub(r"<\(>|<\)>", "", re.sub(r"<\(>(.)<\)>", r"\1", value or ""))
    return (re.sub(r"[ \t]+", " ", v) if squeeze else v).strip()


def sheet_rows(data: bytes) -> tuple[str, int, Iterator[list[str]]]:
    """Name of the first sheet, number of sheets, and its rows as lists of text; reads the XML as a stream."""
    z = zipfile.ZipFile(io.BytesIO(data))
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    sheets = book.findall("m:sheets/m:sheet", _NS)
    if not sheets:
        raise ValueError("the workbook has no sheet")
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    target = rels[sheets[0].get("{%s}id" % _NS["r"])].lstrip("/")
    path = target if target.startswith("xl/") else "xl/" + target
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
            if e.tag == _MAIN + "si":
                shared.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                e.clear()

    def rows() -> Iterator[list[str]]:
        for _, e in ElementTree.iterparse(z.open(path)):
            if e.tag != _MAIN + "row":
                continue
            out: list[str] = []
            for c in e.iter(_MAIN + "c"):
                letters = re.match("[A-Z]+", c.get("r") or "")
                at = len(out)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                out += [""] * (at + 1 - len(out))
                v, kind = c.find("m:v", _NS), c.get("t")
                if kind == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                elif v is not None and v.text is not None:
                    out[at] = shared[int(v.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if kind == "b" else v.text
            e.clear()
            yield out

    return sheets[0].get("name"), len(sheets), rows()


def xlsx_records(data: bytes, most: int | None = MAX_ROWS) -> tuple[str, list[str], list[str], Iterator[dict[str, str]]]:
    """Sheet name, headers, warnings, records. Blank headers go, of equal ones the later column counts, empty rows go."""
    name, count, rows = sheet_rows(data)
    heads = [H.clean(h) for h in next(rows, [])]

    def records() -> Iterator[dict[str, str]]:
        n = 0
        for row in rows:
            rec = {h: cell_text(row[i] if i < len(row) else "") for i, h in enumerate(heads) if h}
            if any(rec.values()):
                n += 1
                if most is not None and n > most:
                    raise ValueError(f"the sheet has more than {most} rows")
                yield rec

    return name, [h for h in heads if h], ["only the first sheet is read"] if count > 1 else [], records()


def read_xlsx(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Records of all workbooks under ``path``, one task per file: binaryFile and a parser on the workers."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for content in p["content"]:
                batch, n = [], 0
                for n, rec in enumerate(xlsx_records(bytes(content), most)[3], 1):
                    batch.append((n, rec))
                    if len(batch) == 5000:
                        yield pd.DataFrame(batch, columns=["row_no", "raw_data"])
                        batch = []
                if batch:
                    yield pd.DataFrame(batch, columns=["row_no", "raw_data"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORDS)


def sniff(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Records of a UTF-8 file with a header, and the headers; the delimiter is found in its first lines."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
    df = spark.read.csv(path, header=True, sep=sniff(head), multiLine=True, quote='"', escape='"', mode="FAILFAST", encoding="UTF-8")
    cols = [(c, H.clean(c)) for c in df.columns]
    cells = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"<\(>(.)<\)>", "$1"), r"<\(>|<\)>", ""))
    last = {clean: raw for raw, clean in cols if clean and not re.fullmatch(r"_c\d+", clean)}
    rec = F.map_from_arrays(F.array(*[F.lit(k) for k in last]), F.array(*[cells(raw) for raw in last.values()]))
    rows = df.select(F.monotonically_increasing_id().alias("row_no"), rec.alias("raw_data")).where(F.exists(F.map_values("raw_data"), lambda v: v != ""))
    return rows, list(last)


def read_material_file(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str], list[str], str]:
    """Records, resolved columns, warnings and sheet name of an .xlsx or .csv file."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "csv":
        rows, heads = read_csv(spark, path)
        return rows, *H.validated(heads), "CSV"
    if kind != "xlsx":
        raise ValueError("only .xlsx and .csv files are supported")
    first = spark.read.format("binaryFile").load(path).select("content").first()
    name, heads, warnings, _ = xlsx_records(bytes(first.content))
    columns, more = H.validated(heads)
    return read_xlsx(spark, path, MAX_ROWS), columns, warnings + more, name


def read_search_items(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query_text: the first 200 items of three characters or more of a list, in order.

    The column is chosen by its header; without a fitting one all cells of a row are joined.
    """
    if path.lower().endswith(".csv"):
        rows, heads = read_csv(spark, path)
    elif path.lower().endswith(".xlsx"):
        rows = read_xlsx(spark, path, MAX_ROWS)
        heads = xlsx_records(bytes(spark.read.format("binaryFile").load(path).first().content))[1]
    else:
        raise ValueError("only .xlsx and .csv files are supported")
    h = H.search_column(heads)
    item = F.col("raw_data")[h] if h else F.concat_ws(", ", *[F.nullif(F.col("raw_data")[x], F.lit("")) for x in heads])
    return rows.select(F.col("row_no").alias("query_id"), F.trim(item).alias("query_text")).where("length(query_text) >= 3").orderBy("query_id").limit(MAX_ITEMS)

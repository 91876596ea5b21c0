"""Search results as flat tables, split into files, and as a workbook."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES_PER_FILE = 50


def summary(matches: DataFrame, *extra: str) -> DataFrame:
    """One row per match, fourteen columns, and the ``extra`` ones."""
    pct = lambda c: F.concat(F.col(c).cast("string"), F.lit("%"))
    return matches.select(
        F.col("query_text").alias("Query"), F.col("rank").alias("Rank"), pct("confidence").alias("Confidence"), F.col("corporate_no").alias("Corporate No"),
        F.col("sap_no").alias("SAP No"), F.array_join("plants", ", ").alias("Plants"), F.col("class_name").alias("Class"),
        F.col("short_description").alias("Short Description"), F.col("status").alias("Status"),
        F.when(F.col("blocked"), "Blocked for procurement").otherwise("Available").alias("Availability"),
        F.when(F.col("exact_match"), "Exact").otherwise("Similar").alias("Match type"), pct("parametric_score").alias("Parametric Score"),
        pct("semantic_score").alias("Semantic Score"), F.array_join("mismatches", " | ").alias("Differences"), *extra,
    )


def details(matches: DataFrame) -> DataFrame:
    """One row per compared attribute, seven columns."""
    c = matches.select("query_text", "rank", "sap_no", F.explode("comparisons").alias("c"))
    return c.select(F.col("query_text").alias("Query"), F.col("rank").alias("Rank"), F.col("sap_no").alias("SAP No"), F.col("c.label").alias("Attribute"), F.col("c.query").alias("Query value"), F.col("c.candidate").alias("Candidate"), F.col("c.state").alias("Result"))


def write_parts(matches: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per 50 queries, in the order of query_id."""
    # only the list of queries, not their matches, is numbered in one place
    numbered = matches.select("query_id").distinct().withColumn("part", F.floor((F.row_number().over(W.orderBy("query_id")) - 1) / QUERIES_PER_FILE))
    summary(matches.join(numbered, "query_id"), "part").write.mode("errorifexists").partitionBy("part").option("header", True).format(fmt).save(path)


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]], path: str, titles: dict[str, tuple[str, str]] | None = None) -> None:
    """A minimal .xlsx: sheets of text cells with a frozen bold header; for results of one request, on the driver.

    ``titles``: sheet -> (name, text) of a row above its header, the text over all columns but the first.
    """
    titles = titles or {}

    def letters(i: int) -> str:
        s = ""
        while i >= 0:
            s, i = chr(65 + i % 26) + s, i // 26 - 1
        return s

    def sheet(head: list[str], rows: list[tuple], title: tuple[str, str] | None) -> str:
        lines, top = [], 2 if title else 1
        for r, row in enumerate([*([title] if title else []), head, *rows], 1):
            cells = "".join(f'<c r="{letters(i)}{r}" t="inlineStr"{" s=\"1\"" if r == top else ""}><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>' for i, v in enumerate(row))
            lines.append(f'<row r="{r}">{cells}</row>')
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="%d" topLeftCell="A%d" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' % (top, top + 1)
        merged = f'<mergeCells count="1"><mergeCell ref="B1:{letters(len(head) - 1)}1"/></mergeCells>' if title and len(head) > 2 else ""
        return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{pane}<sheetData>{"".join(lines)}</sheetData>{merged}</worksheet>'

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    n = len(sheets)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>' + f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (name, (head, rows)) in enumerate(sheets.items(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", sheet(head, rows, titles.get(name)))

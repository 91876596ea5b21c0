import pytest
from pyspark.sql import functions as F

from forgeline.api import Engine, bands, clamp_limit
from forgeline.sources import export, files
from forgeline.sources.records import recordset

HEAD = ["Corporate No", "SAP No", "Plant", "Class", "Short Description", "Long Description", "Status", "Created Date"]
ROWS = [
    ("M1", "20000001", "8501", "VALVE, BALL", "VLV BALL;DN50,PN10,FLANGED,CS", "", "B2-ERP ACCEPTED", "01-02-2015"),
    ("M1", "20000001", "8502", "VALVE, BALL", "VLV BALL;DN50,PN10,FLANGED,CS", "", "Blocked for Procurement", "01-02-2016"),
    ("M2", "20000002", "8501", "FLANGE", "FLNG PIPE;SLP-ON,DN40,CS,CL 150", "", "B2-ERP ACCEPTED", "bad"),
    ("M3", "NIR-0001", "", "PIPE", "PIPE MTLC;4IN,SCH 40,CS", "", "C2-RFC CREATED", ""),
    ("M4", "20000004", "8501", "PIPE", "PIPE MTLC;6IN,SCH 40,CS", "", "A0-DELETED", ""),
]


def test_engine(spark, tmp_path):
    x = str(tmp_path / "m.xlsx")
    export.workbook({"Data": (HEAD, ROWS)}, x)
    e = Engine(spark, str(tmp_path / "cat"))
    assert e.stats()["total"] == 0
    with pytest.raises(LookupError):
        e.rows()
    s = e.ingest(x)
    assert (s["imported"], s["row_count"], s["active_count"], s["imported_unique"]) == (5, 5, 4, 4) and e.stats()["total"] == 5
    m = e.search(["slip on flange DN40 carbon steel", "20000001", " 20000001 "], 3).persist()
    first = {r.query_text: r for r in m.where("rank = 1").collect()}
    assert first["slip on flange DN40 carbon steel"].sap_no == "20000002"
    assert first["20000001"].exact_match and first["20000001"].plants == ["8501", "8502"] and not first["20000001"].blocked
    out = str(tmp_path / "out.xlsx")
    e.export(m, out)
    name, heads, _, rows = files.xlsx_records(open(out, "rb").read())
    assert name == "Matches" and len(heads) == 14 and len(list(rows)) == m.count()
    d = e.dashboard()
    assert d["summary"].first().total == 5 and d["years"].count() == 2 and d["insights"]
    r = e.evaluate(4, str(tmp_path / "report.txt"))
    assert r["empty"] == 0 and "mrr" in open(tmp_path / "report.txt").read()
    one = e.search(["slip on flange DN40"], 3)
    assert set(r.band for r in one.collect()) <= {"strong", "fair", "weak"}
    e.export(one, out)
    top = list(files.sheet_rows(open(out, "rb").read())[2])
    assert top[0][:2] == ["Search query", "slip on flange DN40"] and top[1][0] == "Query" and len(top[1]) == 14
    assert d["upload"]["file_name"] == "m.xlsx" and d["generated_at"] and d["class_quality"].first().active >= 0 and d["plant_health"].count() == 3 and d["years"].first().percentage == 50.0
    assert e.stats()["uploads"] == 1

    def extract(t):
        if "fail" in t:
            raise OSError("no answer")
        return {"sizeMm": 40.0, "materials": ["carbon steel"], "make": "x"} if "flange" in t else None

    def embed(t):
        raise OSError("no answer")

    got = e.respond(["flange in carbon steel", "please fail this"], 3, extract, embed)
    assert got["semantic_mode"] == "lexical" and len(got["warnings"]) == 4 and got["elapsed_ms"] >= 0
    best = got["matches"].where("query_id = 1 and rank = 1").first()
    assert best.sap_no == "20000002" and {c["key"] for c in best.comparisons} >= {"size", "materials", "make"}
    got = e.respond(["flange in carbon steel"], 3, None, lambda t: [1.0, 0.0])
    assert got["semantic_mode"] == "embeddings" and not got["warnings"]
    assert e.backfill_attributes() == 0
    e.backfill_vectors(lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert e.rows().where("status_active and embedding is null").count() == 0
    for bad in ([], ["ab"], ["x" * 2001], [f"query {i}" for i in range(51)]):
        with pytest.raises(ValueError):
            e.search(bad)
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "cat"), max_bytes=10).ingest(x)


def test_small_parts(spark):
    assert [clamp_limit(x) for x in (None, 1, 7, 99)] == [5, 3, 7, 10]
    df = spark.createDataFrame([(90.0,), (50.0,), (10.0,)], "s double").select(bands(F.col("s"), 75, 40).alias("b"))
    assert [r.b for r in df.collect()] == ["strong", "fair", "weak"]
    js = spark.createDataFrame([('[{"a":1,"b":"x"},{"a":2}]',), (None,), ("broken",), ("[]",)], "j string")
    assert sorted(map(tuple, recordset(js, "j", "a int, b string").collect()), key=lambda r: (r[0] is None, r[0] or 0))[:2] == [(1, "x"), (2, None)]

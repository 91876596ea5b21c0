from datetime import datetime

from conftest import rows
from forgeline.llm.truncation import broken_endings, cut_materials, cut_rates, length_limits

UP = "id string, source_system string, created_at timestamp, n int"
MAT = "id string, upload_id string, short_description string, long_description string, field string"
WORDS = ["STAINLESS", "BUTTERFLY", "FLANGED", "CARBON", "STEEL", "AL", "ALUMINIUM", "VALVE", "PN0", "BAR"]


def table(spark):
    base = []
    for i in range(300):
        w = [WORDS[(i * 7 + k * 3) % len(WORDS)] for k in range(2 + i % 4)]
        base.append((f"b{i}", "u", " ".join(w) + f",{i}MM", "MATERIAL : CARBON STEEL; MAKE: ACME; FINISH: POLISHED.", "x"))
    odd = [
        ("cut1", "u", "VALVE FLANGED STAINL", None, "x"), ("cut2", "u", "valve butterf...", "MATERIAL : CARBON STEEL; MAKE :", "x"), ("ok1", "u", "VALVE AL", "", "x"),
        ("ok2", "u", "VALVE ALUMINIUM", "MATERIAL : CARBON", "x"), ("cut3", "u", None, "MATERIAL : CARB", "x"), ("torn", "zz", "VALVE", "MAKE: ACME; FIN�", "x"), ("none", "u", "", None, "x"),
    ]
    return spark.createDataFrame(base + odd, MAT), spark.createDataFrame([("u", "A", datetime(2025, 1, 1), 1)], UP)


def test_endings(spark):
    m, u = table(spark)
    got = {r for r in rows(cut_materials(m, u)) if not r[0].startswith("b")}
    assert got == {("cut1", "short_description"), ("cut2", "short_description"), ("cut2", "long_description"), ("cut3", "long_description"), ("torn", "long_description")}
    rate = {(r.source_system, r.field): (r.texts, r.cut) for r in cut_rates(m, u).collect()}
    assert rate["", "long_description"] == (1, 1) and rate["A", "long_description"][1] == 2
    assert cut_materials(m.limit(0), u).count() == 0


def test_limits(spark):
    data = [("S", "t", "x" * n) for n in range(20, 70) for _ in range(min(40, 4 * (69 - n) + 1))]
    data = [(s, f, t[:-6] + f"{i:06}") for i, (s, f, t) in enumerate(data)]
    data += [("S", "t", f"{i:06}" + "y" * 34) for i in range(600)]
    df = spark.createDataFrame(data, "source_system string, field string, t string")
    assert rows(length_limits(df)) == [("S", "t", 40)]
    assert length_limits(df.limit(0)).count() == 0


def test_very_long_text(spark):
    m, u = table(spark)
    long = spark.createDataFrame([("big", "u", None, "CARBON STEEL " * 50_000 + "STAINL", "x")], MAT)
    assert ("big", "long_description") in rows(cut_materials(m.unionByName(long).unionByName(spark.createDataFrame([("w", "u", None, "MADE OF STAINLESS STEEL NOW.", "")], MAT)), u))


def test_vocabulary_strength(spark):
    df = spark.createDataFrame([("f", "A STEEL B")] * 20 + [("f", "A STE")] * 3 + [("f", "A STEEL")] * 3, "field string, t string")
    assert rows(broken_endings(df)) == [("f", " STE", 2)]


def test_limits_match_sql(spark):
    import duckdb

    from forgeline.llm.sql import P5_LIMITS
    from forgeline.llm.truncation import cut_lengths

    con, tables = duckdb.connect(), {}
    for t in ("materials", "material_uploads"):
        path = f"/root/testdata/sf0.01/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}'")
        tables[t] = spark.read.parquet(path)
    got = sorted(tuple(r) for r in cut_lengths(tables["materials"], tables["material_uploads"]).collect())
    assert got and got == sorted(con.sql(P5_LIMITS).fetchall())

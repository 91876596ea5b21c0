import itertools
import random
from datetime import datetime

from conftest import rows
from forgeline.llm.survivors import best_records, surviving_materials

UP = "id string, source_system string, created_at timestamp"
MAT = "id string, upload_id string, sap_no string, plant string, status string, updated_at timestamp, __rank string"


def test_materials(spark):
    up = spark.createDataFrame([("old", "A", datetime(2025, 1, 1)), ("a", "A", datetime(2025, 2, 1)), ("b", "B", datetime(2025, 1, 1))], UP)
    t = datetime(2025, 1, 5)
    m = [
        ("1", "a", "0020", "", " b2-erp accepted ", t, ""), ("2", "b", "20 ", "P2", "B2-ERP ACCEPTED", None, ""), ("3", "a", "20", "P3", "A0-DELETED", t, ""),
        ("4", "old", "20", "P9", "B2-ERP ACCEPTED", datetime(2026, 1, 1), ""), ("5", "a", "30", "P1", None, t, ""), ("6", "a", None, "P1", "x", t, ""), ("7", "b", "000", "P1", "x", t, ""),
        ("8", "a", "nir-1", None, "Blocked", t, ""), ("9", "b", "NIR-1", " ", "Blocked", t, ""), ("10", "b", "NIR-1", None, "C2-RFD STAGED", t, ""),
    ]
    assert rows(surviving_materials(spark.createDataFrame(m, MAT), up)) == [("20", "1", "P2"), ("NIR-1", "8", "")]
    assert surviving_materials(spark.createDataFrame([], MAT), up).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6]), f"{i:03}", rng.choice([None, "", "x", "y"]), rng.choice([None, "", "u", "v"])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, r int, t int, id string, f string, g string")
    got = {x.k: (x.id, x.f, x.g) for x in best_records(df, ["k"], [("r", "asc"), ("t", "desc"), ("id", "asc")], ["id"], ["f", "g"]).collect()}
    for k, grp in itertools.groupby(sorted(data, key=lambda x: x[0]), key=lambda x: x[0]):
        o = sorted(grp, key=lambda x: (x[1] is None, x[1] or 0, x[2] is None, -(x[2] or 0), x[3]))
        assert got[k] == (o[0][3], next((x[4] for x in o if x[4]), ""), next((x[5] for x in o if x[5]), ""))


def test_hot_group_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("cast(id % 1 as string) as k", "cast(id as string) as id", "'' as p")
    best = best_records(df, ["k"], [("id", "asc")], ["id"], ["p"], 2)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    assert rows(best) == [("0", "0", "")]

from datetime import datetime

from conftest import rows
from forgeline.operators.snapshots import material_changes

UP = "id string, source_system string, created_at timestamp, change_kind string"
MAT = "id string, upload_id string, sap_no string, plant string, short_description string, seq int"


def uploads(spark):
    return spark.createDataFrame([("u1", "S", datetime(2025, 1, 1), ""), ("u2", "s ", datetime(2025, 2, 1), ""), ("u3", "S", datetime(2025, 3, 1), ""), ("x", None, None, "")], UP)


def test_changes(spark):
    m = [
        ("1", "u1", "00A1", "P", "Valve  big", 1), ("2", "u1", "A2", None, "Gone", 1), ("3", "u1", None, "P", "no code", 1),
        ("4", "u2", " a1 ", "P", "VALVE BIG", 1), ("5", "u2", "A3", "", "New", 1), ("6", "u2", "A3", None, "NEW ", 1),
        ("7", "u3", "A1", "P", "VALVE SMALL", 1), ("8", "u3", "A3", "", None, 1), ("9", "zz", "A9", "", "unknown upload", 1),
    ]
    got = rows(material_changes(spark.createDataFrame(m, MAT), uploads(spark)))
    assert got == [("u2", "A2", "", "removed"), ("u2", "A3", "", "added"), ("u3", "A1", "P", "changed"), ("u3", "A3", "", "changed")]


def test_empty_snapshot_and_tables(spark):
    m = spark.createDataFrame([("1", "u1", "A1", "P", "x", 1)], MAT)
    assert rows(material_changes(m, uploads(spark))) == [("u2", "A1", "P", "removed")]
    assert material_changes(spark.createDataFrame([], MAT), uploads(spark)).count() == 0
    assert material_changes(m, spark.createDataFrame([], UP)).count() == 0


def test_hot_key_of_repeated_rows(spark):
    m = [(str(i), "u1" if i % 2 else "u2", "A1", "P", "same  text" if i % 3 else "SAME TEXT", 1) for i in range(3000)]
    assert material_changes(spark.createDataFrame(m, MAT), uploads(spark)).where("upload_id = 'u2'").count() == 0

import json
from datetime import datetime

import pytest

from conftest import rows
from forgeline.operators.drift import Drift, Node, assign, edit_script, schema_changes, unified_table

UP = "id string, source_system string, created_at timestamp"
MAT = "id string, upload_id string, sap_no string, plant string, raw_data string, source_system string"


def tables(spark, *files):
    ups = spark.createDataFrame([(f"u{i}", "S", datetime(2025, i + 1, 1)) for i in range(len(files))], UP)
    mats = [(f"{i}-{j}", f"u{i}", str(j + 1), "P", r if isinstance(r, str) or r is None else json.dumps(r), "clash") for i, f in enumerate(files) for j, r in enumerate(f)]
    return spark.createDataFrame(mats, MAT), ups


def test_changes_and_unified(spark):
    a = [{"SAP No": str(i), "Unit Price": i + 0.5, "Bin": f"B{i}", "Old": "x"} for i in range(20)]
    b = [{"sap_no": str(i), "Unit Price": str(i + 0.5), "Storage  Bin": f"B{i}", "Flag": True} for i in range(20)] + [None, "broken {", "{}"]
    m, u = tables(spark, a, b)
    assert rows(schema_changes(m, u)) == [("u1", "FLAG", "added"), ("u1", "OLD", "removed"), ("u1", "STORAGE BIN", "renamed"), ("u1", "UNIT PRICE", "retyped")]
    t = unified_table(m, u)
    assert t.count() == 43 and {"storage_bin", "unit_price", "sap_no", "flag", "old"} <= set(t.columns)
    assert t.where("id = '0-3'").select("storage_bin", "unit_price", "flag").first() == ("B3", "3.5", None)


def test_renamed_with_another_notation(spark):
    a = [{"Part": f"{i:012d}", "Made": f"{i + 1:02d}-03-2015", "Price": f"{i}.50", "Spare": i % 9 == 0, "Tags": ["a", f"b{i}"], "Sum": f"{i + 1},000"} for i in range(25)]
    b = [{"No": str(i), "ERSDA": 20150300 + i + 1, "Cost": i + 0.5, "Critical": "Y" if i % 9 == 0 else "N", "Words": f"a; b{i}", "Total": (i + 1) * 1000} for i in range(25)]
    m, u = tables(spark, a, b)
    got = rows(schema_changes(m, u))
    assert [g for g in got if g[2] != "retyped"] == [("u1", f, "renamed") for f in ("COST", "CRITICAL", "ERSDA", "NO", "TOTAL", "WORDS")]
    assert {g[1] for g in got if g[2] == "retyped"} == {"COST", "CRITICAL", "ERSDA", "TOTAL", "WORDS"}


def test_nested_rename(spark):
    a = [{"Dim": {"Wall": i, "In": {"Q": f"x{i}"}}} for i in range(20)]
    b = [{"Dim": {"Thickness": i, "In": {"R": f"x{i}"}}} for i in range(20)]
    m, u = tables(spark, a, b)
    assert rows(schema_changes(m, u)) == [("u1", "DIM/IN/R", "renamed"), ("u1", "DIM/THICKNESS", "renamed")]
    m, u = tables(spark, a, [{"Size": r["Dim"]} for r in a])
    assert rows(schema_changes(m, u)) == [("u1", "SIZE", "renamed")]


def test_unified_keeps_refused_values_and_unlisted_rows(spark):
    m, u = tables(spark, [{"Qty": i, "Ok": True} for i in range(5)] + [{"Qty": "about 7", "Ok": "maybe"}])
    m = m.unionByName(spark.createDataFrame([("x1", "gone", "1", "P", '{"Qty": 3, "Extra": "e"}', ""), ("x2", None, "1", "P", '{"Qty": 2}', "")], MAT))
    t = {r.id: r for r in unified_table(m, u).collect()}
    assert len(t) == 8 and t["0-5"].qty is None and t["0-5"]["_rest"] == {"qty": "about 7", "ok": "maybe"} and t["0-1"]["_rest"] == {}
    assert (t["x1"].qty, t["x1"].extra, t["x1"].source_system, t["x2"].upload_id) == (3.0, "e", "", "")


def test_unrelated_flags_are_no_rename(spark):
    m, u = tables(spark, [{"A": i % 10 == 0} for i in range(200)], [{"B": (i // 7) % 10 == 0} for i in range(200)])
    assert rows(schema_changes(m, u)) == [("u1", "A", "removed"), ("u1", "B", "added")]


def test_nested_and_moved(spark):
    m, u = tables(spark, [{"Dim": {"Wall": 1, "Len": 2}, "Box": {"K": 1}}] * 3, [{"Dim": {"Wall": "1"}, "Box": {"K": 1, "Len": 2}}] * 3)
    assert rows(schema_changes(m, u)) == [("u1", "BOX/LEN", "moved"), ("u1", "DIM/WALL", "retyped")]


def test_empty(spark):
    m, u = tables(spark, [], [{"A": 1}])
    assert rows(schema_changes(m, u)) == [("u1", "A", "added")]
    m, u = tables(spark, [], [])
    assert schema_changes(m, u).count() == 0 and unified_table(m, u).count() == 0


def test_value_headers_are_refused(spark):
    m, u = tables(spark, [{f"k{i}": 1 for i in range(30)}])
    with pytest.raises(ValueError):
        Drift(m, u, max_profile=10)


def test_assignment_and_script():
    assert assign([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]
    old, new = Node("", "object", [Node("A", "number")]), Node("", "object", [Node("B", "number")])
    assert edit_script(old, new, lambda x, y: 0.9)[1] == [("rename", ("A",), ("B",))]
    assert sorted(edit_script(old, new, lambda x, y: 0.0)[1]) == [("add", ("B",)), ("delete", ("A",))]

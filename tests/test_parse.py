"""The parser on rows made for these tests; kinds of rows are those of SURVEY 2.9 and 2.10."""

import pytest

from forgeline.functions.parse import amount_of, labelled_values, normalize_text, parse_attributes, respaced, scan
from forgeline.functions.similarity import osa_distance, word_similarity
from forgeline.functions.vocab import derive_item_type, expand_py, item_type_py
from pyspark.sql import functions as F

CASES = [
    # sizes: pair, label, bore, inch with fraction, millimetre; what is no size
    ("UNION SS 32MMX25MM", {"sizeMm": 32, "sizeMm2": 25, "sizeDisplay": "32MM"}),
    ("BUSH 2INX1IN BRS", {"sizeMm": 50.8, "sizeMm2": 25.4, "sizeDisplay": "2IN"}),
    ("REDUCER 80X50", {"sizeMm": 80, "sizeMm2": 50}),
    ("SOCKET; NOMINAL SIZE: 65 MM, 9 MM BOLT", {"sizeMm": 65}),
    ("CAP DN80 CS", {"sizeMm": 80, "sizeDisplay": "80MM"}),
    ("HOSE 40NB", {"sizeMm": 40}),
    ("PLUG 3/4IN NPT", {"sizeMm": 19.05, "sizeDisplay": "3/4IN"}),
    ("BEND 2-1/2IN 45DEG", {"sizeMm": 63.5, "angleDeg": 45, "sizeDisplay": "2-1/2IN"}),
    ('GASKET 4", CNAF', {"sizeMm": 101.6}),
    ("DUCT 0.125IN", {"sizeMm": 3.17}),  # the exact binary value lies under the half
    ("STRAINER 25 MM", {"sizeMm": 25}),
    ("SIZE: ¼ INCHES", {"sizeMm": 6.35, "sizeDisplay": "1/4IN"}),
    ('NIPPLE 1½"', {"sizeMm": 38.1, "sizeDisplay": "1-1/2IN"}),
    ("BORE: DN25 INCLUDES SCREWS", {"sizeMm": 25, "sizeDisplay": "25MM"}),
    ("NUT M12", {"sizeMm": None, "sizeDisplay": None}),
    ("PIPE 0/0IN", {"sizeMm": None}),
    ("PIPE 5/0IN, 20MM", {"sizeMm": 20}),
    ("STEELTUBE18MMODX", {"sizeMm": 18}),
    # pressure
    ("VALVE PN25 10 BAR", {"pressureClass": "PN25", "pressureBar": 25}),
    ("FLANGE CL 300", {"pressureClass": "CLASS 300", "pressureBar": None}),
    ("FLANGE PRESSURE CLASS: 600LB", {"pressureClass": "CLASS 600"}),
    ("COUPLING 6000#, CS", {"pressureClass": None}),
    ("COUPLING 2000#", {"pressureClass": "CLASS 2000"}),
    ("HOSE WEIGHT 17.5 LBS", {"pressureClass": None}),
    ("HOSE WORKING PRESSURE: 12.5 BAR", {"pressureBar": 12.5, "pressureClass": "12.5 BAR"}),
    ("GAUGE 100 PSI", {"pressureBar": 6.89, "pressureClass": "100 PSI"}),
    ("FILTER MAX 16 BARHOUSING", {"pressureClass": "16 BAR"}),
    # schedule, angle, wall, face to face
    ("PIPE SCH 80", {"schedule": "SCH 80"}),
    ("PIPE SCH10S SS", {"schedule": "SCH 10S"}),
    ("PIPE SCHEDULE: XXS", {"schedule": "SCH XXS"}),
    ("PIPE SCHEDULE RATING: STD", {"schedule": "SCH STD"}),
    ("PIPE SCH 40 S.", {"schedule": "SCH 40S"}),
    ("PIPE SCH 40 STEEL", {"schedule": "SCH 40"}),
    ("PIPE SCH 1600", {"schedule": None}),
    ("ELBOW 400DEG", {"angleDeg": None}),
    ("ELBOW 22.5 DEGREE", {"angleDeg": 22.5}),
    ("PIPE DN50\nWALL THICKNESS : 3.2MM", {"wallThicknessMm": 3.2}),
    ("PIPE DN50 THK 4 MM", {"wallThicknessMm": 4}),
    ('PIPE DN50 THK 0.25"', {"wallThicknessMm": 6.35}),
    ("DAMPER FACE-TO-FACE = 114 MM", {"faceToFaceMm": 114}),
    ("DAMPER FF 52MM", {"faceToFaceMm": 52}),
    # labels
    ("PUMP\nMAKE : ORVANTEC LTD, \nBODY : SS316", {"make": "ORVANTEC LTD", "bodyMaterial": "SS 316"}),
    ("PUMP; SEAT MOC: SOFT RUBBER BODYMATERIAL: CI", {"seatMaterial": "SOFT", "bodyMaterial": "CAST IRON"}),
    ("VALVE; DISC: MOC BRONZE", {"discMaterial": "BRONZE"}),
    ("VALVE; STEM:", {"stemMaterial": None}),
    ("", {"itemType": None, "subtypes": [], "materials": [], "standards": []}),
    (None, {"itemType": None, "sizeMm": None}),
]


@pytest.mark.parametrize("text, want", CASES)
def test_rules(text, want):
    got = parse_attributes(text)
    assert {k: got[k] for k in want} == want


def test_lists_and_terms():
    got = parse_attributes("VLV GLB;DN65,WAFER,LEVER ISO5208,API 598, IS 778,ANSI B16.10,ASTM A105,ISO5208", "VALVE, GLOBE", ["GLOBE", "LEVER", "ANGLE"])
    assert got["standards"] == ["ISO5208", "API 598", "IS 778", "ANSI B16.10", "ASTM A105"] and (got["connection"], got["actuation"]) == ("WAFER", "LEVER")
    assert got["subtypes"] == ["GLOBE", "LEVER"] and got["subtype"] == "GLOBE" and got["itemType"] == "VALVE"
    got = parse_attributes("FLG SLP-ON DN80 SS RSD FACE", "", ["SLIP ON", "RAISED"])
    assert got["subtypes"] == ["SLIP ON", "RAISED"] and got["connection"] == "FLANGE" and got["materials"] == ["STAINLESS STEEL", "SS"]
    assert parse_attributes("PUMP; BODY: NODULAR CI\nEPDM LINED")["materials"] == ["NODULAR CI", "CAST IRON", "CI", "EPDM"]
    assert len(parse_attributes(" ".join(f"TERM{chr(65 + i)}" for i in range(12)), "", [f"TERM{chr(65 + i)}" for i in range(12)])["subtypes"]) == 8
    assert parse_attributes("PUMP MAKE: " + "LONG NAME " * 20)["make"] == ("LONG NAME " * 20)[:60]


@pytest.mark.parametrize(
    "text, exact, near",
    [("GLOEB VALV DN40", (None, None), ("GLOBE", "VALVE")), ("FLANGD GASKT", (None, None), (None, "FLANGE")), ("TEE", (None, "TEE"), (None, "TEE")), ("TEF", (None, None), (None, None)), ("SLIP OM FLANGE", (None, "FLANGE"), (None, "FLANGE"))],
)
def test_slips_only_in_queries(text, exact, near):
    for fuzzy, want in ((False, exact), (True, near)):
        got = parse_attributes(text, "", ["GLOBE", "SLIP ON"], fuzzy)
        assert (got["subtype"], got["itemType"]) == want


def test_text():
    assert normalize_text("top<(>&<)>side ,  ０.５–1 :x") == "TOP&SIDE, 0.5-1: X"
    assert respaced("STEELWALLTHICKNESS: 9MMTHK") == "STEEL WALL THICKNESS: 9MM THK"
    assert labelled_values("A\nBODY: X, MAKE :  Y") == {"bodyMaterial": "X", "make": "Y"}
    assert scan("DN200 SCH40S, 3IN").kinds == "dnhnSoni"
    assert [amount_of(x) for x in ("12", "1.5", "3/4", "1 - 1/2", "0", "1/0")] == [12, 1.5, 0.75, 1.5, None, None]
    assert expand_py("GSKT SPRL WND;DN50,CS") == "GASKET SPIRAL WOUND;DN50,CARBON STEEL" and expand_py("STEEL 8MM") == "STEEL 8MM"


def test_item_type_in_python_and_spark(spark):
    """The parser's item type and the expression's are the same on every row."""
    texts = ["GSKT;PIPE", "PIPE; JOINT RING", "EXPANSION JOINT", "JOINTS", "FLEXIBLE JOINT TUBE", "UNIT2", "STUBEND", "STUB END PIPE", "FTG TUBE", "NO TYPE HERE", "", "VALVES", "CABLE-BEARING"]
    df = spark.createDataFrame([(t, "") for t in texts], "s string, c string").unionByName(
        spark.read.parquet("/root/testdata/sf0.01/materials.parquet").select(F.coalesce("short_description", F.lit("")).alias("s"), F.coalesce("class_name", F.lit("")).alias("c")).distinct()
    )
    for r in df.select("s", "c", derive_item_type(F.col("s"), None, F.col("c")).alias("t")).collect():
        assert r.t == (item_type_py(expand_py(r.s)) or item_type_py(expand_py(r.c))), r


def test_distances():
    assert osa_distance("GLOEB", "GLOBE") == 1 and osa_distance("CA", "ABC") == 3 and osa_distance("", "AB") == 2
    assert word_similarity("globe", "VALVE GLOBE DN65") == 1.0 and word_similarity("globe", "") == 0.0
    assert 0 < word_similarity("globe valve", "valve gate") < 1

import pytest
from pyspark.sql import functions as F

from forgeline.operators.units import CONVERSIONS, UnitGraph, foreign_units, measurements

SCHEMA = "id string, short_description string, long_description string, attributes string, quantity string"


def found(spark, short=None, long=None, attributes=None):
    df = spark.createDataFrame([("a", short, long, attributes, "clash")], SCHEMA)
    return {r.quantity: r.amount for r in foreign_units(df).collect()}


@pytest.mark.parametrize(
    "short, long, attributes, want",
    [
        ("VALVE; 1-1/2IN,PN40", None, None, {"size": 38100}),
        ('GASKET;10",EPXY CTD', None, None, {"size": 254000}),
        ("NIPPLE BRL;60IN LG, 6000#, 0.75\"", None, None, {"length": 1524000, "size": 19050}),
        ("PIPE;12 IN,LG 3 M,AL", None, None, {"size": 304800, "length": 3000000}),
        ("ACTR; 36IN LONG 6IN THRDD", None, None, {"length": 914400, "size": 152400}),
        ("VALVE; DN200,16 BAR,PN40,CL 150,SCH 80,150LB,FIG 77M", None, None, {}),
        ("VALVE; SCH 80,16 PSI", None, None, {"pressure": 110}),
        (None, "WALL: 2,5 CM; APPROX WT 0.4KG; UNIT WEIGHT: 3 OZ; TEMP MAX: 300 DEG F", None, {"wall": 25000, "weight": 85, "temp": 1489}),
        (None, "SIZE - 1.5\"\nTHK: 0.134 INCHES\nRATED 1480 LBS/SQ.IN", None, {"size": 38100, "wall": 3404, "pressure": 10204}),
        (None, "SERVICE TEMPERATURE UP TO 176F REPLACES; BORE: 1 1/2 INCH", None, {"temp": 800, "size": 38100}),
        (None, "SIZE - ¼ INCH; THK: 1½IN", None, {"size": 6350, "wall": 38100}),
        (None, None, '{"sizeMm":"16IN","pressureBar":"10.5 KG/CM2","wallThicknessMm":"0.2 CM"}', {"size": 406400, "pressure": 1030, "wall": 2000}),
        (None, None, '{"sizeMm":16,"pressureBar":null}', {}),
        (None, None, "not json", {}),
        ("", "", "", {}),
        (None, "LENGTH: 250 M", None, {}),  # cut off from MM
        (None, "SIZE: 1/0 IN", None, {}),
    ],
)
def test_foreign_units(spark, short, long, attributes, want):
    assert found(spark, short, long, attributes) == want


def test_long_text_and_empty_table(spark):
    long = "PLAIN TEXT WITHOUT UNITS 12345 " * 20_000 + "; SIZE: 4 IN"
    assert found(spark, None, long) == {"size": 101600}
    assert foreign_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_statement_counts_and_repeated_rows(spark):
    df = spark.createDataFrame([("a", "VALVE 2IN", "SIZE: 3 IN", None, ""), ("b", "VALVE 2IN", None, None, ""), ("b", "VALVE 2IN", None, None, "")], SCHEMA)
    assert sorted((r.id, r.amount) for r in foreign_units(df).collect()) == [("a", 50800), ("b", 50800)]


def test_canonical_values_are_measured_too(spark):
    df = spark.createDataFrame([("a", "VALVE 25MM,10BAR")], "id string, t string")
    assert sorted((r.quantity, r.amount, r.is_canonical) for r in measurements(df, "id", [F.col("t")]).collect()) == [("pressure", 1000, True), ("size", 25000, True)]


def test_long_lengths_are_kept(spark):
    """Only an M that ends its text may be a cut-off MM; the value is marked, not dropped."""
    assert found(spark, None, "LENGTH: 250 M; DRUM") == {"length": 250000000}
    assert found(spark, None, "CABLE\nLENGTH: 500 MTR") == {"length": 500000000}
    assert found(spark, "CABLE; 300 M LG", None) == {"length": 300000000}
    assert found(spark, "HOSE LENGTH 99 M", None) == {"length": 99000000}
    assert found(spark, "HOSE LENGTH 250 M ", "SIZE: 2 IN") == {"size": 50800}
    from forgeline.operators.units import canonical_values

    df = spark.createDataFrame([("a", "HOSE LENGTH 250 M", "SIZE: 2 IN; TEMP: 212 F; WT 500 G; WALL: 3 MM, 20 BAR", None, "")], SCHEMA)
    got = {(r.quantity, r.amount, r.unit, r.is_canonical, r.doubtful) for r in canonical_values(df).collect()}
    assert got == {("length", 250000.0, "MM", False, True), ("size", 50.8, "MM", False, False), ("temp", 100.0, "CELSIUS", False, False), ("weight", 0.5, "KG", False, False), ("wall", 3.0, "MM", True, False), ("pressure", 20.0, "BAR", True, False)}


def test_graph():
    g = UnitGraph(CONVERSIONS)
    f = g.compositions("MM")["FOOT"]
    assert abs(f.factor - 304.8) < 1e-9 and f.offset == 0
    t = g.compositions("CELSIUS")["FAHRENHEIT"]
    assert abs(212 * t.factor + t.offset - 100) < 1e-9
    with pytest.raises(ValueError):
        UnitGraph([*CONVERSIONS, ("FOOT", "MM", 300.0, 0.0)])


@pytest.mark.parametrize(
    "long, want",
    [
        ("VALVE\nNOMINAL PIPE SIZE: TWENTY INCH\nPRESSURE RATING: 600 PSIG\nLENGTH: 62.5CM", {"size": 508000, "pressure": 4137, "length": 625000}),
        ("BORE: SIX INCH; STANDARD: ASTM-A106", {"size": 152400}),
        ("BORE: 200 MM;\nOVERALL LENGTH: TWENTY FEET;", {"length": 6096000}),
        ("SIZE - TWENTY-FOUR INCHES; LENGTH: ONE HUNDRED AND TEN FEET", {"size": 609600, "length": 33528000}),
        ("SIZE: ONE AND A HALF INCH; THK: THREE QUARTER INCH", {"size": 38100, "wall": 19050}),
        ("LENGTH: ONE THOUSAND TWO HUNDRED FEET", {"length": 365760000}),
        ("TWO SIX INCH NIPPLES", {"size": 152400}),
        ("SIZE: SIX IN\nMATERIAL: CS", {"size": 152400}),
        ("TEMP MAX: NINETY DEG F; WEIGHT: TWO POUNDS; TEN PSI", {"temp": 322, "weight": 907, "pressure": 69}),
        ("ONE IN EACH BOX; TEN IN STOCK; \"TEN\" MARKED; BORE: 2 AND A HALF INCH; OFTEN INCHES; ZERO POINT FIVE INCH; FIVE BAR; SIX METRES", {}),
    ],
)
def test_numbers_in_words(spark, long, want):
    assert found(spark, None, long) == want

"""Quantities recorded in different units: a conversion graph, its compositions, and the join that applies them."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions.vocab import FRACTIONS
from forgeline.session import small

# Directed conversions (from, to, factor, offset): to = from * factor + offset.
CONVERSIONS = [
    ("INCH", "CM", 2.54, 0.0),
    ("FOOT", "INCH", 12.0, 0.0),
    ("CM", "MM", 10.0, 0.0),
    ("M", "CM", 100.0, 0.0),
    ("FOOT", "M", 0.3048, 0.0),
    ("BAR", "KPA", 100.0, 0.0),
    ("MPA", "KPA", 1000.0, 0.0),
    ("PSI", "KPA", 6.894757293168361, 0.0),
    ("KGF/CM2", "KPA", 98.0665, 0.0),
    ("POUND", "KG", 0.45359237, 0.0),
    ("OUNCE", "POUND", 0.0625, 0.0),
    ("GRAM", "KG", 0.001, 0.0),
    ("FAHRENHEIT", "CELSIUS", 5.0 / 9.0, -160.0 / 9.0),
]
# The canonical unit of each dimension, and how many amounts make one of it.
CANONICAL = {"length": ("MM", 1000.0), "pressure": ("BAR", 100.0), "mass": ("KG", 1000.0), "temperature": ("CELSIUS", 10.0)}
# Spellings of each unit in texts.
SPELLINGS = {
    "INCH": ["IN", "INCH", "INCHES", '"', "''"],
    "FOOT": ["FT", "FOOT", "FEET"],
    "MM": ["MM"],
    "CM": ["CM"],
    "M": ["M", "MTR", "MTRS", "METRE", "METRES", "METER", "METERS"],
    "BAR": ["BAR", "BARG"],
    "KPA": ["KPA"],
    "MPA": ["MPA"],
    "PSI": ["PSI", "PSIG", "LBS/SQ.IN", "LBS/SQIN", "LB/SQ.IN"],
    "KGF/CM2": ["KG/CM2", "KGF/CM2", "KG/SQ.CM", "KGF/SQ.CM", "KG/CM"],
    "KG": ["KG", "KGS"],
    "GRAM": ["G", "GM", "GMS", "GRAM", "GRAMS"],
    "POUND": ["LB", "LBS", "POUND", "POUNDS"],
    "OUNCE": ["OZ", "OUNCE", "OUNCES"],
    "CELSIUS": ["C", "DEG C", "CELSIUS"],
    "FAHRENHEIT": ["F", "DEG F", "FAHRENHEIT"],
}


@dataclass(frozen=True)
class Affine:
    """y = x * factor + offset."""

    factor: float = 1.0
    offset: float = 0.0

    def then(self, g: "Affine") -> "Affine":
        return Affine(self.factor * g.factor, self.offset * g.factor + g.offset)

    def inverse(self) -> "Affine":
        return Affine(1.0 / self.factor, -self.offset / self.factor)


class UnitGraph:
    """Units as nodes, affine conversions as edges in both directions."""

    def __init__(self, edges: list[tuple[str, str, float, float]], tolerance: float = 1e-9):
        self.edges: dict[str, dict[str, Affine]] = {}
        for a, b, k, c in edges:
            f = Affine(k, c)
            self.edges.setdefault(a, {})[b] = f
            self.edges.setdefault(b, {})[a] = f.inverse()
        self.tolerance = tolerance
        self.check_cycles()

    def compositions(self, target: str) -> dict[str, Affine]:
        """For each unit that reaches ``target``: the composition along a shortest path (fewest conversions)."""
        out, queue = {target: Affine()}, deque([target])
        while queue:
            u = queue.popleft()
            for v in sorted(self.edges.get(u, ())):
                if v not in out:
                    out[v] = self.edges[v][u].then(out[u])
                    queue.append(v)
        return out

    def check_cycles(self) -> None:
        """Every edge must agree with the path through a spanning tree, which makes every cycle the identity."""
        seen: set[str] = set()
        for root in sorted(self.edges):
            if root in seen:
                continue
            to_root = self.compositions(root)
            seen |= set(to_root)
            for u in to_root:
                for v, f in self.edges[u].items():
                    via = f.then(to_root[v])
                    for x in (0.0, 1000.0):
                        direct, around = x * to_root[u].factor + to_root[u].offset, x * via.factor + via.offset
                        if abs(direct - around) > self.tolerance * max(1.0, abs(direct)):
                            raise ValueError(f"conversions contradict each other around {u} -> {v}: {direct} and {around}")


def conversion_table(spark: SparkSession, graph: UnitGraph | None = None) -> DataFrame:
    """spelling, dimension, target, factor, offset, is_canonical; one row per spelling (tens of rows)."""
    graph, rows = graph or UnitGraph(CONVERSIONS), []
    for dim, (target, per) in CANONICAL.items():
        for unit, f in graph.compositions(target).items():
            rows += [(s, dim, target, f.factor * per, f.offset * per, unit == target) for s in SPELLINGS[unit]]
    return small(spark, rows, "spelling string, dimension string, target string, factor double, offset double, is_canonical boolean")

# Numbers that are words. Hundreds and thousands multiply, halves and quarters too.
ONES = {w: float(i) for i, w in enumerate("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split(), 1)}
TEENS = {w: float(i) for i, w in enumerate("TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN".split(), 10)}
TENS = {w: 10.0 * i for i, w in enumerate("TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split(), 2)}
PARTS = {"HALF": 0.5, "QUARTER": 0.25, "QUARTERS": 0.25}


def _words() -> str:
    """Pattern of a number in words: TWENTY, TWENTY-FOUR, ONE HUNDRED AND TEN, THREE QUARTERS, TWO AND A HALF."""
    one, teen, ten, part = ("|".join(sorted(d, key=lambda w: (-len(w), w))) for d in (ONES, TEENS, TENS, PARTS))
    s, end = r"[ \-]+", r"(?![A-Z])"
    small = rf"(?:(?:{ten}){end}(?:{s}(?:{one}){end})?|(?:{teen}|{one}){end})"
    hundred = rf"(?:{small}{s})?HUNDRED{end}(?:{s}(?:AND{s})?{small})?"
    thousand = rf"(?:{small}{s})?THOUSAND{end}(?:{s}(?:AND{s})?(?:{hundred}|{small}))?"
    fraction = rf"(?:(?:A|ONE|THREE){s})?(?:{part}){end}"
    return rf"(?:{thousand}|{hundred}|{small}{s}AND{s}{fraction}|{fraction}|{small})"


WORDS = _words()


def _regex(foreign_only: bool) -> tuple[str, str, str]:
    """Patterns of a value with its unit, of the unit, and of the label in front."""
    canonical = {t for t, _ in CANONICAL.values()}
    spelled = sorted({s for u, v in SPELLINGS.items() for s in v if not (foreign_only and u in canonical)}, key=lambda s: (-len(s), s))
    words = "|".join(s.replace(".", r"\.").replace("DEG ", r"DEG\.? ?") for s in spelled if s[0].isalpha())
    unit = rf"(?:(?:{words})(?![A-Z0-9/])|''|\")"
    mark = r"(?:WALL(?: THICKNESS)?|THICKNESS|THK|LENGTH|LG|L(?==)|TEMP[A-Z]*(?: [A-Z]+){0,3}|WEIGHT|WT)"
    # lookaheads stand before lookbehinds, so that the costly ones run at few positions only
    named = r"(?<!\b(?:SCH|CL|CLASS|API|DIN|ISO|EN|BS|FIG|NO|PN|DN)[ .]{0,2})"
    digits = rf"(?=\d)(?<![A-Z0-9./#\-])(?:\d{{1,2}}-\d{{1,2}}/\d{{1,2}}|(?=\d{{1,2}} \d{{1,2}}/){named}\d{{1,2}} \d{{1,2}}/\d{{1,2}}|\d+/\d+|(?=\d+,\d){named}\d+,\d+|\d+(?:\.\d+)?)"
    # in words: not the rest of a number begun otherwise, no quoted word, and IN before another word is no unit
    spoken = rf"(?=[EFHNOQST])(?<![A-Z0-9\"'])(?<!\b(?:POINT|MINUS)[ \-]|\d[ \-]AND[ \-](?:A[ \-])?)(?!(?:H|THOU|Q)(?<=\d[ \-][A-Z]{{1,4}})){WORDS}(?:[\s\-]+(?!IN +(?!(?:LG|LONG|THK|THICK)(?![A-Z]))[A-Z0-9])|(?=[\"']))"
    number = rf"(?:{digits}|{spoken})"
    # "12 IN LG 3 M": a length word between two values belongs to the second, except LONG, which never stands in front
    length_next = r"(?! ?[:=]| *\d[\d./,\-]* *(?:MM|CM|MTR|METRE|M|INCH|INCHES|IN|FT|FEET|\"|'')(?![A-Z]))"
    tail = rf"(?: *(?:(?:THK|THICK|LG)(?![A-Z]){length_next}|LONG(?! RAD)(?![A-Z])))?"
    return rf"(?:(?=[WTL])\b{mark}\s*[:=\-]?\s*)?{number}\s*{unit}{tail}", unit, mark


PATTERNS = {only: _regex(only) for only in (False, True)}


def _number(c: Column) -> Column:
    """Decimal (point or comma), a/b, or a-b/c with a blank or a hyphen."""
    whole = F.coalesce(F.expr("0D") + F.regexp_extract(c, r"^(\d+)[ -]", 1).try_cast("double"), F.lit(0.0))
    frac = F.regexp_extract(c, r"(\d+)/", 1).try_cast("double") / F.nullif(F.regexp_extract(c, r"/(\d+)", 1).try_cast("double"), F.lit(0.0))
    return F.when(c.contains("/"), whole + frac).otherwise(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"))


def _spoken(c: Column) -> Column:
    """The value of a number in words (see ``_words``)."""
    known = F.create_map(*[F.lit(x) for w in ({**ONES, **TEENS, **TENS}).items() for x in w])
    parts = F.create_map(*[F.lit(x) for w in PARTS.items() for x in w])

    def step(a: Column, w: Column) -> Column:
        count = F.when(a["now"] == 0, 1.0).otherwise(a["now"])  # HUNDRED alone is one hundred
        part = F.try_element_at(parts, w)
        total = F.when(w == "THOUSAND", a["total"] + count * 1000).when(w == "AND", a["total"] + a["now"]).otherwise(a["total"])
        now = F.when(w.isin("THOUSAND", "AND"), 0.0).when(w == "HUNDRED", count * 100).when(part.isNotNull(), count * part).otherwise(a["now"] + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))
        return F.struct(total.alias("total"), now.alias("now"))

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("now"))
    return F.when(c != "", F.aggregate(F.split(c, r"[ \-]+"), zero, step, lambda a: a["total"] + a["now"]))


def spelled_out(c: Column) -> Column:
    """Texts with fraction characters (few) with these written out: 1½ as 1-1/2."""
    out = F.regexp_replace(c, f"(?<=[0-9])(?=[{''.join(FRACTIONS)}])", "-")
    for sign, written in FRACTIONS.items():
        out = F.replace(out, F.lit(sign), F.lit(written))
    return F.when(F.octet_length(c) > F.char_length(c), out).otherwise(c)


#: Stands behind every text of a row; a value in front of it may have been cut.
END = "\x1e"


def measurements(df: DataFrame, key: str, texts: list[Column], max_metres: float = 100.0, foreign_only: bool = False) -> DataFrame:
    """``key``, pos, quantity, amount, is_canonical, doubtful: each value with a unit in ``texts`` in canonical amounts.

    The texts of a row are read one behind the other, in the given order; pos counts the values from 0. Values are found with
    one built-in regular expression in the JVM, units resolved by an equi-join with the conversion table, which
    has a fixed size (one row per spelling) whatever the data. quantity: by dimension, lengths told apart by their
    label or the word behind them: wall, length, else size. Masses and temperatures need their label, since bare
    ones are pressure classes, grades and the like; metres need a length label. A length over
    ``max_metres`` whose M is the last letter of its text is doubtful, since it may be a cut-off MM; no other value is. Null and empty texts state nothing; fractions over zero are no values.
    """
    # a projection of its own: the text is made once, though read several times
    whole = df.select(F.col(key).alias("__key"), F.upper(F.concat_ws(END, *texts, F.lit(""))).alias("__text"))
    m = F.col("m")
    pattern, unit, marks = PATTERNS[foreign_only]
    tail = F.regexp_extract(m, r"(THK|THICK|LG|LONG)$", 1)
    spelled = F.regexp_extract(m, rf"({unit}) *(?:THK|THICK|LG|LONG)?$", 1)
    conv = conversion_table(df.sparkSession)
    found = (
        whole.select("__key", F.posexplode(F.regexp_extract_all(spelled_out(F.col("__text")), F.lit(rf"(?:{pattern})(?:\s*{END})?"), F.lit(0))).alias("pos", "m"))
        .select("__key", "pos", m.endswith(END).alias("last"), F.regexp_replace(m, rf"\s*{END}\z", "").alias("m"))
        .select("__key", "pos", "m", "last", F.regexp_replace(spelled, r"^DEG\.? ?", "DEG ").alias("spelling"))
        .join(conv.where("not is_canonical") if foreign_only else conv, "spelling")
    )
    mark = F.regexp_extract(m, rf"^({marks})", 1)
    value = _number(F.regexp_extract(m, r"(\d[\d./,\- ]*?) *(?:[A-Z°]|''|\")[^0-9]*(?:CM2)?[^0-9]*$", 1))
    value = F.coalesce(value, _spoken(F.regexp_extract(m, rf"(?<![A-Z])({WORDS})[\s\-]*{unit} *(?:THK|THICK|LG|LONG)?$", 1)))
    parsed = found.select("*", F.when(mark != "", F.substring(mark, 1, 2)).otherwise(F.substring(tail, 1, 2)).alias("mark"), value.alias("value"))
    dim, mk = F.col("dimension"), F.col("mark")
    quantity = (
        F.when(dim == "pressure", "pressure")
        .when((dim == "mass") & mk.isin("WE", "WT"), "weight")
        .when((dim == "temperature") & (mk == "TE"), "temp")
        .when((dim == "length") & mk.isin("WA", "TH"), "wall")
        .when((dim == "length") & mk.isin("LE", "LG", "LO", "L"), "length")
        .when((dim == "length") & (F.col("factor") != 1e6) & ~mk.isin("WE", "WT", "TE"), "size")
    )
    return (
        parsed.where(F.col("value").isNotNull())
        .select(F.col("__key").alias(key), "pos", quantity.alias("quantity"), F.floor(F.col("value") * F.col("factor") + F.col("offset") + F.lit(0.5 + 1e-7)).cast("long").alias("amount"), "is_canonical", (F.col("last") & (F.col("factor") == 1e6) & (F.col("value") > max_metres) & (F.col("spelling") == "M") & m.endswith("M")).alias("doubtful"))
        .where("quantity is not null")
    )


ATTRIBUTE_SCHEMA = "sizeMm string, sizeDisplay string, wallThicknessMm string, pressureBar string"


def material_texts() -> list[Column]:
    """The two descriptions and the attribute values, each behind the label of its quantity."""
    a = F.from_json("attributes", ATTRIBUTE_SCHEMA)
    return [F.col("short_description"), F.col("long_description"), *[F.concat(F.lit(label), a[f]) for label, f in (("SIZE: ", "sizeMm"), ("SIZE: ", "sizeDisplay"), ("WALL: ", "wallThicknessMm"), ("PRESSURE: ", "pressureBar"))]]


def foreign_units(materials: DataFrame) -> DataFrame:
    """id, quantity, amount of each quantity that a row states in a unit other than the canonical one.

    If a row states a quantity several times, the first counts: short description, long description, attributes.
    Doubtful values (see ``measurements``) are no statement.
    """
    shift = 1 << 40
    m = measurements(materials, "id", material_texts(), foreign_only=True).where("not doubtful")
    # position and amount in one long: a map-side hash aggregate without sorting
    packed = m.groupBy("id", "quantity").agg(F.min(F.col("pos").cast("long") * (2 * shift) + F.col("amount") + shift).alias("x"))
    return packed.select("id", "quantity", (F.pmod(F.col("x"), F.lit(2 * shift)) - shift).alias("amount"))


def canonical_values(materials: DataFrame) -> DataFrame:
    """id, pos, quantity, amount, unit, is_canonical, doubtful: every value that a row states, in whatever unit, as a
    number of the canonical one (mm, bar, kg, degrees Celsius); pos is its place among the values of the row."""
    units = {q: CANONICAL[d] for d, qs in (("length", ("size", "wall", "length")), ("pressure", ("pressure",)), ("mass", ("weight",)), ("temperature", ("temp",))) for q in qs}
    value, unit = F.lit(None).cast("double"), F.lit(None).cast("string")
    for q, (name, per) in units.items():
        value = F.when(F.col("quantity") == q, F.col("amount") / per).otherwise(value)
        unit = F.when(F.col("quantity") == q, name).otherwise(unit)
    return measurements(materials, "id", material_texts()).select("id", "pos", "quantity", value.alias("amount"), unit.alias("unit"), "is_canonical", "doubtful")

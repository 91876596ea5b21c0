"""Schemas that drift between files: profiles, minimum-cost edit scripts, and one consistent table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.session import sap_key, sequence_uploads, small, stripped, text


def header_key(c: F.Column) -> F.Column:
    """Upper case, every run of characters other than A-Z and 0-9 one blank, outer blanks removed."""
    return F.btrim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def header_key_py(h: str) -> str:
    return re.sub("[^A-Z0-9]+", " ", h.upper()).strip()


@dataclass
class Node:
    """A field of a schema; ``kind`` of its non-null values (object fields have children)."""

    name: str
    kind: str = "null"
    children: list["Node"] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def shape(self) -> tuple:
        return (self.name, self.kind, tuple(sorted(c.shape() for c in self.children)))


def assign(cost: list[list[float]]) -> list[int]:
    """Column of each row in a minimum-cost perfect matching of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0, way = i, 0, [0] * (n + 1)
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while match[j0]:
            used[j0], i0, delta, j1 = True, match[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not used[j]:
                    reduced = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def edit_script(old: Node, new: Node, agreement, path: tuple[str, ...] = (), was: tuple[str, ...] = ()) -> tuple[float, list[tuple]]:
    """Constrained edit distance of two unordered schema trees and a script of minimum cost.

    Children of matched nodes are matched with each other by an optimal assignment. Adding or deleting a subtree
    costs its size; matching fields of one name costs the distance of their subtrees; a rename costs
    ``2 * (1 - agreement(old path, new path))`` more, so it is chosen over delete + add when the contents agree
    on more than nothing, and is forbidden where agreement is 0. Script entries: ("add" | "delete", path),
    ("rename", old path, new path), ("move", old path, new path), ("retype", path, old kind, new kind).
    ``path`` and ``was`` are the new and the old path of the two nodes; they differ within renamed objects.
    """
    script: list[tuple] = []
    a, b = sorted(old.children, key=lambda x: x.name), sorted(new.children, key=lambda x: x.name)
    total = 0.0
    n = len(a) + len(b)
    if n:
        big = 1e6
        sub = [[edit_script(x, y, agreement, path + (y.name,), was + (x.name,)) for y in b] for x in a]
        cost = [[big] * n for _ in range(n)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                if x.name == y.name:
                    cost[i][j] = sub[i][j][0]
                elif (s := agreement(was + (x.name,), path + (y.name,))) > 0:
                    cost[i][j] = sub[i][j][0] + 2 * (1 - s)
            cost[i][len(b) + i] = x.size()
        for j, y in enumerate(b):
            cost[len(a) + j][j] = y.size()
            for i in range(len(a)):
                cost[len(a) + j][len(b) + i] = 0.0
        pick = assign(cost)
        for i, x in enumerate(a):
            j = pick[i]
            total += cost[i][j]
            if j >= len(b):
                script.append(("delete", was + (x.name,)))
                continue
            y = b[j]
            if x.name != y.name:
                script.append(("rename", was + (x.name,), path + (y.name,)))
            if x.kind != y.kind and "null" not in (x.kind, y.kind):
                script.append(("retype", path + (y.name,), x.kind, y.kind))
            script += sub[i][j][1]
        for j, y in enumerate(b):
            if pick[len(a) + j] == j:
                total += y.size()
                script.append(("add", path + (y.name,)))
    if not path:
        script = _moves(old, new, script)
    return total, script


def _find(root: Node, path: tuple[str, ...]) -> Node:
    for p in path:
        root = next(c for c in root.children if c.name == p)
    return root


def _moves(old: Node, new: Node, script: list[tuple]) -> list[tuple]:
    """A deleted subtree that is added with the same shape under another parent was moved."""
    out = list(script)
    for d in [s for s in script if s[0] == "delete"]:
        for a in [s for s in out if s[0] == "add"]:
            if d[1][:-1] != a[1][:-1] and _find(old, d[1]).shape() == _find(new, a[1]).shape():
                out[out.index(d)] = ("move", d[1], a[1])
                out.remove(a)
                break
    return out


SEP = "\x1f"


def fields_of(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """``keep`` columns, path (normalised headers joined by SEP), header, value (variant), kind; one row per field.

    Objects are opened level by level as long as the data has any at that level; unreadable JSON has no fields.
    """
    spark = df.sparkSession
    return spark.sql(
        f"select {''.join(f't.{k}, ' for k in keep)} e.key as header, e.value as value from {{t}} t, lateral variant_explode(t.v) e",
        t=df.select(*keep, F.try_parse_json(json).alias("v")).where("v is not null"),
    ).select(*keep, header_key(F.col("header")).alias("path"), "header", "value", json_kind(F.col("value")).alias("kind"))


def json_kind(v: F.Column) -> F.Column:
    s = F.schema_of_variant(v)
    return F.when(s == "VOID", "null").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object").otherwise("number")


def canonical_value(v: F.Column) -> F.Column:
    """What a value says, whatever its kind and notation: numbers without thousands separators, leading and trailing
    zeros, dates as YYYYMMDD, yes and no as true and false, lists without brackets, quotes and kind of separator."""
    t = F.lower(F.btrim(v.cast("string")))
    day_first, year_first = r"^(\d{1,2})[-./](\d{1,2})[-./](\d{4})(?:[t ].*)?$", r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:[t ].*)?$"
    two = lambda p, i: F.lpad(F.regexp_extract(t, p, i), 2, "0")
    plain = F.when(t.rlike(r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    number = plain.try_cast("double").cast("string")
    return (
        F.when(t.rlike(day_first), F.concat(F.regexp_extract(t, day_first, 3), two(day_first, 2), two(day_first, 1)).try_cast("double").cast("string"))
        .when(t.rlike(year_first), F.concat(F.regexp_extract(t, year_first, 1), two(year_first, 2), two(year_first, 3)).try_cast("double").cast("string"))
        .when(number.isNotNull(), number)
        .when(t.isin("true", "y", "yes"), "true")
        .when(t.isin("false", "n", "no"), "false")
        .otherwise(F.regexp_replace(F.regexp_replace(t, r'[\[\]"\s]+', ""), "[;|]", ","))
    )


@dataclass
class Upload:
    upload_id: str
    source: str
    seq: int
    tree: Node
    headers: dict[str, list[str]]


class Drift:
    """Profiles of all uploads and the edit scripts between consecutive ones of a source system.

    Only schemas reach the driver: one row per upload, field, header spelling and kind, which does not grow with
    the rows. ``max_profile`` bounds it; beyond that a ValueError says so, since such a column is no record schema.
    """

    def __init__(self, materials: DataFrame, uploads: DataFrame, max_profile: int = 200_000, min_agreement: float = 0.5):
        self.min_agreement = min_agreement
        ups = sequence_uploads(uploads)
        rows = materials.select(text("upload_id").alias("upload_id"), "raw_data")
        profile, level, nested = [], fields_of(rows, "raw_data", "upload_id"), True
        while nested:
            part = level.groupBy("upload_id", "path", "header", "kind").agg(F.count(F.lit(1)).alias("n")).limit(max_profile + 1).collect()
            profile += part
            if len(profile) > max_profile:
                raise ValueError(f"more than {max_profile} different fields: these are values, not headers")
            nested = any(r.kind == "object" for r in part)
            if nested:
                objects = level.where("kind = 'object'").select("upload_id", F.col("path").alias("parent"), F.col("value").cast("string").alias("o"))
                level = fields_of(objects, "o", "upload_id", "parent").withColumn("path", F.concat("parent", F.lit(SEP), "path")).drop("parent")
        self.materials, self.ups = materials, ups
        self.uploads: list[Upload] = []
        found: dict[str, list] = {}
        for r in profile:
            found.setdefault(r.upload_id, []).append(r)
        for u in ups.orderBy("source_system", "seq").collect():
            mine = found.pop(u.upload_id, [])
            self.uploads.append(Upload(u.upload_id, u.source_system, u.seq, self._tree(mine), self._spellings(mine)))
        # rows of uploads that are not listed are compared with nothing, but read like all others
        self.unlisted = [Upload(k, "", 0, self._tree(mine), self._spellings(mine)) for k, mine in sorted(found.items())]
        self.scripts: dict[str, list[tuple]] = {}
        agree = self._agreement()
        for a, b in self.pairs():
            _, self.scripts[b.upload_id] = edit_script(a.tree, b.tree, lambda x, y, k=b.upload_id: agree.get((k, SEP.join(x), SEP.join(y)), 0.0))

    @staticmethod
    def _tree(rows: list) -> Node:
        root, kinds = Node("", "object"), {}
        for r in rows:
            kinds.setdefault(r.path, {}).setdefault(r.kind, 0)
            kinds[r.path][r.kind] += r.n
        nodes = {"": root}
        for path in sorted(kinds, key=lambda p: p.count(SEP)):
            real = {k: n for k, n in kinds[path].items() if k != "null"}
            kind = max(sorted(real), key=real.get) if real else "null"
            parent, _, name = path.rpartition(SEP)
            nodes[path] = Node(name, kind)
            nodes[parent].children.append(nodes[path])
        return root

    @staticmethod
    def _spellings(rows: list) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for r in rows:
            if SEP not in r.path and r.header not in out.setdefault(r.path, []):
                out[r.path].append(r.header)
        return {k: sorted(v) for k, v in out.items()}

    @classmethod
    def _paths(cls, node: Node, at: tuple[str, ...] = ()) -> set[str]:
        """Paths of all fields below a node, joined by SEP."""
        return {p for c in node.children for p in ({SEP.join((*at, c.name))} | cls._paths(c, (*at, c.name)))}

    def pairs(self) -> list[tuple[Upload, Upload]]:
        return [(a, b) for a, b in zip(self.uploads, self.uploads[1:]) if a.source == b.source]

    def _agreement(self) -> dict[tuple[str, str, str], float]:
        """Agreement beyond chance (Cohen's kappa) of each gone and each new field on the same records.

        Canonical values are compared, as a field may change its notation with its name, on records of one key
        (sap_no, plant) that both uploads hold once; only the fields in question are read, nested ones level by
        level. The counts come back as one row per pair of fields and value bucket.
        """
        gone, came = [], []
        for a, b in self.pairs():
            x, y = self._paths(a.tree), self._paths(b.tree)
            if x - y and y - x:
                gone += [(a.upload_id, b.upload_id, f) for f in sorted(x - y)]
                came += [(b.upload_id, b.upload_id, f) for f in sorted(y - x)]
        if not gone:
            return {}
        spark = self.materials.sparkSession
        keyed = self.materials.select("upload_id", sap_key().alias("k"), stripped("plant").alias("p"), "raw_data").where("k <> ''")
        schema = "upload_id string, pair string, path string"

        def side(wanted: list, name: str) -> DataFrame:
            w = small(spark, wanted, schema)
            few = keyed.join(small(spark, sorted({(u,) for u, _, _ in wanted}), "upload_id string"), "upload_id")
            level = fields_of(few, "raw_data", "upload_id", "k", "p")
            vals = level
            for _ in range(max(p.count(SEP) for *_, p in wanted)):
                objects = level.where("kind = 'object'").select("upload_id", "k", "p", F.col("path").alias("parent"), F.col("value").cast("string").alias("o"))
                level = fields_of(objects, "o", "upload_id", "k", "p", "parent").withColumn("path", F.concat("parent", F.lit(SEP), "path")).drop("parent")
                vals = vals.unionByName(level)
            vals = vals.where("kind <> 'null'").join(w, ["upload_id", "path"])
            one = vals.select("pair", "k", "p", F.col("path").alias(name), F.xxhash64(canonical_value(F.col("value"))).alias("h"))
            return one.groupBy("pair", "k", "p", name).agg(F.min("h").alias(f"{name}_h"), F.max("h").alias("top")).where(f"{name}_h = top").drop("top")

        both = side(gone, "old").join(side(came, "new"), ["pair", "k", "p"])
        cells = both.groupBy("pair", "old", "new").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("old_h") == F.col("new_h")).cast("double")).alias("same"))
        buckets = 512
        o = both.groupBy("pair", "old", "new", F.pmod("old_h", F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("c"))
        e = both.groupBy("pair", "old", "new", F.pmod("new_h", F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("d"))
        chance = o.join(e, ["pair", "old", "new", "b"]).groupBy("pair", "old", "new").agg(F.sum(F.col("c").cast("double") * F.col("d")).alias("cd"))
        out = {}
        for r in cells.join(chance, ["pair", "old", "new"], "left").collect():
            pe = min((r.cd or 0.0) / (float(r.n) * r.n), 0.999)
            kappa = (r.same - pe) / (1 - pe)
            if r.n >= 2 and kappa >= self.min_agreement:
                out[r.pair, r.old, r.new] = kappa
        return out

    def changes(self) -> list[tuple[str, str, str]]:
        """(upload_id, field, change_kind); nested fields are written PARENT/FIELD."""
        names = {"add": "added", "delete": "removed", "rename": "renamed", "retype": "retyped", "move": "moved"}
        out = []
        for upload_id, script in self.scripts.items():
            for s in script:
                p = s[2] if s[0] in ("rename", "move") else s[1]
                out.append((upload_id, "/".join(p), names[s[0]]))
        return sorted(set(out))

    def canonical(self) -> dict[tuple[str, str], str]:
        """(upload_id, field) -> the name that the field has at the end of its chain of renames."""
        out: dict[tuple[str, str], str] = {}
        for u in reversed(self.uploads):
            nxt = next((b for a, b in self.pairs() if a is u), None)
            renames = {s[1][0]: s[2][0] for s in self.scripts.get(nxt.upload_id, []) if s[0] == "rename" and len(s[1]) == 1} if nxt else {}
            for c in u.tree.children:
                to = renames.get(c.name, c.name)
                out[u.upload_id, c.name] = out.get((nxt.upload_id, to), to) if nxt else to
        return out

    def unified(self) -> DataFrame:
        """id, upload_id, source_system, one column per canonical field (lower case with underscores), and ``_rest``.

        The scripts become one projection for all files: each row meets the list of headers under which its upload
        has each field, a table of one row per upload, so the plan is as long as the fields and not the uploads.
        A field is a double if it is a number in every upload, boolean if boolean in every one, else a string;
        lists and objects keep their JSON text. Values that such a cast refuses stand in the map ``_rest`` under
        the name of their column. Rows of uploads that are not listed stay, with an empty source_system.
        """
        names = self.canonical()
        kinds: dict[str, set[str]] = {}
        read: list[tuple[str, str, dict[str, list[str]]]] = []
        for u in [*self.uploads, *self.unlisted]:
            headers: dict[str, list[str]] = {}
            for c in u.tree.children:
                name = names.get((u.upload_id, c.name), c.name)
                kinds.setdefault(name, set()).add(c.kind)
                headers[name] = sorted({*headers.get(name, []), *u.headers[c.name]})
            read.append((u.upload_id, u.source, headers))
        spark = self.materials.sparkSession
        how = small(spark, read, "upload_id string, source_system string, __h map<string, array<string>>")
        base = self.materials.select("id", text("upload_id").alias("upload_id"), F.from_json("raw_data", "map<string,string>").alias("__m")).join(how, "upload_id", "left")
        used: dict[str, str] = {}
        for c in sorted(kinds):
            name = c.lower().replace(" ", "_") or "unnamed"
            while name in used.values() or name in ("id", "upload_id", "source_system", "_rest"):
                name += "_"
            used[c] = name
        text_of, cols, refused = [], [], []
        for c in sorted(kinds):
            found = F.filter(F.transform(F.col("__h")[c], lambda h: F.col("__m")[h]), lambda x: x.isNotNull())
            text_of.append(F.get(found, F.lit(0)).alias(used[c]))
            k, v = kinds[c] - {"null"}, F.col(used[c])
            to = "double" if k == {"number"} else "boolean" if k == {"boolean"} else None
            cols.append(v.try_cast(to).alias(used[c]) if to else v)
            if to:
                refused.append(F.struct(F.lit(used[c]).alias("key"), F.when(v.try_cast(to).isNull(), v).alias("value")))
        none = F.array().cast("array<struct<key:string,value:string>>")
        rest = F.map_from_entries(F.filter(F.array(*refused) if refused else none, lambda e: e["value"].isNotNull()))
        rows = base.select("id", "upload_id", text("source_system").alias("source_system"), *text_of)
        return rows.select("id", "upload_id", "source_system", *cols, rest.alias("_rest"))


def schema_changes(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    """upload_id, field, change_kind: added, removed, renamed, retyped or (nested fields) moved.

    An upload without rows has no fields, so it removes all of the one before it and the next adds them again.
    """
    return materials.sparkSession.createDataFrame(Drift(materials, uploads).changes(), "upload_id string, field string, change_kind string")


def unified_table(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    return Drift(materials, uploads).unified()

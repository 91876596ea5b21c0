import os
import time

import pytest
from pyspark.sql import functions as F

from forgeline.functions import scoring, vocab
from forgeline.functions.parse import ATTRIBUTES, parse_attributes
from forgeline.operators import analytics, evaluate, match, retrieve, store
from forgeline.sources import export, files, headers

DATA = "/root/testdata/sf0.001"


def cand(spark, items, query="VALVE DN50"):
    """Candidates as the retrieval would give them: (id, description, overrides)."""
    base = {"query_id": 1, "query_text": query, "corporate_no": "M", "plant": "8501", "plants": ["8501"], "class_name": "VALVE", "status": "B2-ERP ACCEPTED", "lexical_score": 0.8, "fuzzy_score": 0.8, "exact_match": False, "final_score": 1.0}
    out = []
    for i, (k, text, over) in enumerate(items):
        out.append({**base, "id": k, "sap_no": f"S{k}", "short_description": text, "long_description": text, "attrs": parse_attributes(text, over.pop("class_name", "VALVE")), "q": parse_attributes(query, fuzzy=True), **over})
    a = ATTRIBUTES.simpleString()
    schema = f"query_id long, query_text string, corporate_no string, plant string, plants array<string>, class_name string, status string, lexical_score double, fuzzy_score double, exact_match boolean, final_score double, id string, sap_no string, short_description string, long_description string, attrs {a}, q {a}"
    return spark.createDataFrame(out, schema)


def order(df, size=8, limit=5):
    return [r.id for r in match.ranked(match.shortlist(df, size), limit).orderBy("rank").collect()]


def test_size_beats_text(spark):
    items = [(f"w{i:02}", "VALVE 100MM", {"lexical_score": 1.0, "fuzzy_score": 1.0}) for i in range(12)] + [("right", "VALVE DN300", {"lexical_score": 0.1, "fuzzy_score": 0.1})]
    assert order(cand(spark, items, "VALVE DN300"))[0] == "right"


def test_spares_family_blocked_exact(spark):
    assert order(cand(spark, [("k", "KIT, VALVE REPAIR", {})])) == []
    assert order(cand(spark, [("f", "FLANGE DN200", {"class_name": "FLANGE"}), ("e", "ELBOW DN200 90DEG SCH 40 CS", {"class_name": "ELBOW"})], "ELBOW DN200 90DEG SCH 40 CS")) == ["e", "f"]
    assert order(cand(spark, [("b", "VALVE DN50", {"status": "Blocked for Procurement"}), ("a", "VALVE DN50", {})])) == ["a", "b"]
    got = match.ranked(match.shortlist(cand(spark, [("b", "VALVE DN50", {"status": "Blocked for Procurement", "exact_match": True}), ("a", "VALVE DN50", {})]), 8)).orderBy("rank").collect()
    assert got[0].id == "b" and got[0].confidence == 100.0


def test_plants_and_explanation(spark):
    got = match.ranked(match.shortlist(cand(spark, [("a", "VALVE DN50", {"plants": ["7502", "8502"]}), ("b", "VALVE DN500", {"plants": []})]), 8)).orderBy("rank").collect()
    assert got[0].plants == ["7502", "8502"] and got[1].plants == ["8501"]
    assert got[0].confidence > 1.3 * got[1].confidence
    assert any(m.startswith("Size / DN: requested 50MM") for m in got[1].mismatches)


def test_related_types(spark):
    one = spark.range(1)
    f = lambda a, b: one.select(scoring.related_types(F.lit(a).cast("string"), F.lit(b).cast("string")).alias("x")).first().x
    assert f("ELBOW", "BEND") and f("ADAPTOR", "CONNECTOR") and f(None, "ELBOW") and not f("FLANGE", "ELBOW")


def test_vocabulary_mining(spark):
    d = [(f"ELBW PIPE;{['CORRUGATED', 'PLAIN', 'RIBBED', 'FLUTED'][i % 4]},DN40,CS",) for i in range(40)] + [("ABCDEFGHIJKLMNOPQR",)] * 10 + [("RARE WORD",), ("",), (None,)]
    df = spark.createDataFrame(d, "d string")
    got = {r.token for r in vocab.term_frequencies(F.col("d"), df).collect()}
    assert got == {"CORRUGATED", "PLAIN", "RIBBED", "FLUTED"}
    assert "BUTTERFLY" in vocab.subtype_vocabulary(F.col("d"), df.limit(0))


def test_codes(spark):
    q = spark.createDataFrame([("2000 1426",), ("M1234567",), ("nir-00012",), ("valve dn50",), ("123\n",), ("",)], "t string")
    assert [r.c for r in q.select(retrieve.code_token(F.col("t")).alias("c")).collect()] == ["20001426", "M1234567", "NIR-00012", "", "", ""]


def test_search_properties(spark):
    from forgeline.session import read

    base = retrieve.catalog(read(spark, DATA, "materials"), read(spark, DATA, "material_uploads"))
    q = spark.createDataFrame([(1, "VLV BTRFLY DN50"), (2, "ab"), (3, None), (4, "zzzz qqqq")], "query_id long, query_text string")
    r = match.search(q, base).collect()
    one = sorted(x["rank"] for x in r if x.query_id == 1)
    assert one == list(range(1, len(one) + 1)) and one
    assert all(0 <= x.confidence <= 100 for x in r) and not [x for x in r if x.query_id in (2, 3)]
    assert len({(x.query_id, x.corporate_no, x.sap_no) for x in r}) == len(r)
    with pytest.raises(ValueError):
        match.search(q, base, 11)


def test_arms_split_and_empty(spark, monkeypatch):
    """Postings in many parts and early bounds change nothing; brute force over all rows; empty tables."""
    from forgeline.functions.similarity import word_similarity
    from forgeline.session import read

    base = retrieve.catalog(read(spark, DATA, "materials"), read(spark, DATA, "material_uploads"))
    docs = retrieve.searchable(base, "corporate_no", "sap_no", "item_type", "attrs")
    texts = [(1, "VLV BTRFLY DN50"), (2, "PIPE"), (3, "FLANGE SLIP ON PIPE CS"), (4, "??"), (5, "")]
    asked = retrieve.with_terms(spark.createDataFrame(texts, "query_id long, query_text string").withColumn("q", F.lit(None).cast(ATTRIBUTES)))
    q, rows = {r.query_id: r for r in asked.collect()}, docs.collect()
    want_lexical, want_trigram = set(), set()
    for k, r in q.items():
        score = [(round(len(set(r.terms) & set(d.short_terms)) + 0.4 * len(set(r.terms) & set(d.all_terms)), 6), d.id) for d in rows]
        want_lexical |= {(k, i, s) for s, i in sorted((x for x in score if x[0] > 0), key=lambda x: (-x[0], x[1]))[:7]}
        want_trigram |= {(k, d.id) for d in rows if word_similarity(r.query_text, d.search_doc) >= 0.6}
    for salt, chars in ((10, 0), (500_000, 0), (500_000, 1 << 18)):
        monkeypatch.setattr(retrieve, "SALT_ROWS", salt)
        monkeypatch.setattr(retrieve, "QUERY_CHARS", chars)
        assert {tuple(r) for r in retrieve.lexical_top(asked, docs, 7).collect()} == want_lexical
        assert {(r.query_id, r.id) for r in retrieve.trigram_scores(asked, docs).collect()} == want_trigram
    assert retrieve.pooled(asked, docs.limit(0)).count() == 0 and retrieve.pooled(asked.limit(0), docs).count() == 0
    assert match.search(spark.createDataFrame([], "query_id long, query_text string"), base).count() == 0
    assert match.search(asked.select("query_id", "query_text"), base.limit(0)).count() == 0


def test_code_arm(spark):
    rows = [(f"r{i:03}", "M0000000", str(20000000 + i)) for i in range(150)] + [("s1", "m123456", ""), ("s2", "", "NIR-0007"), ("s3", "AB", "12")]
    base = spark.createDataFrame(rows, "id string, corporate_no string, sap_no string")
    q = spark.createDataFrame([(1, "M0000000"), (2, "20000149"), (3, "0000"), (4, "M123456"), (5, "NIR-"), (6, ""), (7, "99999"), (8, "000014")], "query_id long, code string")
    got: dict = {}
    for r in retrieve.code_arm(q, base).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    first = {f"r{i:03}" for i in range(100)}
    assert got == {1: first, 2: {"r149"}, 3: first, 4: {"s1"}, 5: {"s2"}, 8: {f"r{i:03}" for i in (14, *range(140, 150))}}


def test_recall_gates(spark):
    from forgeline.session import read

    base = retrieve.catalog(read(spark, DATA, "materials"), read(spark, DATA, "material_uploads"))
    r = evaluate.recall(evaluate.paraphrased(base, 20), base).first()
    assert r.empty == 0 and r.recall_10 >= 0.5 and r.recall_1 <= r.recall_5 <= r.recall_10


def test_insights():
    s = {"total": 20000, "excluded": 4339, "duplicate_rows": 18, "embedding_coverage": 0.6, "readiness": 52, "provisional_sap": 4000, "dup_rows": 400}
    q = [{"label": "Size / DN", "percentage": 25.5, "critical": True}, {"label": "Long description", "percentage": 95.8, "critical": True}]
    found = analytics.insights(s, q, [{"label": "VALVE", "percentage": 5.0}])
    assert [i["key"] for i in found] == ["index_gap", "inactive", "weakest", "plant_rows", "same_text", "provisional", "readiness", "largest"] and all(i["title"] and i["description"] for i in found)


def test_dashboard(spark):
    from forgeline.session import read

    d = analytics.dashboard(read(spark, DATA, "materials"), read(spark, DATA, "material_uploads"))
    assert d["summary"].first().total > 0 and 1 <= len(d["insights"]) <= 8


def test_headers():
    assert headers.resolve(["SAP No", "Description"])["short_description"] == "Description"
    assert headers.resolve(["material_number", "MATERIAL DESCRIPTION"]) == {"sap_no": "material_number", "short_description": "MATERIAL DESCRIPTION"}
    m, w = headers.validated(["Material Number", "Material Description", "Description"])
    assert m["material_group_description"] == "Description" and "corporate" in w[0]
    with pytest.raises(ValueError, match="material code column"):
        headers.validated(["Plant", "Created On"])
    assert headers.search_column(["No", "Item Specification"]) == "Item Specification" and headers.search_column(["x"]) is None


def test_files_store_export(spark, tmp_path):
    head = ["Corporate No", "SAP No", "Plant", "Class", "Short Description", "Long Description", "Status", "Extra"]
    rows = [("M1", "200", "8501", "VALVE, BALL", "VLV BALL;DN50", "TOP<(>&<)>BOTTOM  PLATE", "Blocked for Procurement", "1"), ("M1", "200", "8501", "VALVE, BALL", "VLV BALL;DN65", "", "B2-ERP ACCEPTED", None), ("M2", "201", "", "FLANGE", "FLNG DN40", "", "A0-DELETED", ""), ("", "", "", "", "", "", "", "")]
    x = str(tmp_path / "m.xlsx")
    export.workbook({"Data": (head, rows), "Other": (["a"], [])}, x)
    recs, cols, warnings, sheet = files.read_material_file(spark, x)
    assert sheet == "Data" and warnings == ["only the first sheet is read"] and recs.count() == 3
    c = str(tmp_path / "m.csv")
    with open(c, "w") as f:
        f.write("\n".join(";".join(f'"{v or ""}"' for v in r) for r in [head, *rows]))
    crecs, ccols, _, name = files.read_material_file(spark, c)
    assert name == "CSV" and crecs.count() == 3 and ccols == cols
    with pytest.raises(ValueError, match="supported"):
        files.read_material_file(spark, "m.pdf")

    cat = store.Catalog(spark, str(tmp_path / "cat"))
    typed = store.typed(recs, cols)
    first = typed.where("row_no = 1").first()
    assert "TOP&BOTTOM PLATE" in first.long_description and first.status_active and first.procurement_rank == 3
    s = cat.publish(typed, "m.xlsx", sheet)
    assert (s["row_count"], s["active_count"], s["unique_materials"]) == (2, 1, 2)
    row = cat.current().where("sap_no = '200'").first()
    assert row.short_description == "VLV BALL;DN65" and row.attributes.sizeMm == 65 and row.class_name == "VALVE, BALL"
    cat.save_vectors(spark.createDataFrame([(row.id, [1.0, 2.0])], "id string, embedding array<float>"))
    new = cat.backfill_vectors(lambda texts: [[0.5, 0.5] for _ in texts])
    assert new.count() == 0
    assert cat.with_vectors().where("embedding is not null").count() == 1
    v = cat.with_vectors().where("embedding is not null")
    assert store.carry_vectors(typed, v).where("embedding is not null").count() == 1
    s2 = cat.publish(typed.where("row_no < 3"), "again.xlsx")
    assert os.listdir(tmp_path / "cat" / "versions") == [s2["upload_id"]] and cat.changed_attributes().count() == 0
    with cat.lock(), pytest.raises(store.ImportInProgress):
        cat.publish(typed, "x")
    with cat.lock():
        old = time.time() - 3600
        os.utime(tmp_path / "cat" / "import.lock", (old, old))
        with cat.lock():
            pass

    lst = str(tmp_path / "list.csv")
    with open(lst, "w") as f:
        f.write("No,Item description\n1,valve dn50\n2,ab\n3, flange \n")
    assert [r.query_text for r in files.read_search_items(spark, lst).orderBy("query_id").collect()] == ["valve dn50", "flange"]


def test_export(spark, tmp_path):
    m = match.ranked(match.shortlist(cand(spark, [("a", "VALVE DN50", {}), ("b", "VALVE DN500", {})]), 8))
    assert len(export.summary(m).columns) == 14 and len(export.details(m).columns) == 7
    export.write_parts(m, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_merge(spark):
    a, b = parse_attributes("VALVE DN50"), {**parse_attributes("VALVE DN80 PN10"), "make": " acme ", "materials": ["ss "]}
    df = spark.createDataFrame([(a, b)], f"a {ATTRIBUTES.simpleString()}, b {ATTRIBUTES.simpleString()}")
    r = df.select(store.merge_attributes(F.col("a"), F.col("b")).alias("m")).first().m
    assert (r.sizeMm, r.pressureClass, r.make, r.materials) == (50, "PN10", "ACME", ["SS"])


@pytest.mark.parametrize("hadoop", [False, True])
def test_store_side_tables_and_locks(spark, tmp_path, hadoop):
    """The same on local files and through Hadoop: the last saved value counts, a lock that was taken over stays."""
    from forgeline.sources.shared import Hadoop

    root = f"file://{tmp_path}/cat"
    cat = store.Catalog(spark, root, Hadoop(spark, root) if hadoop else None)
    rows = spark.createDataFrame([("M1", "1", "P", "", "VLV BALL;DN50,PN10", "", "B2-ERP ACCEPTED", "1"), ("M2", "2", "P", "", "FLNG DN40", "", "A0-DELETED", "2")], "corporate_no string, sap_no string, plant string, class_name string, short_description string, long_description string, status string, x string")
    cols = {c: c for c in rows.columns if c != "x"}
    records = rows.select(F.col("x").cast("long").alias("row_no"), F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c))]).alias("raw_data"))
    cat.publish(store.typed(records, cols), "f.csv")
    one = cat.current().where("sap_no = '1'").first()
    for v in ([1.0], [9.0], [5.0]):
        cat.save_vectors(spark.createDataFrame([(one.id, v)], "id string, embedding array<float>"))
    assert [r.embedding for r in cat.with_vectors().orderBy("sap_no").collect()] == [[5.0], None]
    stale = cat.current().withColumn("attributes", F.col("attributes").withField("sizeMm", F.lit(1.0)))
    cat._save("attributes", stale.select("id", "attributes"))
    assert [r.a for r in cat.current().orderBy("sap_no").select(F.col("attributes.sizeMm").alias("a")).collect()] == [1.0, 1.0]
    assert cat.backfill_attributes() == 1 and cat.backfill_attributes() == 0  # the deleted row is left alone
    assert [r.a for r in cat.current().orderBy("sap_no").select(F.col("attributes.sizeMm").alias("a")).collect()] == [50.0, 1.0]
    assert cat.backfill_vectors(lambda t: [[0.5]] * len(t)).count() == 0
    lock = f"{tmp_path}/cat/import.lock"
    with cat.lock():
        old = time.time() - 3600
        os.utime(lock, (old, old))
        with cat.lock():
            mine = open(lock).read()
            with pytest.raises(store.ImportInProgress), cat.lock():
                pass
            assert open(lock).read() == mine
        assert not os.path.exists(lock)
        with open(lock, "w") as f:
            f.write("another")
    assert open(lock).read() == "another"


def test_merged_records():
    assert vocab.canonical_item_type("vlv gate") == "VALVE" and vocab.canonical_item_type("STUBEND") == "STUB END" and vocab.canonical_item_type("") is None and vocab.canonical_item_type("xyz") is None
    assert vocab.is_generic_item_type("pipe") and not vocab.is_generic_item_type("ELBOW") and not vocab.is_generic_item_type(None)
    from forgeline.functions.parse import material_search_text

    assert material_search_text("VALVE", "a ,b", "c\nd") == "VALVE A, B C D"

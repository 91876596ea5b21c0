"""Hybrid retrieval: code, lexical, trigram and attribute arms, pooled, scored on every signal, one row per material."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeline.functions import scoring
from forgeline.functions.parse import ATTRIBUTES, parsed, spread
from forgeline.functions.postings import lexical_best, similar
from forgeline.functions.similarity import trigram_set, word_similarity_udf
from forgeline.functions.vocab import derive_item_type, lexemes, search_tokens, subtype_vocabulary
from forgeline.session import BLANKS, cut, sequence_uploads, stripped, text

SHORT_WEIGHT, TEXT_WEIGHT = 1.0, 0.4
ARM_LIMIT, CODE_LIMIT, POOL_LIMIT = 360, 100, 120
WORD_SIMILARITY = 0.6
#: Rows of the catalog whose inverted lists one task holds, and characters of the queries that meet them.
SALT_ROWS, PART_CHARS = 32_768, 1 << 20
#: Groups of queries in which the best rows of all blocks are merged.
MERGES = 64
#: So many characters of queries are broadcast at most.
QUERY_CHARS = 1 << 18


def active(status: Column) -> Column:
    s = F.upper(F.regexp_replace(status, r"\s+", " "))
    return ~F.coalesce(s.rlike("DELETED|RFD STAGED|RFUD STAGED"), F.lit(False))


def blocked(status: Column) -> Column:
    return F.coalesce(F.upper(status).contains("BLOCKED"), F.lit(False))


def status_order(status: Column) -> Column:
    """0 accepted, 1 change requested, 2 anything else, 3 blocked."""
    s = F.btrim(text(status), F.lit(BLANKS))
    return F.when(blocked(s), 3).when(s == "B2-ERP ACCEPTED", 0).when(s.startswith("C2-RFC"), 1).otherwise(2)


def code_token(query: Column) -> Column:
    """The whole query as a code, or empty text."""
    c = F.regexp_replace(F.upper(query), r"\s+", "")
    return F.when(c.rlike(r"^(\d{4,}|[A-Z]\d{6,}|NIR-.*)\z"), c).otherwise("")


def catalog(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    """The current version of every source system, with empty text for missing codes and the attribute struct."""
    current = sequence_uploads(uploads).where("is_current").select("upload_id")
    return materials.join(current, "upload_id").select(
        "id",
        text("corporate_no").alias("corporate_no"),
        stripped("sap_no").alias("sap_no"),
        stripped("plant").alias("plant"),
        text("class_name").alias("class_name"),
        text("short_description").alias("short_description"),
        text("long_description").alias("long_description"),
        text("status").alias("status"),
        text("material_type").alias("material_type"),
        text("item_type").alias("item_type"),
        active(F.col("status")).alias("status_active"),
        status_order(F.col("status")).alias("procurement_rank"),
        "updated_at",
        F.from_json("attributes", ATTRIBUTES).alias("attrs"),
        "raw_data",
        "embedding",
    )


def reparsed(base: DataFrame, subtypes: list[str]) -> DataFrame:
    """``base`` with the attribute record and the item type that an import gives its rows today, in place of the delivered ones."""
    texts = F.concat_ws("\n", F.nullif("short_description", F.lit("")), F.nullif("long_description", F.lit("")))
    kind = derive_item_type(F.col("short_description"), F.col("long_description"), F.col("class_name"))
    return spread(base).withColumn("attrs", parsed(texts, F.col("class_name"), subtypes)).withColumn("item_type", F.coalesce(kind, F.lit("")))


def parse_queries(queries: DataFrame, subtypes: list[str] | None = None) -> DataFrame:
    """query_id, query_text, code, attribute struct q, lexemes; texts of 3 to 2000 characters."""
    t = F.btrim(text("query_text"), F.lit(BLANKS))
    valid = queries.where("query_id is not null").select("query_id", t.alias("query_text")).where("length(query_text) between 3 and 2000")
    return with_terms(spread(valid).select("query_id", "query_text", parsed(F.col("query_text"), F.lit(""), subtypes, fuzzy=True).alias("q")))


def with_terms(asked: DataFrame) -> DataFrame:
    """query_id, query_text and attribute struct q, with the code, the lexemes and the trigrams of the text."""
    t = F.col("query_text")
    return asked.select("query_id", "query_text", code_token(t).alias("code"), "q", lexemes(search_tokens(t)).alias("terms"), trigram_set(t).alias("grams"))


def mined_subtypes(base: DataFrame) -> list[str]:
    """The subtype vocabulary of the active rows, which goes into the parser of every query."""
    return subtype_vocabulary(F.concat_ws(" ", "short_description", "class_name"), base.where("status_active"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy("query_id").orderBy(*order, F.col("id")))).where(F.col("__r") <= n).drop("__r")


def _least_ids(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the least id of each key; Spark limits every group before the shuffle (WindowGroupLimit)."""
    return df.withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy("id"))).where(F.col("__i") <= n).drop("__i")


def code_arm(queries: DataFrame, base: DataFrame, n: int = CODE_LIMIT) -> DataFrame:
    """The ``n`` rows with the least id whose SAP or corporate number contains the code.

    Rows of one number are limited first, so a placeholder on many rows costs no more than any other number; then
    different numbers are found by the rarest four characters of the code. A code of four characters is itself
    such a gram, which may stand in most numbers: of each gram only the ``n`` least ids can answer it.
    """
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4))))
    asked = queries.where("length(code) >= 4").select("query_id", "code")
    numbers = base.select("id", F.explode(F.array_distinct(F.array(F.col("sap_no"), F.upper("corporate_no")))).alias("number")).where("length(number) >= 4")
    held = _least_ids(numbers, ["number"], n)
    grams = held.select("number").distinct().select("number", F.explode(gram(F.col("number"))).alias("g"))
    often = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    rarest = asked.where("length(code) > 4").select("query_id", "code", F.explode(gram(F.col("code"))).alias("g")).join(often, "g")
    rarest = rarest.groupBy("query_id", "code").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    long = grams.join(rarest, "g").where(F.col("number").contains(F.col("code"))).select("query_id", "number").join(held, "number").select("query_id", "id")
    heads = _least_ids(held.select("id", F.explode(gram(F.col("number"))).alias("code")).distinct(), ["code"], n)
    short = asked.where("length(code) = 4").join(heads, "code").select("query_id", "id")
    return top(long.unionByName(short).distinct(), n)


def indexed(base: DataFrame) -> DataFrame:
    """The search columns of the rows: text in lower case and its trigrams, lexemes of the short description and of the whole text."""
    if "search_doc" in base.columns:
        return base
    tokens = base.select("*", F.explode(F.array(search_tokens(F.col("short_description"), F.col("long_description"), F.col("class_name")))).alias("__t"))
    short = lexemes(search_tokens(F.col("short_description")))
    doc = tokens.withColumns({"search_doc": F.lower(F.array_join("__t", " ")), "short_terms": short, "all_terms": lexemes(F.col("__t"))}).drop("__t")
    return doc.withColumn("doc_grams", trigram_set(F.col("search_doc")))


def searchable(base: DataFrame, *keep: str) -> DataFrame:
    """The active rows with their search columns, written once, as every arm and the scoring read them; ``no`` rises with the id.

    Terms are written as one text per row and trigrams not at all, which need more room as arrays.
    """
    ordered = base.where("status_active").select("id", *keep, "short_description", "long_description", "class_name").orderBy("id")  # before the texts are cut, as Spark reads twice what it sorts
    terms = ("short_terms", "all_terms")
    rows = indexed(ordered.withColumn("no", F.monotonically_increasing_id())).drop("doc_grams")
    written = cut(rows.withColumns({c: F.array_join(c, " ") for c in terms}))
    return written.withColumns({c: F.array_remove(F.split(c, " "), "") for c in terms} | {"doc_grams": trigram_set(F.col("search_doc"))})


def raw_lexical(terms: Column, short: Column, whole: Column) -> Column:
    """1.0 for each query term in the short description, 0.4 for each in the whole text."""
    return F.round(SHORT_WEIGHT * F.size(F.array_intersect(terms, short)) + TEXT_WEIGHT * F.size(F.array_intersect(terms, whole)), 6)


def _hint(queries: DataFrame):
    """Broadcasts what is made of the queries if their texts, counted, have at most QUERY_CHARS characters: of one
    character come at most three trigrams, so that is 40 MB at most. Larger query sets are joined by shuffles."""
    chars = queries.agg(F.sum(F.length("query_text"))).first()[0] or 0
    return F.broadcast if chars <= QUERY_CHARS else lambda df: df


def _in_blocks(queries: DataFrame, docs: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of every block of rows (at most SALT_ROWS, in the order of ``no``) with every part of the queries.

    A part of the queries has about PART_CHARS characters, so nearly always there is one, and the rows are sent once.
    """
    chars = queries.agg(F.sum(F.length("query_text"))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    docs = docs.withColumn("block", F.col("no") - F.pmod(F.col("no").bitwiseAND((1 << 33) - 1), F.lit(SALT_ROWS))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    blocks = docs.select(F.col("block").alias("of_block")).distinct()
    asked = queries.withColumn("of_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).crossJoin(F.broadcast(blocks))
    return docs.groupBy("block", "part").cogroup(asked.groupBy("of_block", "of_part")).applyInArrow(f, schema)


def lexical_top(queries: DataFrame, base: DataFrame, n: int = ARM_LIMIT) -> DataFrame:
    """query_id, id, raw_lexical of the ``n`` best rows of each query; ties go to the smaller id. ``base`` as ``searchable`` gives it.

    Every block of rows gives its ``n`` best by inverted lists, as one row of numbers per query; the best of these follow from a sort.
    """
    key, tenths = queries.schema["query_id"].dataType, (round(10 * SHORT_WEIGHT), round(10 * TEXT_WEIGHT))
    kind = key.simpleString()

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs, asked = docs.sort_by("no").combine_chunks(), asked.combine_chunks()
        whole = lambda c: c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
        found = list(lexical_best(asked["terms"].to_pylist(), whole(docs["short"]), whole(docs["whole"]), tenths, n)) if len(docs) else []
        rows = np.concatenate([np.empty(0, int), *(r for r, _ in found)])
        at = pa.array(np.cumsum([0, *(len(r) for r, _ in found)]).astype(np.int32))
        low = docs["no"][0].as_py() if len(docs) else 0
        lists = lambda x: pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32)))
        place = docs["no"].to_numpy()[rows] - low
        scores = np.concatenate([np.empty(0, int), *(x for _, x in found)])
        asked = asked.slice(0, len(found))
        return pa.table({"query_id": asked["query_id"], "low": pa.array(np.full(len(found), low, dtype=np.int64)), "place": lists(place), "score": lists(scores)})

    def merged(t: pa.Table) -> pa.Table:
        t = t.sort_by("low").combine_chunks()
        lists = t["place"].chunk(0)
        row = pc.list_parent_indices(lists).to_numpy()
        ids = t["query_id"].chunk(0)
        query = pc.index_in(ids, value_set=ids.unique()).to_numpy()[row]
        no = t["low"].to_numpy()[row] + pc.list_flatten(lists).to_numpy()
        score = pc.list_flatten(t["score"].chunk(0)).to_numpy()
        # of one query and score they stand in the order of no, as blocks and what they give do
        order = np.argsort(query.astype(np.int64) * (int(score.max(initial=0)) + 1) - score, kind="stable")
        sizes = np.bincount(query)
        kept = order[np.arange(len(order)) - np.repeat(sizes.cumsum() - sizes, sizes) < n]
        return pa.table({"query_id": ids.take(pa.array(row[kept])), "no": no[kept], "raw_lexical": score[kept] / 10.0})

    terms = lambda c: F.array_join(c, " ")
    docs = base.select("no", terms("short_terms").alias("short"), terms("all_terms").alias("whole"))
    found = _in_blocks(queries.select("query_id", "query_text", terms("terms").alias("terms")), docs, best, f"query_id {kind}, low long, place array<int>, score array<int>")
    groups = found.where(F.size("place") > 0).groupBy(F.pmod(F.xxhash64("query_id"), F.lit(MERGES)))
    return groups.applyInArrow(merged, f"query_id {kind}, no long, raw_lexical double").join(base.select("no", "id"), "no").select("query_id", "id", "raw_lexical")


def trigram_scores(queries: DataFrame, base: DataFrame, least: float = WORD_SIMILARITY, n: int | None = None) -> DataFrame:
    """query_id, id, fuzzy_score of every row with a word similarity of ``least`` or more, or of the ``n`` best of each query.

    ``base`` as ``searchable`` gives it. Rows that share too few of the query's trigrams are not compared (``postings.similar``).
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def best(docs: pa.Table, asked: pa.Table) -> pa.Table:
        docs = docs.sort_by("no")
        found = list(similar(asked["query"].to_pylist(), docs["search_doc"].to_pylist(), least, n)) if len(docs) else []
        which = np.repeat(np.arange(len(found)), [len(r) for r, _ in found]).astype(int)
        rows = np.concatenate([np.empty(0, int), *(r for r, _ in found)])
        return pa.table({"query_id": asked["query_id"].take(pa.array(which)), "id": docs["id"].take(pa.array(rows)), "fuzzy_score": np.concatenate([np.empty(0), *(s for _, s in found)])})

    asked = queries.select("query_id", "query_text", F.lower("query_text").alias("query"))
    found = _in_blocks(asked, base.select("no", "id", "search_doc"), best, f"query_id {kind}, id string, fuzzy_score double")
    return found if n is None else top(found, n, F.col("fuzzy_score").desc())


def attribute_arm(queries: DataFrame, base: DataFrame, n: int = ARM_LIMIT) -> DataFrame:
    """The ``n`` rows with the least id of the asked item type; with a size, only those within a millimetre.

    Of each type and size only the ``n`` least ids can answer, which Spark finds before the shuffle. Queries with a
    size meet them by type and whole millimetre, three of which hold all that is near enough; queries without one
    meet the ``n`` least ids of the type.
    """
    q = queries.select("query_id", F.col("q.itemType").alias("item_type"), F.col("q.sizeMm").alias("size")).where("item_type is not null")
    heads = _least_ids(base.select("id", "item_type", F.col("attrs.sizeMm").alias("mm")), ["item_type", "mm"], n)
    band = F.floor("mm").cast("long")
    sized = q.where("size is not null").select("query_id", "item_type", "size", F.explode(F.sequence(F.floor("size").cast("long") - 1, F.floor("size").cast("long") + 1)).alias("band"))
    near = heads.where("mm is not null").withColumn("band", band).join(sized, ["item_type", "band"]).where(F.abs(F.col("mm") - F.col("size")) <= 1)
    free = _least_ids(heads, ["item_type"], n).join(q.where("size is null"), "item_type")
    return top(near.select("query_id", "id").unionByName(free.select("query_id", "id")), n)


def pooled(queries: DataFrame, base: DataFrame) -> DataFrame:
    """query_id, id and a flag per arm that found the row; ``base`` as ``searchable`` gives it."""
    arms = {
        "code_arm": code_arm(queries, base),
        "lexical_arm": lexical_top(queries, base),
        "trigram_arm": trigram_scores(queries, base, n=ARM_LIMIT),
        "attribute_arm": attribute_arm(queries, base),
    }
    parts = [df.select("query_id", "id", *[F.lit(int(a == name)).alias(a) for a in arms]) for name, df in arms.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "id").agg(*[F.max(a).alias(a) for a in arms])


def plants_of(base: DataFrame) -> DataFrame:
    """All plants of each material, sorted, over the whole base and not only the pool."""
    return base.groupBy("corporate_no", "sap_no").agg(F.array_sort(F.collect_set(F.nullif("plant", F.lit("")))).alias("plants"))


CANDIDATE_COLUMNS = ["corporate_no", "sap_no", "plant", "status", "item_type", "procurement_rank", "updated_at", "attrs"]


def candidates(queries: DataFrame, base: DataFrame, n: int = POOL_LIMIT) -> DataFrame:
    """The best ``n`` materials per query by exact match, attribute, lexical and fuzzy score, one row each.

    Of a material's rows the one with the best status stays, then the latest, then the least id. The word
    similarity, the one score that is no built-in expression, is computed only for rows that can be among the
    best: the shared trigrams bound it from above, and ``n`` rows must not do better without it.
    """
    base, queries = searchable(base, *CANDIDATE_COLUMNS), cut(queries)
    pool = pooled(queries, base)
    rows = pool.select("query_id", "id").join(_hint(queries)(queries), "query_id").join(base, "id")
    rows = rows.withColumn("raw_lexical", raw_lexical(F.col("terms"), F.col("short_terms"), F.col("all_terms")))
    rows = rows.withColumn("__most", F.coalesce(F.size(F.array_intersect("doc_grams", "grams")) / F.nullif(F.size("grams"), F.lit(0)), F.lit(0.0)))
    rows = rows.drop("short_terms", "all_terms", "terms", "doc_grams", "grams")
    code = (F.col("code") != "") & ((F.col("sap_no") == F.col("code")) | (F.upper("corporate_no") == F.col("code")))
    eng = scoring.engineering_score(F.col("q.itemType"), F.col("q.sizeMm"), F.col("q.subtypes"), F.coalesce("q.connection", F.lit("")), F.coalesce("q.pressureClass", F.lit("")), F.col("item_type"), F.col("attrs"))
    scored = rows.withColumn("exact_match", code | (F.lower("short_description") == F.lower("query_text"))).withColumn("lexical_score", scoring.squashed(F.col("raw_lexical")))
    one = W.partitionBy("query_id", "corporate_no", "sap_no").orderBy("procurement_rank", F.col("updated_at").desc_nulls_last(), "id")
    best = scored.withColumn("__eng", eng).withColumn("__m", F.row_number().over(one)).where("__m = 1").drop("__m")
    final = lambda fuzzy: F.when(F.col("exact_match"), 10.0).otherwise(0.45 * F.col("__eng") + 0.30 * F.col("lexical_score") + 0.25 * fuzzy)
    place = W.partitionBy("query_id").orderBy(F.col("__low").desc())
    able = best.withColumn("__low", final(F.lit(0.0))).withColumn("__p", F.row_number().over(place))
    able = able.withColumn("__bar", F.max(F.when(F.col("__p") == n, F.col("__low"))).over(W.partitionBy("query_id")))
    able = able.where(F.col("__bar").isNull() | (final(F.col("__most")) + 1e-9 >= F.col("__bar"))).drop("__low", "__p", "__bar", "__most")
    full = able.withColumn("fuzzy_score", word_similarity_udf(F.lower("query_text"), F.col("search_doc"))).drop("search_doc").withColumn("final_score", final(F.col("fuzzy_score"))).drop("__eng")
    return top(full, n, F.col("final_score").desc(), F.col("procurement_rank")).join(plants_of(base), ["corporate_no", "sap_no"], "left")

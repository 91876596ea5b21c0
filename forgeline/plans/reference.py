"""Queries of the catalog operators over the material tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeline.functions import parse, vocab
from forgeline.functions.similarity import nearest_of_all
from forgeline.operators import analytics as an
from forgeline.operators import evaluate, match, retrieve
from forgeline.operators import store
from forgeline.session import cut, read, sequence_uploads, text


def _profile(spark, d):
    return an.profile(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def _base(spark, d):
    return retrieve.catalog(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def _asked(spark, d):
    return retrieve.parse_queries(read(spark, d, "search_queries"), retrieve.mined_subtypes(_base(spark, d)))


def _texts(spark, d):
    """The queries without their attributes, for what reads only the text."""
    return retrieve.with_terms(read(spark, d, "search_queries").select("query_id", text("query_text").alias("query_text"), F.lit(None).alias("q")).where("query_id is not null"))


def dash_status(spark, d):
    return an.distribution(_profile(spark, d), "status")


def dash_summary(spark, d):
    return an.summary(_profile(spark, d))


def dash_class_quality(spark, d):
    return an.distribution(_profile(spark, d), "class_name", 15, an.CLASS_COVERAGE)


def dash_plant_health(spark, d):
    return an.distribution(_profile(spark, d), "plant", 20)


def dash_class_coverage(spark, d):
    return an.class_quality(_profile(spark, d))


def dash_plant_rates(spark, d):
    return an.plant_health(_profile(spark, d))


def dash_shares(spark, d):
    """Tiers of readiness, lengths, years and gaps with their percentages, in one table."""
    p = _profile(spark, d)
    live = p.where("active")
    parts = {"readiness": (an.readiness_tiers(p), live), "length": (an.length_buckets(live, "long_description"), live), "year": (an.created_years(p), an.dated(p)), "gap": (an.gap_patterns(p), live)}
    out = None
    for kind, (counted, total) in parts.items():
        part = an.with_percentage(counted, total).select(F.lit(kind).alias("kind"), "label", "n", "percentage")
        out = part if out is None else out.unionByName(part)
    return out


def dash_type(spark, d):
    return an.distribution(_profile(spark, d), "material_type", 10)


def dash_coverage(spark, d):
    return an.coverage(_profile(spark, d))


def dash_quality(spark, d):
    return an.quality(_profile(spark, d))


def dash_readiness_tiers(spark, d):
    return an.readiness_tiers(_profile(spark, d))


def dup_descriptions(spark, d):
    return an.repeated_texts(_profile(spark, d).where("active"), "long_description")


def dup_documents(spark, d):
    return an.repeated_texts(read(spark, d, "documents"), "text")


def len_buckets(spark, d):
    return an.length_buckets(_profile(spark, d).where("active"), "long_description")


def created_year(spark, d):
    return an.created_years(_profile(spark, d))


def gap_patterns(spark, d):
    return an.gap_patterns(_profile(spark, d))


def sap_maturity(spark, d):
    return an.sap_maturity(_profile(spark, d))


def stats(spark, d):
    return an.stats(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def expand_abbrev(spark, d):
    return read(spark, d, "materials").select("id", vocab.expand(F.col("short_description")).alias("expanded"))


def search_text(spark, d):
    return read(spark, d, "materials").select("id", F.array_join(vocab.search_tokens(F.col("short_description"), F.col("class_name")), " ").alias("tokens"))


def item_type(spark, d):
    return read(spark, d, "materials").select("id", vocab.derive_item_type(F.col("short_description"), F.col("long_description"), F.col("class_name")).alias("derived"))


def vocab_df(spark, d):
    return vocab.term_frequencies(F.concat_ws(" ", "short_description", "class_name"), _base(spark, d).where("status_active"))


def class_rule(spark, d):
    return store.class_names(read(spark, d, "materials")).select("id", "chosen_class")


def import_dedupe(spark, d):
    rows = read(spark, d, "materials").select("upload_id", text("corporate_no").alias("corporate_no"), text("sap_no").alias("sap_no"), text("plant").alias("plant"), "id", "short_description")
    return store.last_of_key(rows, ["upload_id", "corporate_no", "sap_no", "plant"], "id")


def embedding_carryover(spark, d):
    m = read(spark, d, "materials")
    return store.carry_vectors(m, m.where("embedding is not null")).groupBy("upload_id").agg(F.count(F.lit(1)).alias("rows"), F.count("embedding").alias("with_vector"))


def procurement_rank(spark, d):
    return read(spark, d, "materials").select("id", retrieve.status_order(F.col("status")).alias("procurement_rank"), retrieve.active(F.col("status")).alias("is_active"), retrieve.blocked(F.col("status")).alias("is_blocked"))


def plants_per_material(spark, d):
    return retrieve.plants_of(_base(spark, d)).select("corporate_no", "sap_no", F.array_join("plants", ",").alias("plants"))


def material_dedupe(spark, d):
    w = W.partitionBy("corporate_no", "sap_no").orderBy("procurement_rank", F.col("updated_at").desc_nulls_last(), "id")
    return _base(spark, d).withColumn("r", F.row_number().over(w)).where("r = 1").select("corporate_no", "sap_no", "id", "procurement_rank")


def code_queries(spark, d):
    """The codes of the catalog asked for as queries: every SAP and corporate number (numeric, provisional, letter
    and digits, the placeholder), and the last four characters of each."""
    base = _base(spark, d)
    numbers = base.select(F.explode(F.array("sap_no", "corporate_no")).alias("query_text")).distinct()
    asked = numbers.unionByName(numbers.select(F.right("query_text", F.lit(4)).alias("query_text"))).distinct()
    return asked.select(F.xxhash64("query_text").alias("query_id"), "query_text", retrieve.code_token(F.col("query_text")).alias("code"))


def code_lookup(spark, d):
    asked = code_queries(spark, d)
    return retrieve.code_arm(asked, _base(spark, d)).join(asked.select("query_id", "query_text"), "query_id").select("query_text", "id")


def _records(spark, d):
    """Every material of the catalog whose number is divisible by 20, as a query by its own text and attribute record."""
    rows = _base(spark, d).where("status_active and int(substring(id, 2)) % 20 = 0 and length(btrim(short_description)) between 3 and 2000")
    return retrieve.with_terms(rows.select(F.expr("bigint(substring(id, 2))").alias("query_id"), F.btrim("short_description").alias("query_text"), F.col("attrs").alias("q")))


def attr_lookup(spark, d):
    return retrieve.attribute_arm(_records(spark, d), _base(spark, d).where("status_active"))


def lexical_topk(spark, d):
    return retrieve.lexical_top(_texts(spark, d), retrieve.searchable(_base(spark, d)), 20)


def trigram_topk(spark, d):
    s = retrieve.trigram_scores(_texts(spark, d), retrieve.searchable(_base(spark, d)))
    return retrieve.top(s, 20, F.col("fuzzy_score").desc())


def arm_union(spark, d):
    return retrieve.pooled(cut(_records(spark, d)), retrieve.searchable(_base(spark, d), "corporate_no", "sap_no", "item_type", "attrs"))


def _six(c):
    """Six decimals; what lies on the half but for the last bits goes up."""
    return F.floor(c * 1e6 + 0.5001) / 1e6


def candidates_top(spark, d):
    c = retrieve.candidates(_records(spark, d), _base(spark, d))
    return c.select("query_id", "id", _six(F.col("final_score")).alias("final_score"), "exact_match", F.array_join("plants", ",").alias("plants"))


def engineering_score(spark, d):
    """The attribute score of each candidate of each record searched for."""
    from forgeline.functions import scoring

    c = retrieve.candidates(_records(spark, d), _base(spark, d))
    eng = scoring.engineering_score(F.col("q.itemType"), F.col("q.sizeMm"), F.col("q.subtypes"), F.coalesce("q.connection", F.lit("")), F.coalesce("q.pressureClass", F.lit("")), F.col("item_type"), F.col("attrs"))
    return c.select("query_id", "id", _six(eng).alias("score"))


def parse_full(spark, d):
    m = parse.spread(read(spark, d, "materials").select("id", F.concat_ws("\n", "short_description", "long_description").alias("t"), text("class_name").alias("c")))
    return m.select("id", parse.parsed(F.col("t"), F.col("c")).alias("a")).select("id", "a.*")


def parse_rules(spark, d):
    """What the parser finds by rule and by exact vocabulary, which SQL can express too."""
    a = parse_full(spark, d)
    return a.select("id", "itemType", F.array_join("subtypes", ",").alias("subtypes"), "sizeDisplay", "schedule", "angleDeg", "pressureClass", "connection", "faceToFaceMm", F.array_join("standards", ",").alias("standards"), "actuation")


def _imported(spark, d):
    """The active rows as an import would store them, and the vocabulary mined from them."""
    base = _base(spark, d).where("status_active")
    terms = retrieve.mined_subtypes(base)
    return retrieve.reparsed(base, terms), terms


def search_batch(spark, d):
    base, terms = _imported(spark, d)
    m = match.search(read(spark, d, "search_queries"), base, subtypes=terms)
    return m.select("query_id", "rank", "id", "sap_no", F.array_join("plants", ", ").alias("plants"), "confidence", "parametric_score", "semantic_score", "lexical_score", "exact_match", "blocked", F.array_join("mismatches", " | ").alias("differences"))


def match_explain(spark, d):
    base, terms = _imported(spark, d)
    return match.explained(match.search(read(spark, d, "search_queries"), base, subtypes=terms))


def shortlist(spark, d):
    s = match.shortlist(retrieve.candidates(_records(spark, d), _base(spark, d)), 10)
    return s.select("query_id", "id", "position", _six(F.col("shortlist_score")).alias("shortlist_score"))


def search_records(spark, d):
    """The whole search, from given attribute records to ranked and explained matches."""
    m = match.ranked(match.shortlist(retrieve.candidates(_records(spark, d), _base(spark, d)), 10))
    return m.select("query_id", "rank", "id", "confidence", "parametric_score", "semantic_score", "lexical_score", "exact_match", "blocked", F.array_join("mismatches", " | ").alias("differences"))


def cosine_topk(spark, d):
    """The ten nearest of all vectors, whatever their label, for each vector whose number is divisible by 20."""
    return nearest_of_all(read(spark, d, "embeddings"), "vec_id % 20 = 0")


def event_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


def search_items(spark, d):
    """Free text split into items: lines of three characters or more, each once per query."""
    lines = F.explode(F.split(text("query_text"), r"[\r\n]+")).alias("line")
    return read(spark, d, "search_queries").select("query_id", lines).select("query_id", F.trim("line").alias("item")).where("length(item) >= 3").distinct()


def current_version(spark, d):
    return sequence_uploads(read(spark, d, "material_uploads"))


def eval_recall(spark, d):
    base, terms = _imported(spark, d)
    return evaluate.recall(evaluate.paraphrased(base), base, subtypes=terms)


QUERIES = {
    f.__name__: f
    for f in (
        dash_status, dash_summary, dash_class_quality, dash_plant_health, dash_class_coverage, dash_plant_rates, dash_shares, dash_type, dash_coverage, dash_quality, dash_readiness_tiers, dup_descriptions,
        dup_documents, len_buckets, created_year, gap_patterns, sap_maturity, stats, expand_abbrev, search_text, item_type, vocab_df, class_rule,
        import_dedupe, embedding_carryover, procurement_rank, plants_per_material, material_dedupe, code_lookup, attr_lookup, lexical_topk, trigram_topk,
        arm_union, candidates_top, engineering_score, parse_full, parse_rules, search_batch, search_records, match_explain, shortlist, cosine_topk, event_props, search_items,
        current_version, eval_recall,
    )
}

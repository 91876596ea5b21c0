"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from forgeline.llm import abuse, leakage, leximin, mixing, neighbours, survivors, truncation
from forgeline.session import read

SCORES = ["lexical_score", "fuzzy_score"]


def p1_found(spark, d):
    return survivors.surviving_materials(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def p2_found(spark, d):
    return leximin.leximin_best(read(spark, d, "material_candidates"), "query_id", "material_id", SCORES)


def p2_ranking(spark, d):
    return leximin.leximin_ranking(read(spark, d, "material_candidates"), "query_id", "material_id", SCORES)


def p3_found(spark, d):
    return neighbours.mutual_neighbours(read(spark, d, "materials"), "id", "embedding")


def p3_neighbours(spark, d):
    """The lists of the query set: every material whose number is divisible by 20, against all."""
    return neighbours.nearest_neighbours(read(spark, d, "materials"), "id", "embedding", probes=32, queries="int(substring(id, 2)) % 20 = 0")


def p5_found(spark, d):
    return truncation.cut_materials(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def p5_limits(spark, d):
    return truncation.cut_lengths(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def p5_rates(spark, d):
    return truncation.cut_rates(read(spark, d, "materials"), read(spark, d, "material_uploads"))


def _leaks(spark, d):
    return leakage.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p8_found(spark, d):
    return _leaks(spark, d).where("kind = 'verbatim'").select("doc_id", "item_id")


def p8_leaks(spark, d):
    return _leaks(spark, d)


def p9_mix(spark, d):
    return mixing.mixed(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return mixing.mix_report(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p9_mix_corpus(spark, d):
    """The mix as large as the corpus: sources that are too small are used max_repeats times and fall short."""
    return mixing.mixed(read(spark, d, "documents"), read(spark, d, "mix_targets"), mixing.CORPUS)


def p9_shares_corpus(spark, d):
    return mixing.mix_report(read(spark, d, "documents"), read(spark, d, "mix_targets"), mixing.CORPUS)


def _scored(spark, d):
    return abuse.scored_documents(read(spark, d, "documents"), read(spark, d, "doc_labels"))


def p10_found(spark, d):
    return _scored(spark, d).where("abusive").select("doc_id")


def p10_scores(spark, d):
    return _scored(spark, d).select("doc_id", "score")


def p10_rates(spark, d):
    return abuse.abuse_rates(_scored(spark, d))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_ranking, p3_found, p3_neighbours, p5_found, p5_limits, p5_rates, p8_found, p8_leaks, p9_mix, p9_shares, p9_mix_corpus, p9_shares_corpus, p10_found, p10_scores, p10_rates)
}

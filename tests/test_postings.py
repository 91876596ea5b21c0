"""Inverted lists against brute force, and what the search writes of its rows."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from forgeline.functions.postings import lexical_best, similar
from forgeline.functions.similarity import word_similarity
from forgeline.operators import retrieve

WORDS = ["valve", "vlv", "gate", "globe", "dn50", "dn80", "pn10", "steel", "ab", "abab", "ababab", "zz", "ünder"]


def texts(rng, n, most):
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, most))) for _ in range(n)]


def test_similar_equals_brute_force():
    rng = random.Random(3)
    queries, docs = texts(rng, 80, 5), texts(rng, 120, 14)
    for least in (0.4, 0.6, 0.9):
        full, few = list(similar(queries, docs, least)), list(similar(queries, docs, least, 5))
        for q, got, best in zip(queries, full, few, strict=True):
            scores = [(-word_similarity(q, d), i) for i, d in enumerate(docs) if q and d]
            want = sorted((i, -s) for s, i in scores if -s >= least)
            assert sorted(zip(*(x.tolist() for x in got))) == want
            assert list(zip(*(x.tolist() for x in best))) == sorted(want, key=lambda x: (-x[1], x[0]))[:5]


def test_lexical_equals_brute_force():
    rng = random.Random(4)
    unique = lambda t: " ".join(dict.fromkeys(t.split()))
    queries, short, rest = ([unique(t) for t in texts(rng, n, k)] for n, k in ((60, 6), (90, 3), (90, 6)))
    whole = [unique(f"{a} {b}") if i % 9 else b for i, (a, b) in enumerate(zip(short, rest))]
    for n in (1, 7, 500):
        for q, (rows, scores) in zip(queries, lexical_best(queries, pa.array(short), pa.array(whole), (10, 4), n), strict=True):
            hits = lambda t: len(set(q.split()) & set(t.split()))  # noqa: E731, B023
            want = [(-10 * hits(a) - 4 * hits(b), i) for i, (a, b) in enumerate(zip(short, whole)) if hits(b)]
            assert sorted(zip((-scores).tolist(), rows.tolist())) == sorted(want)[:n]


def test_search_columns_are_written_without_arrays(spark, monkeypatch):
    """Arrays of terms and trigrams are not written; they are made again where they are read."""
    written = []
    monkeypatch.setattr(retrieve, "cut", lambda df: written.append(df) or df)
    row = [("b", "VLV GLB;DN50", "", "VALVE", True), ("a", "", "PIPE", "", True), ("c", "PIPE", "", "", False)]
    docs = retrieve.searchable(spark.createDataFrame(row, "id string, short_description string, long_description string, class_name string, status_active boolean"))
    assert not [c for c, kind in written[0].dtypes if kind.startswith("array")]
    got = docs.orderBy("no").collect()
    assert [r.id for r in got] == ["a", "b"] and got[0].short_terms == [] and got[0].all_terms == ["PIPE"]
    assert set(got[1].short_terms) == {"VLV", "GLB", "DN50", "VALVE"} and "val" in got[1].doc_grams
    assert docs.where(F.size("doc_grams") == 0).count() == 0

import pytest

from conftest import rows
from forgeline.llm.mixing import CORPUS, copies, encoder, mix_report, mixed, rates, token_counts
from forgeline.llm.queries import QUERIES

D, T = "doc_id long, text string, source string, rate double", "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    big = [(i, "plain words of the trade " * (1 + i % 3), " Big ", 0.0) for i in range(400)]
    small = [(1000 + i, "other words of the trade", "small", 0.0) for i in range(40)]
    return spark.createDataFrame(big + small + [(5000, None, "big", 0.0), (5001, "", "big", 0.0), (5002, "x", None, 0.0)], D)


def test_counts(spark, docs):
    got = {r.doc_id: r.tokens for r in token_counts(docs).collect()}
    assert got[0] == len(encoder().encode_ordinary("plain words of the trade ")) and got[5000] == got[5001] == 0


def test_all_targets_met(spark, docs):
    t = spark.createDataFrame([("BIG", 0.6, 1), ("small", 0.4, 3)], T)
    r = {x.source: x for x in mix_report(docs, t, tolerance=0.05).collect()}
    assert all(x.met for x in r.values()) and r["small"].rate == 3.0 and 0 < r["big"].rate < 1
    m = mixed(docs, t)
    assert m.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert sum(x.uses for x in r.values()) == m.count()
    assert rows(m) == rows(mixed(docs.repartition(7), t))


def test_targets_that_cannot_be_met(spark, docs):
    t = spark.createDataFrame([("big", 0.2, 1), ("small", 0.5, 2), ("absent", 0.3, 5)], T)
    r = {x.source: x for x in mix_report(docs, t, total_tokens=4000).collect()}
    assert not r["small"].met and r["small"].rate == 2.0 and r["absent"].mix_tokens == 0 and not r["absent"].met
    r = {x.source: x for x in mix_report(docs, t).collect()}
    assert r["absent"].rate == 0.0 and r["small"].rate == 2.0


def test_expected_size(spark):
    c = spark.createDataFrame([(i, "s", 10) for i in range(20_000)], "doc_id long, source string, tokens long")
    plan = rates(c, spark.createDataFrame([("s", 1.0, 2)], T), total_tokens=250_000)
    n = copies(c, plan).groupBy("copies").count().collect()
    assert {r.copies for r in n} == {1, 2} and abs(next(r["count"] for r in n if r.copies == 2) - 5000) < 300


def test_empty(spark, docs):
    t = spark.createDataFrame([("big", 1.0, 1)], T)
    assert mixed(docs.limit(0), t).count() == 0 and mixed(docs, t.limit(0)).count() == 0 and mix_report(docs.limit(0), t).first().actual_share == 0.0


def test_corpus_size_shows_targets_that_cannot_be_met(spark, docs):
    t = spark.createDataFrame([("big", 0.4, 2), ("small", 0.6, 2)], T)
    r = {x.source: x for x in mix_report(docs, t, total_tokens=CORPUS, tolerance=0.05).collect()}
    total = sum(x.tokens for x in token_counts(docs).collect())
    assert r["small"].rate == 2.0 and r["small"].actual_share < 0.6 and not r["small"].met and not r["big"].met
    assert abs(r["big"].rate - 0.4 * total / r["big"].tokens) < 1e-9
    assert mix_report(docs.limit(0), t, total_tokens=CORPUS).where("uses > 0").count() == 0


def test_registered_with_the_size_of_the_corpus(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["p9_shares_corpus"](spark, d).collect()
    short = [x for x in got if x.tokens > 0 and not x.met]
    assert short and any(x.rate == x.max_repeats and x.actual_share < x.target_share for x in short)
    assert QUERIES["p9_mix_corpus"](spark, d).count() == sum(x.uses for x in got)

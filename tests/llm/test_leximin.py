import math
import random

from conftest import rows
from forgeline.llm.leximin import leximin_best, leximin_ranking, percentiles

S = "q long, i string, a double, b double, extra string, __g int"


def brute(data):
    best = {}
    for q, i, a, b, *_ in data:
        if q is None or i is None:
            continue
        c = best.setdefault(q, {}).setdefault(i, [None, None])
        for k, v in enumerate((a, b)):
            if v is not None and not math.isnan(v) and (c[k] is None or v > c[k]):
                c[k] = v
    out = {}
    for q, items in best.items():
        pct = {}
        for i, c in items.items():
            pct[i] = sorted(0.0 if c[k] is None or len(items) < 2 else sum(o[k] is None or o[k] < c[k] for j, o in items.items() if j != i) / (len(items) - 1) for k in (0, 1))
        out[q] = sorted(items, key=lambda i: ([-x for x in pct[i]], i))
    return out


def test_ranking_against_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice([1, 1, 1, 2, 3]), f"m{rng.randrange(150)}", rng.choice([None, float("nan"), rng.randrange(40) * 1.0]), rng.choice([None, rng.random() * 1000]), "x", 1) for _ in range(600)]
    data += [(9, "only", 1.0, None, "x", 1), (None, "n", 1.0, 1.0, "x", 1), (8, None, 1.0, 1.0, "x", 1)]
    df = spark.createDataFrame(data, S)
    want = brute(data)
    got = {}
    for r in leximin_ranking(df, "q", "i", ["a", "b"]).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.i)
    assert got == want
    assert rows(leximin_best(df, "q", "i", ["a", "b"])) == sorted((q, o[0]) for q, o in want.items())


def test_many_ties_and_empty(spark):
    df = spark.createDataFrame([(1, f"{i:04}", 5.0, None, "", 0) for i in range(2000)], S)
    r = leximin_ranking(df, "q", "i", ["a", "b"])
    assert r.agg({"rank": "max"}).first()[0] == 2000 and r.where("rank = 1").first().i == "0000"
    assert leximin_best(df.limit(0), "q", "i", ["a", "b"]).count() == 0


def test_percentiles_are_exact_in_large_groups(spark):
    df = spark.range(5000).selectExpr("1L as q", "cast(id as string) as i", "cast(pow(id, 3) as double) as a")
    p = percentiles(df, "q", "i", ["a"])
    assert p.where("abs(pct_a - cast(i as long) / 4999) > 1e-12").count() == 0


def test_scale_of_a_score_does_not_matter(spark):
    df = spark.createDataFrame([(1, "x", 1e9, 0.1, "", 0), (1, "y", 5e8, 0.6, "", 0), (1, "z", 1.0, 0.9, "", 0)], S)
    assert rows(leximin_best(df, "q", "i", ["a", "b"])) == [(1, "y")]

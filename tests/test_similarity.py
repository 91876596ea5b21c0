import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import rows
from forgeline.functions.similarity import cosine, nearest_of_all

DATA = "/root/testdata/sf0.001"


def test_cosine_topk_searches_all_labels(spark):
    """Against brute force over all vectors, without a condition on the label."""
    want = duckdb.sql(f"""WITH e AS (SELECT * FROM '{os.path.join(DATA, "embeddings.parquet")}'),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, least(1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS sim FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""").fetchall()
    got = entry.queries()["cosine_topk"](spark, DATA)
    assert got.columns == ["query_id", "vec_id", "sim", "rank"] and rows(got) == sorted(want)


@pytest.mark.parametrize("block", [4, 1000])
def test_blocks_ties_and_vectors_without_cosine(spark, block):
    v = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 0.0], None, [1.0], [1.0, 1.0], [3.0, 4.0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    pairs = q.crossJoin(df).where("vec_id <> query_id").select("query_id", "vec_id", F.round(cosine(F.col("qe"), F.col("embedding")), 4).alias("sim"))
    want: dict = {}
    for r in sorted(pairs.collect(), key=lambda r: (r.query_id, r.sim is None, -(r.sim or 0.0), r.vec_id)):
        if len(want.setdefault(r.query_id, [])) < 4:
            want[r.query_id].append((r.vec_id, r.sim, len(want[r.query_id]) + 1))
    got: dict = {}
    for r in nearest_of_all(df, "vec_id % 2 = 0", k=4, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.sim, r["rank"]))
    assert got == want
    assert nearest_of_all(df.limit(0), "vec_id % 2 = 0").count() == 0

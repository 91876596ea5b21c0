from forgeline.streaming.maintenance import embed_arrivals

S = "id string, status string, short_description string, long_description string, embedding array<float>"


def test_arrivals_are_embedded_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))

    def arrive(rows):
        spark.createDataFrame(rows, S).coalesce(1).write.mode("append").parquet(src)
        embed_arrivals(spark, src, S, out, chk, lambda texts: [[float(len(t)), 1.0] for t in texts]).awaitTermination()

    arrive([("a", "B2-ERP ACCEPTED", "x", "yy", None), ("b", "A0-DELETED", "x", "y", None), ("c", None, None, None, None), ("d", "", "x", "y", [1.0])])
    arrive([("e", "", "new", None, None)])
    assert sorted((r.id, r.embedding[0]) for r in spark.read.parquet(out).collect()) == [("a", 4.0), ("c", 0.0), ("e", 3.0)]

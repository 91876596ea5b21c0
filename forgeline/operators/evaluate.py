"""Retrieval evaluation with shuffled paraphrases of the catalog's own short descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeline.functions.vocab import expand_py
from forgeline.operators import match
from forgeline.session import sap_key


def paraphrase(text: str, seed: int) -> str:
    """Expanded, lower case, without punctuation, words of two letters or more in an order drawn from the seed."""
    import random
    import re

    words = [w for w in re.sub(r"[^a-z0-9/.\" ]+", " ", expand_py(text).lower()).split() if len(w) > 1]
    random.Random(seed).shuffle(words)
    return " ".join(words)


def paraphrased(base: DataFrame, n: int = 60, least: int = 12) -> DataFrame:
    """query_id, query_text, sap_no: the ``n`` active materials with the least md5 of sap_no, paraphrased."""
    rows = base.where(F.col("status_active") & (F.length("short_description") >= least) & (F.col("sap_no") != "")).orderBy(F.md5("sap_no"), "id").limit(n).select("sap_no", "short_description", F.crc32(F.col("id").cast("binary")).alias("query_id"))

    def reword(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame({"query_id": p["query_id"], "query_text": [paraphrase(t, int(s)) for t, s in zip(p["short_description"], p["query_id"])], "sap_no": p["sap_no"]})

    return rows.mapInPandas(reword, "query_id long, query_text string, sap_no string")


def recall(asked: DataFrame, base: DataFrame, limit: int = 10, subtypes: list[str] | None = None) -> DataFrame:
    """queries, empty, recall_1, recall_5, recall_10, mrr; a query whose material is not found counts 0.

    Numbers of one material may be written in several layouts; they are compared without outer blanks, leading
    zeros and letter case.
    """
    hits = match.search(asked.select("query_id", "query_text"), base, limit, subtypes).select("query_id", "rank", F.col("sap_no").alias("got"))
    per = asked.join(hits, "query_id", "left").groupBy("query_id").agg(F.min(F.when(sap_key("got") == sap_key("sap_no"), F.col("rank"))).alias("rank"), F.count("got").alias("n"))
    at = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}")
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") == 0).alias("empty"), at(1), at(5), at(10), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))

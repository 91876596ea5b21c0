"""Edit distance, trigram word similarity and cosine."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def typo_tolerance(length: int) -> int:
    return 0 if length <= 3 else 1 if length <= 8 else 2


def osa_distance(a: str, b: str, most: int | None = None) -> int:
    """Optimal string alignment: insert, delete, replace, or swap two neighbours. Stops beyond ``most``."""
    if a == b:
        return 0
    older, old = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
            if older is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if most is not None and min(row) > most and min(old) > most:
            return most + 1
        older, old = old, row
    return old[-1]


@lru_cache(maxsize=20_000)
def trigrams(text: str) -> tuple[str, ...]:
    """Trigrams in order; words in lower case, two blanks in front and one behind."""
    return tuple(sys.intern(p[i : i + 3]) for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2))


def word_similarity(query: str, doc: str) -> float:
    """Greatest similarity of the query's trigram set with any run of the document's trigrams.

    The best run begins and ends with a trigram of the query. Runs are given up when they, or all that begin
    later, can no longer be better.
    """
    q = set(trigrams(query))
    if not q:
        return 0.0
    seq = trigrams(doc)
    hits = [i for i, t in enumerate(seq) if t in q]
    left, ahead = set(), []
    for i in reversed(hits):
        left.add(seq[i])
        ahead.append(len(left))
    ahead.reverse()
    n, best = len(q), 0.0
    for s, start in enumerate(hits):
        if ahead[s] <= best * n:
            break
        seen: set[str] = set()
        shared, at = 0, start
        for end in hits[s:]:
            for t in seq[at : end + 1]:
                if t not in seen:
                    seen.add(t)
                    shared += t in q
            at = end + 1
            best = max(best, shared / (n + len(seen) - shared))
            if n <= best * len(seen):
                break
    return best


@F.pandas_udf(DoubleType())
def word_similarity_udf(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for q, d in it:
        yield pd.Series([word_similarity(a, b) if a and b else 0.0 for a, b in zip(q, d)])


def trigram_set(c: Column) -> Column:
    """Distinct trigrams as built-in expressions, for posting joins."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is missing, the lengths differ or a norm is zero; between 0 and 1 otherwise."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = dot(a, a) * dot(b, b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.sqrt(norm))))


def nearest_of_all(vectors: DataFrame, queries: str, k: int = 10, places: int = 4, block: int = 8192) -> DataFrame:
    """query_id, vec_id, sim, rank: the ``k`` nearest other vectors of each vector that meets the SQL condition ``queries``.

    Every query is compared with every vector, by the cosine above, rounded to ``places``; ties go to the smaller
    vec_id, and vectors without a cosine (null) come last. Blocks of vectors meet blocks of queries (a quarter as
    large), each pair of blocks in one task that keeps its best ``k``; the best of these follow from a window.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.where(queries)
    nv, nq = (max(1, -(-df.count() // size)) for df, size in ((v, block), (q, max(1, block // 4))))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    members = v.select("vec_id", "v", F.lit(False).alias("asks"), own(nv).alias("b"), every(nq).alias("qb"))
    asking = q.select("vec_id", "v", F.lit(True).alias("asks"), every(nv).alias("b"), own(nq).alias("qb"))
    unit = 10**places

    def best(p: pd.DataFrame) -> pd.DataFrame:
        a, m = p[p["asks"]], p[~p["asks"]].sort_values("vec_id", kind="stable")
        aid, mid = a["vec_id"].to_numpy(), m["vec_id"].to_numpy()
        length = lambda x: np.array([-1 if e is None else len(e) for e in x["v"]], dtype=int)
        alen, mlen = length(a), length(m)
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for i in range(0, len(a), 256):
            sims = np.full((len(aid[i : i + 256]), len(mid)), -1, dtype=np.int64)  # -1: no cosine
            for n in set(alen[i : i + 256]) - {-1, 0}:
                rows, cols = np.flatnonzero(alen[i : i + 256] == n), np.flatnonzero(mlen == n)
                if len(cols):
                    x, y = np.stack(a["v"].iloc[i + rows].to_list()), np.stack(m["v"].iloc[cols].to_list())
                    norm = np.outer((x * x).sum(1), (y * y).sum(1))
                    with np.errstate(all="ignore"):
                        c = np.floor(np.clip(x @ y.T / np.sqrt(norm), 0.0, 1.0) * unit + 0.5)
                        sims[np.ix_(rows, cols)] = np.where(norm > 0, c, -1)
            # one number holds the order: the similarity, then the place by vec_id; a vector is not its own neighbour
            order = (unit - sims) * len(mid) + np.arange(len(mid))
            order[aid[i : i + 256, None] == mid[None, :]] = np.iinfo(np.int64).max
            top = np.argpartition(order, min(k, len(mid)) - 1, axis=1)[:, :k] if len(mid) else np.empty((len(order), 0), int)
            r, c = np.repeat(np.arange(len(order)), top.shape[1]), top.ravel()
            keep = order[r, c] < np.iinfo(np.int64).max
            r, c = r[keep], c[keep]
            found.append((aid[i + r], mid[c], np.where(sims[r, c] < 0, np.nan, sims[r, c] / unit)))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "vec_id", "sim"), zip(*found))})

    local = members.unionByName(asking).groupBy("b", "qb").applyInPandas(best, "query_id long, vec_id long, sim double")
    ranked = local.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("sim").desc_nulls_last(), "vec_id")))
    return ranked.where(F.col("rank") <= k)

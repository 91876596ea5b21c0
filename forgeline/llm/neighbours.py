"""Most similar vectors for every vector: additive quantisation, lookup-table scoring, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm in blocks; empty clusters restart at random points."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    if len(c) < k:
        c = np.concatenate([c, x[rng.integers(0, len(x), k - len(c))] + 1e-3 * rng.standard_normal((k - len(c), x.shape[1])).astype(x.dtype)])
    for _ in range(rounds):
        a = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        n = np.bincount(a, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c.astype(np.float32)


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + block] @ c.T - half, 1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


@dataclass
class AdditiveQuantiser:
    """A vector is the sum of one codeword of each full-dimensional codebook; the first codebook, or where more cells
    are wanted than it can have words the first two together, also names cells."""

    books: list[np.ndarray]
    second: int = 1  # cells that share a word of the first codebook: 1, or the words of the second

    @classmethod
    def train(cls, x: np.ndarray, cells: int, levels: int = 6, words: int = 128, rounds: int = 8, seed: int = 7, first: int = 4096) -> "AdditiveQuantiser":
        """Each codebook is fitted to what the codebooks before it leave of the sample. The first has ``cells``
        words, but if that is more than ``first`` or a quarter of the sample, a ``words``-th of it."""
        second = 1 if cells <= min(first, max(4, len(x) // 4)) else words
        rng, books, rest = np.random.default_rng(seed), [], x.astype(np.float32)
        for level in range(levels):
            books.append(kmeans(rest, max(2, cells // second) if level == 0 else words, rounds, rng))
            rest = rest - books[-1][nearest(rest, books[-1])]
        return cls(books, second)

    def cells(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0] * self.second + (codes[:, 1] if self.second > 1 else 0)

    def encode(self, x: np.ndarray, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Codes (one column per codebook) of the best of ``beam`` sums, and the squared length of that sum."""
        n = len(x)
        rest, err, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.int32)
        rows = np.arange(n)[:, None]
        for book in self.books:
            b = rest.shape[1]
            # |rest - word|^2 up to |rest|^2, which is the path's error so far
            d = (book * book).sum(1)[None, None, :] - 2 * (rest.reshape(n * b, -1) @ book.T).reshape(n, b, -1) + (rest * rest).sum(2)[:, :, None]
            flat = d.reshape(n, -1)
            keep = np.argpartition(flat, min(beam, flat.shape[1]) - 1, 1)[:, :beam] if flat.shape[1] > beam else np.tile(np.arange(flat.shape[1]), (n, 1))
            path, word = keep // len(book), keep % len(book)
            rest, err = rest[rows, path] - book[word], flat[rows, keep]
            codes = np.concatenate([codes[rows, path], word[:, :, None]], 2)
        best = err.argmin(1)
        return codes[np.arange(n), best], ((x - rest[np.arange(n), best]) ** 2).sum(1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells whose sums of words are nearest, for each row."""
        c = self.books[0]
        s = x @ c.T - (c * c).sum(1) / 2
        if self.second == 1:
            return np.argpartition(-s, n - 1, 1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
        b, wide = self.books[1], min(len(c), 2 * n)
        near = np.argpartition(-s, wide - 1, 1)[:, :wide] if wide < len(c) else np.tile(np.arange(len(c)), (len(x), 1))
        # closeness to word + second word, up to the length of x: s of the word, and the rest's to the second
        both = np.take_along_axis(s, near, 1)[:, :, None] + (x @ b.T)[:, None, :] - (c[near] @ b.T) - (b * b).sum(1) / 2
        flat = both.reshape(len(x), -1)
        n = min(n, flat.shape[1])
        top = np.argpartition(-flat, n - 1, 1)[:, :n]
        return np.take_along_axis(near, top // len(b), 1) * self.second + top % len(b)


def _unpack(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.tolist()), dtype=np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key``, v (binary, float32): without vectors that are null, of another length, all zero, or hold null, NaN or infinity."""
    v = F.col(vector)
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    good = df.where(v.isNotNull() & (F.size(v) == dim)).select(F.col(key).alias("id"), v.cast("array<float>").alias("e"), total.alias("q")).where("id is not null and q > 0 and q < double('infinity')")

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            if len(p):
                m = np.ascontiguousarray(np.stack(p["e"].to_numpy()).astype(np.float32))
                yield pd.DataFrame({"id": p["id"], "v": [r.tobytes() for r in m]})

    return good.select("id", "e").mapInPandas(pack, "id string, v binary")


def nearest_neighbours(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, probes: int = 12, shortlist: int = 32, queries: str | None = None,
                       levels: int = 6, words: int = 128, beam: int = 4, sample: int = 16_384, block: int = 4_096, copies: bool = True, first: int = 4096) -> DataFrame:
    """id_a, id_b, cosine, rank: the ``k`` most similar other vectors (id_b) of every vector (id_a).

    Codebooks are fitted on a sample read on the driver, the vectors whose hash is under a bound that lets about
    ``sample`` of them through, whatever the size of the table; every vector is indexed. There are about 2 * sqrt(n)
    cells: the words of the first codebook, or beyond ``first`` of them its pairs with words of the second. A query
    looks at the ``probes`` cells nearest to it; there all members are scored by table lookup (query times codeword,
    summed over the codebooks, divided by the stored length of the sum), and the best ``shortlist`` are ranked
    by their exact cosine. ``queries``: SQL condition on id for the vectors that ask; by default all do.

    Exact copies are searched once: of each group of equal vectors only the k + 1 least ids are indexed, which is
    all that any list can hold, as ties go to the smaller id; the other copies ask, if they ask, as their group
    does (``copies`` = False leaves their lists out). Cells are split into blocks of at most about ``block`` members and ``block`` queries, so a hot cell costs
    more tasks, not larger ones. An empty table, or one without usable vectors, gives an empty result. Fewer than
    k other vectors give shorter lists.
    """
    from forgeline.session import cut

    spark = df.sparkSession
    schema = "id_a string, id_b string, cosine double, rank int"
    vecs = usable(df, key, vector, dim).withColumn("h", F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit("copy")).alias("b")))
    # Spark limits each group before the shuffle, so copies never meet in one task; written once, read three times
    few = cut(vecs.withColumn("c", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("c") <= k + 1))
    n = few.count()
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, sample / n)
    head = few.where(F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 40)) < int(share * (1 << 40)) + 1).select("v").toPandas()
    if not len(head):  # a handful of vectors of which the bound let none through
        head = few.limit(64).select("v").toPandas()
    cells = 1 << max(2, round(math.log2(2 * math.sqrt(n))))
    probes = min(probes, cells)
    aq = AdditiveQuantiser.train(_unit(_unpack(head["v"], dim)).astype(np.float32), cells, levels, words, first=first)
    shared = spark.sparkContext.broadcast(aq)  # (first + levels * words) * dim floats: under 2 MB, whatever the data

    def index(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for p in it:
            for i in range(0, len(p), 2048):
                s = p.iloc[i : i + 2048]
                x = _unit(_unpack(s["v"], dim)).astype(np.float32)
                codes, norm = q.encode(x, beam)
                near = q.probes(x, probes)
                yield pd.DataFrame({"id": s["id"], "v": s["v"], "cell": q.cells(codes), "codes": [r.tobytes() for r in codes[:, 1:].astype(np.uint8)], "norm": np.sqrt(np.maximum(norm, 1e-12)), "near": list(near)})

    coded = cut(few.select("id", "v").mapInPandas(index, "id string, v binary, cell int, codes binary, norm float, near array<int>"))
    ask = coded.where(queries) if queries else coded
    # one row per cell, which is about 2 * sqrt(n) rows of 16 bytes
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    asks = ask.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    blocks = lambda c: F.ceil(F.coalesce(c, F.lit(1)) / block).cast("int")
    plan = cut(sizes.join(asks, "cell", "left").select("cell", blocks(F.col("n")).alias("mb"), blocks(F.col("m")).alias("qb")))
    members = coded.join(F.broadcast(plan), "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("mb")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), "id", "v", "codes", "norm")
    asking = (
        ask.select("id", "v", F.explode("near").alias("cell"))
        .join(F.broadcast(plan), "cell")
        .select("cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(F.xxhash64("id"), F.col("qb")).cast("int").alias("q"), "id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"))
    )

    def search(key_: tuple, p: pd.DataFrame) -> pd.DataFrame:
        is_member = p["codes"].notna().to_numpy()
        mem, ask_ = p[is_member], p[~is_member]
        if not len(mem) or not len(ask_):
            return pd.DataFrame({"id_a": [], "id_b": [], "cosine": []}).astype({"id_a": str, "id_b": str, "cosine": float})
        aq_ = shared.value
        mv, mid = _unit(_unpack(mem["v"], dim)), mem["id"].to_numpy()
        codes = np.frombuffer(b"".join(mem["codes"].tolist()), np.uint8).reshape(len(mem), -1)
        norm, out = mem["norm"].to_numpy(), []
        r = min(shortlist, len(mem))
        for i in range(0, len(ask_), 512):
            part = ask_.iloc[i : i + 512]
            qv = _unit(_unpack(part["v"], dim))
            q32 = qv.astype(np.float32)
            score = np.repeat((q32 @ aq_.books[0][key_[0] // aq_.second])[:, None], len(mem), 1)
            for level, book in enumerate(aq_.books[1:]):
                score += (q32 @ book.T)[:, codes[:, level]]
            score /= norm
            top = np.argpartition(-score, r - 1, 1)[:, :r] if r < len(mem) else np.tile(np.arange(r), (len(part), 1))
            exact = np.einsum("qd,qrd->qr", qv, mv[top])
            ids = part["id"].to_numpy()
            exact = np.where(mid[top] == ids[:, None], -2.0, np.round(exact, 9))
            kk = min(k, r)
            order = np.argsort(-exact, 1, kind="stable")[:, : kk + k]
            row = np.repeat(np.arange(len(part)), order.shape[1])
            col = order.ravel()
            c = exact[row, col]
            ok = c > -2
            out.append(pd.DataFrame({"id_a": ids[row][ok], "id_b": mid[top[row, col]][ok], "cosine": c[ok]}))
        return pd.concat(out)

    found = members.unionByName(asking).groupBy("cell", "m", "q").applyInPandas(search, "id_a string, id_b string, cosine double")
    best = W.partitionBy("id_a").orderBy(F.col("cosine").desc(), "id_b")
    lists = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    lists = lists.select("id_a", "id_b", "cosine", "rank")
    if not copies:
        return lists
    # copies beyond the k + 1 least ids of their group: the k least ids of the group are their list
    more = few.where(F.col("c") == k + 1).select("h")
    rest = vecs.select("id", "h").join(few.select("id"), "id", "left_anti")
    rest = rest.where(queries) if queries else rest
    # a vector may be that of a third of all rows: its rows are spread over 32 parts, its short list is repeated
    lists_of = few.where(F.col("c") <= k).join(more, "h").select("h", F.col("id").alias("id_b"), F.col("c").alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("s"))
    spread = rest.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(32)).cast("int")).join(lists_of, ["h", "s"])
    return lists.unionByName(spread.select(F.col("id").alias("id_a"), "id_b", F.lit(1.0).alias("cosine"), "rank"))


def mutual_neighbours(df: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.95, **kw) -> DataFrame:
    """id_a < id_b: each is among the other's ``k`` most similar, and their cosine is at least ``least``."""
    # lists of copies beyond the k + 1 least ids hold nobody who has them in theirs
    close = nearest_neighbours(df, key, vector, k, copies=False, **kw).where(F.col("cosine") >= least)
    return (
        close.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = 2")
        .select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
    )

"""Mixing sources to target weights."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeline.session import cut, small

#: Ranks of a public byte-level BPE; every worker must have the file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before byte pairs are merged, as published with that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """One encoder per process and vocabulary file."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("forgeline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def source_key(c: str = "source") -> F.Column:
    return F.lower(F.btrim(F.coalesce(F.col(c), F.lit(""))))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document; null text has none."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for p in it:
            yield pd.DataFrame({"doc_id": p["doc_id"], "source": p["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in p["text"]]})

    return documents.select("doc_id", source_key().alias("source"), "text").mapInPandas(count, "doc_id long, source string, tokens long")


#: As total_tokens: as many tokens as all documents have.
CORPUS = "corpus"


def rates(counts: DataFrame, targets: DataFrame, total_tokens: float | str | None = None) -> DataFrame:
    """source, target_share, max_repeats, docs, tokens, rate: how often each document of a source is used on average.

    Without ``total_tokens`` the whole is as large as it can be with every share met: the least over the sources
    of max_repeats * tokens / target_share. With it, a source that is too small for its share is used max_repeats
    times and falls short; ``CORPUS`` asks for as many tokens as all documents have. A source without tokens, or with max_repeats 0, cannot be met and does not shrink the
    whole; its rate is 0. Targets of one source in several spellings add up, with the least max_repeats.
    """
    want = targets.select(source_key().alias("source"), "target_share", "max_repeats").where("source <> '' and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    have = counts.where("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    both = want.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    room = F.col("max_repeats") * F.col("tokens")
    if total_tokens is None:
        # a window over the few sources
        both = both.withColumn("whole", F.min(F.when(room > 0, room / F.col("target_share"))).over(W.partitionBy(F.lit(0))))
    else:
        if total_tokens == CORPUS:
            total_tokens = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        both = both.withColumn("whole", F.lit(float(total_tokens)))
    exact = F.when(room > 0, F.least(F.col("max_repeats").cast("double"), F.col("target_share") * F.col("whole") / F.col("tokens"))).otherwise(0.0)
    return both.select("source", "target_share", "max_repeats", "docs", "tokens", exact.alias("rate"))


def settled(plan: DataFrame, most: int = 100_000) -> DataFrame:
    """The plan as rows of the driver, broadcast by their counted size, if it has at most ``most`` sources.

    Documents then meet it in a broadcast join and are not shuffled by source, of which there are few and large ones.
    """
    rows = plan.limit(most + 1).collect()
    return small(plan.sparkSession, rows, plan.schema) if len(rows) <= most else plan


def copies(counts: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, tokens, copies: floor(rate), and one more with the probability of the fraction.

    The draw is a hash of the seed and the document, so it does not depend on partitions or runs.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / float(1 << 52)
    whole = F.floor("rate")
    n = F.least(whole + (u < F.col("rate") - whole).cast("long"), F.col("max_repeats").cast("long"))
    return counts.where("tokens > 0").join(plan.select("source", "rate", "max_repeats"), "source").select("doc_id", "source", "tokens", n.alias("copies")).where("copies > 0")


def mixed(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, copy (1, 2, ...): the chosen mix, one row per use of a document."""
    counts = cut(token_counts(documents, vocabulary))
    return copies(counts, settled(rates(counts, targets, total_tokens))).select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, vocabulary: str = VOCABULARY, tolerance: float = 0.01) -> DataFrame:
    """Per source: target and actual share, tokens and documents before and in the mix, rate, and whether it is met.

    met: the actual share is within ``tolerance`` (absolute) of the target.
    """
    counts = cut(token_counts(documents, vocabulary))
    plan = settled(rates(counts, targets, total_tokens))
    got = copies(counts, plan).groupBy("source").agg(F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("tokens")).alias("mix_tokens"))
    both = plan.join(got, "source", "left").withColumns({"uses": F.coalesce("uses", F.lit(0)), "mix_tokens": F.coalesce("mix_tokens", F.lit(0))})
    share = F.coalesce(F.col("mix_tokens") / F.nullif(F.sum("mix_tokens").over(W.partitionBy(F.lit(0))), F.lit(0)), F.lit(0.0))
    return both.select("source", "target_share", "max_repeats", "docs", "tokens", "rate", "uses", "mix_tokens", share.alias("actual_share"), (F.abs(share - F.col("target_share")) <= tolerance).alias("met"))

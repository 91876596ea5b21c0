"""Text cut off by field limits or in transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeline.session import cut, sequence_uploads, text

#: What a transfer leaves behind a cut.
MARKS = "(?:\\.\\.\\.|…|�)+$"
END, TAB = "\x01", "\x02"


def _clean(c: Column) -> Column:
    """Upper case, marks of a cut and outer blanks removed, no blanks around anything but letters, digits as 0."""
    s = F.rtrim(F.regexp_replace(F.rtrim(F.upper(text(c))), MARKS, ""))
    return F.translate(F.regexp_replace(s, r"\s*([^\p{Lu}\s]+|\s)\s*", "$1"), "123456789", "000000000")


def _ending(c: Column) -> Column:
    """The last word with the character in front of it; empty if the text does not end in a letter."""
    return F.regexp_extract(F.right(c, F.lit(48)), r"([^\p{Lu}]?\p{Lu}+)$", 1)


def _long(rows: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    return rows.select(*keep, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields])).alias("x")).select(*keep, "x.field", "x.t").where("t is not null and t <> ''")


def length_limits(texts: DataFrame, source: str = "source_system", reach: int = 3, alpha: float = 0.01, min_rows: int = 20) -> DataFrame:
    """source, field, n: lengths at which texts of a source stop significantly more often than at the neighbours.

    The hazard of length n is the share of the texts of at least n characters that end at n. Each is tested
    against the pooled hazard of the ``reach`` lengths on either side (window functions over the counts); the
    probability of so great an excess is bounded by Chernoff's inequality, and false discoveries are held under
    ``alpha`` by Benjamini and Hochberg's procedure over all lengths of all sources. Lengths with fewer than
    ``min_rows`` texts are not tested. Only counts per length are sorted, never texts.
    """
    # snapshots repeat their texts: only different ones are independent evidence
    different = texts.select(F.col(source).alias("source"), "field", F.length("t").alias("n"), F.xxhash64("t").alias("h")).distinct()
    counts = different.groupBy("source", "field", "n").agg(F.count(F.lit(1)).alias("c"))
    by = W.partitionBy("source", "field").orderBy("n")
    at_risk = counts.withColumn("risk", F.sum("c").over(by.rowsBetween(0, W.unboundedFollowing)))
    near = by.rangeBetween(-reach, reach)
    h = at_risk.withColumn("oc", F.sum("c").over(near) - F.col("c")).withColumn("orisk", F.sum("risk").over(near) - F.col("risk"))
    p1, p0 = F.col("c") / F.col("risk"), (F.col("oc") + 1) / (F.col("orisk") + 2)
    kl = p1 * F.log(p1 / p0) + F.when(p1 < 1, (1 - p1) * F.log((1 - p1) / (1 - p0))).otherwise(0.0)
    tested = h.where(F.col("c") >= min_rows).withColumn("logp", F.when((p1 > p0) & (p0 < 1), -F.col("risk") * kl).otherwise(0.0))
    everything = W.partitionBy(F.lit(0))
    ranked = tested.withColumn("k", F.row_number().over(everything.orderBy("logp", "source", "field", "n"))).withColumn("m", F.count(F.lit(1)).over(everything))
    last = ranked.withColumn("cut", F.max(F.when(F.col("logp") <= F.log(F.col("k") * alpha / F.col("m")), F.col("k"))).over(everything))
    return last.where("k <= cut").select("source", "field", "n")


def broken_endings(texts: DataFrame) -> DataFrame:
    """field, ending, strength: last words that are beginnings of other words rather than words.

    Over all texts, each word is counted together with the character in front of it (so that a unit behind a
    number, a value behind a colon and a word in a phrase are told apart), as inner word and as ending. An ending
    is broken if longer inner words begin with it, and it is itself hardly ever an inner word: seldom compared
    with how often it ends a text and how often the longer words occur. strength: 2 below a tenth, 1 below half.
    Everything after the first partial aggregation is as long as the vocabulary.
    """
    c = texts.select("field", _clean(F.col("t")).alias("c"))
    words = F.regexp_extract_all("c", F.lit(r"[^\p{Lu}]?\p{Lu}+"), F.lit(0))
    ends = F.when(F.col("c").rlike(r"\p{Lu}$"), F.array(F.concat(F.lit(END), _ending(F.col("c"))))).otherwise(F.array().cast("array<string>"))
    seen = c.select("field", F.explode(F.concat(words, ends)).alias("w")).groupBy("field", "w").agg(F.count(F.lit(1)).alias("n"))
    is_end = F.col("w").startswith(END)
    # as long as the vocabulary; read several times below, so the texts are read once for it
    vocab = cut(
        seen.groupBy("field", F.ltrim("w", F.lit(END)).alias("w"))
        .agg(F.sum(F.when(is_end, 0).otherwise(F.col("n"))).alias("total"), F.sum(F.when(is_end, F.col("n")).otherwise(0)).alias("ends"))
        .select("field", "w", F.greatest(F.col("total") - F.col("ends"), F.lit(0)).alias("inner"), "ends")
    )
    # where no longer word stands behind the same character, words behind any other decide
    bare = F.regexp_replace("w", r"^[^\p{Lu}]", "")
    anywhere = vocab.groupBy("field", bare.alias("w")).agg(F.sum("inner").alias("inner"), F.sum("ends").alias("ends"))
    own, general = _strength(vocab), _strength(anywhere).select("field", F.col("w").alias("bare"), F.col("strength").alias("general"))
    rated = vocab.where("ends > 0").select("field", "w", bare.alias("bare")).join(own, ["field", "w"], "left").join(general, ["field", "bare"], "left")
    return rated.select("field", F.col("w").alias("ending"), F.coalesce("strength", F.when(F.col("general") == 2, 2)).alias("strength")).where("strength > 0")


def _strength(vocab: DataFrame) -> DataFrame:
    """field, w, strength of the endings that begin longer inner words (0 if they are words themselves)."""
    starts = (
        vocab.where("inner > 0")
        .select("field", "inner", F.explode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring("w", F.lit(1), i))).alias("p"), "w")
        .where("p <> w")
        .groupBy("field", F.col("p").alias("w"))
        .agg(F.max("inner").alias("longer"))
    )
    least = F.least("ends", "longer")
    return vocab.where("ends > 0").join(starts, ["field", "w"]).select("field", "w", F.when(F.col("inner") <= 0.1 * least, 2).when(F.col("inner") <= 0.5 * least, 1).otherwise(0).alias("strength"))


def truncated(rows: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """``key``, field, source, n, at_limit of every text that breaks off.

    First the lengths at which a source cuts (``length_limits``), then the incomplete endings. A text breaks off
    if it ends in a broken word, strong evidence being asked for away from such lengths; behind the colon or
    equals sign of a label; behind a fraction stroke; or at the replacement character of a torn transfer. Null
    and empty texts are not cut.
    """
    texts = _long(rows, [key, source], fields)
    limits = length_limits(texts, source).withColumn("at_limit", F.lit(True))
    broken = broken_endings(texts)
    t = texts.select(key, source, "field", F.length("t").alias("n"), F.right("t", F.lit(64)).alias("tail"))
    t = t.withColumn("c", _clean(F.col("tail"))).withColumn("torn", F.rtrim("tail").rlike("�$"))
    t = t.select(key, source, "field", "n", (F.col("torn") | F.col("c").rlike(r"([:=]|\p{Lu}-|\d/)$")).alias("open"), F.nullif(_ending(F.col("c")), F.lit("")).alias("ending"))
    # most texts end in a full stop or a number: only the others meet the vocabulary
    t = t.where("open or ending is not null")
    found = t.join(broken, ["field", "ending"], "left").where("open or strength is not null")
    found = found.join(limits.withColumnsRenamed({"source": source}), [source, "field", "n"], "left")
    return found.where(F.col("open") | (F.col("strength") == 2) | F.col("at_limit")).select(key, "field", source, "n", F.coalesce("at_limit", F.lit(False)).alias("at_limit"))


FIELDS = ["short_description", "long_description"]


def _with_source(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    """Rows of uploads that are not listed stay, with an empty source."""
    rows = materials.select("id", "upload_id", *FIELDS)
    return rows.join(sequence_uploads(uploads).select("upload_id", "source_system"), "upload_id", "left").withColumn("source_system", text("source_system"))


def cut_lengths(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    """source, field, n: the field limits that the length hazards show."""
    return length_limits(_long(_with_source(materials, uploads), ["source_system"], FIELDS))


def cut_materials(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    return truncated(_with_source(materials, uploads), "id", "source_system", FIELDS).select("id", "field")


def cut_rates(materials: DataFrame, uploads: DataFrame) -> DataFrame:
    """source_system, field, texts, cut, cut_at_limit, share."""
    rows = _with_source(materials, uploads)
    texts = _long(rows, ["source_system"], FIELDS).groupBy("source_system", "field").agg(F.count(F.lit(1)).alias("texts"))
    found = truncated(rows, "id", "source_system", FIELDS).groupBy("source_system", "field").agg(F.count(F.lit(1)).alias("cut"), F.count_if("at_limit").alias("cut_at_limit"))
    n = F.coalesce("cut", F.lit(0))
    return texts.join(found, ["source_system", "field"], "left").select("source_system", "field", "texts", n.alias("cut"), F.coalesce("cut_at_limit", F.lit(0)).alias("cut_at_limit"), (n / F.col("texts")).alias("share"))

"""Evaluation texts leaking into training text.

Template windows are three words in order of which none, the second or the third may be one word further on, so a
passage that keeps three fifths of an item's words shares windows with it however the other words are spread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forgeline.session import cut

# Words that count as units of measurement.
UNITS = ["mm", "cm", "m", "metre", "metres", "millimetre", "millimetres", "inch", "inches", "in", "ft", "feet", "bar", "psi", "kpa", "mpa", "kg", "g", "lb", "lbs", "degree", "degrees", "percent", "litre", "litres", "micron", "microns", "hertz", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years"]


#: Codes of the typed placeholders among the hashed words.
NUMBER, UNIT = 1, 2
#: How far the second and the third word of a window are from its first.
REACHES = [(1, 2), (1, 3), (2, 3), (2, 4)]


def raw_words(text: Column) -> Column:
    """Words in order and as they are written, whatever the punctuation, spacing, line breaks and markup.

    Markup, quotation marks of mail and invisible characters go; words broken at a line end are joined again, and
    hyphens within words do not count.
    """
    # each pattern runs only over texts with a character that it needs
    t = F.when(text.contains("<") | text.contains("&"), F.regexp_replace(text, r"<[^<>]{1,200}>|&[A-Za-z]{2,8};|&#\d{1,6};", " ")).otherwise(text)
    t = F.when(F.octet_length(text) > F.char_length(text), F.regexp_replace(t, "[\u00ad\u200b-\u200f\u2060\ufeff]", "")).otherwise(t)
    t = F.when(text.contains("-") | text.contains("‐"), F.regexp_replace(t, r"(?<=\p{L})[-‐](?:\s*[\r\n]+[>|\s]*)?(?=\p{L})", "")).otherwise(t)
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def template(words: Column) -> Column:
    """One number per word: placeholders for words with a digit and for units, else the hash of the word in lower case."""

    def code(w: Column) -> Column:
        low = F.lower(w)
        return F.when(w.rlike(r"\p{N}"), F.lit(NUMBER).cast("long")).when(low.isin(UNITS), F.lit(UNIT).cast("long")).otherwise(F.xxhash64(low))

    return F.transform(words, code)


def windows(df: DataFrame, keep: list[str], codes: str) -> DataFrame:
    """``keep``, h, pos: the windows of each row's words. Windows of placeholders only say nothing and are left out."""
    c, n = F.col(codes), F.size(codes)
    after = [F.slice(c, k + 1, F.greatest(n, F.lit(1))).alias(f"c{k}") for k in range(REACHES[-1][1] + 1)]
    # the neighbours of each word as columns of its row: everything behind is compiled code
    rows = df.where(n > 2).select(*keep, F.posexplode(F.arrays_zip(*after)).alias("pos", "z")).select(*keep, "pos", "z.*")

    def window(a: int, b: int) -> Column:
        x, y, z = F.col("c0"), F.col(f"c{a}"), F.col(f"c{b}")
        words = z.isNotNull() & ~(x.isin(NUMBER, UNIT) & y.isin(NUMBER, UNIT) & z.isin(NUMBER, UNIT))
        return F.when(words, F.xxhash64(x, y, z))

    return rows.select(*keep, "pos", F.explode(F.array(*[window(a, b) for a, b in REACHES])).alias("h")).where("h is not null")


def longest_common(item_bits: dict[str, int], n: int, words: list[str]) -> int:
    """Length of the longest common subsequence with an item of ``n`` words, given as bit positions of each word."""
    full = (1 << n) - 1
    row = full
    for w in words:
        m = item_bits.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def passage_length(n):
    """Words of the longest passage that is looked at for an item of ``n`` words: a quarter more, and five."""
    return F.floor(n * 1.25).cast("int") + 5 if isinstance(n, Column) else int(n * 1.25) + 5


def best_passage(item: list[str], doc: list[str], last: int | None = None) -> tuple[float, int]:
    """Greatest share of the item's words that stand in order in one passage, and where the passage begins.

    Passages begin in steps of an eighth of the item up to the word ``last``, by default everywhere.
    """
    n = len(item)
    bits: dict[str, int] = {}
    for i, w in enumerate(item):
        bits[w] = bits.get(w, 0) | 1 << i
    length, best, where = passage_length(n), 0, 0
    for s in range(0, min(len(doc), last + 1 if last is not None else len(doc)), max(1, n // 8)):
        c = longest_common(bits, n, doc[s : s + length])
        if c > best:
            best, where = c, s
    return best / n, where


NAME = re.compile(r"[^\W\d_]{3,}")


def slots(raw: list[str], names: set[str]) -> list[str]:
    """Words in lower case with typed placeholders: # for words with a digit, % for units, @ for names.

    Names are words in capitals, unless most words are, and the words in ``names``.
    """
    capitals = [bool(NAME.fullmatch(w)) and w.isupper() for w in raw]
    if 2 * sum(capitals) > len(raw):
        capitals = [False] * len(raw)
    out = []
    for w, c in zip(raw, capitals):
        low = w.lower()
        out.append("#" if any(x.isnumeric() for x in w) else "%" if low in _UNITS else "@" if c or low in names else low)
    return out


_UNITS = set(UNITS)


def consistent_slots(item: list[str], item_t: list[str], doc: list[str], doc_t: list[str]) -> bool:
    """Whether, in the alignment of the templates, each value of a slot of the item stands for one value in the text."""
    to: dict[str, str] = {}
    for a, b, n in SequenceMatcher(None, item_t, doc_t, autojunk=False).get_matching_blocks():
        for k in range(n):
            if item_t[a + k] in "#%@" and to.setdefault(item[a + k], doc[b + k]) != doc[b + k]:
                return False
    return True


def once(c: Column) -> Column:
    """A generator of one row: what it holds is computed once, not again for each element of a later lambda."""
    return F.explode(F.array(c))


def bounded(df: DataFrame, size: Column, most: int) -> DataFrame:
    """A broadcast hint if the sum of ``size`` over the rows is at most ``most``; else the plain side of a shuffled join."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def item_windows(icoded: DataFrame, hits: int) -> DataFrame:
    """item_id, n, h, bit, need: the windows of the items that are looked for, and how many positions must have one.

    Where an item keeps three fifths of its n words and the rest is exchanged word for word, at least n/5 - 2 of its
    positions begin a window that is still there: fewer than n/5 gaps can be of three words or more, and each breaks
    two windows. One less than that is relied on. So of an item's positions, put in order of how many items their
    windows stand in, all but the last few are enough: the rarest N - relied + ``need`` of N must hold ``need`` that
    are still there. That leaves out the windows of the most common words, and loses nothing. bit: the position, in
    items of more than 128 words the 128th part of the item that it lies in, which lowers ``need`` accordingly.
    """
    all_ = windows(icoded, ["item_id", "n"], "ic")
    often = all_.groupBy("h").agg(F.count_distinct("item_id").alias("df"))
    weight = all_.join(often, "h").groupBy("item_id", "n", "pos").agg(F.sum("df").alias("w"))
    order = W.partitionBy("item_id").orderBy("w", "pos")
    n, held = F.col("n"), F.count(F.lit(1)).over(W.partitionBy("item_id"))
    ranked = weight.select("item_id", "n", "pos", F.row_number().over(order).alias("r"), held.alias("held"))
    relied = F.greatest(F.lit(1), F.floor(n / 5) - 3 - (n - 2 - F.col("held")))
    need = F.least(F.lit(hits), relied)
    kept = ranked.where(F.col("r") <= F.col("held") - relied + need)
    part = F.ceil(n / 128)
    kept = kept.select("item_id", "pos", F.floor(F.col("pos") / part).cast("int").alias("bit"), F.ceil(need / part).cast("int").alias("need"))
    return all_.join(kept, ["item_id", "pos"]).select("item_id", "n", "h", "bit", "need")


def leaks(documents: DataFrame, items: DataFrame, least: float = 0.6, least_template: float = 0.85, hits: int = 6, short: int = 15, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, share, kind of every document with a passage of an item; one row per pair.

    Numbers and units of both sides become typed placeholders, and windows of these templates (see the module) are
    joined by hash. Hits are counted per stretch of a document of two passage lengths, every passage lying within
    one; stretches with too few different positions of the item (see ``item_windows``, at most ``hits``) go. Items
    of fewer than ``short`` words, of which no window need be left, are found by their single words instead. The
    remaining stretches are checked on the texts: kind is "verbatim" if at least ``least`` of the item's words stand
    in order in one passage, else "re-parameterised" if ``least_template`` of its template, names in capitals being
    placeholders too, does and every slot value was exchanged consistently.

    Null and empty texts leak nothing. Items with the same text each leak. The items' side is broadcast if its
    counted size is at most ``broadcast_bytes``, and joined by a shuffle beyond that.
    """
    it = items.where("item_id is not null and text is not null").select("item_id", once(raw_words(F.col("text"))).alias("iw"))
    it = it.where(F.size("iw") > 0).select("item_id", "iw", F.size("iw").alias("n"))
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    coded = docs.select("doc_id", once(raw_words(F.col("text"))).alias("dw")).select("doc_id", once(template(F.col("dw"))).alias("dc"))
    coded = coded.select("doc_id", "dc", F.size("dc").alias("m"))
    # the items' side is read twice, for its size and for the join
    icoded = it.select("item_id", "n", template(F.col("iw")).alias("ic"))
    iwin = cut(item_windows(icoded.where(F.col("n") >= short), hits))

    def stretches(found: DataFrame) -> DataFrame:
        """Stretch k of a document holds the words from the k-th passage length on; the last begins one before its end."""
        length = passage_length(F.col("n"))
        at = F.floor(F.col("pos") / length).cast("int")
        parts = F.when(at == 0, F.array(at)).when((at + 1) * length >= F.col("m"), F.array(at - 1)).otherwise(F.array(at - 1, at))
        one = F.lit(1).cast("long")
        low = F.when(F.col("bit") < 64, F.call_function("shiftleft", one, F.col("bit"))).otherwise(one - one)
        high = F.when(F.col("bit") < 64, one - one).otherwise(F.call_function("shiftleft", one, F.col("bit") - 64))
        both = found.select("doc_id", "item_id", "n", "need", low.alias("low"), high.alias("high"), F.explode(parts).alias("part"))
        seen = both.groupBy("doc_id", "item_id", "n", "need", "part").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high"))
        return seen.where(F.bit_count("low") + F.bit_count("high") >= F.col("need")).select("doc_id", "item_id", "n", "part")

    row = F.lit(40)
    pairs = stretches(windows(coded, ["doc_id", "m"], "dc").join(bounded(iwin, row, broadcast_bytes), "h"))
    few = icoded.where(F.col("n") < short)
    if few.limit(1).count():
        iwords = few.select("item_id", "n", F.posexplode("ic").alias("bit", "h"), F.ceil(F.col("n") * least - 1e-9).cast("int").alias("need"))
        dwords = coded.select("doc_id", "m", F.posexplode("dc").alias("pos", "h"))
        pairs = pairs.unionByName(stretches(dwords.join(bounded(iwords, row, broadcast_bytes), "h")))
    length = passage_length(F.col("n"))
    found = pairs.join(docs, "doc_id").join(bounded(it.drop("n"), F.lit(24) + F.length(F.array_join("iw", " ")) * 4, broadcast_bytes), "item_id")
    ready = found.select("doc_id", "item_id", "iw", (F.col("part") * length).alias("begin"), length.alias("length"), once(raw_words(F.col("text"))).alias("dw"))
    # as one text each, which Arrow carries faster than lists
    ready = ready.select("doc_id", "item_id", F.array_join("iw", " ").alias("iw"), F.array_join(F.slice("dw", F.col("begin") + 1, F.col("length") * 2), " ").alias("dw"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}  # the items of this partition
        for p in batches:
            rows = []
            for doc_id, item_id, it_, dw in p[["doc_id", "item_id", "iw", "dw"]].itertuples(index=False):
                if it_ not in known:
                    iw = it_.split(" ")
                    il, item_t = [w.lower() for w in iw], slots(iw, set())
                    known[it_] = il, item_t, frozenset(w for w, t in zip(il, item_t) if t not in "#%@"), frozenset(w for w, t in zip(il, item_t) if t in "#%@")
                il, item_t, plain, slotted = known[it_]
                dl = dw.lower().split(" ")
                words, n, length = set(dl), len(il), passage_length(len(il))
                # each different word that is missing takes one from the share
                missing = sum(w not in words for w in plain)
                if missing > n * (1 - least):
                    continue
                if missing + sum(w not in words for w in slotted) <= n * (1 - least) + 1e-9:
                    share, _ = best_passage(il, dl, length)
                    if share >= least - 1e-9:
                        rows.append((doc_id, item_id, round(share, 4), "verbatim"))
                        continue
                if missing > n * (1 - least_template) + 1e-9:
                    continue
                doc_t = slots(dw.split(" "), {w for w, t in zip(il, item_t) if t == "@"})
                t_share, at = best_passage(item_t, doc_t, length)
                if t_share >= least_template and consistent_slots(il, item_t, dl[at : at + length], doc_t[at : at + length]):
                    rows.append((doc_id, item_id, round(t_share, 4), "re-parameterised"))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "kind"])

    checked = ready.mapInPandas(check, "doc_id long, item_id long, share double, kind string")
    best = F.max(F.struct((F.col("kind") == "verbatim").alias("v"), "share", "kind")).alias("b")
    return checked.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.share", "b.kind")

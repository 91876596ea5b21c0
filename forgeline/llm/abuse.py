"""Abusive, hateful or sexual content: a string-kernel support vector machine with Nyström landmarks."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and signs that stand for letters within words.
LOOKALIKES = str.maketrans("асеіорхуѕјһкмнтвгԁԛԝαονι", "aceiopxysjhkmntbrdqwaovi")
STAND_INS = str.maketrans("013457@$!|", "oieastasii")
HIDDEN = re.compile("[­​-‏⁠﻿]")
MARKUP = re.compile(r"<[^<>]{1,80}>|&[a-z]{2,8};")
SPELT = re.compile(r"(?<![^\W\d_])(?:[^\W\d_]([ ._\-*]))(?:[^\W\d_]\1){1,}[^\W\d_](?![^\W\d_])")
MIXED = re.compile(r"[^\W_]*[a-z][^\W_]*[013457@$!|][013457@$!|]*(?=[a-z])[a-z0-9@$!|]*|[@$][a-z]{2,}")
# what every match of MIXED holds
MAYBE_MIXED = re.compile(r"[a-z][0-9]*[013457@$!|]+[a-z]|[@$][a-z]{2}")
COMBINING = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f]+")
SPLIT = re.compile(r"(?<=[.!?;:…])\s+|[\r\n]+|\s*[()\[\]]\s+|\s+[-–—]\s+")


def plain(text: str) -> str:
    """Lower case without accents, hidden characters, markup, look-alikes, stand-ins, spelt-out and drawn-out letters."""
    if "Ã" in text or "Â" in text:
        text = re.sub("(?:[ÃÂ][\u0080-¿])+", lambda m: m[0].encode("latin-1").decode("utf-8", "ignore"), text)
    t = HIDDEN.sub("", text)
    t = MARKUP.sub(" ", t) if "<" in t or "&" in t else t
    t = t.lower()
    if not t.isascii():
        t = COMBINING.sub("", unicodedata.normalize("NFKD", t)).translate(LOOKALIKES).replace("ß", "ss")
    t = SPELT.sub(lambda m: m[0].replace(m[1], ""), t)
    if MAYBE_MIXED.search(t):
        t = MIXED.sub(lambda m: m[0].translate(STAND_INS), t)
    return re.sub(r"([a-z])\1{2,}", r"\1", t)


def pieces(text: str, words: int = 12, step: int = 6) -> list[str]:
    """Sentences and their parts as plain text, numbers as 0, in windows of at most ``words`` words.

    A comma does not end a part: an insult and what goes with it are one statement. Parts under four words (an address, a subject line) are too short to judge alone and join the next.
    """
    out, left = [], ""
    for part in SPLIT.split(plain(text)):
        if not part or not part.strip():
            continue
        w = re.sub(r"\d+(?:[.,/\-]\d+)*", "0", re.sub(r"[^a-z0-9*.,/\-]+", " ", left + " " + part)).split()
        w = [x for x in (y.strip(".,/-") for y in w) if x]
        if len(w) < 4:
            left = " ".join(w)
            continue
        left = ""
        if len(w) <= words:
            out.append(" ".join(w))
        else:
            out += [" ".join(w[i : i + words]) for i in range(0, len(w) - words + step, step)]
    if left:
        out.append(left)
    return [x for x in out if x]


@dataclass(frozen=True)
class Kernel:
    """Gap-weighted subsequences of three and four characters within a short reach, hashed to ``2 ** bits`` features.

    A subsequence counts ``decay`` to the number of characters it skips, so words keep most of their features
    when characters are inserted. Values are divided by the square root of the piece's length.
    """

    bits: int = 16
    reach3: int = 4
    reach4: int = 5
    decay: float = 0.5

    def patterns(self) -> list[tuple[tuple[int, ...], float]]:
        three = [(0, i, j) for j in range(2, self.reach3 + 1) for i in range(1, j)]
        four = [(0, i, j, k) for k in range(3, self.reach4 + 1) for j in range(2, k) for i in range(1, j)]
        return [(p, self.decay ** (p[-1] + 1 - len(p))) for p in three + four]

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, float]]]:
        """Where each text's positions begin, the texts' lengths, and for each pattern the hashed feature of every
        position and its weight. A text has a blank in front and enough behind that no feature reaches another."""
        lens = np.array([len(t) for t in texts])
        pad = " " * (max(self.reach3, self.reach4) + 1)
        joined = np.frombuffer("".join(f" {t}{pad}" for t in texts).encode("ascii", "replace"), np.uint8).astype(np.uint64)
        begin = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        at = np.arange(int((lens + 1).sum())) + np.repeat(np.arange(len(texts)) * len(pad), lens + 1)
        mask = np.uint64((1 << self.bits) - 1)
        mult = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]

        def hashed() -> Iterator[tuple[np.ndarray, float]]:
            chars = {k: joined[at + k] for k in range(len(pad))}
            for p, weight in self.patterns():
                h = np.full(len(at), np.uint64(len(p)))
                for step, off in enumerate(p):
                    h = (h ^ chars[off]) * mult[step]
                    h ^= h >> np.uint64(29)
                yield ((h * mult[0]) >> np.uint64(20)) & mask, weight

        return begin, lens, hashed()

    def project(self, texts: list[str], table: np.ndarray) -> np.ndarray:
        """Sum of the rows of ``table`` over each text's features."""
        begin, lens, hashed = self.features(texts)
        here = np.zeros((int((lens + 1).sum()), *table.shape[1:]), np.float32)  # per position, over all patterns
        for feat, weight in hashed:
            here += table[feat] if weight == 1 else table[feat] * np.float32(weight)
        out = np.add.reduceat(here, begin, axis=0)
        scale = (1 / np.sqrt(np.maximum(lens, 20))).astype(np.float32)
        return out * (scale[:, None] if table.ndim == 2 else scale)

    def table(self, texts: list[str]) -> np.ndarray:
        """Feature values of each text as a column."""
        t = np.zeros((1 << self.bits, len(texts)), np.float32)
        _, lens, hashed = self.features(texts)
        who = np.repeat(np.arange(len(texts)), lens + 1)
        for feat, weight in hashed:
            np.add.at(t, (feat, who), np.float32(weight))
        return t / np.sqrt(np.maximum(lens, 20)).astype(np.float32)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, start: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton's method; the last coefficient is the bias."""
    w = np.zeros(x.shape[1] + 1) if start is None else start.copy()
    reg = np.full(len(w), 1.0)
    reg[-1] = 1e-3
    for _ in range(rounds):
        gap = 1 - y * (x @ w[:-1].astype(np.float32) + w[-1])
        grad, curve = reg * w, np.diag(reg)
        for i in range(0, len(x), 4096):
            a = np.flatnonzero(gap[i : i + 4096] > 0) + i
            xa = np.concatenate([x[a], np.ones((len(a), 1), np.float32)], 1)
            wa = (c * weight[a]).astype(np.float32)
            grad = grad - 2 * (xa.T @ (wa * (y[a] * gap[a]).astype(np.float32))).astype(np.float64)
            curve = curve + 2 * ((xa * wa[:, None]).T @ xa).astype(np.float64)
        step = np.linalg.solve(curve, grad)
        w = w - step
        if np.abs(step).max() < 1e-3 * max(1.0, np.abs(w).max()):
            break
    return w


@dataclass
class Scorer:
    """The machine written out over the hashed features: one weight each, which is exact for a linear method.
    Pieces that judgements show to be ``clean`` score no more than -1 whatever the machine makes of them."""

    kernel: Kernel
    weights: np.ndarray
    bias: float
    threshold: float
    clean: frozenset[str] = frozenset()

    def pieces(self, texts: list[str], block: int = 2000) -> np.ndarray:
        if not texts:
            return np.zeros(0, np.float32)
        return np.concatenate([self.kernel.project(texts[i : i + block], self.weights) for i in range(0, len(texts), block)]) + self.bias

    def documents(self, texts: list[str]) -> np.ndarray:
        """The score of a document is that of its worst piece; -9 without any."""
        parts = [pieces(t) for t in texts]
        flat = [p for ps in parts for p in ps]
        distinct = list(dict.fromkeys(flat))
        value = {p: min(v, -1.0) if p in self.clean else v for p, v in zip(distinct, self.pieces(distinct).tolist())}
        return np.array([max((value[p] for p in ps), default=-9.0) for ps in parts])


def fit_machine(
    texts: list[str], labels: list[int], landmarks: int = 384, c: float = 1.0, rounds: int = 6, seed: int = 3, kernel: Kernel | None = None, folds: int = 4, machines: int = 3
) -> Scorer:
    """Train on documents whose label says whether any statement in them is abusive: 1, 0, or -1 for not judged.

    Pieces are the instances. Pieces that stand in several documents labelled clean, or in five that are not judged,
    and not mostly in abusive ones, are clean; other pieces of documents not judged are taken for clean until they look
    abusive. Instances weigh by how many documents hold them. Of an abusive document the worst piece counts as
    abusive, with the others over the margin, which is decided anew in each round.

    Some judgements are wrong, and a piece that was trained as abusive looks abusive. So each abusive document is
    also scored by a machine that learnt from the other ``folds`` only; one whose worst piece is then no worse than
    usual in clean documents is left out, and so are such further pieces. The more abusive documents there are, the
    more kinds are seen repeatedly and the more this counts. Pieces of a single clean document that lie on the abusive
    side for a machine that did not see them are left out as well.

    Nyström: kernel values against ``landmarks`` pieces, whitened by the inverse root of the landmarks' own kernel
    matrix; after the first rounds the landmarks are chosen again among the pieces near the margin. The result is the
    mean of ``machines`` machines with landmarks of their own.
    Without an abusive or without a clean piece nothing can be learnt, and every score is -1.
    """
    kernel, rng = kernel or Kernel(), np.random.default_rng(seed)
    bags = [list(dict.fromkeys(pieces(t))) for t in texts]
    bad: dict[str, int] = {}
    count: dict[str, int] = {}
    judged: dict[str, int] = {}
    for b, y in zip(bags, labels):
        for p in b:
            if y == 1:
                bad[p] = bad.get(p, 0) + 1
            else:
                count[p] = count.get(p, 0) + 1
                judged[p] = judged.get(p, 0) + (y == 0)
    sure = {p: 0.5 * judged[p] + 0.2 * (n - judged[p]) for p, n in count.items()}
    known = {p for p, v in sure.items() if v >= 0.99 and bad.get(p, 0) <= 4 * v}
    clean = list(count)
    # as most judged documents are clean, a piece of as many clean as abusive ones is no evidence
    bad_bags = [b for b in ([p for p in b if p not in known and bad[p] > judged.get(p, 0)] for b, y in zip(bags, labels) if y == 1) if b]
    suspects = [p for p in dict.fromkeys(p for b in bad_bags for p in b) if p not in count]
    if not suspects or not clean:
        return Scorer(kernel, np.zeros(1 << kernel.bits, np.float32), -1.0, 0.0)
    instances, n_clean = clean + suspects, len(clean)
    times = np.array([count.get(p, 1) for p in instances], float)
    often = np.array([bad.get(p, 1) for p in instances], float)
    once = np.array([p not in known for p in instances])
    at = {p: i for i, p in enumerate(instances)}
    bag_rows = [np.array([at[p] for p in b]) for b in bad_bags]
    single = [r for r in (np.array([at[p] for p in b if p not in known], int) for b, y in zip(bags, labels) if y != 1) if len(r)]
    ends = np.cumsum([0] + [len(r) for r in single])[:-1]
    fold = rng.permutation(len(bag_rows)) % folds  # of an abusive document
    part = np.where(once[:n_clean], rng.integers(0, folds, n_clean), -1)  # of a piece that is not known to be clean
    # what a document's own score counts against that of the other folds' machine, and where the scores of clean
    # documents are cut: with few abusive documents most kinds are seen once, and nothing can be held against them
    own = min(1.0, (140 / len(bag_rows)) ** 0.5)
    cut, cut_further = max(0.0, 1 - (33 / len(bag_rows)) ** 1.2), 1 - own**5
    k1 = min(landmarks // 2, len(suspects))
    likely = rng.permutation(np.arange(n_clean, len(instances)))[:k1]
    common = np.argsort(-times[:n_clean] * rng.random(n_clean))[: landmarks - k1]
    x = table = root = w = None
    norm = 1.0

    def place(rows: np.ndarray) -> None:
        nonlocal x, table, root, norm
        table = kernel.table([instances[i] for i in rows])
        vals, vecs = np.linalg.eigh((table.T @ table).astype(np.float64))
        root = (vecs / np.sqrt(np.maximum(vals, 1e-4 * vals.max()))) @ vecs.T
        x = np.concatenate([kernel.project(instances[i : i + 48], table) for i in range(0, len(instances), 48)]) @ root.astype(np.float32)
        norm = max(float(np.sqrt(np.einsum("ij,ij->i", x, x)).mean()), 1e-9)
        x /= np.float32(norm)

    def place_near(score: np.ndarray, positive: np.ndarray) -> None:
        pos = rng.permutation(np.flatnonzero(positive))[: landmarks // 2]
        neg = np.argsort(-np.where(positive, -np.inf, score))[: min(2 * landmarks, int((~positive).sum()))]
        place(np.concatenate([pos, rng.permutation(neg)[: landmarks - len(pos)]]))

    def fit(positive: np.ndarray, use: np.ndarray, start: np.ndarray | None) -> np.ndarray:
        weight = np.sqrt(np.minimum(times, 50.0))
        ratio = np.clip(np.sqrt(weight[use & ~positive].sum() / max(1, positive[use].sum())), 1, 8)
        weight[positive] = ratio * np.sqrt(often[positive])
        return squared_hinge(x[use], np.where(positive, 1.0, -1.0)[use], weight[use], c, start)

    def marked(rows: list[np.ndarray]) -> np.ndarray:
        m = np.zeros(len(instances), bool)
        m[np.concatenate([np.zeros(0, int), *rows])] = True
        return m

    place(np.concatenate([likely, common]))
    chosen = [r[often[r] > np.where(r < n_clean, times[r], 0)] for r in bag_rows]  # the pieces of each document that count as abusive
    drop = np.zeros(len(instances), bool)
    for turn in range(rounds):
        positive = marked(chosen)
        w = fit(positive, ~drop | positive, w)
        score = x @ w[:-1] + w[-1]
        if turn == rounds - 1:
            break
        fair, apart = score.copy(), [np.zeros(0)] * len(bag_rows)
        for k in range(folds):
            others = marked([chosen[i] for i in np.flatnonzero(fold != k)])
            use = (~drop | others) & ~(positive & ~others)
            use[:n_clean] &= (part != k) | others[:n_clean]
            v = fit(others, use, w)
            s = x @ v[:-1] + v[-1]
            fair[:n_clean][part == k] = s[:n_clean][part == k]
            for i in np.flatnonzero(fold == k):
                apart[i] = s[bag_rows[i]]
        usual = np.maximum.reduceat(fair[np.concatenate(single)], ends) if single else np.array([-1.0])
        least = min(0.2, np.quantile(usual, cut))
        further = min(0.2, np.quantile(usual, cut_further)) if own < 1 else -np.inf
        chosen = []
        for r, s in zip(bag_rows, apart):
            both = own * score[r] + (1 - own) * s
            chosen.append(r[(both == both.max()) | ((both > 0.2) & (s > further))] if s.max() > least else r[:0])
        positive = marked(chosen)
        drop[:] = False
        drop[:n_clean] = once[:n_clean] & (fair[:n_clean] > 0.5)
        for r, s in zip(bag_rows, apart):  # what an abusive document holds besides its worst pieces is not known to be clean
            drop[r[s > -0.8]] = True
        drop &= ~positive
        if turn == 1:
            place_near(score, positive)
            w = None
    weights, bias = table @ (root @ w[:-1] / norm), w[-1]
    for _ in range(machines - 1):
        place_near(score, positive)
        w = fit(positive, ~drop | positive, None)
        weights, bias = weights + table @ (root @ w[:-1] / norm), bias + w[-1]
    return Scorer(kernel, (weights / machines).astype(np.float32), float(bias / machines), 0.0, frozenset(p for p in known if judged[p] > 1))


def _least(ids: DataFrame, most: int, n: int) -> DataFrame:
    """The ``most`` of ``n`` rows with the least hash of doc_id, found among the rows under a bound that lets a few
    more than that through, so no more than these are sorted, however many there are."""
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 40))
    some = most + 6 * most**0.5 + 20
    return (ids if n <= some else ids.where(u < int(some / n * (1 << 40)))).orderBy(u, "doc_id").limit(most)


def training_documents(documents: DataFrame, labels: DataFrame, abusive: int = 2000, clean: int = 4000) -> DataFrame:
    """text, y: at most so many documents of either judgement, those with the least hash of doc_id; where there are
    fewer clean ones than that, documents without a judgement (y = -1) make up the number.

    Judgements of a document are averaged; documents judged both ways alike are left out. Only the numbers of the
    chosen documents, of which there are as many as the parameters say whatever the tables hold, meet the texts.
    """
    votes = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("y")).where("y <> 0.5")
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    judged = votes.select("doc_id", (F.col("y") > 0.5).cast("int").alias("y")).join(texts.select("doc_id"), "doc_id", "left_semi")
    have = {r.y: r.n for r in judged.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = _least(judged.where("y = 1"), abusive, have.get(1, 0)).unionByName(_least(judged.where("y = 0"), clean, have.get(0, 0)))
    short = clean - have.get(0, 0)
    if short > 0:
        # few judgements: documents without one, of which few are abusive, show what is usual
        others = texts.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")
        chosen = chosen.unionByName(_least(others, short, others.count()).select("doc_id", F.lit(-1).alias("y")))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "y")


_MACHINES: dict[str, Scorer] = {}


def _fitted(rows: list[tuple[int, str]], **kw) -> Scorer:
    """The machine of a sample, which this process keeps: judgements that did not change are not learnt again."""
    key = hashlib.sha256(repr((rows, sorted(kw.items()))).encode("utf-8", "replace")).hexdigest()
    if key not in _MACHINES:
        while len(_MACHINES) > 7:
            _MACHINES.pop(next(iter(_MACHINES)))
        _MACHINES[key] = fit_machine([t for _, t in rows], [y for y, _ in rows], **kw)
    return _MACHINES[key]


def scored_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.2, **kw) -> DataFrame:
    """doc_id, source, score, abusive for every document.

    The machine is trained on the driver on a bounded sample of judged documents (``training_documents``) and
    sent to the workers as one weight per hashed feature, a fixed 256 KB, with the pieces that several documents of the
    sample show to be clean. Every document is scored whole by its worst
    statement; null and empty texts, and all texts where nothing could be learnt, score below zero.
    """
    rows = sorted((r.y, r.text) for r in training_documents(documents, labels).collect())
    machine = _fitted(rows, **kw)
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            for i in range(0, len(p), 500):
                s = p.iloc[i : i + 500]
                v = shared.value.documents(s["text"].tolist())
                yield pd.DataFrame({"doc_id": s["doc_id"], "source": s["source"], "score": np.round(v, 4), "abusive": v > threshold})

    src = F.lower(F.btrim(F.coalesce(F.col("source"), F.lit(""))))
    return documents.select("doc_id", src.alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(score, "doc_id long, source string, score double, abusive boolean")


def abuse_rates(scored: DataFrame) -> DataFrame:
    """source, documents, abusive, share."""
    n, a = F.count(F.lit(1)), F.count_if("abusive")
    return scored.groupBy("source").agg(n.alias("documents"), a.alias("abusive"), (a / n).alias("share"))

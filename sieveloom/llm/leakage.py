"""Evaluation passages inside corpus documents, by latent semantic retrieval.

The passages are TF-IDF vectors over their own words, weighted by how many
corpus documents and passages hold a word, and reduced by a randomised
singular value decomposition whose products are summed over the cluster.
Windows of a document's words are folded into the latent space; passages of
sufficient cosine are candidates, and nothing else decides which passages are
looked at.  A candidate is checked by weighted longest common subsequences in
their local form: stretches of the document and of the passage that run in the
same order, words weighted by rarity, foreign and missing words at a price.
The best stretch is taken, then the best in what is left, so that pieces in any
order, other layouts and changed words count, and a shared style doesn't.
What counts is the part of a passage that its stretches span; how much of it
is in common tells a text with changed words from another one, and where that
is little, the answer decides.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, unclash

#: Latent dimensions, those above it in the range finder, power iterations.
RANK, OVERSAMPLE, POWERS = 160, 16, 2
#: Words of a window and its step, least cosine of a candidate, share of the passage that its stretches span, share that is in common word by word, and the one that is enough where the document holds the answer too.
WINDOW, STEP, COSINE, SHARE, COMMON, REWORDED = 60, 20, 0.25, 0.5, 0.4, 0.3
#: Prices in mean values of a passage's words: of a changed, a foreign and a missing word; and what a stretch must be worth to be more than a phrase.
CHANGED, FOREIGN, MISSING, STRETCH = 0.55, 0.3, 0.3, 3.0
#: Words of a document that are looked at together, besides the overlap that no stretch exceeds.
PLACES = 8192
#: Words of a passage in a row that a stretch may leave out or change and still span.
LEFT_OUT = 6
#: Passages of one index at most; a longer evaluation list is searched for in blocks, one pass over the documents each.
BLOCK = 2_000
#: Least weight of a word: words of copies that fill much of the corpus, or of every text, still count.
LEAST_WEIGHT = 0.1

_HYPHEN = re.compile(r"(\w)[-‐­]\s*\n\s*(\w)")
_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿]")
_WORD = re.compile(r"[^\W_]+")
# Fixed value: characters of other scripts that look like Latin letters.
_ALIKE = str.maketrans("аеорсухіјѕԁһӏοαερικνυ", "aeopcyxijsdhloaepiknu")
_MARKS = re.compile("[̀-ͯ]")


def clean(text: str) -> str:
    """Lower case without accents, invisible characters, line-end hyphens and look-alikes."""
    if "-\n" in text or "-\r" in text or "­" in text or "‐" in text:
        text = _HYPHEN.sub(r"\1\2", text)
    if text.isascii():
        return text.lower()
    text = _INVISIBLE.sub("", text).lower()
    text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text if text.isascii() else text.translate(_ALIKE)


def tokens(text: str) -> list[str]:
    """Words, the possessive ending left out; letters set apart one by one are joined."""
    words = _WORD.findall(clean(text))
    return [w for w in words if w != "s"]


def _deletions(w: str) -> set[str]:
    return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}


class Reading(dict):
    """A word as its code: of itself if a passage holds it, else, from five letters on, of the passage word within one letter of it, else -1."""

    def __init__(self, index: Index):
        self.index = index
        self.update(index.code)

    def __missing__(self, w: str) -> int:
        if len(self) > KNOWN + len(self.index.code):
            self.clear()
            self.update(self.index.code)
        near = next((x for d in sorted(_deletions(w)) if (x := self.index.near.get(d))), None) if 4 < len(w) < LONGEST else None
        self[w] = found = self.index.code[near] if near else -1
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


#: Words whose code a worker keeps, and letters from which on a word is no misspelling.
KNOWN, LONGEST = 200_000, 40


class Index:
    """Passages, word weights and the latent vectors; picklable, as large as the evaluation set."""

    def __init__(self, passages: list[list[str]], rarity: dict[str, float]):
        self.passages = passages
        self.rarity = rarity  # of every passage word
        words = sorted(rarity)
        self.code = {w: i for i, w in enumerate(words)}
        self.weight = np.array([rarity[w] for w in words])
        self.near: dict[str, str] = {}
        for w in words:
            if len(w) > 4:
                for d in _deletions(w):
                    self.near.setdefault(d, w)
        self.basis = self.latent = None
        self.value = [np.array([0.3 + rarity[w] for w in p], np.float32) for p in passages]
        self.coded = [np.array([self.code[w] for w in p], np.int32) for p in passages]
        self.unit = min((float(v.mean()) for v in self.value), default=1.0)
        # the most a word can add to a stretch, the last for words of no passage
        self.gain = np.append(0.3 + self.weight, -FOREIGN * self.unit).astype(np.float32)

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Columns and values of a TF-IDF row of length 1."""
        ids, n = np.unique([i for w in words if (i := self.code.get(w)) is not None], return_counts=True)
        ids = ids.astype(np.int64)
        v = (1 + np.log(n)) * self.weight[ids] if len(ids) else np.zeros(0)
        return ids, v / (np.sqrt((v**2).sum()) or 1.0)


def decompose(spark: SparkSession, index: Index, seed: int = 7) -> None:
    """Randomised SVD of the passages' TF-IDF matrix, rows spread over the cluster; leaves the basis (words by dimensions) in the index.

    A step multiplies the transposed matrix with the matrix times a thin block:
    every task returns the sum over its rows, of the size of the words times
    the dimensions.
    """
    n_words, k = len(index.code), min(RANK + OVERSAMPLE, len(index.passages), len(index.code))
    block = np.random.default_rng(seed).standard_normal((n_words, k))
    rows = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(index.passages)], "k int, words string").repartition(min(8, len(index.passages)))

    def times(block: np.ndarray):
        def run(frames):
            total = np.zeros_like(block)
            for f in frames:
                for words in f["words"]:
                    ids, v = index.vector(words.split())
                    total[ids] += v[:, None] * (v @ block[ids])
            yield pd.DataFrame({"part": [total.astype(np.float64).tobytes()]})

        return sum(np.frombuffer(r[0], np.float64).reshape(block.shape) for r in rows.mapInPandas(run, "part binary").collect())

    for _ in range(POWERS):
        block, _ = np.linalg.qr(times(block))
    # in the subspace found: the eigenvectors of the small Gram matrix give the right singular vectors
    values, turn = np.linalg.eigh(block.T @ times(block))
    order = np.argsort(-values)[:RANK]
    index.basis = (block @ turn[:, order]).astype(np.float32)
    latent = np.stack([v @ index.basis[ids] if len(ids) else np.zeros(len(order)) for ids, v in map(index.vector, index.passages)])
    index.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def document_frequencies(documents: DataFrame, words: set[str]) -> tuple[dict[str, int], int]:
    """Documents of the corpus that hold each of the words, and documents with text; counted over all of them."""

    def run(data):
        n: dict[str, int] = {}
        for t in data["text"]:
            if t:
                for w in words.intersection(tokens(t)):
                    n[w] = n.get(w, 0) + 1
                n[""] = n.get("", 0) + 1
        return {"word": list(n), "n": list(n.values())}

    counted = arrow_map(unclash(documents, ["text"]), ["text"], run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in counted}
    return found, found.pop("", 0)


def build(documents: DataFrame, items: DataFrame) -> tuple[Index, dict[int, list[tuple[int, str]]]]:
    """The index of the different passages and, per passage, its items with their gold answers.

    An item without passage is represented by its question; one without either
    has no passage.  The list is read to the driver: ``search`` bounds it by blocks.
    """
    text = F.coalesce(F.col("passage"), F.col("question"))
    gold = F.try_element_at("completions", F.col("gold") + 1)
    by: dict[tuple[str, ...], list[tuple[int, str]]] = {}
    for r in items.select("item_id", text.alias("t"), F.coalesce(gold, F.lit("")).alias("gold")).where("t IS NOT NULL").orderBy("item_id").collect():
        if words := tuple(tokens(r["t"])):
            by.setdefault(words, []).append((r["item_id"], r["gold"]))
    passages = [list(p) for p in by]
    vocabulary = {w for p in passages for w in p}
    df, n = document_frequencies(documents, vocabulary)
    rarity = {w: max(float(np.log((n + 2) / (df.get(w, 0) + 1))), LEAST_WEIGHT) for w in vocabulary}
    index = Index(passages, rarity)
    if passages and index.code:
        decompose(documents.sparkSession, index)
    return index, dict(enumerate(by.values()))


def promising(gain: np.ndarray, least: float) -> np.ndarray:
    """Begins and ends of the places in which a stretch worth ``least`` can lie, rows of two.

    ``gain`` is the most that each word can add.  The worth of a stretch is
    positive all along, so it lies inside one run of positive sums.
    """
    total = np.cumsum(gain)
    above = total - np.minimum(np.minimum.accumulate(total), 0)
    low = np.concatenate([[-1], np.flatnonzero(above <= 0), [len(gain)]])
    wide = np.flatnonzero(np.diff(low) > 1)
    if not len(wide):
        return np.zeros((0, 2), np.int64)
    begin, end = low[wide] + 1, low[wide + 1]
    high = np.maximum.reduceat(above, begin)  # between runs nothing is above
    return np.column_stack([begin, end])[high >= least]


def candidates(index: Index, coded: np.ndarray) -> set[int]:
    """Passages near a window of the words in the latent space; only windows at places that can hold a stretch of some passage."""
    places = promising(index.gain[coded], STRETCH * index.unit)
    if not len(places):
        return set()
    at = np.flatnonzero(coded >= 0)
    n = coded[at]
    first = np.arange(0, max(len(coded) - STEP, 1), STEP)
    lo, hi = np.searchsorted(at, first), np.searchsorted(at, first + WINDOW)
    # places are apart and in order: the first that ends after a window's begin must begin before its end
    next_ = np.searchsorted(places[:, 1], first, "right")
    full = (hi > lo) & (next_ < len(places)) & (places[np.minimum(next_, len(places) - 1), 0] < first + WINDOW)
    if not full.any():
        return set()
    # all windows at once: a row per window and word with its frequency
    lo, size = lo[full], (hi - lo)[full]
    row = np.repeat(np.arange(len(size)), size)
    take = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
    key, count = np.unique(row * len(index.weight) + n[take], return_counts=True)
    row, ids = np.divmod(key, len(index.weight))
    value = ((1 + np.log(count)) * index.weight[ids]).astype(np.float32)
    q = np.add.reduceat(value[:, None] * index.basis[ids], np.searchsorted(row, np.arange(len(size))), axis=0)
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=len(size)))[:, None]
    return set(np.unique(np.nonzero(q @ index.latent.T >= COSINE * np.maximum(norm, 1e-9))[1]).tolist())


def stretch(value: np.ndarray, passage: np.ndarray, y: np.ndarray, unit: float, least: float) -> tuple[float, np.ndarray, int, int]:
    """The best common stretch of a passage and a document's words: its worth, the passage words it has in common, and where it begins and ends in the document.

    A row per passage word, all places of the document at once; a stretch worth
    less than ``least`` isn't followed back.  ``unit`` is the mean value of a
    word of the passage.
    """
    m, n = len(passage), len(y)
    slope = (FOREIGN * unit * np.arange(n + 1)).astype(np.float32)
    step = np.where(passage[:, None] == y, value[:, None], np.float32(-CHANGED * unit)).astype(np.float32)
    met = np.zeros((m + 1, n + 1), np.float32)  # worth where the last word of the passage was met, changed or missing
    worth = np.zeros((m + 1, n + 1), np.float32)  # or foreign words came after it
    missing = np.float32(MISSING * unit)
    for i in range(m):
        new = met[i + 1]
        np.maximum(worth[i] - missing, 0, out=new)
        np.maximum(new[1:], worth[i, :-1] + step[i], out=new[1:])
        # foreign words in between: the best place before, less the price of the way
        np.subtract(np.maximum.accumulate(new + slope), slope, out=worth[i + 1])
    end = int(worth.argmax())
    i, j = divmod(end, n + 1)
    best, last, tiny = float(worth[i, j]), j, 1e-3 * unit
    common: list[int] = []
    while best >= least and i:
        if met[i, j] < worth[i, j] - tiny:
            j -= 1
        elif met[i, j] <= tiny:
            break
        elif j and worth[i - 1, j - 1] + step[i - 1, j - 1] >= met[i, j] - tiny:
            i, j = i - 1, j - 1
            if passage[i] == y[j]:
                common.append(i)
        else:
            i -= 1
    return best, np.array(common[::-1], np.int64), j, last


def reproduced(index: Index, k: int, coded: np.ndarray) -> tuple[float, float]:
    """Shares of passage k: by rarity, of the words in common with the document, and by number, of the words its stretches span.

    ``coded`` are the document's words as codes of passage words, -1 for others.
    Both are 0 where the words in common can't reach REWORDED.
    """
    passage, value = index.coded[k], index.value[k]
    total, unit = float(value.sum()), float(value.mean())
    least = STRETCH * unit
    free, parts, common, span = [(0, len(passage))], [coded], 0.0, 0
    while free:
        # what the words that are left can add, and where; at most those that stand there at all can be common
        left = np.concatenate([np.arange(a, b) for a, b in free])
        gain = np.full(len(index.code) + 1, -FOREIGN * unit, np.float32)  # the last for words of no passage
        gain[passage[left]] = value[left]
        # no stretch has more words than ``over``: its worth would be spent on foreign ones
        over = int(len(passage) * (1 + 1 / FOREIGN)) + 1
        parts = [y[c : min(c + PLACES + over, b)] for y in parts for a, b in promising(gain[y], least) for c in range(a, b, PLACES)]
        there = np.zeros(len(index.code) + 1, bool)
        for y in parts:
            there[y] = True
        there[-1] = False
        if common + value[left][there[passage[left]]].sum() < REWORDED * total:
            return 0.0, 0.0
        if not parts:
            break
        a, b = free.pop()
        if value[a:b].sum() < least:
            continue
        found = [stretch(value[a:b], passage[a:b], y, unit, least) for y in parts]
        at = max(range(len(found)), key=lambda i: found[i][0])
        worth, met, p0, p1 = found[at]
        if worth < least or not len(met):
            continue
        met += a
        common += float(value[met].sum())
        parts[at] = np.where((np.arange(len(parts[at])) < p0) | (np.arange(len(parts[at])) >= p1), parts[at], -1)
        # words left out in a row are not spanned, they may stand elsewhere
        edges = np.concatenate([[a - 1], met, [b]])
        wide = np.diff(edges) > np.array([1, *[LEFT_OUT] * (len(met) - 1), 1])
        free += [(int(edges[e]) + 1, int(edges[e + 1])) for e in np.flatnonzero(wide)]
        span += b - a - sum(int(edges[e + 1] - edges[e]) - 1 for e in np.flatnonzero(wide))
    return common / total, span / len(passage)


def find(documents: DataFrame, index: Index, items: dict[int, list[tuple[int, str]]]) -> DataFrame:
    """``(doc_id, item_id, share, answered)``: documents and the items they reproduce, with the share of the passage and whether the gold answer stands there too.

    An item counts if the stretches span SHARE of its passage or more, and the
    words in common are COMMON of it, or REWORDED and the answer stands in the
    document.  Null and blank texts have no row; repeated documents each have
    theirs; items that share a passage are each reported.  One pass, no shuffle.
    """

    read = Reading(index)

    def run(data):
        out = {"doc_id": [], "item_id": [], "share": [], "answered": []}
        for i, t in zip(data["doc_id"], data["text"]):
            if not t or not (words := tokens(t)):
                continue
            coded = read.of(words)
            joined = None
            for k in sorted(candidates(index, coded)):
                share, span = reproduced(index, k, coded)
                if share < REWORDED or span < SHARE:
                    continue
                joined = joined or f" {' '.join(words)} "
                for item, gold in items[k]:
                    answer = " ".join(tokens(gold))
                    answered = bool(answer) and f" {answer} " in joined
                    if share >= COMMON or answered:
                        for c, v in zip(out.values(), (i, item, span, answered)):
                            c.append(v)
        return out

    if not index.code:
        return documents.sparkSession.createDataFrame([], _SCHEMA)
    return arrow_map(documents, ["doc_id", "text"], run, _SCHEMA)


def search(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """``find`` for every item of a list of any length: items are dealt by their passage into blocks of about ``block``, each with an index of its own."""
    blocks = -(-items.count() // block) or 1
    part = F.pmod(F.xxhash64(F.coalesce("passage", "question")), F.lit(blocks))
    return reduce(DataFrame.unionByName, [find(documents, *build(documents, items.where(part == b) if blocks > 1 else items)) for b in range(blocks)])


_SCHEMA = "doc_id bigint, item_id bigint, share double, answered boolean"

"""Reading level of English prose by a Rasch-style model of word occurrence.

A document has a latent level on a continuous scale, and the sentences of a
document are of levels scattered around it (a rating scale: the log odds of a
level fall with its distance).  A word has a difficulty, the log odds against
meeting it in a sentence, and steps by which it is met more or less readily
from one level to the next, drawn towards none.  Document levels and
difficulties are estimated in turn: given the words every sentence gets level
probabilities and every document its latent level, bound to its judged level
where there is one; given these the occurrences of all words are summed over
the cluster and difficulties and steps follow, until they settle.  Thresholds
on the latent scale, set by the judged documents, give the reading level.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines
from .common import arrow_map, least_hash, shared_dir, unclash

LEVELS = 4
#: Judged rows at most (those of least hash), turns of the alternation at most, and the mean change of the words' log odds, by occurrence, at which it has settled.
LABELLED, TURNS, SETTLED = 10_000, 8, 0.02
#: Fall of the log odds of a sentence's level with its distance from the document's, that of a judged document's level from the judged one, and deviation of a word's steps from none.
SCATTER, BOUND, STEP = 1.0, 1.0, 2.0
#: The latent scale, and rounds between the sentences of a document and its level.
SCALE, ROUNDS = np.linspace(0.5, 4.5, 33), 5
#: Words separated by white space that a text needs for a level.
LEAST_WORDS = 60

_WORD = re.compile(r"[a-zà-ÿ]+")
#: The languages of which a word is a function word.
_LANGUAGES = {w: tuple(lang for lang, ws in lines._LANG.items() if w in ws) for w in lines._WORDS}


def is_english(words: list[str]) -> bool:
    """By function words; a text with hardly any of any language counts if its letters are plain."""
    met = Counter(map(_LANGUAGES.get, words))
    n = {lang: sum(k for own, k in met.items() if own and lang in own) for lang in lines._LANG}
    en, other = n["en"], max(v for k, v in n.items() if k != "en")
    if max(en, other) < 0.04 * len(words):
        words = [w for w in words if w[0].isalpha()] or words
    if max(en, other) < 0.04 * len(words):
        latin = sum(w[0].isascii() and w[0].isalpha() for w in words)
        return latin > 0.7 * len(words) and sum(not w.isascii() for w in words) < 0.03 * len(words)
    return en > other


def _rating() -> np.ndarray:
    """Log probability of a sentence's level (column) in a document of a latent level (row)."""
    x = -SCATTER * np.abs(np.arange(1, LEVELS + 1) - SCALE[:, None])
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Difficulties:
    """Word numbers, log rates of occurrence by level (minus difficulty and steps), and the thresholds of the latent scale."""

    def __init__(self, words: list[str], counts: np.ndarray, sentences: np.ndarray, n_words: float):
        self.number = {w: i for i, w in enumerate(words)}
        self.rate = _rates(counts, sentences)
        self.rest = -np.exp(self.rate).sum(axis=0)  # of a sentence of mean length
        self.length = max(n_words / sentences.sum(), 1.0)
        self.cuts = np.arange(1, LEVELS) + 0.5

    def score(self, numbers: np.ndarray, first: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Log probability of each sentence's words at each level, up to a constant."""
        total = np.concatenate([np.zeros((1, LEVELS)), np.cumsum(self.rate[numbers], axis=0)])
        return total[np.append(first[1:], len(numbers))] - total[first] + self.rest * (n_words / self.length)[:, None]


def _rates(counts: np.ndarray, sentences: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Log rates of words (rows) by level that are likeliest for their occurrences: a difficulty and steps with a normal prior, by Newton's method, all words at once."""
    base = np.log((counts.sum(axis=1, keepdims=True) + 0.5) / sentences.sum())
    steps = np.diff(np.eye(LEVELS), axis=0)
    prior = (steps.T @ steps + 0.05 * np.eye(LEVELS)) / STEP**2
    off = np.zeros_like(counts)
    for _ in range(rounds):
        expected = sentences * np.exp(base + off)
        curve = expected[:, :, None] * np.eye(LEVELS) + prior
        off += np.clip(np.linalg.solve(curve, (counts - expected - off @ prior)[:, :, None])[:, :, 0], -1, 1)
    return base + off


def _tokens(parts: list[str]) -> list[list[str]]:
    return [_WORD.findall(s.lower()) for s in parts]


def _numbered(model: Difficulties, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get, flat, first = model.number.get, [], []
    for ws in sentences:
        first.append(len(flat))
        flat.extend([i for w in ws if (i := get(w)) is not None])
    return np.array(flat, np.int64), np.array(first, np.int64), np.array([len(ws) for ws in sentences], float)


def _probabilities(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def latent(model: Difficulties, sentences: list[list[str]], doc: np.ndarray, n_docs: int, judged: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latent level of each document, the level shares of its words, and the level probabilities of its sentences; ``judged`` levels bind the documents'.

    A document without sentences lies in the middle of the scale.
    """
    numbers, first, n_words = _numbered(model, sentences)
    log = model.score(numbers, first, n_words) if sentences else np.zeros((0, LEVELS))
    rating = _rating()
    prior = -BOUND * np.abs(SCALE - judged[:, None]) if judged is not None else np.zeros((n_docs, len(SCALE)))
    place, p = _probabilities(prior), log
    shares = np.full((n_docs, LEVELS), 1 / LEVELS)
    for _ in range(ROUNDS):
        p = _probabilities(log + (place @ rating)[doc])
        shares = np.stack([np.bincount(doc, weights=p[:, i] * n_words, minlength=n_docs) for i in range(LEVELS)], axis=1)
        place = _probabilities(shares @ rating.T / model.length + prior)
    total = shares.sum(axis=1, keepdims=True)
    return place @ SCALE, np.where(total > 0, shares / np.maximum(total, 1e-9), 1 / LEVELS), p


def thresholds(levels: np.ndarray, judged: np.ndarray) -> np.ndarray:
    """Per level but the last the place of the latent scale above which the fewest judgements are on the wrong side, the middle of equal ones."""
    order = np.argsort(levels, kind="stable")
    x, y = levels[order], judged[order]
    between = np.concatenate([[-np.inf], (x[1:] + x[:-1]) / 2, [np.inf]])
    cuts = []
    for c in range(1, LEVELS):
        wrong = np.concatenate([[0], np.cumsum(y > c)]) + (y <= c).sum() - np.concatenate([[0], np.cumsum(y <= c)])
        best = np.flatnonzero(wrong == wrong.min())
        cuts.append(between[best[len(best) // 2]])
    return np.maximum.accumulate(cuts)


def judged_sentences(documents: DataFrame, labels: DataFrame, sample: int = LABELLED) -> DataFrame:
    """``(level, sentences)`` of documents with a judged level: one per document (the median judgement), ``sample`` at most."""
    judged = labels.where("reading_level BETWEEN 1 AND 4").groupBy("doc_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY reading_level)").cast("int").alias("level"))
    judged = least_hash(judged, "doc_id", sample)
    texts = unclash(documents, ["doc_id", "text"]).where("text IS NOT NULL").join(F.broadcast(judged), "doc_id")

    def run(data):
        return {"level": data["level"], "sentences": [_tokens(lines.segments(t)) for t in data["text"]]}

    return arrow_map(texts, ["level", "text"], run, "level int, sentences array<array<string>>")


def fit(documents: DataFrame, labels: DataFrame, sample: int = LABELLED) -> Difficulties | None:
    """Difficulties from judged documents; None without any.

    A turn sums the expected occurrences of all words of the judged documents
    over the cluster; the words are as many as these bounded texts hold.
    """
    shared_dir(documents.sparkSession)
    data = judged_sentences(documents, labels, sample).checkpoint()
    columns = [f"c{i}" for i in range(LEVELS)]
    model = None
    for _ in range(TURNS):
        counts = data.mapInPandas(_turn(model), "word string, " + ", ".join(f"{c} double" for c in columns))
        rows = counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().sort_values("word")
        # "" counts sentences and " " words
        special, rows = rows[rows.word.str.strip() == ""].set_index("word"), rows[rows.word.str.strip() != ""]
        if not special.loc[""].sum() if "" in special.index else True:
            return None
        before = model
        model = Difficulties(rows.word.tolist(), rows[columns].to_numpy(float), special.loc[""][columns].to_numpy(float) + 1e-3, special.loc[" "].sum())
        if before is not None:
            weight = rows[columns].to_numpy(float)
            if (np.abs(model.rate - before.rate) * weight).sum() < SETTLED * weight.sum():
                break

    def place(frames):
        for f in frames:
            yield pd.DataFrame({"level": f["level"], "latent": latent(model, *_flat(f["sentences"]), len(f))[0]})

    rows = data.mapInPandas(place, "level int, latent double").toPandas()  # two numbers for each judged document
    model.cuts = thresholds(rows.latent.to_numpy(), rows.level.to_numpy())
    return model


def _flat(documents) -> tuple[list[list[str]], np.ndarray]:
    """Sentences of documents in a row, and the document of each."""
    parts = [[list(s) for s in own] for own in documents]
    return [s for p in parts for s in p], np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _turn(model: Difficulties | None):
    """Expected occurrences by level of every word in a partition, given the difficulties (at first the judged levels alone)."""

    def run(frames):
        number: dict[str, int] = {"": 0, " ": 1}
        sums = np.zeros((2, LEVELS))
        for f in frames:
            sentences, doc = _flat(f["sentences"])
            judged = f["level"].to_numpy()
            p = np.exp(-BOUND * np.abs(np.arange(1, LEVELS + 1) - judged[doc][:, None])) if model is None else latent(model, sentences, doc, len(f), judged)[2]
            p = p / p.sum(axis=1, keepdims=True)
            n_words = np.array([len(ws) for ws in sentences], np.int64)
            ids = np.fromiter((number.setdefault(w, len(number)) for ws in sentences for w in ws), np.int64, n_words.sum())
            # a word counts once in a sentence
            at, word = np.divmod(np.unique(np.repeat(np.arange(len(sentences)), n_words) * len(number) + ids), len(number))
            new = np.stack([np.bincount(word, weights=p[at, i], minlength=len(number)) for i in range(LEVELS)], axis=1)
            new[0], new[1] = p.sum(axis=0), (p * n_words[:, None]).sum(axis=0)
            new[: len(sums)] += sums
            sums = new
        yield pd.DataFrame([(w, *v) for w, v in zip(number, sums)], columns=["word", *(f"c{i}" for i in range(LEVELS))])

    return run


def levels(documents: DataFrame, model: Difficulties | None, kinds: lines.Model | None = None) -> DataFrame:
    """``(doc_id, reading_level, latent, level_1 .. level_4)`` of English prose of LEAST_WORDS words or more: the level, its place on the latent scale, and the level shares of the text's words.

    Others, among them null and blank texts, lists, tables and junk, have no
    row; without a model there are no rows at all.  Texts are read once: the
    levels are found in the pass that describes their lines, and those of other
    kinds than prose are dropped after.
    """
    if model is None:
        return documents.sparkSession.createDataFrame([], _SCHEMA)

    def read(data, parts):
        chosen = [i for i, t in enumerate(data["text"]) if t and len(words := t.lower().split()) >= LEAST_WORDS and is_english(words)]
        sentences = [ws for i in chosen for ws in _tokens(parts[i])]
        doc = np.repeat(np.arange(len(chosen)), [len(parts[i]) for i in chosen])
        place, share, _ = latent(model, sentences, doc, len(chosen))
        out: dict = {"reading_level": [None] * len(parts), "latent": [None] * len(parts), "shares": [None] * len(parts)}
        for i, level, x, own in zip(chosen, np.searchsorted(model.cuts, place).tolist(), place.tolist(), share.tolist()):
            out["reading_level"][i], out["latent"][i], out["shares"][i] = level + 1, x, own
        return out

    seen = lines.observed(unclash(documents, ["doc_id", "text"]), ["doc_id"], read, "reading_level int, latent double, shares array<double>")
    told = lines.judged(seen, kinds or lines.estimate(seen)).where("kind = 'prose' AND reading_level IS NOT NULL")
    return told.select("doc_id", "reading_level", "latent", *[F.get("shares", F.lit(i)).alias(f"level_{i + 1}") for i in range(LEVELS)])


_SCHEMA = "doc_id bigint, reading_level int, latent double, " + ", ".join(f"level_{i + 1} double" for i in range(LEVELS))

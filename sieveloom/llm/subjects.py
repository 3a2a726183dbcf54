"""Subjects of documents by class-association rules.

Sentences of a bounded sample of labelled documents become transactions of
their telling words, in the order of the text, and the document's topic; long
ones become overlapping windows.  Frequent itemsets are mined by parallel
FP-growth; those with one topic give rules ``words -> topic`` with a confidence.  A rule is redundant if a shorter one is about as sure.  A
document's sentences, entries and rows are each matched against the rules; the
summed log odds, calibrated on the sample, give topic probabilities, and these
weighted by length the shares of the subjects in the text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines
from .common import arrow_map, latest, least_hash, shared_dir, unclash

TOPICS = 24
#: Labelled documents at most: hand labels first, then recorded ones, of each those of least hash.
SAMPLE = 8_000
#: A telling word occurs in LEAST documents or more, CONCENTRATION of them of one topic, and LIFT times as often there as that topic is.
LEAST, CONCENTRATION, LIFT = 3, 0.25, 2.0
#: Telling words that lie so near each other that they can make a rule: a window's, and its step.
WIDTH, STEP = 8, 4
#: Occurrences a rule needs, its least confidence, its words, and how much surer than a shorter rule it must be.
SUPPORT, CONFIDENCE, ANTECEDENT, GAIN = 4, 0.35, 2, 0.05
#: Log odds of a topic's name before it is met, and the occurrences that this belief counts for.
NAMED, BELIEF = 4.0, 5.0
#: Share of the text that makes a further subject ("about a third or more").
SECOND = 0.28

_WORD = re.compile(r"[^\W\d_]{2,}")
_PATH = re.compile(r"^[a-z][a-z0-9+.-]*://[^/?#]*/?([^?#]*)", re.I)


def words_of(s: str) -> list[str]:
    return _WORD.findall(s.lower())


def labelled(documents: DataFrame, labels: DataFrame, topics: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, topic, text)`` of ``sample`` documents: those judged by hand come first, then those with a recorded topic."""
    shared_dir(documents.sparkSession)
    docs = unclash(documents, ["doc_id", "shard_idx", "doc_idx"])
    hand = labels.where(f"topic BETWEEN 0 AND {TOPICS - 1}").groupBy("doc_id").agg(F.max_by("topic", F.coalesce("labelled_at", F.timestamp_micros(F.lit(-(2**60))))).alias("hand"))
    recorded = latest(topics, ["shard_idx", "doc_idx"], "annotated_at", ["topic"]).where(f"topic BETWEEN 0 AND {TOPICS - 1}")
    known = (
        docs.join(recorded, ["shard_idx", "doc_idx"], "left").join(hand, "doc_id", "left")
        .select("doc_id", F.coalesce("hand", "topic").cast("int").alias("topic"), F.col("hand").isNotNull().alias("judged")).where("topic IS NOT NULL").checkpoint()
    )
    judged = least_hash(known.where("judged"), "doc_id", sample).checkpoint()
    chosen = judged.unionByName(least_hash(known.where("NOT judged"), "doc_id", max(sample - judged.count(), 0)))
    return unclash(documents, ["doc_id", "text"]).where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "topic")), "doc_id")


class Rules:
    """Evidence of words and word pairs for topics, and the scale that makes it a probability."""

    def __init__(self, single: dict[str, list[tuple[int, float]]], pairs: dict[tuple[str, str], list[tuple[int, float]]]):
        self.single, self.pairs, self.scale = single, pairs, 1.0
        self.paired = {w for p in pairs for w in p}
        self.telling = set(single) | self.paired

    def evidence(self, words: list[str]) -> dict[int, float]:
        """Summed log odds by topic; a pair's rule adds to those of its words."""
        own = self.telling.intersection(words)
        out: dict[int, float] = {}
        for w in sorted(own) if len(own) > 1 else own:
            for topic, odds in self.single.get(w, ()):
                out[topic] = out.get(topic, 0.0) + odds
        if len(own) > 1 and self.pairs:
            found = sorted(self.paired.intersection(own))
            for i, a in enumerate(found):
                for b in found[i + 1 :]:
                    for topic, odds in self.pairs.get((a, b), ()):
                        out[topic] = out.get(topic, 0.0) + odds
        return out

    def shares(self, parts: list[str]) -> dict[int, float]:
        """Words of the parts by topic; parts without evidence count for none."""
        out: dict[int, float] = defaultdict(float)
        for s in parts:
            words = words_of(s)
            e = self.evidence(words)
            if len(e) == 1:
                out[next(iter(e))] += len(words)
            elif e:
                top = max(e.values())
                p = {t: math.exp(self.scale * (v - top)) for t, v in e.items()}
                total = sum(p.values())
                for t, v in p.items():
                    if v > 0.05 * total:
                        out[t] += len(words) * v / total
        return out


def mine(sample: DataFrame, names: dict[str, int]) -> Rules:
    """Rules from ``(topic, text)`` rows; without rows only the topics' names in ``names`` are rules."""
    shared_dir(sample.sparkSession)

    def cut(data):
        topic, parts = [], []
        for t, text in zip(data["topic"], data["text"]):
            own = [list(dict.fromkeys(words_of(s))) for s in lines.segments(text)]
            topic.append(t)
            parts.append([p for p in own if p])
        return {"topic": topic, "parts": parts}

    parts = arrow_map(sample, ["topic", "text"], cut, "topic int, parts array<array<string>>").checkpoint()
    n_topic = {r[0]: r[1] for r in parts.groupBy("topic").count().collect()}
    n_all = sum(n_topic.values())
    single: dict[str, list] = {n: [(c, NAMED)] for n, c in names.items()}
    if not n_all:
        return Rules(single, {})
    prior = {t: n / n_all for t, n in n_topic.items()}
    by_word = parts.select("topic", F.explode(F.array_distinct(F.flatten("parts"))).alias("word")).groupBy("word", "topic").count()
    told = by_word.groupBy("word").agg(F.sum("count").alias("n"), F.max(F.struct("count", "topic")).alias("top")).where(f"n >= {LEAST} AND top.count >= {CONCENTRATION} * n")
    # at most the different words of the bounded sample
    items = {r["word"] for r in told.collect() if r["top"]["count"] / r["n"] >= LIFT * prior[r["top"]["topic"]] or r["top"]["count"] == r["n"]} | set(names)

    def transact(frames):
        for f in frames:
            out = []
            for topic, own in zip(f["topic"], f["parts"]):
                for p in own:
                    kept = [w for w in p if w in items]
                    out.extend([*kept[i : i + WIDTH], f"#{topic}"] for i in range(0, max(len(kept) - WIDTH + STEP, min(len(kept), 1)), STEP))
            yield pd.DataFrame({"items": out})

    baskets = parts.mapInPandas(transact, "items array<string>").checkpoint()
    n = baskets.count()
    if not n:
        return Rules(single, {})
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, SUPPORT / n), numPartitions=max(8, sample.sparkSession.sparkContext.defaultParallelism)).fit(baskets).freqItemsets
    label = F.try_element_at(F.filter("items", lambda x: x.startswith("#")), F.lit(1))
    split = sets.withColumn("label", label).withColumn("words", F.array_sort(F.filter("items", lambda x: ~x.startswith("#")))).where(f"size(words) BETWEEN 1 AND {ANTECEDENT}").checkpoint()
    whole = split.where("label IS NULL").select("words", F.col("freq").alias("all"))
    rules = split.where("label IS NOT NULL").join(whole, "words").select("words", F.substring("label", 2, 9).cast("int").alias("topic"), "freq", "all")
    named = F.when(F.size("words") == 1, F.col("words")[0].isin(list(names))).otherwise(F.lit(False))
    rules = rules.where((F.col("freq") >= CONFIDENCE * F.col("all")) | named).collect()
    sure = {(tuple(r["words"]), r["topic"]): (r["freq"] + 1.0) / (r["all"] + 2.0) for r in rules if r["words"][0] not in names or len(r["words"]) > 1}
    pairs: dict[tuple[str, str], list] = {}

    def odds(conf: float, topic: int) -> float:
        conf, p = min(conf, 0.995), min(max(prior.get(topic, 0.01), 0.002), 0.9)
        return math.log(conf / (1 - conf) * (1 - p) / p)

    # a topic's name: what is met of it against the belief; of other topics as any word
    met: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rules:
        if len(r["words"]) == 1 and r["words"][0] in names:
            met.setdefault(r["words"][0], {})[r["topic"]] = r["freq"], r["all"]
    belief = 1 / (1 + math.exp(-NAMED))
    for name, by in met.items():
        n = max(a for _, a in by.values())
        confs = {t: (f + 1.0) / (a + 2.0) for t, (f, a) in by.items() if t != names[name] and f >= CONFIDENCE * a}
        own = (by.get(names[name], (0, n))[0] + BELIEF * belief) / (n + BELIEF)
        single[name] = [(t, odds(c, t)) for t, c in confs.items()] + ([(names[name], odds(own, names[name]))] if own >= CONFIDENCE else [])
        sure |= {((name,), t): c for t, c in confs.items()}
    for (ws, topic), conf in sorted(sure.items(), key=lambda x: len(x[0][0])):
        if len(ws) == 1:
            if ws[0] not in names:
                single.setdefault(ws[0], []).append((topic, odds(conf, topic)))
        else:
            # redundant unless surer than its words' own rules by GAIN; then what it adds to them
            shorter = max(sure.get(((w,), topic), 0.0) for w in ws)
            if conf > shorter + GAIN:
                own = sum(o for w in ws for t, o in single.get(w, ()) if t == topic)
                if (more := odds(conf, topic) - own) > 0:
                    pairs.setdefault(ws, []).append((topic, more))
    found = Rules(single, pairs)
    found.scale = _calibrate(found, parts)
    return found


#: Scales of the evidence that are tried.
SCALES = (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5)


def _calibrate(rules: Rules, parts: DataFrame) -> float:
    """The scale of the evidence under which the sample's labels are likeliest; a task returns a sum for each scale."""

    def weigh(frames):
        total = np.zeros(len(SCALES))
        for f in frames:
            for topic, own in zip(f["topic"], f["parts"]):
                for p in own:
                    e = rules.evidence(list(p))
                    if len(e) > 1:
                        v = np.outer(SCALES, list(e.values()))
                        q = np.exp(v - v.max(axis=1, keepdims=True))
                        hit = np.array([t == topic for t in e])
                        total += np.log(0.9 * q[:, hit].sum(axis=1) / q.sum(axis=1) + 0.1 / TOPICS)
        yield pd.DataFrame({"scale": SCALES, "total": total})

    rows = parts.mapInPandas(weigh, "scale double, total double").groupBy("scale").agg(F.sum("total").alias("total")).collect()
    return max(rows, key=lambda r: (round(r["total"], 6), -abs(r["scale"] - 1)))["scale"] if rows else 1.0


def subjects_of(rules: Rules, parts: list[str], url: str | None) -> list[tuple[int, float]]:
    """(topic, share of the telling text), main subject first; of the url, with share 0, where the text says nothing."""
    share = rules.shares(parts)
    total = sum(share.values())
    if total > 0:
        ranked = sorted(((t, v / total) for t, v in share.items()), key=lambda x: (-x[1], x[0]))
        return ranked[:1] + [x for x in ranked[1:] if x[1] >= SECOND]
    path = _PATH.match(url or "")
    e = rules.evidence(words_of(path[1].replace("_", " "))) if path else {}
    return [(max(e, key=lambda t: (e[t], -t)), 0.0)] if e else []


def assign(documents: DataFrame, rules: Rules, kinds: lines.Model | None = None) -> DataFrame:
    """``(doc_id, topic, share, rank)``: one row per document and subject.

    Null and blank texts, junk, and texts without a subject whose url names
    none have no row.  Texts are read once: their subjects are found in the
    pass that describes their lines, and those of junk are dropped after.
    """

    def subjects(data, parts):
        return {"subjects": [[{"topic": t, "share": s} for t, s in subjects_of(rules, own, url)] if own else [] for own, url in zip(parts, data["url"])]}

    seen = lines.observed(unclash(documents, ["doc_id", "url", "text"]), ["doc_id"], subjects, "subjects array<struct<topic: int, share: double>>")
    told = lines.judged(seen, kinds or lines.estimate(seen)).where("kind <> 'junk'")
    return told.select("doc_id", F.posexplode("subjects").alias("rank", "s")).select("doc_id", "s.topic", "s.share", (F.col("rank") + 1).alias("rank"))

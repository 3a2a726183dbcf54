"""Annotators: one value or vector per document by a scorer that is loaded once per task.

A scorer is ``make() -> predict``, and ``predict(list of texts)`` gives one
dict per text; its keys become suffixes of the output columns.  Built-in
scorers are deterministic and need no model files; others plug in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

Scorer = Callable[[], Callable[[list[str]], list[dict]]]


def annotate(docs: DataFrame, key: str, make: Scorer, name: str, columns: dict[str, str], by_length: bool = False) -> DataFrame:
    """``key`` and ``name<suffix>`` columns; ``columns`` maps suffix to type. Null texts are scored as empty ones; with ``by_length`` batches hold texts of like size."""
    names = [name + s for s in columns]
    schema = ", ".join([f"{key} {dict(docs.dtypes)[key]}", *(f"`{name}{s}` {t}" for s, t in columns.items())])

    def run(frames):
        predict = make()
        for f in frames:
            rows = predict([t or "" for t in f["text"]])
            out = pd.DataFrame([[r.get(s) for s in columns] for r in rows], columns=names)
            out.insert(0, key, f[key].to_numpy())
            yield out

    rows = docs.select(key, "text")
    return (length_sorted(rows) if by_length else rows).mapInPandas(run, schema)


def length_sorted(docs: DataFrame) -> DataFrame:
    """Rows of a task by length, so that batches of a padded model hold texts of like size."""
    return docs.sortWithinPartitions(F.length("text"))


def keyword_chooser(choices: dict[str, list[str]]) -> Scorer:
    """A chooser that counts keywords of each choice; shares of the hits as probabilities, the first of equal ones chosen."""

    def make():
        tests = {c: re.compile(r"\b(?:" + "|".join(map(re.escape, ws)) + r")\b", re.I) for c, ws in choices.items()}

        def predict(texts):
            out = []
            for t in texts:
                n = [len(p.findall(t)) for p in tests.values()]
                total = sum(n)
                probs = [(x + 1) / (total + len(n)) for x in n]
                out.append({"": list(tests)[max(range(len(n)), key=lambda i: (probs[i], -i))], "_probs": probs})
            return out

        return predict

    return make


def entity_features(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities by patterns, in the first ``limit`` characters where given (10,000 in the reference): capitalised spans, dates, quantities.

    ``entity_density`` are different entities per 1000 words of the whole text,
    ``entity_unique_ratio`` different ones of all mentions (0 without any),
    ``entity_per_sentence`` mentions per sentence.
    """
    t = F.coalesce("text", F.lit(""))
    t = t if limit is None else F.substring(t, 1, limit)
    span = r"(?<![.!?]\s)(?<!^)\b[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+)*|\b(?:1[0-9]|20)\d\d\b|\b\d+(?:[.,]\d+)?\s?(?:%|percent|km|kg|dollars|euros|days|years)(?![A-Za-z])"
    x = docs.select("doc_id", "text", F.regexp_extract_all(t, F.lit(span), F.lit(0)).alias("e"))
    n, unique = F.size("e"), F.size(F.array_distinct("e"))
    words, sentences = F.size(tx.words(F.col("text"))), F.greatest(F.size(tx.sentences(F.col("text"))), F.lit(1))
    r = lambda c, name: F.round(c, 6).alias(name)
    return x.select("doc_id", r(unique * 1000.0 / F.greatest(words, F.lit(1)), "entity_density"), r(F.when(n > 0, unique / n).otherwise(0.0), "entity_unique_ratio"), r(n / sentences, "entity_per_sentence"))

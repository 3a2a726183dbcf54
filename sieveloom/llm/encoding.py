"""Encoding of whole texts and token counts."""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, latest, shared_dir, unclash
from .tokenizer import TOKENIZER_DIR, VOCABULARY, encoder, split

#: Greatest recorded count that is taken for a key without a text to compare it with.
MOST = 1_000_000
#: Pieces at most whose lengths go to every task (a few tens of MB), and pieces that a task counts before it passes them on.
HOT, HELD = 300_000, 300_000
#: Unicode white space, for the test of blank texts on the JVM side.
BLANK = r"^[\s\u0085   -     　\u001C-\u001F]*$"


def encode(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)``: the token ids of every document's text, unchanged and without special tokens.

    Null and empty texts give an empty list; white space is encoded as it
    stands; repeated rows give repeated rows.  One pass, no shuffle.
    """

    def run(data):
        enc = encoder(folder, name)
        ids = [list(chain.from_iterable(map(enc.__getitem__, split(t)))) if t else [] for t in data["text"]]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
        return {"doc_id": pa.array(data["doc_id"], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}

    return arrow_map(documents, ["doc_id", "text"], run, "doc_id bigint, ids array<int>")


def piece_lengths(documents: DataFrame, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """``(piece, n, length)``: every distinct piece of all texts, its occurrences, and its tokens, each piece tokenised once in the cluster.

    Tasks combine their occurrences before the shuffle, so a frequent piece
    costs a row per task; the table is written to the shared folder.
    """
    shared_dir(documents.sparkSession)

    def occur(batches):
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
        for batch in batches:
            for t in batch.column(0):
                if t := t.as_py():
                    seen.update(split(t))
                    if len(seen) > HELD:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    def tokenise(data):
        enc = encoder(folder, name)
        return {**data, "length": [len(enc[p]) for p in data["piece"]]}

    occurring = unclash(documents, ["text"]).mapInArrow(occur, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return arrow_map(occurring, ["piece", "n"], tokenise, "piece string, n bigint, length int").checkpoint()


def _frequent(lengths: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pieces occur so often."""
    rows = lengths.groupBy((F.length(F.bin("n")) - 1).alias("p")).count().orderBy(F.desc("p")).collect()  # a row per power
    total, least = 0, 0
    for r in rows:
        total += r["count"]
        if total > most:
            least = r["p"] + 1
            break
    return 2**least


def count_tokens(documents: DataFrame, columns: list[str], folder: str = TOKENIZER_DIR, name: str = VOCABULARY, hot: int = HOT) -> DataFrame:
    """``columns`` plus ``n_tokens``, exact: the piece frequencies of each text joined with the lengths of ``piece_lengths``.

    The lengths of the ``hot`` most frequent pieces at most go to every task, so
    a frequent piece is never a key of the join; the frequencies of all other
    pieces are shuffled and joined, those of equal texts once.  A blank or null
    text has 0 tokens.
    """
    lengths = piece_lengths(documents, folder, name)
    least = _frequent(lengths, hot)
    known = {r["piece"]: r["length"] for r in lengths.where(F.col("n") >= least).collect()}  # ``hot`` rows at most
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)

    def run(data):
        out = {c: data[c] for c in columns}
        sums, keys, rest = [], [], []
        for t in data["text"]:
            total, rare = 0, []
            if t and not t.isspace():
                for p, k in Counter(split(t)).items():
                    if (n := known.get(p)) is None:
                        rare.append({"piece": p, "k": k})
                    else:
                        total += n * k
            sums.append(total)
            keys.append(blake2b(t.encode(), digest_size=16).digest() if rare else None)
            rest.append(rare)
        return {**out, "__sum": sums, "__text": keys, "__rare": rest} if least > 1 else {**out, "n_tokens": sums}

    if least == 1:  # no piece is left
        return arrow_map(documents, [*columns, "text"], run, schema + ", n_tokens bigint")
    counted = arrow_map(documents, [*columns, "text"], run, schema + ", __sum bigint, __text binary, __rare array<struct<piece: string, k: int>>").checkpoint()
    rare = counted.where("__text IS NOT NULL").select("__text", F.inline("__rare")).groupBy("__text", "piece").agg(F.first("k").alias("k"))
    more = rare.join(lengths.where(F.col("n") < least).select("piece", "length"), "piece").groupBy("__text").agg(F.sum(F.col("k") * F.col("length")).alias("__more"))
    return counted.drop("__rare").join(more, "__text", "left").select(*columns, (F.col("__sum") + F.coalesce("__more", F.lit(0))).alias("n_tokens"))


def usable_counts(documents: DataFrame, tokens: DataFrame, factor: float = 3.0, every_key: bool = False, **tokenizer) -> DataFrame:
    """Per document, with ``every_key`` also per key of ``tokens`` without one: the recorded count of its key, the count of its text, and whether the recorded one is usable.

    ``n_recorded`` is the ``token_count`` of the latest row of the key (null
    without a row); ``n_estimated`` the tokens of the text plus one for its
    start; ``usable`` holds if the recorded count is 1 or more and within
    ``factor`` of the estimate; ``n_used`` is the recorded count where usable,
    else the estimate; ``blank`` texts have an estimate of 0 and keep any
    positive recorded count.  Documents with a null key have no recorded count.
    A key without a document has a null ``doc_id`` and estimate; its recorded
    count is usable from 1 to ``MOST``, else ``n_used`` is null.
    """
    counted = count_tokens(unclash(documents, ["doc_id", "shard_idx", "doc_idx", "source", "lang", "text"]), ["doc_id", "shard_idx", "doc_idx", "source", "lang"], **tokenizer)
    newest = latest(tokens, ["shard_idx", "doc_idx"], "annotated_at", ["token_count"])
    joined = counted.join(newest, ["shard_idx", "doc_idx"], "full" if every_key else "left")
    recorded, estimate = F.col("token_count").cast("bigint"), F.col("n_tokens") + F.when(F.col("n_tokens") > 0, 1).otherwise(0)
    textless = F.col("n_tokens").isNull() & (recorded <= MOST)
    usable = F.coalesce((recorded >= 1) & (textless | (estimate == 0) | ((recorded <= factor * estimate) & (recorded * factor >= estimate))), F.lit(False))
    return joined.select("doc_id", "shard_idx", "doc_idx", "source", "lang", recorded.alias("n_recorded"), estimate.alias("n_estimated"), usable.alias("usable"), F.coalesce(F.col("n_tokens") == 0, F.lit(True)).alias("blank"), F.when(usable, recorded).otherwise(estimate).alias("n_used"))


def recorded_counts(tokens: DataFrame) -> DataFrame:
    """The counts of every key of ``tokens`` as recorded, in the columns of ``usable_counts``: usable from 1 to ``MOST``, without text, source and language."""
    recorded = F.col("token_count").cast("bigint")
    usable = F.coalesce(recorded.between(1, MOST), F.lit(False))
    return latest(tokens, ["shard_idx", "doc_idx"], "annotated_at", ["token_count"]).select(
        F.lit(None).cast("bigint").alias("doc_id"), "shard_idx", "doc_idx", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        recorded.alias("n_recorded"), F.lit(None).cast("bigint").alias("n_estimated"), usable.alias("usable"), F.lit(True).alias("blank"), F.when(usable, recorded).alias("n_used"),
    )


def token_budget(counts: DataFrame, topics: DataFrame, formats: DataFrame) -> DataFrame:
    """Tokens and documents by source, language, topic and format, of those together and of each alone.

    ``dimension`` is source, lang, topic or format, and ``slice`` its value,
    ``(unknown)`` for null or out-of-range ones; for the four together
    ``dimension`` is ``source, lang, topic, format`` and ``slice`` the JSON array
    of their values.  Sources and languages are compared without case, outer
    blanks and regional suffix.  ``uncounted_documents`` have neither a usable
    count nor a text to estimate it from and add no tokens.  The four together
    are summed first, a hot slice pre-aggregated in each task before the
    shuffle; each alone is summed from those.
    """
    keys = ["shard_idx", "doc_idx"]
    wide = counts.join(latest(topics, keys, "annotated_at", ["topic"]), keys, "left").join(latest(formats, keys, "annotated_at", ["format"]), keys, "left")
    known = lambda c: F.coalesce(c, F.lit("(unknown)"))
    label = lambda c: F.when(F.col(c).between(0, 23), F.col(c).cast("string"))
    by = {
        "source": F.nullif(F.lower(F.trim("source")), F.lit("")),
        "lang": F.nullif(F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]+)", 1), F.lit("")),
        "topic": label("topic"),
        "format": label("format"),
    }
    estimated, uncounted = ~F.col("usable") & F.col("n_used").isNotNull(), F.col("n_used").isNull()
    sums = {"documents": F.lit(1), "tokens": F.coalesce("n_used", F.lit(0)), "estimated_documents": estimated.cast("bigint"), "uncounted_documents": uncounted.cast("bigint")}
    together = wide.select(*[known(c).alias(n) for n, c in by.items()], *[c.alias(n) for n, c in sums.items()]).groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])
    slices = F.array(
        *[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("slice")) for n in by],
        F.struct(F.lit(", ".join(by)).alias("dimension"), F.to_json(F.array(*by)).alias("slice")),
    )
    return together.select(*sums, F.inline(slices)).groupBy("dimension", "slice").agg(*[F.sum(n).alias(n) for n in sums])

"""Token ids of texts by a pluggable tokenizer, and the flat store they are kept in.

A tokenizer is ``make() -> encode``, and ``encode(list of texts)`` gives a list
of ids per text; it is made once in each Python worker.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_sum

Tokenizer = Callable[[], Callable[[list[str]], list[list[int]]]]
#: Vocabulary of byte pairs, a parameter: a line of base64 piece and rank each.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once.
AT_ONCE = 4_000_000


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def byte_pairs(path: str = VOCABULARY, pattern: str = SPLIT) -> Tokenizer:
    """Byte-pair encoding by a vocabulary file that every worker can read."""

    def make():
        enc = _encoding(path, pattern)
        return lambda texts: enc.encode_ordinary_batch(texts, num_threads=1)

    return make


def encoded(docs: DataFrame, key: str, make: Tokenizer, text: str = "text") -> DataFrame:
    """``key`` and ``ids`` of each document; null and empty texts have an empty list. One pass, no shuffle."""

    def run(batches):
        encode = make()
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= AT_ONCE):
                    size += len(texts[stop] or "")
                    stop += 1
                ids = encode([t or "" for t in texts[start:stop]])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])
                start = stop

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, ids array<int>")


def offsets(ids: DataFrame, order: list[str]) -> DataFrame:
    """``(order..., start, n)``: where each document's ids begin in the flat store of all, in total order; only lengths move."""
    sized = ids.select(*order, F.size("ids").cast("bigint").alias("n"))
    return running_sum(sized, "n", [], [F.col(c).asc() for c in order], "stop").select(*order, (F.col("stop") - F.col("n")).alias("start"), "n")


def write_store(ids: DataFrame, order: list[str], path: str) -> DataFrame:
    """The store as Parquet in total order, each row with its ids, start and length; read back, the ids laid end to end are the flat array."""
    placed = ids.join(offsets(ids, order), order)
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    return ids.sparkSession.read.parquet(path)
